from .arrays import clean_numbers, median_memory, median_of, zip_shortest
from .numbers import (ceil_div, convert_units, optimised_footprint, round_java,
                      round_py)
from .seeded import hash32, shuffle_key

__all__ = ["ceil_div", "clean_numbers", "convert_units", "hash32",
           "median_memory", "median_of", "optimised_footprint", "round_java",
           "round_py", "shuffle_key", "zip_shortest"]
