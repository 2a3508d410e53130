"""Repeatable randomness: every draw is a hash of the row's own identity.

The same row gets the same draw on any cluster, in any partitioning and after
any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash32(*parts) -> Column:
    """Uniform integer in [0, 2**32) from the parts."""
    return F.conv(F.substring(F.md5(_text(*parts)), 1, 8), 16, 10).cast("bigint")


def shuffle_key(*parts) -> Column:
    """Hex key whose order is a random order of the rows."""
    return F.md5(_text(*parts))
