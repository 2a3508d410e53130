"""Where the rows of a long history go: to the tasks of its chunks, however large Spark takes the tables to be."""

from collections import Counter

import pytest
from helpers import make_trace
from pyspark.sql import functions as F
from warmtrace.operators import gauges as ga
from warmtrace.operators import starts as st


@pytest.fixture
def large_tables(spark):
    """Plans as for tables too large to be broadcast by their size."""
    of_large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in of_large}
    for k, v in of_large.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def one_function(spark):
    return make_trace(spark, [("o", "f", 128, 5, 10 * i) for i in range(400)])


SPREAD = {
    "active_segments": lambda tr: st.active_segments(tr, 20, chunk_rows=10),
    "hot_cold_starts": lambda tr: st.hot_cold_starts(tr, 2, 30, chunk_rows=10),
    "level_steps": lambda tr: ga.level_steps(ga._vm_moves(tr, ["function"]), ["function"], ["vms"], ga.is_active, 10),
}


@pytest.mark.parametrize("name", SPREAD)
def test_a_history_is_in_many_tasks(large_tables, name):
    out = SPREAD[name](one_function(large_tables))
    # All columns, so that no step is left out of the plan.
    per_task = Counter(r.task for r in out.select("*", F.spark_partition_id().alias("task")).collect())
    assert len(per_task) > 4 and max(per_task.values()) < per_task.total() / 2
