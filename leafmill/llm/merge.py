"""Adding up fixed-size sums of many tasks in two levels."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks whose sums one task adds up directly.
DIRECT = 64


def add_up(parts: DataFrame, run, keys: list[str], slots: int) -> DataFrame:
    """The sums ``parts`` of all tasks added up by ``keys`` with ``run``, which adds up those of a task.

    Beyond ``DIRECT`` tasks about the square root of their number is added up first, so that no task of the second level
    reads more than that many sums of a key.
    """
    n = parts.rdd.getNumPartitions()
    if n > DIRECT:
        groups = isqrt(n)
        marked = parts.withColumn("_group", F.spark_partition_id() % groups)
        parts = marked.repartition(min(groups * slots, 4000), *keys, "_group").drop("_group").mapInArrow(run, parts.schema)
    return parts.repartition(slots, *keys).mapInArrow(run, parts.schema)
