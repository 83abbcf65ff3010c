"""Equality joins on few keys, each with many rows on both sides.

The rows of a key are dealt over blocks on either side and every pair of blocks is a key of the join, so that no
task holds all pairs of a frequent key. The number of partitions is given, since small inputs with a large result would
otherwise be put into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.contains import merged

BLOCK = 1024


def meet(left: DataFrame, right: DataFrame, on: list[str], block: int = BLOCK) -> DataFrame:
    """Inner join of `left` and `right` on the columns `on`; nothing else may be common to both."""
    shards = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(df, name):
        return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).alias(name))

    n = blocks(left, "_nl").join(blocks(right, "_nr"), on)
    keys = [*on, "_bl", "_br"]

    def dealt(df, own, other, own_block, other_block):
        own_number = F.pmod(F.xxhash64(*df.columns), F.col(own))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return df.join(n, on).withColumn(own_block, own_number).withColumn(other_block, every).drop(own, other).repartition(shards, *keys)

    return dealt(left, "_nl", "_nr", "_bl", "_br").join(merged(dealt(right, "_nr", "_nl", "_br", "_bl")), keys).drop("_bl", "_br")
