"""Stage tables: results that several later steps read, written once where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; where it is unset (tests), one of our own is set for the session.

    On a cluster it has to be set: executors would not see each other's files in a folder of one machine.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='run-', dir='/tmp')}"
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends here and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores put before it until no column of `df` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_IN_PLACE = {"Project", "Filter", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "SubqueryAlias"}


def tabled(df: DataFrame) -> DataFrame:
    """`df` itself if its rows come from a scan, else (out of a shuffle, a join, Python) written as a table, so that rows
    numbered as they come have the same numbers in every pass."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    names = {line.lstrip(" :+-").split("[")[0].split("(")[0].split(" ")[0] for line in plan.splitlines() if line.strip()}
    return df if names <= _IN_PLACE else written(df, "table")
