"""Writers: one table per stage, partitioned by client, replaced per client; run metadata and logs appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_META = "client string, stage string, status string, cutoff_year int, ran_at timestamp, rows bigint, files bigint, failures string"


def write_stage(df: DataFrame, path: str, by: str = "client", fmt: str = "parquet") -> None:
    """Replaces the written clients' partitions and leaves the others; zero rows still leave a schema.

    Rows are rebalanced by client first: few files a client, and a large client is split over tasks.
    """
    (
        df.hint("rebalance", by).write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).save(path)
    )


def read_stage(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stage table, empty when it was never written."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(location):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).load(path)


def append_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("append").save(path)


def run_meta(rows: DataFrame, stage: str, cutoff_year: int | None, failures: DataFrame | None = None) -> DataFrame:
    """One metadata row per client of a finished stage: rows, files, status and the failure summary."""
    counted = rows.groupBy("client").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_contract").alias("files"))
    if failures is not None:
        told = failures.groupBy("client").agg(F.count(F.lit(1)).alias("_n"))
        counted = counted.join(told, "client", "full_outer")
    else:
        counted = counted.withColumn("_n", F.lit(0))
    n = F.coalesce("_n", F.lit(0))
    return counted.select(
        "client", F.lit(stage).alias("stage"), F.when(F.coalesce("rows", F.lit(0)) > 0, "complete").otherwise("empty").alias("status"),
        F.lit(cutoff_year).cast("int").alias("cutoff_year"), F.current_timestamp().alias("ran_at"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("files", F.lit(0)).alias("files"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" chunk(s) failed"))).otherwise("").alias("failures"),
    )


def pending(contracts: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Contracts without output yet; all of them when forced."""
    return contracts if force else contracts.join(done.select("client", "filename").distinct(), ["client", "filename"], "left_anti")
