"""Session helpers: builder defaults for local runs and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names.

    Only a local master may fall back to a scratch folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_CONF, None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
