"""Structured Streaming jobs: document intake, usage per window, latest run state.

All three recover from their checkpoint after a lost executor or driver. Usage windows bound
their state with a watermark, intake has none but the file source's own log, and the latest run
state holds one row per client and agent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.portfolio import model_key, token_totals

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def new_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, modificationTime, size) for files that appear in a folder, whatever their age."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFileAge", "36500d").load(folder)
    return files.select("path", "modificationTime", F.col("length").alias("size"))


def intake(documents: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, key: str = "path") -> StreamingQuery:
    """Hands every new document to `process` once, however old its modification time is.

    The file source remembers the files it has seen; a key that repeats within a batch counts once. `process` may be called again with the same batch id after a failure, so it should write per batch.
    """

    def once(batch: DataFrame, batch_id: int) -> None:
        process(batch.dropDuplicates([key]), batch_id)

    return (
        documents.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def usage_windows(calls: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Calls and tokens per model and tumbling window of `ts`; works on a stream and on a table alike."""
    rows = token_totals(calls.withWatermark("ts", late) if calls.isStreaming else calls)
    return (
        rows.groupBy(F.window("ts", size), model_key(F.col("actual_model"), F.col("requested_model")).alias("model"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
             F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "model", "calls",
                "input_tokens", "output_tokens", "total_tokens")
    )


def latest_states(runs: DataFrame) -> DataFrame:
    """Newest run per client and agent; on a stream run it in update mode, one row of state per pair."""
    return runs.groupBy("client", "agent").agg(
        F.max_by(F.struct("run_id", "state", "ts"), F.struct("ts", "run_id")).alias("r")
    ).select("client", "agent", "r.run_id", "r.state", "r.ts")


def write_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows only, appended once each."""
    return (
        windows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every change of a pair's latest run, one folder per batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return states.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
