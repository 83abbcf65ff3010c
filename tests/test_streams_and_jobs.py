"""Streams run to completion on files; registered queries keep their contract."""

import inspect
import os
import re
from pathlib import Path

import __spark_entry__ as entry
from pyspark.sql import functions as F

from ledgerloom.plans import jobs
from ledgerloom.streaming import jobs as st

CALLS = ("run_id bigint, client string, agent string, ts timestamp, input_tokens bigint, output_tokens bigint, total_tokens bigint, "
         "requested_model string, actual_model string, state string")


def _calls(spark, rows):
    return spark.createDataFrame(rows, CALLS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))


def test_usage_stream_drops_late_rows(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    first = [(1, "c", "x", "2024-01-01 00:10:00", 1, 2, None, "m", None, "complete"), (2, "c", "x", "2024-01-01 05:00:00", 1, 2, None, "m", "n", "complete")]
    late = [(3, "c", "x", "2024-01-01 00:20:00", 9, 9, None, "m", None, "complete"), (4, "c", "x", "2024-01-01 09:00:00", 5, 5, 0, "m", "n", "error")]
    for batch in (first, late):
        _calls(spark, batch).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(CALLS).parquet(src)
        st.write_windows(st.usage_windows(stream), out, chk).awaitTermination()
    rows = {(str(r.window_start), r.model): r.total_tokens for r in spark.read.parquet(out).collect()}
    assert rows[("2024-01-01 00:00:00", "m")] == 3  # the late row came after its window closed
    assert rows[("2024-01-01 05:00:00", "n")] == 3


def test_latest_state_stream(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for i, (state, ts) in enumerate((("running", "2024-01-01 00:00:00"), ("complete", "2024-01-01 01:00:00"))):
        _calls(spark, [(i, "c", "x", ts, 1, 1, 2, "m", "m", state)]).write.mode("append").parquet(src)
        st.write_states(st.latest_states(spark.readStream.schema(CALLS).parquet(src)), out, chk).awaitTermination()
    last = spark.read.parquet(out).orderBy(F.desc("batch")).first()
    assert last.state == "complete"


def test_intake_hands_over_once(spark, tmp_path):
    folder, chk = tmp_path / "docs", str(tmp_path / "chk")
    folder.mkdir()
    seen = []

    def process(batch, _):
        seen.extend(r.path.rsplit("/", 1)[-1] for r in batch.select("path").collect())

    for name in ("a.pdf", "b.pdf", "old.pdf"):
        (folder / name).write_text("x")
        if name == "old.pdf":
            os.utime(folder / name, (0, 0))  # copied with its old time
        st.intake(st.new_documents(spark, str(folder)), process, chk).awaitTermination()
    assert seen == ["a.pdf", "b.pdf", "old.pdf"]


def test_incremental_run(spark, tmp_path):
    contracts = spark.createDataFrame([("a", "1.pdf"), ("a", "2.pdf"), ("b", "3.pdf")], "client string, filename string")
    done = spark.createDataFrame([("a", "1.pdf", 10)], "client string, filename string, n int")
    meta = jobs.incremental(contracts, done, lambda todo: todo.withColumn("n", F.lit(1)), str(tmp_path / "s"), "items")
    assert {r.client: r.rows for r in meta.collect()} == {"a": 2, "b": 1}
    rows = {(r.client, r.filename): r.n for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert rows == {("a", "1.pdf"): 10, ("a", "2.pdf"): 1, ("b", "3.pdf"): 1}


def test_entry(spark):
    df = entry.entry(spark)
    assert {"client", "material_code", "billing_type"} <= set(df.columns)
    kinds = {r.billing_type for r in df.select("billing_type").distinct().collect()}
    assert kinds <= {"ONE_TIME", "PERIODIC", "RECURRING"} and kinds


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 170


def test_library_never_collects_or_crosses():
    library = Path(inspect.getfile(jobs)).parent.parent
    code = "\n".join(p.read_text() for p in library.rglob("*.py") if p.relative_to(library).parts[0] != "llm")  # tests/llm has its own
    assert not re.search(r"localCheckpoint|crossJoin|\.collect\(\)|toPandas\(", code)
