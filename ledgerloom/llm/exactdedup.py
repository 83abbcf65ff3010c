"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Equal blocks get one integer name: the blocks are dealt by
content, sorted, and numbered in that order. Adjacent names of a document are then paired, the distinct pairs are
sorted and named in the same way, and so on until one name is left. Names stand for equality of bytes, never for a
hash, so two documents with as many blocks and the same last name have the same text.

A task names equal blocks of its own rows first and passes each content on once, so that a text that a third of all
rows share costs the shuffle one row a task. Each document takes log2(its blocks) rounds; rounds after the first move
only integers, and half as many each time.

Null texts count as empty; an empty text is one empty block. Rows may repeat: every row is named, the row with the
largest doc_id (null is smallest), among equals the last one, stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.stages import fresh, written
from ledgerloom.llm.textbytes import LOWER, column_bytes

BLOCK_BYTES = 4096
_HELD_BYTES = 16 << 20
_HOLDER = pa.struct([("row", pa.int64()), ("at", pa.int64()), ("blocks", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary())])
_CUT = pa.schema([("block", pa.binary()), ("holders", pa.list_(_HOLDER))])


def _cut(block_bytes: int):
    """Rows to distinct blocks, each with the places that hold it."""

    def flush(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        while held:
            part, size = [], 0
            while held and size < (4 << 20):
                block, places = held.popitem()
                size += len(block) + 64 * len(places)
                part.append((block, places))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.binary()), pa.array([p for _, p in part], pa.list_(_HOLDER))], schema=_CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for row, doc_id, low, high in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                text = LOWER[data[low:high]].tobytes()
                blocks = max(1, -(-len(text) // block_bytes))
                for at in range(blocks):
                    block = text[at * block_bytes : (at + 1) * block_bytes]
                    digest = hashlib.sha256(text).digest() if at == 0 else None
                    held.setdefault(block, []).append((row, at, blocks, doc_id if at == 0 else None, digest))
                    size += len(block) + 200
                if size > _HELD_BYTES:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return run


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks to integers: the partition's number, then the rank among its distinct blocks."""
    name, last = TaskContext.get().partitionId() << 36, None
    for batch in batches:
        names = np.empty(len(batch), np.int64)
        for i, block in enumerate(batch.column("block").to_pylist()):
            if block != last:
                name, last = name + 1, block
            names[i] = name
        yield pa.RecordBatch.from_arrays([pa.array(names), batch.column("holders")], ["name", "holders"])


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, at, blocks, name, and for at = 0 also doc_id and digest: the named blocks of every row."""
    holder = "array<struct<row:bigint,at:bigint,blocks:bigint,doc_id:bigint,digest:binary>>"
    blocks = docs.mapInArrow(_cut(block_bytes), f"block binary, holders {holder}")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(shards, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_name, f"name bigint, holders {holder}").select("name", F.explode("holders").alias("h")).select("h.*", "name")


def identities(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, doc_id, digest, blocks, name: rows with equal (blocks, name) have equal text, and only those."""
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    level = written(block_names(docs, block_bytes), "blocks")
    done = level.where("blocks = 1").drop("at")
    longest = level.agg(F.max("blocks")).first()[0] or 1
    width = 1
    while width < longest:
        width *= 2
        half = F.col("at") % 2
        level = (
            level.where(F.col("blocks") > width // 2)
            .groupBy("row", "blocks", F.shiftright("at", 1).alias("at"))
            .agg(
                F.max(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right"),
                F.max("doc_id").alias("doc_id"), F.max("digest").alias("digest"),
            )
        )
        pairs = level.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id())
        level = written(level.join(pairs, ["left", "right"]).select("row", "at", "blocks", "doc_id", "digest", "name"), "pairs")
        done = done.unionByName(level.where((F.col("blocks") > width // 2) & (F.col("blocks") <= width)).drop("at"))
    return done


def exact_groups(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and row, its place in the table."""
    named = identities(documents, block_bytes)
    groups = named.groupBy("blocks", "name").agg(F.max(F.struct("doc_id", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["blocks", "name"]).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keeper.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "row",
    )


def drop_exact_copies(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`documents` with one row of each group of equal texts, all columns as they were."""
    row, kept_row = fresh(documents, "row"), fresh(documents, "kept_row")
    kept = exact_groups(documents, block_bytes).where("kept").select(F.col("row").alias(kept_row))
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(kept.hint("shuffle_hash"), F.col(row) == F.col(kept_row), "left_semi").drop(row)
