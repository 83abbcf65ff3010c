"""Near duplicates by SimHash and deletion-variant signatures.

A document's fingerprint has bit i set if over half of its word shingles' XXH64 values have it. Fingerprints within
`DISTANCE` = 3 bits are linked: cut into two halves, one half differs by at most one bit. Each distinct fingerprint is
therefore indexed under every half with one bit taken out (64 signatures); two linked fingerprints share at least one
signature, are found by equality, and the full distance is checked.

The documents of one fingerprint are one node, so copies never meet in pairs. A signature's members are compared only
up to `GROUP_LIMIT`; a larger group is passed on and cut again by the same rule over its free bits, until at most
1024 fingerprints can share a signature. From each group only a spanning forest of its links leaves, never all pairs,
which keeps the components whole. Components come from alternating star contraction with equality joins.

Null texts count as empty; texts without words have fingerprint zero, linked like any other. Repeated rows are rows of
one fingerprint. component_id is the smallest doc_id reachable; null doc_ids only count where a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.stages import fresh, written
from ledgerloom.llm.textbytes import column_bytes

DISTANCE = 3
GROUP_LIMIT = 2048
SEED = 42
BITS = 64

# For each byte value its eight bits as the eight bytes of one integer, so that adding integers counts bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64)[:, 0]


def _bit_counts(digests: bytes) -> np.ndarray:
    lanes = _LANES[np.frombuffer(digests, np.uint8).reshape(-1, 8)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(lanes), 255 * 64):
        part = lanes[at : at + 255 * 64]
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes, shingle_words: int) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as a signed integer."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    ends = ends[min(shingle_words, len(ends)) - 1 :]
    shingles = [joined[low:high] for low, high in zip(starts, ends)]
    counts = _bit_counts(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))))
    return int(np.packbits(2 * counts > len(shingles)).view(">i8")[0])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            prints = [fingerprint(data[low:high].tobytes(), shingle_words) for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(prints, pa.int64())], ["row", "doc_id", "print"])

    return run


def fingerprints(documents: DataFrame, shingle_words: int = 3) -> DataFrame:
    """row, doc_id, print of every document."""
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints(shingle_words), "row bigint, doc_id bigint, print bigint")


def signatures_of(fixed: int) -> list[int]:
    """Masks of the bits that must be equal: the fixed ones, and either half of the others without one bit."""
    free = [1 << b for b in range(BITS) if not fixed >> b & 1]
    halves = free[: len(free) // 2], free[len(free) // 2 :]
    masks = [fixed | sum(half) & ~bit for half in halves for bit in half]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _resign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups that were too large, under signatures that fix more bits."""
    for batch in batches:
        masks, prints = (batch.column(c).to_numpy() for c in ("mask", "print"))
        kinds, kind = np.unique(masks, return_inverse=True)
        order = np.argsort(kind, kind="stable")
        out = []
        for mask, part in zip(kinds.tolist(), np.split(prints[order], np.cumsum(np.bincount(kind))[:-1])):
            more = np.array(signatures_of(mask & ((1 << 64) - 1)))
            out.append((np.repeat(more, len(part)), np.tile(part, len(more))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], ["mask", "print"])


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of 64-bit integers (numpy counts those of the absolute value if they are signed)."""
    return np.bitwise_count(x.view(np.uint64))


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    edges, rest = [], prints
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            near = _bits(rest ^ node) <= DISTANCE
            if near.any():
                found = rest[near]
                edges += [(int(node), int(x)) for x in found]
                frontier += list(found)
                rest = rest[~near]
    return edges


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("crowded", pa.bool_())])


def _out(a, b, crowded: bool) -> pa.RecordBatch:
    a = pa.array(a, pa.int64())
    return pa.RecordBatch.from_arrays([a, pa.array(b, pa.int64()), pa.array(np.full(len(a), crowded))], schema=_FOUND)


def _links(limit: int):
    """Sorted rows to links (a, b); rows of groups above the limit come back as (mask, print) with crowded set.

    Holds one group of at most `limit` rows beside the batch; groups with ten free bits have 1024 at most.
    """

    def most(masks: np.ndarray) -> np.ndarray:
        return np.where(_bits(~masks) > 10, limit, 1 << 10)

    def solved(masks: np.ndarray, prints: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups, given where each begins."""
        sizes = np.diff(np.append(starts, len(prints)))
        two = starts[sizes == 2]
        two = two[_bits(prints[two] ^ prints[two + 1]) <= DISTANCE]
        large = sizes > most(masks[starts]) if len(starts) else np.zeros(0, bool)
        some = (sizes > 2) & ~large
        edges = [e for low, n in zip(starts[some].tolist(), sizes[some].tolist()) for e in _forest(prints[low : low + n])]
        edges = np.array(edges, np.int64).reshape(-1, 2)
        yield _out(np.append(prints[two], edges[:, 0]), np.append(prints[two + 1], edges[:, 1]), False)
        if large.any():
            crowd = np.repeat(large, sizes)
            yield _out(masks[starts[0] :][crowd], prints[starts[0] :][crowd], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held_masks = held_prints = none
        crowded = None
        for batch in batches:
            masks = np.concatenate([held_masks, batch.column("mask").to_numpy()])
            prints = np.concatenate([held_prints, batch.column("print").to_numpy()])
            held_masks = held_prints = none
            keys = prints & masks
            if crowded is not None:
                same = (masks == crowded[0]) & (keys == crowded[1])
                n = len(same) if same.all() else int(np.argmin(same))
                yield _out(masks[:n], prints[:n], True)
                masks, prints, keys = masks[n:], prints[n:], keys[n:]
            if not len(masks):
                continue
            crowded = None
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (masks[1:] != masks[:-1])))
            last = int(starts[-1])
            yield from solved(masks[:last], prints[:last], starts[:-1])
            if len(prints) - last > most(masks[last:][:1])[0]:
                crowded = masks[last], keys[last]
                yield _out(masks[last:], prints[last:], True)
            else:
                held_masks, held_prints = masks[last:], prints[last:]
        if len(held_prints):
            yield from solved(held_masks, held_prints, np.zeros(1, np.int64))

    return run


def links(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """a, b: links that connect all fingerprints of `prints` (distinct, column print) within three bits."""
    shards = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select(F.explode(F.array(*[F.lit(m) for m in signatures_of(0)])).alias("mask"), "print")
    found = None
    while True:
        key = F.col("print").bitwiseAND(F.col("mask"))
        dealt = rows.withColumn("key", key).repartition(shards, "mask", "key").sortWithinPartitions("mask", "key").select("mask", "print")
        level = written(dealt.mapInArrow(_links(group_limit), "a bigint, b bigint, crowded boolean"), "links")
        pairs = level.where("not crowded").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = level.where("crowded").select(F.col("a").alias("mask"), F.col("b").alias("print"))
        if crowded.isEmpty():
            return found
        rows = crowded.mapInArrow(_resign, "mask bigint, print bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b): alternating large and small stars until nothing changes."""
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, state = written(stars, "edges"), None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a").alias("a"), F.col("low").alias("b")))).alias("e"))
        stars = written(small.select("e.a", "e.b").where("a <> b").distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_groups(documents: DataFrame, shingle_words: int = 3) -> DataFrame:
    """row, doc_id, print, component_id, and keeper: the row of each component that stays (smallest doc_id, then row)."""
    docs = written(fingerprints(documents, shingle_words), "prints")
    nodes = docs.groupBy("print").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    roots = components(links(nodes.select("print")))
    rooted = nodes.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", "first", F.coalesce("root", "print").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    named = rooted.select("print", "root").join(groups, "root").select("print", "component_id", F.col("first.row").alias("first_row"))
    return docs.join(named, "print").select("row", "doc_id", "print", "component_id", (F.col("row") == F.col("first_row")).alias("keeper"))


def drop_near_copies(documents: DataFrame, shingle_words: int = 5) -> DataFrame:
    """`documents` with one row of each component, all columns as they were."""
    row, kept_row = fresh(documents, "row"), fresh(documents, "kept_row")
    kept = near_groups(documents, shingle_words).where("keeper").select(F.col("row").alias(kept_row))
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(kept.hint("shuffle_hash"), F.col(row) == F.col(kept_row), "left_semi").drop(row)
