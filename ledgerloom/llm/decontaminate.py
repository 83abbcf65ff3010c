"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z). An item's windows are its runs of `WINDOW` words, or the whole item if it is shorter. Of
the `GRAM`-word grams in each window the one with the least hash (the first, if equal) is the window's fingerprint, on
both sides, so every shared window has the same fingerprint at the same offset: none can be missed. Shorter items have
their whole text as the fingerprint, compared with every run of as many document words.

Fingerprints of the benchmark are passed to the tasks in slices of at most `SLICE` numbers (32 MB), one pass over the
documents for each slice; only document fingerprints that some item has leave a task, each with the words that a
window around it can reach. They join the windows by equality, and the window's words are compared one by one: hashes
propose, words decide. Hit words are the union of the matching windows.

Null and empty texts have no words and no hits; items without words are never found. Repeated rows of either table are
each handled as they stand (a repeated item_id counts once). Empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.stages import fresh, written
from ledgerloom.llm.textbytes import LOWER, WORD, mix, prefix_sums, rolling_min, runs, span_hashes, words

WINDOW = 10
GRAM = 5
SLICE = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(hashes) < n:
        return hashes[:0]
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for at in range(n):
        total = total * _STEP + hashes[at : len(hashes) - n + 1 + at]
    return mix(total + np.uint64(n))


def fingerprint_offsets(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words: where its fingerprint starts within it, and the fingerprint."""
    grams = gram_hashes(hashes, gram)
    least = rolling_min(grams, window - gram + 1)
    offset = np.zeros(len(least), np.int64)
    for at in range(window - gram, -1, -1):
        offset[grams[at : at + len(least)] == least] = at
    return offset, least


def _tokens(data: np.ndarray, offsets: np.ndarray):
    lowered = LOWER[data]
    starts, ends, first = words(lowered, offsets, WORD)
    return lowered, starts, ends, first, span_hashes(prefix_sums(lowered), starts, ends)


_WINDOWS = "item_id bigint, words string, n int, start int, print bigint"


def _windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            items = batch.column("item_id").to_pylist()
            for row, data, offsets in runs(batch.column("text")):
                lowered, starts, ends, first, hashes = _tokens(data, offsets)
                for i in range(len(offsets) - 1):
                    low, high = first[i], first[i + 1]
                    n = min(window, int(high - low))
                    if n == 0:
                        continue
                    spelled = [lowered[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist())]
                    at, prints = fingerprint_offsets(hashes[low:high], n, min(gram, n) if n == window else n)
                    out += [(items[row + i], " ".join(spelled[s : s + n]), n, int(a), p) for s, (a, p) in enumerate(zip(at.tolist(), prints.view(np.int64).tolist()))]
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "words", "n", "start", "print"])

    return run


_HIT = pa.struct([("at", pa.int32()), ("print", pa.int64()), ("before", pa.int32()), ("context", pa.string())])
_HITS = "row bigint, doc_id bigint, n_words bigint, hits array<struct<at:int,print:bigint,before:int,context:string>>"


def _hits(prints, lengths: list[int], window: int, gram: int):
    """Documents to their word counts and the places of fingerprints that the benchmark has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prints.value
        for batch in batches:
            counts, found = [], []
            for _, data, offsets in runs(batch.column("text")):
                lowered, starts, ends, first, hashes = _tokens(data, offsets)
                counts.append(np.diff(first))
                row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                hits: list[list] = [[] for _ in range(len(offsets) - 1)]
                for n in [window, *lengths]:
                    if n == window:
                        at, least = fingerprint_offsets(hashes, window, gram)
                        whole = np.flatnonzero(row_of[: len(at)] == row_of[window - 1 :]) if len(at) else np.zeros(0, np.int64)
                        spot, index = np.unique(whole + at[whole], return_index=True)
                        value = least[whole[index]]
                    else:
                        value = gram_hashes(hashes, n)
                        spot = np.flatnonzero(row_of[: len(value)] == row_of[n - 1 :]) if len(value) else np.zeros(0, np.int64)
                        value = value[spot]
                    if len(known) and len(spot):
                        near = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
                        spot, value = spot[near], value[near]
                    else:
                        spot = spot[:0]
                    reach = window - gram if n == window else 0
                    for s, v in zip(spot.tolist(), value.view(np.int64).tolist()):
                        doc = int(row_of[s])
                        low = max(s - reach, int(first[doc]))
                        high = min(s + n, int(first[doc + 1]))
                        context = " ".join(lowered[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist()))
                        hits[doc].append((s - int(first[doc]), v, s - low, context))
                found += hits
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()), pa.array(found, pa.list_(_HIT))],
                ["row", "doc_id", "n_words", "hits"],
            )

    return run


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Word counts (row, doc_id, n_words), matching windows (row, start, n, words), and which items have a window."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = written(items.mapInArrow(_windows(window, gram), _WINDOWS), "windows")
    lengths = [r.n for r in windows.where(F.col("n") < window).select("n").distinct().collect()]  # fewer than `window`
    prints = windows.select("print").distinct()
    slices = -(-prints.count() // SLICE) or 1
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = hits = None
    for i in range(slices):
        part = prints.where(F.pmod(F.xxhash64("print"), F.lit(slices)) == i)
        known = np.sort(np.array([r[0] for r in part.collect()], np.int64).view(np.uint64))
        found = written(docs.mapInArrow(_hits(spark.sparkContext.broadcast(known), lengths, window, gram), _HITS), "hits")
        counts = found.select("row", "doc_id", "n_words") if counts is None else counts
        spots = found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
        hits = spots if hits is None else hits.unionByName(spots)
    distinct = windows.select("words", "n", "start", "print").distinct()
    context = F.split("context", " ")
    low = F.col("before") - F.col("start")
    verified = (
        hits.join(distinct, "print")
        .where((low >= 0) & (low + F.col("n") <= F.size(context)))
        .where(F.array_join(F.slice(context, low + 1, F.col("n")), " ") == F.col("words"))
        .select("row", (F.col("at") - F.col("start")).alias("start"), "n", "words")
    )
    return counts, written(verified, "matches"), windows.select("words", "item_id").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row, doc_id, n_words, n_hit, and items, the sorted item_ids (as strings) found in each document."""
    counts, found, owners = matches(documents, benchmark, window, gram)
    end = F.col("start") + F.col("n")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.select("row", "start", end.alias("end")).distinct()
        .withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).alias("n_hit"))
    )
    items = found.select("row", "words").distinct().join(owners, "words").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return (
        counts.join(covered, "row", "left").join(items, "row", "left")
        .select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`documents` without a window of any benchmark item, all columns as they were."""
    row, hit_row = fresh(documents, "row"), fresh(documents, "hit_row")
    _, found, _ = matches(documents, benchmark)
    hit = found.select(F.col("row").alias(hit_row)).distinct()
    return documents.withColumn(row, F.monotonically_increasing_id()).join(hit.hint("shuffle_hash"), F.col(row) == F.col(hit_row), "left_anti").drop(row)
