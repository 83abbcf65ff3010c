"""Mixing sources to target weights by entropy balancing.

Each source has a token constraint: its documents' rates, times their sizes, add up to its target. Among all rates the
ones nearest to one in relative entropy are exponential tilts, rate = exp(lambda * size / mean size), cut off at
`MOST` copies. Lambda solves the convex dual by Newton steps on the logarithm of the moment, kept inside a bracket;
a step is one distributed aggregation over (source, size, documents), which says the same as the documents and does not
grow with their number. Sources stay rows of a table throughout.

Rates become copies: the whole part, and one more for documents in the order of hash / fraction (sequential Poisson
sampling) until the source's words reach its target. The place where a source stops is found by two rounds of
histograms, so that no source is ever sorted as a whole.

Null texts have size 0 and are taken with 0 words; a null source is a source, last in order; a source without words has
target 0. Repeated rows get the same number of copies. Reruns give the same copies, since the hash is of doc_id and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.stages import fresh, written

WEIGHTS = (5, 2, 1)
MOST = 3
TOLERANCE = 1e-6
STEPS = 60
_BINS = 1 << 12


def words(text: Column) -> Column:
    """The number of runs of characters other than the six ASCII white spaces."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, place (its rank by code point), source_size, docs, target, for rows of (source, size).

    Shares go by weight, at most `most` times a source's size: sources stop in the order of size / weight, and who is
    still below its limit shares what is left. Windows run over one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy("fill", "place")
    full, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("place", place).withColumn("weight", weight)
        .withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("fill", F.col("limit") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(full), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("stops", F.col("fill") <= F.col("level"))
        .withColumn("share", F.max(F.when(~F.col("stops"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("share")))
        .select("source", "place", "source_size", "docs", "target")
    )


def _rate(most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))


def balance(histogram: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """`sources` with mean, open and lam: the dual solution of each source between 0 and its limit (those are open)."""
    start = sources.withColumn("mean", F.coalesce(F.col("source_size") / F.nullif("docs", F.lit(0)), F.lit(1.0)))
    start = start.withColumn("open", (F.col("target") > 0) & (F.col("target") < most * F.col("source_size")))
    empty = F.lit(None).cast("double")
    state = written(start.withColumns({"lam": F.lit(0.0), "low": empty, "high": empty, "gap": F.lit(0.0)}), "balance")
    rate = _rate(most)
    words_ = F.col("n") * F.col("size") * rate
    for _ in range(STEPS):
        sums = (
            histogram.join(state.where("open").select("place", "lam", "mean"), "place").groupBy("place")
            .agg(F.sum(words_).alias("g"), F.sum(F.when(rate < most, words_ * F.col("size") / F.col("mean")).otherwise(0.0)).alias("h"))
        )
        gap = F.abs(F.col("g") / F.col("target") - 1)
        low = F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("g") > F.col("target"), F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.log("g") - F.log("target")) * F.col("g") / F.nullif("h", F.lit(0.0))
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        split = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        moved = F.when(~F.col("open") | (F.col("gap") <= TOLERANCE), F.col("lam")).when(inside, newton).otherwise(split)
        step = state.join(sums, "place", "left").withColumn("gap", F.coalesce(gap, F.lit(0.0))).withColumns({"low": low, "high": high})
        state = written(step.withColumn("lam", moved).select(state.columns), "balance")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.withColumn("lam", F.round("lam", 9)).drop("low", "high", "gap")


def _rated(sized: DataFrame, balanced: DataFrame, most: int) -> DataFrame:
    """`sized` (doc_id, source, size, more) with its source's figures, rate, whole copies, key and bin.

    Documents get one more copy in the order of `key`; `bin` cuts the keys into 2^24 ascending parts.
    """
    rate = F.when(F.col("open"), _rate(most)).when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    unit = (F.xxhash64("doc_id", "size").bitwiseAND((1 << 53) - 1) + 1) / F.lit(float(1 << 53))
    part = F.col("rate") - F.col("whole")
    return (
        sized.join(balanced.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
        .withColumn("rate", rate).withColumn("whole", F.floor("rate"))
        .withColumn("key", F.when((part > 0) & (F.col("size") > 0), unit / part))
        .withColumn("bin", F.floor(F.col("key") / (1 + F.col("key")) * (_BINS * _BINS)))
    )


def _stops(rated: DataFrame) -> DataFrame:
    """place, bin, last: one more copy for documents in bins before `bin`, and within it up to the key `last`."""
    keyed = written(rated.where("key IS NOT NULL").select("place", "size", "key", "bin", F.floor(F.col("bin") / _BINS).alias("coarse")), "keys")
    need = rated.groupBy("place").agg((F.max("target") - F.sum(F.col("size") * F.col("whole"))).alias("need"))

    def reached(rows: DataFrame, by: str, need: DataFrame) -> DataFrame:
        """The last `by` of each source whose predecessors together don't exceed the need, and what they leave of it.

        Sums are finished by (source, bin) first; a window straight upon them would bring every task's part of a large
        source together.
        """
        before = Window.partitionBy("place").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = written(rows.groupBy("place", by).agg(F.sum("size").alias("words")), "sums").join(need, "place")
        sums = sums.withColumn("left", F.col("need") - F.coalesce(F.sum("words").over(before), F.lit(0)))
        return sums.where("left >= 0").groupBy("place").agg(F.max(by).alias(by), F.min("left").alias("need"))

    coarse = written(reached(keyed, "coarse", need), "coarse")
    fine = written(reached(keyed.join(coarse, ["place", "coarse"]), "bin", coarse.select("place", "need")), "bins")
    upto = Window.partitionBy("place").orderBy("key")
    ends = keyed.join(fine, ["place", "bin"]).groupBy("place", "bin", "need", "key").agg(F.sum("size").alias("words"))
    ends = ends.withColumn("upto", F.sum("words").over(upto))
    last = ends.where(F.col("upto") - F.col("words") / 2 <= F.col("need")).groupBy("place").agg(F.max("key").alias("last"))
    return fine.select("place", F.col("bin").alias("stop")).join(last, "place", "left")


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`sized` (doc_id, source, size, and any more columns without clashing names) with source_size, target, copies, taken."""
    narrow = written(sized.select("doc_id", "source", "size"), "sizes")
    sources = written(targets(narrow, weights, most), "targets")
    placed = narrow.join(sources.select(F.col("source").alias("its_source"), "place"), F.col("source").eqNullSafe(F.col("its_source")))
    histogram = written(placed.where("size > 0").groupBy("place", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    balanced = written(balance(histogram, sources, most), "balanced")
    stops = written(_stops(_rated(narrow, balanced, most)), "stops")
    more = (F.col("bin") < F.col("stop")) | ((F.col("bin") == F.col("stop")) & (F.col("key") <= F.col("last")))
    copies = F.least(F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"), F.lit(most))
    rated = _rated(narrow if set(sized.columns) == {"doc_id", "source", "size"} else sized, balanced, most)
    return rated.join(stops, "place", "left").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(
        *sized.columns, "source_size", "target", "copies", "taken"
    )


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size of every document."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))


def mix_documents(documents: DataFrame) -> DataFrame:
    """`documents` with size, source_size, target, copies, taken (under other names where they have such columns)."""
    whole = documents.select(
        F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size")
    )
    added = ("size", "source_size", "target", "copies", "taken")
    return mix(whole).select("document.*", *[F.col(c).alias(fresh(documents, c)) for c in added])
