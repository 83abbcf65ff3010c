"""Exact substring join without a nested loop.

Every needle picks the rarest of its own q-grams (q = the largest level that fits)
as its seed; a haystack can only contain the needle if it contains the seed, so an
equi join on the seed gives a complete candidate set that `contains` then verifies.
Grams travel as 64-bit hashes and texts as the hash of their key: equal hashes only add
candidates. Only levels that some needle needs are cut. The joins are sort-merge joins by
hint: Spark takes an exploded side for as small as its texts and would broadcast it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.grams import gram_hashes

LEVELS = (12, 6, 3, 1)
WORDS = 2048


def merged(df: DataFrame) -> DataFrame:
    """The other side of a join that must not be broadcast."""
    return df.hint("merge")


def _level(levels) -> Column:
    """The largest level that fits a needle; 0 for one shorter than all."""
    return reduce(lambda acc, q: F.when(F.length("_needle") >= q, q).otherwise(acc), sorted(levels), F.lit(0))


def _needle_grams(words: DataFrame, on: list[str], levels) -> DataFrame:
    """(on, _needle, _asked, _gram): every (q / 2)-th gram of a needle and the last, and how many these are."""
    own = reduce(
        lambda acc, q: F.when(F.col("_q") == q, gram_hashes(F.col("_needle"), q)).otherwise(acc),
        sorted(levels), F.array().cast("array<bigint>"),
    )
    # the place of the last gram from lengths: the size of the array would cut all grams again for each of them
    step, last = F.greatest(F.col("_q") / 2, F.lit(1)).cast("int"), F.length("_needle") - F.col("_q")
    some = F.array_distinct(F.filter(own, lambda g, i: (i % step == 0) | (i == last)))
    # as a generated column the grams are not cut again where they are counted
    return words.withColumn("_q", _level(levels)).withColumn("_some", F.explode(F.array(some))).select(
        *on, "_needle", F.size("_some").alias("_asked"), F.explode("_some").alias("_gram"))


def _seeds(grams: DataFrame, words: DataFrame, on: list[str], levels) -> DataFrame:
    """(on, _needle, _gram): each needle with the gram fewest haystacks hold.

    Of a long needle only some grams are looked up. A needle with one that no haystack holds is in none.
    """
    needle_grams = _needle_grams(words, on, levels)
    counts = grams.groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    return (
        needle_grams.join(merged(counts), [*on, "_gram"])
        .groupBy(*on, "_needle", "_asked")
        .agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count(F.lit(1)).alias("_held"))
        .where(F.col("_held") == F.col("_asked")).drop("_asked", "_held")
    )


def _grams(texts: DataFrame, words: DataFrame, kept: list[str], levels) -> DataFrame:
    """(kept, _gram): the distinct grams of `_hay` at the levels that needles have."""
    # one row of at most five numbers, met by every text
    asked = F.broadcast(words.agg(F.collect_set(_level(levels)).alias("_asked")).withColumn("_all", F.lit(0)))
    none = F.array().cast("array<bigint>")
    cut = [F.when(F.array_contains("_asked", q), gram_hashes(F.col("_hay"), q)).otherwise(none) for q in levels]
    # grams of no needle stay out of the shuffles, as far as a bitmap of WORDS numbers can tell
    own = F.filter(F.array_distinct(F.concat(*cut)), lambda g: F.bit_get(F.get("_bits", _word(g)), _bit(g)) == 1)
    met = texts.withColumn("_all", F.lit(0)).join(asked, "_all").join(_bitmap(words, levels), "_all")
    return met.select(*kept, F.explode(own).alias("_gram"))


def _word(gram: Column) -> Column:
    return F.pmod(F.shiftright(gram, 6), F.lit(WORDS)).cast("int")


def _bit(gram: Column) -> Column:
    return F.pmod(gram, F.lit(64)).cast("int")


def _bitmap(words: DataFrame, levels) -> DataFrame:
    """One row (_all, _bits): WORDS numbers with a bit set for every gram that needles look up."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("_gram")))
    set_bits = _needle_grams(words, [], levels).groupBy(_word(F.col("_gram")).alias("_w")).agg(F.bit_or(one).alias("_b"))
    whole = set_bits.agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long")))
    return F.broadcast(whole.select(F.lit(0).alias("_all"), F.explode(F.array(every)).alias("_bits")))


def _dealt(df: DataFrame) -> DataFrame:
    """Distinct rows, in as many tasks as shuffles have: few bytes make many grams."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns).distinct()


def contains_pairs(
    hay: DataFrame, needles: DataFrame, hay_text: str, needle_text: str, on: list[str] | None = None, levels=LEVELS
) -> DataFrame:
    """Distinct (on, hay_text, needle_text) where the first contains the second; for short texts."""
    on = list(on or [])
    texts = _dealt(hay.where(F.length(hay_text) > 0).select(*on, F.col(hay_text).alias("_hay")))
    words = _dealt(needles.where(F.length(needle_text) > 0).select(*on, F.col(needle_text).alias("_needle")))
    grams = _grams(texts, words, [*on, "_hay"], levels)
    return (
        grams.join(merged(_seeds(grams, words, on, levels)), [*on, "_gram"])
        .where(F.contains("_hay", "_needle"))
        .select(*on, F.col("_hay").alias(hay_text), F.col("_needle").alias(needle_text))
    )


def contains_join(
    hay: DataFrame, needles: DataFrame, hay_text: str, needle_text: str, on: list[str] | None = None, levels=LEVELS
) -> DataFrame:
    """Pairs (hay row, needle row) where `hay_text` contains `needle_text`; for long texts.

    `on` names equality columns both sides share (kept once, from the hay side); they must leave few
    needles a key, such as those of one document, which then meet the key's texts without grams. Blank
    needles match nothing. Rows of both sides keep all their columns.
    """
    if on:
        held = F.col("_hay_text").contains(F.col("_needle_text"))
        texts = hay.withColumn("_hay_text", F.col(hay_text))
        return texts.join(
            merged(needles.where(F.length(needle_text) > 0).withColumn("_needle_text", F.col(needle_text))), list(on)
        ).where(held).drop("_hay_text", "_needle_text")
    # texts travel as a hash; equal hashes only add candidates, `contains` decides
    keyed = hay.where(F.length(hay_text) > 0).withColumn("_h", F.xxhash64(hay_text))
    words = _dealt(needles.where(F.length(needle_text) > 0).select(F.col(needle_text).alias("_needle")))
    grams = _grams(keyed.withColumn("_hay", F.col(hay_text)), words, ["_h"], levels)
    candidates = grams.join(merged(_seeds(grams, words, [], levels)), "_gram").select("_h", "_needle").distinct()
    pairs = keyed.join(merged(candidates), "_h").where(F.contains(F.col(hay_text), F.col("_needle"))).drop("_h")
    return pairs.join(merged(needles.withColumn("_needle", F.col(needle_text))), "_needle").drop("_needle")
