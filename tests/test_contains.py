"""Substring joins against all pairs, and without broadcasts of exploded sides."""

from ledgerloom.operators import contains
from ledgerloom.operators.contains import LEVELS, _grams, _seeds, contains_join, contains_pairs
from ledgerloom.operators.invoices import bridge_names

TEXTS = ["abcabcabcabcabc", "the quick brown fox jumps", "x", "naïve \U0001f600\U0001f601 text of the fox", "", None, "abcabcabcabcabd", "12\n34567890123456"]
NEEDLES = ["abcabcabcabc", "fox", "x", "\U0001f600\U0001f601", "quick brown fox jumps", "abcabcabcabcabd", "", None, "2\n345678901234", "zz"]


def test_pairs_equal_brute_force(spark):
    hay = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    needles = spark.createDataFrame([(j, n) for j, n in enumerate(NEEDLES)], "j int, needle string")
    want = {(i, j) for i, t in enumerate(TEXTS) for j, n in enumerate(NEEDLES) if t and n and n in t}
    assert {(r.i, r.j) for r in contains_join(hay, needles, "text", "needle").collect()} == want
    assert {(r.text, r.needle) for r in contains_pairs(hay, needles, "text", "needle").collect()} == {(TEXTS[i], NEEDLES[j]) for i, j in want}


def test_texts_of_one_file_meet_without_grams(spark):
    """Needles of a document meet its own lines by its name; exploding every gram of a page does not end on 0.1 GB."""
    hay = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate([*TEXTS, *TEXTS])], "f int, i int, text string")
    needles = spark.createDataFrame([(j % 2, j, n) for j, n in enumerate([*NEEDLES, *NEEDLES])], "f int, j int, needle string")
    out = contains_join(hay, needles, "text", "needle", on=["f"])
    want = sorted((i, j) for i, t in enumerate([*TEXTS, *TEXTS]) for j, n in enumerate([*NEEDLES, *NEEDLES]) if i % 2 == j % 2 and t and n and n in t)
    assert out.columns == ["f", "i", "text", "j", "needle"]
    assert sorted((r.i, r.j) for r in out.collect()) == want
    assert "explode" not in out._jdf.queryExecution().executedPlan().toString()


def test_grams_are_never_broadcast(spark):
    """Explode does not raise Spark's size estimate, so only the one-row table of levels may be broadcast."""
    clients = spark.createDataFrame([("Alpha FCU",)], "client string")
    lines = spark.createDataFrame([("1", "Alpha Federal Credit Union")], "billto string, billto_name string")
    out = bridge_names(clients, lines)
    assert [(r.client, r.billto, r.score) for r in out.collect()] == [("Alpha FCU", "1", 100)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_needles_with_a_gram_in_no_text_are_no_candidates(spark):
    """File names of one client differ in a few letters only; before, each met the texts that name any of them."""
    hay = spark.createDataFrame([("see alpha-000000001_master_1-15-1998_7.pdf p. 9",), ("nothing here",)], "_hay string")
    words = spark.range(300).selectExpr("concat('alpha-000000001_master_1-15-1998_', id) AS _needle").unionByName(
        spark.createDataFrame([("fox",), ("re",)], "_needle string"))
    grams = _grams(hay, words, ["_hay"], LEVELS)
    assert {r._needle for r in _seeds(grams, words, [], LEVELS).collect()} == {"alpha-000000001_master_1-15-1998_7", "re"}


def test_grams_of_no_needle_are_not_dealt(spark):
    """Names that hold no needle sent all of their grams through the shuffles."""
    hay = spark.range(500).selectExpr("concat('customer-', id, ' amendment of a long name') AS _hay").unionByName(
        spark.createDataFrame([("CTR-101 and CTR-102",)], "_hay string"))
    words = spark.createDataFrame([("CTR-101",), ("SOW-7",)], "_needle string")
    assert _grams(hay, words, ["_hay"], LEVELS).count() < 200
    assert [(r._hay, r._needle) for r in contains_pairs(hay, words, "_hay", "_needle").collect()] == [("CTR-101 and CTR-102", "CTR-101")]


def test_long_needles_are_cut_once(spark):
    """The grams of a needle were cut again for each of them, in one task for all needles."""
    grams = contains._needle_grams(spark.createDataFrame([("a" * 14 + "b" * 9,)], "_needle string"), [], LEVELS)
    assert sorted({r._asked for r in grams.collect()}) == [3] and grams.count() == 3
    assert grams._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= len(LEVELS)
    assert contains._dealt(spark.range(9).repartition(1)).rdd.getNumPartitions() > 1
