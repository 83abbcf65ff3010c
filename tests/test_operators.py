"""Operators on small tables, against brute force or stated rules."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.fuzzy import token_set_ratio
from ledgerloom.operators import clauses as cl
from ledgerloom.operators import hierarchy as h
from ledgerloom.operators import invoices as inv
from ledgerloom.operators import matching, parents
from ledgerloom.operators import similarity as sim
from ledgerloom.operators.contains import contains_join, contains_pairs
from ledgerloom.operators.medians import exact_median
from ledgerloom.sources import files, model_output, sinks


def test_contains_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["ab" * rng.randint(1, 9) + rng.choice("xyz") + "".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(60)]
    needles = sorted({w[i:i + n] for w in words for i, n in ((0, 1), (1, 3), (2, 7), (0, 14)) if len(w) >= i + n} | {"zzz"})
    hay = spark.createDataFrame([(w,) for w in words], "t string")
    ndl = spark.createDataFrame([(n,) for n in needles], "n string")
    want = {(w, n) for w in words for n in needles if n in w}
    assert {tuple(r) for r in contains_pairs(hay, ndl, "t", "n").select("t", "n").collect()} == want
    assert {(r.t, r.n) for r in contains_join(hay, ndl, "t", "n").collect()} == want


def test_exact_median(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([-5.25, 0.0, 1.5, 2.0, 1e6, rng.random() * 100])) for k in "aab" for _ in range(101)]
    got = {r.k: r.m for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()}
    assert got == {k: pytest.approx(statistics.median(v for x, v in rows if x == k)) for k in "ab"}


def test_reconcile_one_and_one(spark):
    codes = spark.createDataFrame([("c", "M1", "Old SKU", "a.pdf", "Item", "$1", "3")],
                                  "client string, code string, description string, source_contract string, item string, price string, page string")
    lines = spark.createDataFrame([("c", "INV-9", None, 1, "M9", "New SKU", "", 5.0)],
                                  "client string, document string, invoice_date date, line_no int, material string, material_text string, hier_name string, net double")
    got = {r.bucket: r.invoice_docs for r in inv.reconcile(codes, lines).collect()}
    assert got == {"CONTRACT_ONLY": None, "INVOICE_ONLY": 1}


def test_levels_cycles_and_order(spark):
    rows = [("r", None, 0), ("a", "r", None), ("b", "a", None), ("c", "b", None), ("x", "y", None), ("y", "x", None), ("o", None, -1), ("m", "gone", None)]
    rows += [(f"d{i}", f"d{i - 1}" if i else "r", None) for i in range(25)]
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "key string, parent_key string, level int")
        got.append({r.key: r.level for r in h.assign_levels(df).collect()})
    assert got[0] == got[1]
    lv = got[0]
    assert (lv["r"], lv["a"], lv["b"], lv["c"], lv["o"]) == (0, 1, 2, 3, -1)
    assert lv["x"] is None and lv["m"] is None
    assert lv["d19"] == 20 and lv["d24"] == 25  # however deep


def _forest(spark, rows, citations, codes=()):
    meta = spark.createDataFrame(
        [(f"c/{n}", "c", n, k, e, None, p, "high", 80, None) for n, k, e, p in rows],
        "key string, client string, filename string, contract_type string, effective_date string, signed_date date, parties array<string>, "
        "extraction_confidence string, extraction_score int, is_active boolean",
    ).withColumn("effective_date", F.to_date("effective_date"))
    cites = spark.createDataFrame([("c", f"c/{n}", 0, "parent_reference", q) for n, q in citations],
                                  "client string, key string, position int, source string, quote string")
    marks = spark.createDataFrame([("c", f"c/{n}", v, p) for n, v, p in codes], "client string, key string, value string, position string")
    none = spark.createDataFrame([], "client string, key string, product string")
    out = h.resolve_hierarchy(meta, cites, marks, none, ("vendorco",))
    return {r.filename: r for r in out.collect()}


def test_forest_rules(spark):
    bank, other = ["Vendorco, Inc.", "Harbor Bank"], ["Vendorco LLC", "Atlas Bank"]
    f = _forest(
        spark,
        [
            ("Harbor_m1", "MSA", "2007-07-25", bank), ("Harbor_m2", "Master Agreement", "2007-07-25", bank), ("Atlas_m", "MSA", "2007-07-25", other),
            ("Harbor_am", "Amendment", "2007-07-27", bank), ("Harbor_self", "Amendment", "2016-03-28", bank), ("Harbor_sow", "SOW", "2009-01-01", bank),
            ("Harbor_sw", "Software Agreement", "2007-09-01", bank), ("Harbor_late", "Software Agreement", "2012-09-01", bank),
            ("Harbor_chain", "Purchase Order", "2010-01-01", bank), ("Harbor_chain2", "Purchase Order", "2011-01-01", bank),
        ],
        [
            ("Harbor_am", "Master RMD Agreement dated July 25, 2007"), ("Harbor_self", "AMENDMENT dated as of March 28, 2016"),
            ("Harbor_sow", "under the Master Agreement"), ("Harbor_sw", "Agreement dated 7/25/2007"), ("Harbor_late", "Agreement dated 7/25/2007"),
        ],
        [("Harbor_chain", "Contract 2035", "printed_body"), ("Harbor_chain2", "Order #2035", "handwritten_margin")],
    )
    assert f["Harbor_am"].parent_key == "c/Harbor_m1" and f["Harbor_am"].level == 1  # the copies fold, the other entity is ignored
    assert f["Harbor_m2"].duplicate_of == "c/Harbor_m1" and f["Harbor_m2"].status == "Duplicate"
    assert f["Harbor_self"].status == "Orphan"  # its own date is no citation
    assert f["Harbor_sow"].method == "single_msa_fallback" and f["Harbor_sow"].parent_key == "c/Harbor_m1"
    assert f["Harbor_sw"].method == "reference"  # within the bundle window
    assert f["Harbor_late"].method == "miscellaneous" and f["Harbor_late"].level == 0
    assert f["Harbor_chain"].method == "chain_root" and f["Harbor_chain2"].parent_key == "c/Harbor_chain"
    for r in f.values():
        if r.parent_key:
            parent = next(p for p in f.values() if p.key == r.parent_key)
            assert r.level == parent.level + 1


def test_tied_parents_refused(spark):
    f = _forest(
        spark,
        [("Bank_a", "MSA", "2001-01-01", ["Alpha East"]), ("Bank_b", "Services Agreement", "2001-01-01", ["Alpha West"]), ("Bank_c", "Amendment", "2005-05-05", [])],
        [("Bank_c", "Agreement dated January 1, 2001")],
    )
    assert f["Bank_c"].status == "Orphan" and f["Bank_c"].is_ambiguous


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["monthly", "setup", "card", "fee", "core", "ledger", "annual", "a", "account"]
    left = [(i, " ".join(rng.choices(words, k=3))) for i in range(25)]
    right = [(i, " ".join(rng.choices(words, k=3))) for i in range(25)]
    q = spark.createDataFrame(left, "q bigint, text string").withColumn("g", F.lit("x"))
    c = spark.createDataFrame(right, "c bigint, text string").withColumn("g", F.lit("x"))
    qc, cc = sim.gram_counts(q, ["g", "q"], "text"), sim.gram_counts(c, ["g", "c"], "text")
    idf = sim.gram_idf(cc, ["g", "c"], ["g"])
    qv, cv = sim.unit_vectors(qc, idf, ["g", "q"], ["g"]).cache(), sim.unit_vectors(cc, idf, ["g", "c"], ["g"]).cache()
    every = q.select("g", "q").join(c.select("g", "c"), "g")
    want = {(r.q, r.c): r.cosine for r in sim.cosine_of(every, qv, cv, ["g"]).collect() if r.cosine >= 0.4}
    for found in (sim.similar_pairs(qv, cv, 0.4, ["g"]), sim.similar_pairs_blocked(qv, cv, 0.4, ["g"], block=7)):
        assert {(r.q, r.c): pytest.approx(r.cosine) for r in found.collect()} == want


def test_product_spelling(spark):
    terms = spark.createDataFrame([("d_v1.csv", 1, "Old"), ("d_v2.csv", 1, "SecureNow"), ("d_v2.csv", 2, "ACH Manager"), ("d_v2.csv", 3, "X")],
                                  "file string, position int, term string")
    names = spark.createDataFrame([("SecureNow Services Schedule to the Exhibit",), ("ach mananger",), ("Old",), ("X Services",)], "product string")
    got = {r.product: r.canonical for r in matching.canonical_products(names, matching.product_dictionary(terms)).collect()}
    assert got == {"SecureNow Services Schedule to the Exhibit": "SecureNow", "ach mananger": "ACH Manager", "Old": None, "X Services": "X"}


def test_snippets_merge_like_the_greedy_rule(spark):
    texts = ["uptime of the core system is 99 percent", "uptime of the core system is 99 percent each month", "downtime credits apply",
             "Downtime credits apply", "an outage of the card network"]
    hits = spark.createDataFrame([("c", "f.pdf", "sla", i + 1, 0, t) for i, t in enumerate(texts)],
                                 "client string, filename string, family string, page int, at int, snippet string")
    kept = []
    for t in texts:
        n = t.lower()
        near = next((k for k in kept if token_set_ratio(k[1], n) >= 70), None)
        if near is None:
            kept.append([t, n])
        elif len(t) > len(near[0]):
            near[:] = [t, n]
    got = [r.snippet for r in cl.dedupe_snippets(hits).orderBy("position").collect()]
    assert got == [k[0] for k in kept]


def test_phrases_and_windows(spark):
    pages = spark.createDataFrame([("c", "Master.pdf", 2, "The (Service-Level) was met. ﬁve days of early  termination fee due")],
                                  "client string, filename string, page int, text string")
    rows = {(r.family, r.at): r.snippet for r in cl.keyword_hits(pages).collect()}
    assert set(rows) == {("sla", 1), ("termination", 7), ("termination", 8)}
    assert rows[("sla", 1)].startswith("(File: Master.pdf - Page 2) The (Service-Level)")


def test_nearest_date(spark):
    rows = [("a", "c", "a", 0, "2001-01-01"), ("b", "c", "b", 0, "2003-01-01"), ("b2", "c", "b2", 0, "2003-02-01"), ("k", "c", "k", 1, "2003-02-15")]
    c = spark.createDataFrame(rows, "key string, client string, filename string, hrank int, effective_date string").withColumn(
        "effective_date", F.to_date("effective_date"))
    got = parents.parent_by_nearest_date(c, c).collect()
    assert [(r.key, r.parent_key, r.is_ambiguous) for r in got] == [("k", "b2", True)]


def test_conform(spark):
    df = spark.createDataFrame([(1, "m")], "DOC int, material string")
    rows, report = files.conform(df, ["document", "material", "url"], {"document": ["doc"]}, required=("material",), sort_column="document")
    assert rows.collect() == [(1, "m", "")]
    r = report.first()
    assert (r.present, r.missing, r.aliased, r.can_sort) == (["document", "material"], ["url"], ["document=DOC"], True)
    with pytest.raises(ValueError):
        files.conform(df, ["x"], required=("x",))


def test_folder_scan(spark, tmp_path):
    for name in ("Acme/Master 1-2-2020.pdf", "Acme/notes.xlsx", "Beta/deal.DOCX"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    paths = files.list_files(spark, str(tmp_path))
    asked = spark.createDataFrame([("Acme",), ("Nobody",)], "client string")
    found, unknown = files.scan_contracts(paths, asked)
    assert [(r.client, r.filename, str(r.filename_date)) for r in found.collect()] == [("Acme", "Master 1-2-2020.pdf", "2020-01-02")]
    assert [r.client for r in unknown.collect()] == ["Nobody"]


def test_partition_overwrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "stage")
    schema = "client string, n int"
    assert sinks.read_stage(spark, path, schema).count() == 0
    sinks.write_stage(spark.createDataFrame([("a", 1), ("b", 2)], schema), path)
    sinks.write_stage(spark.createDataFrame([("b", 3)], schema), path)
    sinks.write_stage(spark.createDataFrame([], schema), path)
    assert sorted((r.client, r.n) for r in sinks.read_stage(spark, path, schema).collect()) == [("a", 1), ("b", 3)]


def test_truncated_reply(spark):
    text = '```json\n{"results": [{"row_id": 1, "code": "A"}, {"row_id": 2, "code": "B"}, {"row_id": 3, "co'
    rows, bad = model_output.parse_model_output(spark.createDataFrame([(text,), ("no",)], "reply string"), "reply", "row_id int, code string", "results")
    assert [(r.row_id, r.code) for r in rows.collect()] == [(1, "A"), (2, "B")] and bad.count() == 1


def test_deep_chains_keep_their_levels(spark):
    from ledgerloom.operators import hierarchy as h

    rows = [(f"k{i}", f"k{i - 1}" if i else None, 0 if i == 0 else None) for i in range(26)] + [("a", "b", None), ("b", "a", None), ("c", "gone", None), ("o", None, -1)]
    levels = {r.key: r.level for r in h.assign_levels(spark.createDataFrame(rows, "key string, parent_key string, level int")).collect()}
    assert [levels[f"k{i}"] for i in range(26)] == list(range(26))
    assert levels["a"] is levels["b"] is levels["c"] is None and levels["o"] == -1


def test_any_number_of_generic_words_is_stripped(spark):
    from ledgerloom.operators import matching

    names = spark.createDataFrame([("ab" + " service" * n,) for n in (1, 6, 8, 15)] + [("zz service",)], "product string")
    dictionary = spark.createDataFrame([("ab", "AB")], "norm string, canonical string")
    found = {r["product"]: r.canonical for r in matching.canonical_products(names, dictionary, suffixes=("service",), close=False).collect()}
    assert found["ab" + " service" * 8] == found["ab" + " service" * 15] == "AB" and found["zz service"] is None


def test_close_spelling_does_not_depend_on_the_cut(spark):
    from ledgerloom.functions.fuzzy import all_scores

    texts, tide = spark.createDataFrame([("abcd",)], "t string"), spark.createDataFrame([("tide",)], "c string")
    choices = spark.createDataFrame([(f"abcd{c}",) for c in "abcde"], "c string")
    for chunk in (1, 500):
        got = [(r.choice, round(r.score, 2)) for r in all_scores(texts, choices, "t", "c", "sequence", 20.0, True, chunk).collect()]
        assert got == [("abcde", 88.89)]
    diet = spark.createDataFrame([("diet",)], "t string")
    assert [r.score for r in all_scores(diet, tide, "t", "c", "sequence", 20.0, True).collect()] == [25.0]


def test_lookups_read_every_line(spark):
    from ledgerloom.operators import invoices as inv

    lines = spark.range(3000).selectExpr("cast(id as string) as document", "'X1' as material")
    asked = spark.createDataFrame([(1, "x1")], "question_id int, code string")
    assert inv.invoice_by_material(lines, asked).count() == 3000


def test_billing_texts_and_medians_are_shuffled_once(spark):
    from ledgerloom.functions.names import norm_company
    from ledgerloom.operators import invoices as inv
    from ledgerloom.operators import validation as v

    lines = spark.createDataFrame(
        [("A", "d1", 1, "m1", "The Fee & Co", 10.0, 2.0), ("A", "d1", 2, "m1", "The Fee & Co", 30.0, 2.0), ("A", "d2", 1, "m2", "fee company", -8.0, 1.0), ("B", "d2", 1, "m1", "", 5.0, 0.0)],
        "client string, document string, line_no int, material string, material_text string, net double, quantity double",
    ).withColumn("invoice_date", F.to_date(F.lit("2020-01-01"))).withColumn("hier_name", F.lit("Hier"))
    codes = spark.createDataFrame(
        [("A", "k.pdf", "2", "m1", "x", "", "$1"), ("A", "k.pdf", "1.0", "m1", "x", "", "$2"), ("A", "k.pdf", "3", "q9", "FEE COMPANY", "", "$3"), ("A", "", "4", "q8", "none", "", "")],
        "client string, source_contract string, page string, code string, description string, item string, price string")
    got = sorted(tuple(r) for r in inv.reconcile(codes, lines).select("bucket", "client", F.coalesce("code", F.lit("")), F.coalesce("contract_pages", F.lit("-")), F.coalesce("invoice_code", F.lit("")), F.coalesce("invoice_docs", F.lit(0))).collect())
    assert got == [("CONTRACT_ONLY", "A", "q8", "-", "", 0), ("INVOICE_ONLY", "A", "", "-", "m2", 1), ("INVOICE_ONLY", "B", "", "-", "m1", 1), ("MATCH", "A", "m1", "1,2", "m1", 1),
                   ("MATCH", "A", "m1", "1,2", "m1", 1), ("MISMATCH", "A", "q9", "3", "m1", 2)]
    stats = v.code_stats(lines)
    assert sorted((r.client, r.code, r.median_net, r.median_unit) for r in stats.collect()) == [("A", "m1", 20.0, 10.0), ("A", "m2", -8.0, 8.0), ("B", "m1", 5.0, None)]
    asked = spark.createDataFrame([("A", "i1", 9.0), ("A", "i2", 21.0), ("A", "i2", 21.0), ("A", "i3", 0.0), ("B", "i4", 6.0)], "client string, item_id string, unit_price double")
    band = v.price_band_codes(asked, stats)
    assert sorted(map(tuple, band.collect())) == [("A", "i1", "m1"), ("A", "i1", "m2"), ("A", "i2", "m1"), ("A", "i2", "m1"), ("B", "i4", "m1")]
    # two shuffles for the distinct counts, one for all medians; the join has none
    assert stats._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 3


def test_norm_company_of_odd_texts(col):
    from ledgerloom.functions.names import norm_company

    texts = ["FCU & CO", "the corp of a", "", None, "Natl Assn", "red  anvil & LARGE", "COOP inc-co", "F.C.U. intl"]
    assert col(norm_company, texts) == [
        "FEDERAL CREDIT UNION COMPANY", "CORPORATION", "", "", "NATIONAL ASSOCIATION", "RED ANVIL LARGE", "COOP COMPANY", "FEDERAL CREDIT UNION INTERNATIONAL"]
