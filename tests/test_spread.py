"""Joins on few keys, and the queries that need them."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import matching as m
from ledgerloom.operators.spread import meet
from ledgerloom.plans import jobs


def test_meet_is_the_plain_join(spark):
    rng = random.Random(3)
    left = [(rng.choice(["a", "b", None, "c"]), i % 40) for i in range(300)]
    right = [(rng.choice(["a", "b", None, "d"]), i % 50) for i in range(300)]
    l, r = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    want = sorted((k, x, y) for k, x in left for j, y in right if k is not None and k == j)
    for block in (7, 1024):
        assert sorted(tuple(row) for row in meet(l, r, ["k"], block).collect()) == want


def test_pairs_of_one_keyword_are_many_tasks(spark):
    items = spark.range(200).select(F.concat(F.lit("gizmo no "), "id").alias("item"))
    rows = spark.range(20000).select(F.col("id").alias("position"), F.lit("Cards").alias("section"), F.concat(F.lit("red GIZMO "), "id").alias("description"))
    rows = rows.unionByName(rows.where("position = 7").withColumn("description", F.lit("blue no word")))
    keywords = spark.createDataFrame([("gizmo",), ("no ",), ("red",)], "keyword string")
    pairs = m.keyword_pool(items, rows, keywords)
    sizes = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(s["count"] for s in sizes) == 200 * 20000 == pairs.distinct().count()
    assert max(s["count"] for s in sizes) < 200 * 20000 * 0.6


def test_billing_report_of_repeated_questions(spark):
    ask = lambda q, c, text: (q, c, text)
    questions = [ask("1", "Acme", "What was billed under CTR 101 since 1996?"), ask("2", "Acme", "What was billed under CTR 101 since 1996?"),
                 ask("3", "Acme", "Show billing since 1995"), ask("3", "Acme", "Show billing since 1995"), ask("4", "Bolt", "Show billing for CTR-999"),
                 ask("5", "Acme", "Who signed?"), ask(None, "Bolt", "Show billing for CTR-101")]
    lines = [("b1", "d1", "1995-05-01", "m1", 10), ("b1", "d2", "1996-05-01", "m1", 20), ("b1", "d2", "1996-05-01", " m1", 5), ("b1", "d3", "1997-05-01", "m2", 7), ("b2", "d4", "1997-05-01", "m2", 3)]
    table = spark.createDataFrame(lines, "billto string, document string, invoice_date string, material string, net int").select(
        "billto", "document", F.to_date("invoice_date").alias("invoice_date"), "material", "net", *[F.lit("x").alias(c) for c in ("material_text", "gl_category", "hier_name", "item_category")],
        *[F.lit(1).alias(c) for c in ("tax", "quantity")])
    parties = spark.createDataFrame([("b1", "Acme Corp"), ("b2", "Bolt Corp")], "billto string, billto_name string")
    codes = spark.createDataFrame([("Acme CTR-101.pdf", "M1"), ("other", "m2")], "source_contract string, code string")
    out = jobs.billing_report(spark.createDataFrame(questions, "question_id string, client string, text string"), parties, table, codes)
    got = sorted((r.question_id or "", r.client, r.material_code, r.line_count, r.invoice_doc_count, int(r.total_net)) for r in out.collect())
    assert got == sorted([
        ("1", "Acme", "m1", 1, 1, 20), ("1", "Acme", " m1", 1, 1, 5), ("2", "Acme", "m1", 1, 1, 20), ("2", "Acme", " m1", 1, 1, 5),
        ("3", "Acme", "m1", 4, 2, 60), ("3", "Acme", " m1", 2, 1, 10), ("3", "Acme", "m2", 2, 1, 14), ("4", "Bolt", "m2", 1, 1, 3), ("", "Bolt", "m2", 1, 1, 3)])


def test_codes_of_an_id_do_not_multiply_with_its_questions(spark):
    lookups = spark.range(50).select(F.array(F.lit("CTR-1"), F.lit("CTR-2")).alias("_ids"))
    codes = spark.range(400).select(F.concat(F.lit("CTR-1 "), F.col("id") % 90).alias("source_contract"), (F.col("id") % 40).cast("string").alias("code"))
    ids = spark.createDataFrame([("CTR-1",), ("CTR-2",)], "_id string")
    assert jobs.codes_of_ids(lookups, ids, codes).count() == 40
