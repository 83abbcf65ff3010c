"""Queries read all rows of their tables."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from ledgerloom.operators import invoices as inv
from ledgerloom.plans import catalog_jobs, jobs


def test_billing_report_takes_codes_of_every_page(spark):
    lines = spark.createDataFrame([("b1", "d1", "m1", 10), ("b1", "d2", "m2", 20), ("b1", "d3", "m3", 30)], "billto string, document string, material string, net int").select(
        "*", F.to_date(F.lit("1996-05-01")).alias("invoice_date"), *[F.lit("x").alias(c) for c in ("material_text", "gl_category", "hier_name", "item_category")],
        *[F.lit(1).alias(c) for c in ("tax", "quantity")])
    t = SimpleNamespace(
        questions=spark.createDataFrame([("1", "Acme", "What was billed under CTR-101?")], "question_id string, client string, text string"),
        parties=spark.createDataFrame([("b1", "Acme Corp")], "billto string, billto_name string"),
        invoice_parties=lines,
        contract_codes=spark.createDataFrame([("Acme CTR-101.pdf", 1, "m1"), ("Acme CTR-101.pdf", 2, "m2"), ("Bolt CTR-7.pdf", 2, "m3")], "source_contract string, page int, code string"),
    )
    assert sorted(r.material_code for r in catalog_jobs.billing_report(t).collect()) == ["m1", "m2"]


def test_code_hits_are_summed_once_a_code(spark):
    lines = spark.range(60).select(
        F.col("id").cast("int").alias("line_no"), F.concat(F.lit("d"), F.col("id") % 7).alias("document"), F.to_date(F.lit("1996-05-01")).alias("invoice_date"),
        F.when(F.col("id") % 2 == 0, " m1").otherwise("M2").alias("material"), F.concat(F.lit("text "), "id").alias("material_text"), F.col("id").cast("decimal(18,2)").alias("net"))
    asked = [(q, c) for q in (None, "1", "2", "2", *map(str, range(10, 300))) for c in ("M1", "m1", "M2", "M9")]
    wanted = spark.createDataFrame(asked, "question_id string, code string")
    out = jobs.code_hits_of(lines, wanted)
    want = inv.code_hits(inv.invoice_by_material(lines, wanted), ("question_id", "code"))
    key = lambda r: (r[0] or "", *r[1:])
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    # no more rows meet their code than there are lines: a group by question would hold 292 times as many
    met = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("question_id" not in line for line in met.splitlines() if "Aggregate" in line and "document" in line)
