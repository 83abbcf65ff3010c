"""Invoice lines: scoping, lookups, billing history, totals, reconciliation.

`lines` is the invoice line table. `scope` is a table (client, billto) or (client, soldto)
that says which lines belong to which client; joining it on the code column is the only
way lines are narrowed, so one plan serves one client or all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import page_number
from ledgerloom.functions.names import name_variants, norm_company, norm_strict
from ledgerloom.functions.questions import code_tokens
from ledgerloom.functions.text import nonblank, strip, text_or_blank
from ledgerloom.operators.contains import contains_join, contains_pairs, merged

NEWEST = ("invoice_date", "document", "line_no", "material", "net")


def newest_first(*extra: str) -> list[Column]:
    """Total order of lines: newest date, then document and the line's own values."""
    return [F.col("invoice_date").desc_nulls_last(), *[F.col(c) for c in (*NEWEST[1:], *extra)]]


def _age(date: str = "invoice_date") -> Column:
    """Ascending key of the newest-first order, undated last."""
    return F.coalesce(-F.unix_date(date), F.lit(2**31 - 1))


def _line_order() -> Column:
    return F.struct(_age(), "document", "line_no", "material", "net")


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First `n` rows per group; the rank filter is applied before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ------------------------------------------------------------------ names and scope


def score_names(clients: DataFrame, stored: DataFrame, name: str, threshold: int = 90) -> DataFrame:
    """(client, stored name, score): 100 equal, 95 strict substring, 90 raw substring.

    `clients` has a `client` column; `stored` the column `name`. Any acronym variant of
    the client may hit; the best tier counts.
    """
    names = (
        stored.select(strip(F.col(name)).alias(name)).distinct()
        .withColumn("_strict", norm_strict(F.col(name)))
        .where(F.col("_strict") != "")
    )
    variants = (
        clients.select("client").distinct()
        .withColumn("_v", F.explode(name_variants(F.col("client"))))
        .withColumn("_vstrict", norm_strict(F.col("_v")))
        .where(F.col("_vstrict") != "")
        .select("client", "_vstrict").distinct()
    )
    # raw substring implies strict substring, so the strict pairs hold every tier
    tier = F.when(F.col("_vstrict") == F.col("_strict"), 100).otherwise(95)
    hits = contains_pairs(names, variants, "_strict", "_vstrict").withColumn("_score", tier)
    return (
        hits.where(F.col("_score") >= threshold)
        .join(merged(variants), "_vstrict")
        .groupBy("client", "_strict")
        .agg(F.max("_score").alias("score"))
        .join(merged(names), "_strict")
        .select("client", name, "score")
    )


def bridge_names(clients: DataFrame, lines: DataFrame, threshold: int = 90) -> DataFrame:
    """Bill-to codes whose name matches the client, best score first, shorter name first."""
    pairs = distinct_billto(lines)
    scored = score_names(clients, pairs, "billto_name", threshold)
    order = Window.partitionBy("client").orderBy(
        F.desc("score"), F.length(norm_strict(F.col("billto_name"))), "billto_name", "billto"
    )
    return (
        scored.join(merged(pairs.withColumn("billto_name", strip(F.col("billto_name")))), "billto_name")
        .withColumn("position", F.row_number().over(order))
    )


def distinct_billto(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("billto_name").isNotNull()).select("billto", "billto_name").distinct()


def party_pairs(lines: DataFrame) -> DataFrame:
    return lines.select("billto", "billto_name", "soldto", "soldto_name").distinct()


def resolve_scope(clients: DataFrame, parties: DataFrame, threshold: int = 90) -> DataFrame:
    """(client, kind, value): sold-tos of matched bill-tos and of matching sold-to names, else bill-tos.

    `parties` is one row per (billto, soldto) with their names: `party_pairs(lines)` or a party table.
    """
    named = parties.select(
        "billto", strip(F.col("soldto")).alias("soldto"),
        F.explode(
            F.array(
                F.struct(F.lit("billto").alias("via"), strip(F.col("billto_name")).alias("name")),
                F.struct(F.lit("soldto").alias("via"), strip(F.col("soldto_name")).alias("name")),
            )
        ).alias("n"),
    ).select("billto", "soldto", "n.via", "n.name")
    matched = score_names(clients, named, "name", threshold).join(merged(named), "name")
    soldtos = (
        matched.where(F.col("soldto") != "")
        .select("client", F.lit("soldto").alias("kind"), F.col("soldto").alias("value")).distinct()
    )
    fallback = (
        matched.where(F.col("via") == "billto")
        .select("client", F.lit("billto").alias("kind"), F.col("billto").alias("value")).distinct()
        .join(soldtos.select("client").distinct(), "client", "left_anti")
    )
    return soldtos.unionByName(fallback)


def scope_labels(scope: DataFrame) -> DataFrame:
    """One label per client: the first four sold-tos, or the number of bill-tos."""
    first = top_per(scope, ["client", "kind"], [F.col("value")], 4)
    names = first.groupBy("client", "kind").agg(F.array_sort(F.collect_list("value")).alias("_first"))
    sizes = scope.groupBy("client", "kind").agg(F.count(F.lit(1)).alias("n_values"))
    label = F.when(F.col("kind") == "soldto", F.concat(F.lit("sold-to "), F.array_join("_first", ", "))).otherwise(
        F.concat(F.col("n_values").cast("string"), F.lit(" bill-to(s)"))
    )
    return sizes.join(names, ["client", "kind"]).select("client", "kind", "n_values", label.alias("label"))


def lines_in_scope(lines: DataFrame, scope: DataFrame, parties: DataFrame) -> DataFrame:
    """Lines tagged with every client whose scope they fall in.

    The scope is turned into (billto, soldto) pairs first, so the lines are read and joined once.
    """
    pairs = parties.select("billto", "soldto").distinct()
    by_kind = [
        pairs.join(scope.where(F.col("kind") == k).select("client", F.col("value").alias(k)), k)
        for k in ("soldto", "billto")
    ]
    tags = by_kind[0].unionByName(by_kind[1]).select(
        "client", F.coalesce("billto", F.lit("")).alias("_b"), F.coalesce("soldto", F.lit("")).alias("_s")
    ).distinct()
    keyed = lines.withColumn("_b", F.coalesce("billto", F.lit(""))).withColumn("_s", F.coalesce("soldto", F.lit("")))
    return keyed.join(tags, ["_b", "_s"]).drop("_b", "_s")


# ------------------------------------------------------------------ line lookups


def invoice_recent(lines: DataFrame, scope: DataFrame, n: int = 400) -> DataFrame:
    """Each client's newest `n` lines; `scope` is (client, billto)."""
    tagged = lines.join(merged(scope.select("client", "billto").distinct()), "billto")
    return top_per(tagged, ["client"], newest_first(), n)


def invoice_by_document(lines: DataFrame, asked: DataFrame, n: int | None = None) -> DataFrame:
    """Lines of the asked documents of each question, whoever was billed; all of them, or the newest `n`."""
    wanted = asked.select("question_id", strip(F.col("document")).alias("document")).distinct()
    rows = lines.join(wanted, "document")
    return rows if n is None else top_per(rows, ["question_id"], newest_first(), n)


def invoice_by_material(lines: DataFrame, asked: DataFrame, by_client: bool = False, n: int | None = None) -> DataFrame:
    """Full-history lines of the asked codes, or the newest `n`; `by_client` keeps the asking client's own (scoped) lines."""
    wanted = asked.withColumn("_code", F.upper(strip(F.col("code")))).drop("code").distinct()
    keyed = lines.withColumn("_code", F.upper(strip(F.col("material"))))
    on = ["_code", "client"] if by_client else ["_code"]
    hits = keyed.join(wanted, on).withColumnRenamed("_code", "code")
    return hits if n is None else top_per(hits, ["question_id"], newest_first(), n)


def question_codes(questions: DataFrame, known: DataFrame, most: int = 12) -> DataFrame:
    """(question_id, code, position): code-shaped tokens in order, then known codes named verbatim."""
    shaped = questions.select("question_id", F.posexplode(code_tokens(F.col("text"))).alias("position", "code")).select(
        "question_id", "code", F.lit(0).alias("_rank"), "position"
    )
    codes = known.select(F.upper(strip(F.col("code"))).alias("code")).where(F.col("code") != "").distinct()
    upper = questions.select("question_id", F.upper("text").alias("_text"))
    named = (
        contains_join(upper, codes, "_text", "code")
        .where(
            F.rlike(
                F.col("_text"),
                F.concat(F.lit(r"\b\Q"), F.col("code"), F.lit(r"\E\b")),
            )
        )
        .select("question_id", "code", F.lit(1).alias("_rank"), F.lit(0).alias("position"))
    )
    best = (
        shaped.unionByName(named)
        .groupBy("question_id", "code")
        .agg(F.min(F.struct("_rank", "position")).alias("_at"))
    )
    w = Window.partitionBy("question_id").orderBy("_at", "code")
    return (
        best.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= most)
        .select("question_id", "code", "position")
    )


def missing_documents(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """Asked documents no line carries."""
    have = lines.select(strip(F.col("document")).alias("document"))
    return asked.select("question_id", "document").distinct().join(have, "document", "left_anti")


def cross_client_documents(asked: DataFrame, lines: DataFrame, focus: DataFrame) -> DataFrame:
    """Asked documents billed to a bill-to outside the question's focus; `focus` is (question_id, billto)."""
    found = (
        asked.select("question_id", "document").distinct()
        .join(lines.select("document", "billto").distinct(), "document")
        .join(focus.select("question_id").distinct(), "question_id", "left_semi")
    )
    return found.join(focus.select("question_id", "billto").distinct(), ["question_id", "billto"], "left_anti")


def billed_or_not(asked: DataFrame, lines: DataFrame, scope: DataFrame, parties: DataFrame) -> DataFrame:
    """Per (question, client, code): billed; or, when no focused client was billed, who else was.

    `asked` is (question_id, client, code), codes upper case.
    """
    keyed = lines.withColumn("code", F.upper(strip(F.col("material"))))
    asked_codes = asked.select("code").distinct()
    asked_lines = keyed.join(asked_codes, "code", "left_semi")
    in_scope = (
        lines_in_scope(asked_lines, scope, parties).groupBy("client", "code").agg(F.count(F.lit(1)).alias("lines"))
    )
    flagged = asked.join(in_scope, ["client", "code"], "left").withColumn("billed", F.col("lines").isNotNull())
    anywhere = flagged.groupBy("question_id", "code").agg(F.max("billed").alias("_in_focus"))
    buyers = (
        asked_lines.where(nonblank(F.col("billto_name")).isNotNull())
        .groupBy("code", strip(F.col("billto_name")).alias("billto_name"))
        .agg(F.min(_line_order()).alias("_first"))
    )
    others = (
        top_per(buyers, ["code"], [F.col("_first"), F.col("billto_name")], 3)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list(F.struct("_first", "billto_name"))).alias("_named"))
        .select("code", F.array_join(F.transform("_named", lambda x: x["billto_name"]), ", ").alias("_others"))
    )
    status = (
        F.when(F.col("billed"), "billed")
        .when(F.col("_in_focus"), "not billed")
        .when(F.col("_others").isNotNull(), "other customers")
        .otherwise("nowhere")
    )
    return (
        flagged.join(anywhere, ["question_id", "code"])
        .join(others, "code", "left")
        .select(
            "question_id", "client", "code", F.coalesce("lines", F.lit(0)).alias("lines"), status.alias("status"),
            F.when(status == "other customers", F.col("_others")).otherwise(F.lit("")).alias("others"),
        )
    )


def url_registry(lines: DataFrame) -> DataFrame:
    """Every document with the URL of its first line; missing URLs are blank."""
    return (
        lines.withColumn("document", strip(F.col("document"))).where(F.col("document") != "")
        .groupBy("document")
        .agg(F.min_by(text_or_blank(F.col("url")), F.struct(_age(), "line_no", "material", "net", "url")).alias("url"))
    )


# ------------------------------------------------------------------ aggregates


def billing_type(months: Column) -> Column:
    return F.when(months >= 6, "RECURRING").when(months >= 2, "PERIODIC").otherwise("ONE_TIME")


def billing_history(
    lines: DataFrame,
    by: tuple[str, ...] = (),
    codes: DataFrame | None = None,
    date_from: Column | None = None,
    date_to: Column | None = None,
) -> DataFrame:
    """Every code ever billed, one row per (by, code, category), nothing capped.

    `codes` narrows by (by, material); dates bound `invoice_date` inclusively.
    """
    rows = lines.where(strip(F.col("material")) != "")
    if date_from is not None:
        rows = rows.where(date_from.isNull() | (F.col("invoice_date") >= date_from))
    if date_to is not None:
        rows = rows.where(date_to.isNull() | (F.col("invoice_date") <= date_to))
    if codes is not None:
        rows = rows.join(codes.select(*by, "material").distinct(), [*by, "material"], "left_semi")

    def amount(c):
        return F.col(c).try_cast("decimal(38,4)")

    return (
        rows.groupBy(*by, F.col("material").alias("material_code"), "item_category")
        .agg(
            F.min("material_text").alias("material_description"),
            F.min("gl_category").alias("gl_category"),
            F.min("hier_name").alias("product_hierarchy"),
            F.count(F.lit(1)).alias("line_count"),
            F.countDistinct("document").alias("invoice_doc_count"),
            F.countDistinct(F.trunc("invoice_date", "month")).alias("distinct_months"),
            F.min("invoice_date").alias("first_billed"),
            F.max("invoice_date").alias("last_billed"),
            F.sum(amount("net")).alias("total_net"),
            F.sum(amount("tax")).alias("total_tax"),
            F.sum(amount("quantity")).alias("total_quantity"),
            F.min(amount("net")).alias("min_net"),
            F.max(amount("net")).alias("max_net"),
        )
        .withColumn("billing_type", billing_type(F.col("distinct_months")))
    )


def history_order() -> list[Column]:
    """Report order of a billing history."""
    kind = F.when(F.col("billing_type") == "ONE_TIME", 1).when(F.col("billing_type") == "PERIODIC", 2).otherwise(3)
    return [kind, F.col("first_billed"), F.col("total_net").desc(), F.col("material_code"), F.col("item_category")]


def history_coverage(history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals over a history. `doc_code_pairs` adds per-code document counts, so shared documents count again."""

    def of(kind):
        return F.count_if(F.col("billing_type") == kind)

    return history.groupBy(*by).agg(
        F.count(F.lit(1)).alias("codes"),
        F.sum("line_count").alias("lines"),
        F.sum("invoice_doc_count").alias("doc_code_pairs"),
        F.sum("total_net").alias("net"),
        of("ONE_TIME").alias("one_time"),
        of("PERIODIC").alias("periodic"),
        of("RECURRING").alias("recurring"),
    )


def invoice_totals(lines: DataFrame) -> DataFrame:
    """Net, tax, gross and line count per document, plus the grand total (document null)."""
    return (
        lines.rollup("document")
        .agg(
            F.sum("net").alias("net"),
            F.sum("tax").alias("tax"),
            F.sum(F.col("net") + F.col("tax")).alias("gross"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def invoice_codes(lines: DataFrame) -> DataFrame:
    """Every code of every document with its line count and first non-blank text."""
    text = nonblank(F.col("material_text"))
    return (
        lines.where(nonblank(F.col("material")).isNotNull())
        .groupBy("document", strip(F.col("material")).alias("code"))
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.coalesce(
                F.substring(F.min_by(text, F.when(text.isNotNull(), F.struct("line_no", "net", "material_text"))), 1, 40),
                F.lit(""),
            ).alias("text"),
        )
    )


def code_hits(hits: DataFrame, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Per asked code: lines, documents, net, sample text, first three documents."""
    text = nonblank(F.col("material_text"))
    docs = hits.groupBy(*by, "document").agg(
        F.min(_age()).alias("_age"),
        F.max("invoice_date").alias("invoice_date"),
        F.sum("net").alias("net"),
        F.count(F.lit(1)).alias("lines"),
        F.min(F.when(text.isNotNull(), F.struct(_line_order().alias("o"), text.alias("t")))).alias("_text"),
    )
    totals = docs.groupBy(*by).agg(
        F.sum("lines").alias("lines"),
        F.count(F.lit(1)).alias("documents"),
        F.sum("net").alias("net"),
        F.substring(F.min("_text")["t"], 1, 50).alias("sample_text"),
    )
    example = F.concat(F.col("document"), F.lit(" ("), F.col("invoice_date").cast("string"), F.lit(", net $"),
                       F.format_number("net", 2), F.lit(")"))
    first = (
        top_per(docs, list(by), [F.col("_age"), F.col("document")], 3)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("_age", "document", example.alias("e")))).alias("_l"))
        .select(*by, F.array_join(F.transform("_l", lambda x: x["e"]), "; ").alias("examples"))
    )
    return totals.join(first, list(by))


def invoice_detail(lines: DataFrame, by: tuple[str, ...] = ("client",), invoices: int = 20, per_invoice: int = 15):
    """(headers, details): newest invoices of each client, their totals, and their first lines.

    Headers count the invoices left out and the lines not shown; nothing else is lost.
    """
    keys = list(by)
    docs = lines.groupBy(*keys, "document").agg(
        F.max("invoice_date").alias("invoice_date"),
        F.count(F.lit(1)).alias("lines"),
        F.countDistinct("material").alias("codes"),
        F.sum("net").alias("net"),
        F.sum("tax").alias("tax"),
    )
    counts = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_docs"))
    w = Window.partitionBy(*keys).orderBy(F.col("invoice_date").desc_nulls_last(), "document")
    shown = docs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= invoices)
    headers = shown.join(counts, keys).select(
        *keys, "document", "invoice_date", "position", "lines", "codes", "net", "tax",
        (F.col("net") + F.col("tax")).alias("gross"),
        F.greatest(F.col("lines") - per_invoice, F.lit(0)).alias("hidden_lines"),
        F.greatest(F.col("_docs") - invoices, F.lit(0)).alias("skipped_invoices"),
        (F.col("position") == 1).alias("most_recent"),
    )
    details = top_per(
        lines.join(shown.select(*keys, "document"), [*keys, "document"], "left_semi"),
        [*keys, "document"], newest_first(), per_invoice,
    )
    return headers, details


# ------------------------------------------------------------------ contract codes against billing


def with_norm(rows: DataFrame, text: Column) -> DataFrame:
    """Adds `norm`, the company normal form of a text, row by row: a join by text would shuffle every row, most of them
    to the tasks of a few common texts. As a generated column it is not worked out again where it is filtered."""
    return rows.withColumn("norm", F.explode(F.array(norm_company(text))))


def contract_rows(codes: DataFrame) -> DataFrame:
    """Contract code rows with clean text, page number and normalised description; blank codes dropped."""
    clean = codes.select(
        "client",
        text_or_blank(F.col("source_contract")).alias("source_contract"),
        text_or_blank(F.col("code")).alias("code"),
        text_or_blank(F.col("description")).alias("description"),
        text_or_blank(F.col("item")).alias("item"),
        text_or_blank(F.col("price")).alias("price"),
        page_number(F.col("page")).alias("page"),
    ).where(F.col("code") != "")
    named = F.when(F.col("description") != "", F.col("description")).otherwise(F.col("item"))
    return with_norm(clean.withColumn("named", named), F.col("named"))


_ROW_ORDER = ("source_contract", "page", "named", "item", "price")


def contract_code_map(rows: DataFrame) -> DataFrame:
    """First record of every (client, code)."""
    first = F.min_by(F.struct("named", "source_contract", "item", "price"), F.struct(*_ROW_ORDER))
    return rows.groupBy("client", "code").agg(first.alias("r"), F.count(F.lit(1)).alias("rows")).select(
        "client", "code", "r.named", "r.source_contract", "r.item", "r.price", "rows"
    )


def code_by_norm(rows: DataFrame) -> DataFrame:
    """First code of every normalised description of a client."""
    return rows.where(F.col("norm") != "").groupBy("client", "norm").agg(
        F.min_by("code", F.struct(*_ROW_ORDER, "code")).alias("code")
    )


def code_pages(rows: DataFrame, by: tuple[str, ...] = ("client", "code", "source_contract")) -> DataFrame:
    """Sorted distinct pages a code is on, per contract (or per code)."""
    return (
        rows.where(F.col("page").isNotNull() & (F.col("source_contract") != ""))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set("page")).alias("pages"))
    )


def _billed_sides(lines: DataFrame):
    """Billing by code and by normalised text, per client; text of the newest line."""
    clean = lines.select(
        "client", "document",
        text_or_blank(F.col("material")).alias("code"),
        text_or_blank(F.col("material_text")).alias("text"),
        text_or_blank(F.col("hier_name")).alias("hier"),
        _line_order().alias("_at"),
    )
    shown = F.when(F.col("text") != "", F.col("text")).otherwise(F.col("hier"))
    clean = with_norm(clean, shown)
    first = F.min(F.struct("_at", "code", "text", "hier"))
    # dealt by their keys at once, as distinct documents would otherwise shuffle the lines twice
    by_code = (
        clean.where(F.col("code") != "").drop("norm").repartition("client", "code").groupBy("client", "code")
        .agg(first.alias("f"), F.countDistinct("document").alias("docs"))
        .select("client", "code", F.col("f.text").alias("text"), F.col("f.hier").alias("hier"), "docs")
    )
    by_norm = (
        clean.where(F.col("norm") != "").repartition("client", "norm").groupBy("client", "norm")
        .agg(first.alias("f"), F.countDistinct("document").alias("docs"))
        .select("client", "norm", F.col("f.code").alias("invoice_code"), F.col("f.text").alias("text"), "docs")
    )
    return clean, by_code, by_norm


def reconcile(codes: DataFrame, lines: DataFrame) -> DataFrame:
    """Contract codes against billed codes of the same client.

    MATCH: the code is billed. MISMATCH: the same description is billed under another code.
    CONTRACT_ONLY: neither. INVOICE_ONLY: a billed code no contract row accounts for.
    """
    rows = contract_rows(codes)
    _, by_code, by_norm = _billed_sides(lines)
    page = F.when(F.col("source_contract") != "", F.col("page"))
    pages = F.array_sort(F.collect_set(page).over(Window.partitionBy("client", "code", "source_contract")))
    walked = (
        rows.join(
            merged(by_norm.where(F.col("invoice_code") != "").select(
                "client", "norm", F.col("invoice_code").alias("n_code"), F.col("text").alias("n_text"),
                F.col("docs").alias("n_docs"),
            )),
            ["client", "norm"], "left",
        )
        .join(
            merged(by_code.select("client", "code", F.col("text").alias("c_text"), F.col("docs").alias("c_docs"))),
            ["client", "code"], "left",
        )
        # the pages of a code are in the task that the join by code has put its rows into
        .withColumn("pages", pages)
        .withColumn("pages", F.when(F.col("client").isNotNull() & (F.size("pages") > 0), F.col("pages")))
        .withColumn(
            "bucket",
            F.when(F.col("c_docs").isNotNull(), "MATCH")
            .when(F.col("n_docs").isNotNull(), "MISMATCH")
            .otherwise("CONTRACT_ONLY"),
        )
        .withColumn(
            "invoice_code",
            F.when(F.col("bucket") == "MATCH", F.col("code")).when(F.col("bucket") == "MISMATCH", F.col("n_code")),
        )
    )
    contract_side = walked.select(
        "bucket", "client", "code", F.col("named").alias("description"), "source_contract", "price",
        F.array_join("pages", ",").alias("contract_pages"), "invoice_code",
        F.when(F.col("bucket") == "MATCH", F.col("c_text"))
        .when(F.col("bucket") == "MISMATCH", F.col("n_text")).alias("invoice_text"),
        F.when(F.col("bucket") == "MATCH", F.col("c_docs"))
        .when(F.col("bucket") == "MISMATCH", F.col("n_docs")).alias("invoice_docs"),
    )
    accounted = (
        walked.select("client", "code")
        .unionByName(walked.where(F.col("invoice_code").isNotNull()).select("client", F.col("invoice_code").alias("code")))
        .distinct()
    )
    invoice_only = by_code.join(accounted, ["client", "code"], "left_anti").select(
        F.lit("INVOICE_ONLY").alias("bucket"), "client",
        F.lit(None).cast("string").alias("code"), F.col("hier").alias("description"),
        F.lit(None).cast("string").alias("source_contract"), F.lit(None).cast("string").alias("price"),
        F.lit(None).cast("string").alias("contract_pages"), F.col("code").alias("invoice_code"),
        F.col("text").alias("invoice_text"), F.col("docs").alias("invoice_docs"),
    )
    return contract_side.unionByName(invoice_only)


def reconcile_documents(reconciled: DataFrame, lines: DataFrame) -> DataFrame:
    """The invoice documents behind every reconciled code, one row each.

    A MISMATCH is backed by the documents of the shared description, the rest by their code.
    """
    clean, _, _ = _billed_sides(lines)
    by_code = (
        reconciled.where(F.col("bucket").isin("MATCH", "INVOICE_ONLY"))
        .select("client", "bucket", F.col("invoice_code").alias("code")).distinct()
        .join(clean.select("client", "code", "document"), ["client", "code"])
        .select("client", "bucket", "code", "document")
    )
    by_norm = (
        reconciled.where(F.col("bucket") == "MISMATCH")
        .select("client", "bucket", "code", norm_company(F.col("description")).alias("norm")).distinct()
        .join(clean.select("client", "norm", "document"), ["client", "norm"])
        .select("client", "bucket", "code", "document")
    )
    return by_code.unionByName(by_norm).distinct()
