"""Model replies as tables: parsing, merging chunks, normalising old shapes, choosing what to redo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.contracts import filename_type, normal_type
from ledgerloom.functions.text import strip

CODE_TYPE = "array<struct<value:string,position:string>>"
SUB_TYPE = "struct<text:string,product:string,items:array<string>>"
SECTION_TYPE = f"array<struct<header:string,product:string,subheaders:array<{SUB_TYPE}>>>"
CONTRACT_TYPE = (
    "contract_type string, effective_date string, signed_date string, parties array<string>, parent_references array<string>, "
    f"supersedes_text string, internal_doc_codes {CODE_TYPE}, section_structure {SECTION_TYPE}, "
    "extraction_confidence string, extraction_confidence_score int"
)


def unfence(text: Column) -> Column:
    """The reply without a leading and trailing code fence."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.startswith(t, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\n?", ""), r"```$", ""))).otherwise(t)


def _valid(text: Column, schema: str) -> Column:
    """Parsed value, null when the text is not JSON of that shape."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def parse_object(text: Column, schema: str) -> Column:
    """One JSON object: the whole reply, else from the first brace to the last."""
    s = unfence(text)
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.coalesce(_valid(F.when(F.startswith(s, F.lit("{")), s), schema), _valid(F.nullif(inner, F.lit("")), schema))


def parse_items(text: Column, item: str, key: str = "items") -> Column:
    """array<item>: a list, an object holding the list under `key`, or a single object."""
    s = unfence(text)
    outer = F.regexp_extract(s, r"(?s)\{.*\}|\[.*\]", 0)
    whole = f"struct<`{key}`:array<struct<{item}>>>"

    def read(t):
        array = F.when(F.startswith(t, F.lit("[")), _valid(t, f"array<struct<{item}>>"))
        holder = _valid(F.when(F.startswith(t, F.lit("{")), t), whole)
        single = F.when(F.startswith(t, F.lit("{")), F.array(_valid(t, f"struct<{item}>")))
        return F.coalesce(array, holder[key], F.when(holder.isNotNull(), single))

    return F.coalesce(read(s), read(outer))


def salvage_items(text: Column, item: str, marker: str = "row_id") -> Column:
    """array<item>: the complete objects holding `marker` in a truncated reply."""
    pattern = rf'(?s)\{{[^{{}}]*"{marker}"[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}'
    found = F.regexp_extract_all(unfence(text), F.lit(pattern), F.lit(0))
    return F.filter(F.transform(found, lambda o: _valid(o, f"struct<{item}>")), lambda o: o.isNotNull())


def parse_model_output(replies: DataFrame, column: str, item: str, key: str = "items", marker: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(one row per item, replies nothing could be read from); other columns are kept."""
    read = replies.withColumn("_items", parse_items(F.col(column), item, key))
    read = read.withColumn("_items", F.coalesce("_items", F.nullif(salvage_items(F.col(column), item, marker), F.array().cast(f"array<struct<{item}>>"))))
    rest = [c for c in replies.columns if c != column]
    rows = read.where(F.col("_items").isNotNull()).select(*rest, F.posexplode("_items").alias("position", "_i")).select(*rest, "position", "_i.*")
    bad = read.where(F.col("_items").isNull()).select(*rest, column)
    return rows, bad


# ------------------------------------------------------------------ shapes


def _none_like(text: Column) -> Column:
    t = strip(text)
    return F.when(F.lower(t).isin("", "null", "none", "n/a"), None).otherwise(t)


def normal_doc_codes(codes: Column) -> Column:
    """{value, position} with trimmed values; blanks dropped, unknown positions 'unknown'."""
    known = (*fixed.HIGH_VALUE_POSITIONS, *fixed.LOW_VALUE_POSITIONS)
    place = lambda p: F.when(strip(F.lower(p)).isin(*known), strip(F.lower(p))).otherwise("unknown")
    kept = F.filter(F.coalesce(codes, F.array().cast(CODE_TYPE)), lambda c: strip(F.coalesce(c["value"], F.lit(""))) != "")
    return F.transform(kept, lambda c: F.struct(strip(c["value"]).alias("value"), place(c["position"]).alias("position")))


def codes_from_json(text: Column) -> Column:
    """Codes written as objects or as plain strings."""
    entries = F.from_json(text, "array<string>")
    return normal_doc_codes(F.transform(entries, lambda e: F.coalesce(
        F.when(F.startswith(strip(e), F.lit("{")), F.from_json(e, "struct<value:string,position:string>")),
        F.struct(e.alias("value"), F.lit("unknown").alias("position")))))


def normal_sections(nested: Column, headers: Column, products: Column) -> Column:
    """The nested sections; without any, the flat headers (first of each) with their products."""
    subs = lambda s: F.transform(
        F.filter(F.coalesce(s, F.array().cast(f"array<{SUB_TYPE}>")), lambda x: strip(F.coalesce(x["text"], F.lit(""))) != ""),
        lambda x: F.struct(
            strip(x["text"]).alias("text"), _none_like(x["product"]).alias("product"),
            F.transform(F.filter(F.coalesce(x["items"], F.array().cast("array<string>")), lambda i: strip(F.coalesce(i, F.lit(""))) != ""),
                        lambda i: strip(i)).alias("items")))
    tree = F.transform(
        F.filter(nested, lambda e: strip(F.coalesce(e["header"], F.lit(""))) != ""),
        lambda e: F.struct(strip(e["header"]).alias("header"), _none_like(e["product"]).alias("product"), subs(e["subheaders"]).alias("subheaders")))
    heads = F.transform(F.coalesce(headers, F.array().cast("array<string>")), lambda h: strip(h))
    flat = F.transform(
        F.filter(heads, lambda h, i: (F.coalesce(h, F.lit("")) != "") & (F.array_position(heads, h) == i + 1)),
        lambda h: F.struct(h.alias("header"), _none_like(F.get(products, (F.array_position(heads, h) - 1).cast("int"))).alias("product"),
                           F.array().cast(f"array<{SUB_TYPE}>").alias("subheaders")))
    return F.when(F.size(F.coalesce(nested, F.array().cast(SECTION_TYPE))) > 0, tree).otherwise(flat)


def walk_products(sections: Column) -> Column:
    """Every product name at any level, in order, without repeats."""
    names = F.transform(sections, lambda e: F.concat(
        F.array(e["product"]), F.flatten(F.transform(e["subheaders"], lambda s: F.concat(F.array(s["product"]), s["items"])))))
    return F.array_distinct(F.filter(F.flatten(names), lambda n: F.coalesce(strip(n), F.lit("")) != ""))


def render_sections(sections: Column) -> Column:
    """Readable outline of the sections."""
    tag = lambda p: F.when(p.isNotNull(), F.concat(F.lit(" ["), p, F.lit("]"))).otherwise("")
    sub = lambda s: F.concat(F.lit("    — "), s["text"], tag(s["product"]), F.when(
        F.size(s["items"]) > 0, F.concat(F.lit(" :: "), F.array_join(s["items"], ", "))).otherwise(""))
    lines = F.transform(sections, lambda e: F.concat(
        F.array(F.concat(F.lit("• "), e["header"], tag(e["product"]))), F.transform(e["subheaders"], sub)))
    return F.array_join(F.flatten(lines), "\n")


_POSITION_RANK = ("handwritten_margin", "handwritten_inline", "printed_stamp", "printed_label_box", "printed_body", "printed_header",
                  "printed_footer", "unknown")


def merge_chunks(chunks: DataFrame, by: list[str]) -> DataFrame:
    """One record per contract from its parsed chunks (`chunk` gives their order).

    The first chunk decides type, dates and parties; references keep first-seen order; codes keep
    their best position; sections are merged by header and sub-header, a later product filling a
    missing one; confidence and score are the best seen. A group holds one contract's chunks.
    """
    fields = ["contract_type", "effective_date", "signed_date", "parties", "parent_references", "supersedes_text", "internal_doc_codes",
              "section_structure", "extraction_confidence", "extraction_confidence_score"]
    ordered = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", *fields))).alias("c"))
    first = F.get("c", F.lit(0))
    every = lambda f, kind: F.flatten(F.transform("c", lambda x: F.coalesce(x[f], F.array().cast(kind))))
    codes = normal_doc_codes(every("internal_doc_codes", CODE_TYPE))
    rank = lambda p: F.array_position(F.array(*[F.lit(x) for x in _POSITION_RANK]), p)
    values = F.array_distinct(F.transform(codes, lambda x: x["value"]))
    best = F.transform(values, lambda v: F.array_min(F.transform(
        F.filter(codes, lambda x: x["value"] == v), lambda x: F.struct(rank(x["position"]).alias("r"), x["position"].alias("position"))))["position"])
    known = lambda arr, f: F.get(F.filter(F.transform(arr, lambda x: x[f]), lambda p: p.isNotNull()), F.lit(0))
    conf = F.array_max(F.transform("c", lambda x: F.when(x["extraction_confidence"] == "high", 3).when(
        x["extraction_confidence"] == "medium", 2).when(x["extraction_confidence"] == "low", 1).otherwise(0)))
    scores = F.filter(F.transform("c", lambda x: x["extraction_confidence_score"]), lambda s: s.between(0, 100))
    no_flat = F.array().cast("array<string>")
    staged = ordered.withColumn("_s", normal_sections(every("section_structure", SECTION_TYPE), no_flat, no_flat)).withColumn("_codes", codes)
    heads = F.array_distinct(F.transform("_s", lambda e: e["header"]))

    def section(h):
        mine = F.filter("_s", lambda e: e["header"] == h)
        subs = F.flatten(F.transform(mine, lambda e: e["subheaders"]))
        texts = F.array_distinct(F.transform(subs, lambda s: s["text"]))

        def sub(t):
            same = F.filter(subs, lambda s: s["text"] == t)
            return F.struct(t.alias("text"), known(same, "product").alias("product"),
                            F.array_distinct(F.flatten(F.transform(same, lambda s: s["items"]))).alias("items"))

        return F.struct(h.alias("header"), known(mine, "product").alias("product"), F.transform(texts, sub).alias("subheaders"))

    return staged.select(
        *by, first["contract_type"].alias("contract_type"), first["effective_date"].alias("effective_date"),
        first["signed_date"].alias("signed_date"), first["parties"].alias("parties"),
        F.array_distinct(F.filter(every("parent_references", "array<string>"), lambda r: F.coalesce(r, F.lit("")) != "")).alias("parent_references"),
        F.get(F.filter(F.transform("c", lambda x: x["supersedes_text"]), lambda s: strip(F.coalesce(s, F.lit(""))) != ""), F.lit(0)).alias("supersedes_text"),
        F.arrays_zip(values.alias("value"), best.alias("position")).alias("internal_doc_codes"),
        F.transform(heads, section).alias("section_structure"),
        F.when(conf == 3, "high").when(conf == 2, "medium").when(conf == 1, "low").alias("extraction_confidence"),
        F.array_max(scores).alias("extraction_confidence_score"),
    )


def stale_records(records: DataFrame) -> DataFrame:
    """Adds `triggers`: why an earlier extraction should be repeated, each reason once only.

    `records` has key, filename, contract_type, n_references, codes_json, n_nested, n_flat, failed and the four
    `*_attempted` flags. Failed extractions are never repeated for these reasons.
    """
    kind, named = normal_type(F.col("contract_type")), filename_type(F.col("filename"))
    child = kind.isin(*fixed.CHILD_TYPES)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    entries = F.from_json("codes_json", "array<string>")
    objects = F.exists(entries, lambda e: F.startswith(strip(e), F.lit("{")))
    reasons = F.array(
        F.when(no("references_attempted") & child & (F.col("n_references") == 0), "no parent reference"),
        F.when(no("type_attempted") & named.isin(*fixed.RESCUE_TYPES) & (child | ((named == "MSA") & (kind != "MSA"))), "type mismatch"),
        F.when(no("codes_attempted") & (F.size(F.coalesce(entries, F.array().cast("array<string>"))) > 0) & ~F.coalesce(objects, F.lit(False)), "flat codes"),
        F.when(no("sections_attempted") & (F.col("n_nested") == 0) & (F.col("n_flat") > 0), "flat sections"),
    )
    return records.where(no("failed")).withColumn("triggers", F.array_compact(reasons)).where(F.size("triggers") > 0)
