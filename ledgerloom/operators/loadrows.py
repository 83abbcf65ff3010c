"""Rows ready to load into billing, built from contract items and their matched codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.text import contains_any, strip


def legal_item(*texts: Column, vendor: str | None = None) -> Column:
    """True for amounts that belong to liability and service-level wording, not to fees."""
    patterns = [p.format(vendor=vendor) for p in fixed.VENDOR_CLAUSES] if vendor else []
    blob = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.rlike(blob, F.lit(f"(?i)(?:{'|'.join((*patterns, *fixed.LEGAL_CLAUSES))})"))


def split_legal_items(items: DataFrame, vendor: str | None = None) -> DataFrame:
    """Adds `legal`; rows stay, so kept and dropped are two filters of one table."""
    return items.withColumn(
        "legal",
        legal_item(F.col("item"), F.col("section_header"), F.col("pricing_condition"), F.col("explanation"), vendor=vendor),
    )


def minimum_fee(condition: Column) -> Column:
    text = F.regexp_extract(F.coalesce(condition, F.lit("")), r"(?i)minimum[^$]*\$?\s*([\d,]+\.?\d*)", 1)
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def parse_price(price: Column) -> tuple[Column, Column]:
    """(number or null, status text)."""
    raw = strip(F.coalesce(price, F.lit("")))
    s = strip(F.regexp_replace(raw, r"[$,]|USD", ""))
    number = F.when(F.lower(s).isin(*fixed.PRICE_STATUSES), None).otherwise(s.try_cast("decimal(18,2)"))
    number = F.when(F.rlike(s, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)$")), number)
    return number, F.when((s == "") | number.isNotNull(), "").otherwise(raw)


def item_category(frequency: Column) -> Column:
    """One-time, recurring monthly or usage category from frequency words."""
    f = F.lower(F.coalesce(frequency, F.lit("")))
    recurring = contains_any(f, ("monthly", "/month", "per month", "annual", "per year"))
    per_unit = contains_any(f, ("per ", "/trans", "per item", "each"))
    return (
        F.when(contains_any(f, ("one time", "one-time", "onetime")), "ZINL")
        .when(recurring & ~per_unit, "ZINM")
        .otherwise("ZINR")
    )


def cpi_eligible(description: Column, category: Column, vendor: str = "vendor") -> Column:
    """Default eligibility of a dictionary row; fees passed through or named after the vendor have none."""
    d = F.upper(F.coalesce(description, F.lit("")))
    words = [w.upper() for w in (*fixed.PASS_THROUGH_WORDS, vendor)]
    no = (F.upper(F.coalesce(category, F.lit(""))) == "ZINL") | contains_any(d, words)
    return F.when(no, "No").otherwise("Yes")


def group_dictionary(dictionary: DataFrame) -> DataFrame:
    """Per code: its descriptions in order and the first row's category, condition and eligibility.

    `position` gives the row order. One row per (code, description) is kept before grouping,
    so a group holds distinct descriptions only.
    """
    rows = dictionary.withColumn("code", strip(F.col("code"))).where(F.col("code") != "")
    distinct = (
        rows.withColumn("description", strip(F.coalesce("description", F.lit(""))))
        .groupBy("code", "description")
        .agg(F.min("position").alias("_at"))
    )
    names = distinct.where(F.col("description") != "").groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct("_at", "description"))).alias("_d")
    )
    first = F.min_by(F.struct("item_category", "condition_type", "cpi_eligible"), F.col("position"))
    return (
        rows.groupBy("code").agg(first.alias("f"))
        .join(names, "code", "left")
        .select("code", F.transform("_d", lambda x: x["description"]).alias("descriptions"),
                "f.item_category", "f.condition_type", "f.cpi_eligible")
    )


def dictionary_pick(matches: DataFrame, primary: DataFrame, fallback: DataFrame, width: int | None = None) -> DataFrame:
    """Adds the dictionary row behind each matched code.

    Of the primary rows of the code, the one whose description was picked, else the first;
    codes only the fallback knows take the picked or the fallback description; everything
    else keeps the item text, with `width` cut to that many characters.
    """
    pick = F.upper(strip(F.coalesce("picked_description", F.lit(""))))
    rows = primary.where(strip(F.col("code")) != "").select(
        strip(F.col("code")).alias("code"),
        F.upper(strip(F.coalesce("description", F.lit("")))).alias("_desc_key"),
        F.struct("position", "description", "item_category", "condition_type", "cpi_eligible").alias("row"),
    )
    first = rows.groupBy("code").agg(F.min_by("row", F.col("row.position")).alias("_first"))
    exact = rows.groupBy("code", "_desc_key").agg(F.min_by("row", F.col("row.position")).alias("_exact"))
    master = fallback.groupBy("code").agg(F.min_by("description", F.col("position")).alias("_fallback"))
    raw = strip(F.coalesce("item", F.lit("")))
    short = raw
    if width:
        short = F.when(F.length(raw) > width, F.concat(F.rtrim(F.substring(raw, 1, width - 3)), F.lit("..."))).otherwise(raw)
    joined = (
        matches.withColumn("_desc_key", F.when(pick != "", pick))
        .join(first, "code", "left")
        .join(exact, ["code", "_desc_key"], "left")
        .join(master, "code", "left")
        .withColumn("_row", F.coalesce("_exact", "_first"))
    )
    known = F.when(F.col("_row").isNotNull(), F.col("_row.description")).when(
        F.col("_fallback").isNotNull(), F.coalesce(F.nullif(strip(F.col("picked_description")), F.lit("")), "_fallback")
    )
    return joined.select(
        *matches.columns,
        F.coalesce(F.nullif(known, F.lit("")), short).alias("final_description"),
        F.nullif(F.col("_row.item_category"), F.lit("")).alias("dict_category"),
        F.when(F.col("_row").isNotNull(), F.coalesce(F.nullif(F.col("_row.condition_type"), F.lit("")), F.lit("ZPRM"))).alias("dict_condition"),
        F.when(F.col("_row").isNotNull(), F.col("_row.cpi_eligible")).alias("dict_cpi"),
    )


def load_rows(picked: DataFrame, manual_codes: tuple[str, ...] = ()) -> DataFrame:
    """One load row per item; input is `dictionary_pick` output with item fields and `signing_date`.

    Codes of `manual_codes` are flagged for manual work, as minimum fees are.
    """
    number, status = parse_price(F.col("price"))
    fee = minimum_fee(F.col("pricing_condition"))
    has_code = F.coalesce(F.col("code"), F.lit("")) != ""
    category = F.coalesce("dict_category", F.nullif(F.col("model_category"), F.lit("")), item_category(F.col("frequency")))
    text = F.lower(F.concat_ws(" ", F.coalesce("item", F.lit("")), F.coalesce("section_header", F.lit(""))))
    passed = contains_any(text, fixed.PASS_THROUGH_WORDS) & number.isNull()
    start = F.add_months(F.trunc("signing_date", "month"), 1)
    one_time = category == "ZINL"
    signed = F.concat_ws("/", F.month("signing_date"), F.day("signing_date"), F.year("signing_date"))
    note = F.concat(F.lit("AGRMNT DTD "), signed)
    condition = F.when(passed, "").otherwise(F.coalesce("dict_condition", F.lit("ZPRM")))
    eligible = F.startswith(F.lower(F.coalesce("dict_cpi", F.lit("Yes"))), F.lit("y"))
    return picked.select(
        "client", "item_id",
        F.coalesce("code", F.lit("")).alias("material"),
        F.col("final_description").alias("description"),
        F.coalesce(F.nullif(F.col("quantity"), F.lit("")), F.lit("1")).alias("quantity"),
        category.alias("item_category"),
        start.alias("start_date"),
        F.when(one_time, F.last_day(start)).otherwise(F.add_months(start, 120)).alias("end_date"),
        F.when(has_code, condition).otherwise("").alias("condition_type"),
        number.alias("price"),
        F.when(number.isNotNull(), "USDN").otherwise("").alias("currency"),
        F.when(fee.isNotNull(), F.concat(F.lit("*PMIN "), fee.cast("string"), F.lit("*"), note)).otherwise(note).alias("customer_note"),
        F.when(has_code & ~one_time & ~passed & eligible, "CPI").otherwise("").alias("cpi"),
        F.col("signing_date").alias("contract_signed"),
        F.when(one_time, start).alias("bill_plan_date"),
        F.when(F.col("checkbox"), "Picked").when(~F.col("checkbox"), "Not Picked").otherwise("Does Not Exist").alias("checkbox"),
        status.alias("price_status"),
        (fee.isNotNull() | F.coalesce(F.col("code").isin(*manual_codes), F.lit(False))).alias("manual_flag"),
        F.when(~has_code, "no match")
        .when(~F.col("checkbox"), "not picked")
        .when(F.col("source_dict") == "fallback", "fallback")
        .when(passed, "pass-through")
        .otherwise("ok").alias("fill_class"),
    )
