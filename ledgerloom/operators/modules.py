"""Products, modules and engagement overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.documents import extraction_route, filename_date_text, is_license, type_from_name
from ledgerloom.functions.text import strip, text_or_blank


def is_real_module(parent: Column, level: Column, product: Column, module: Column, blocked=fixed.NOT_MODULES) -> Column:
    mod = strip(F.coalesce(module, F.lit("")))
    low = F.lower(mod)
    prod = F.lower(strip(F.coalesce(product, F.lit(""))))
    return (
        ~low.isin("", "nan", "none")
        & F.lower(strip(F.coalesce(parent, F.lit("")))).isin(*fixed.MODULE_PARENTS)
        & (F.lower(strip(F.coalesce(level, F.lit("")))) == fixed.MODULE_LEVEL)
        & ((prod == "") | (low != prod))
        & ~low.isin(*blocked)
    )


def missing_schedules(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest schedules (client, filename, parent, schedule_title) without one real module."""
    expected = manifest.withColumn("product", F.concat("schedule_title", F.lit(" Schedule to "), "parent"))
    covered = rows.where(is_real_module(F.col("parent"), F.col("level"), F.col("product"), F.col("module")))
    return expected.join(covered, ["client", "filename", "parent", "product"], "left_anti").distinct()


def license_override(documents: DataFrame) -> DataFrame:
    """Documents with license titles become license agreements without schedules."""
    hint = F.when(F.trim(F.col("agreement_type")) != "", F.col("agreement_type")).otherwise(F.substring("first_page", 1, 2000))
    lic = is_license(hint)
    return documents.withColumn(
        "document_type", F.when(lic, "LicenseAgreement").otherwise(F.col("document_type"))
    ).withColumn("schedules", F.when(lic, 0).otherwise(F.col("schedules")))


def with_route(documents: DataFrame) -> DataFrame:
    return documents.withColumn("route", extraction_route(F.col("schedules") > 0, F.col("document_type")))


def product_modules(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Clean product/module rows by the route of their document; duplicates dropped."""
    routed = rows.join(documents.select("client", "filename", "document_type", "route"), ["client", "filename"])
    product, module = (strip(F.coalesce(c, F.lit(""))) for c in ("product", "module"))
    strict = is_real_module(F.col("parent"), F.col("level"), F.col("product"), F.col("module"))
    keep = (
        F.when(F.col("route") == "strict", strict)
        .when(F.col("route") == "license", (product != "") & (module != ""))
        .otherwise(product != "")
    )
    licensed = F.col("route") == "license"
    return (
        routed.where(keep)
        .select(
            "client", "filename", type_from_name(F.col("filename")).alias("contract_type"), "document_type",
            F.when(licensed, "Agreement").otherwise(F.col("parent")).alias("parent"),
            F.when(licensed, "Exhibit").otherwise(F.col("level")).alias("level"),
            "product", "module",
        )
        .distinct()
    )


ENGAGEMENT_FIELDS = (
    "type_of_agreement", "effective_date", "envelope_id", "client_name", "client_address", "provider_name",
    "provider_address", "client_signatory_name", "client_signatory_title", "client_signatory_date",
    "provider_signatory_name", "provider_signatory_title", "provider_signatory_date", "contract_summary",
    "project_name", "project_reference_number", "sow_creator", "sow_expiration", "client_email", "provider_email",
    "client_number",
)


def engagements(contracts: DataFrame, overview: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per contract; contracts without a parsed overview keep a blank row."""
    keys = ["client", "filename"]
    sent = pages.groupBy(*keys).agg(F.array_sort(F.collect_set("page")).alias("_p"))
    fields = [f for f in ENGAGEMENT_FIELDS if f in overview.columns]
    joined = (
        contracts.select(*keys).distinct()
        .join(overview.select(*keys, *fields, F.lit(True).alias("_ok")), keys, "left")
        .join(sent, keys, "left")
        .join(documents.select(*keys, "document_type"), keys, "left")
    )
    blank = F.lit("")
    return joined.select(
        *keys,
        type_from_name(F.col("filename")).alias("contract_type"),
        filename_date_text(F.col("filename")).alias("contract_effective_date"),
        F.when(F.col("_ok"), text_or_blank(F.col("document_type"))).otherwise(blank).alias("document_type"),
        *[text_or_blank(F.col(f)).alias(f) if f in fields else blank.alias(f) for f in ENGAGEMENT_FIELDS],
        F.when(F.col("_ok"), F.array_join(F.col("_p").cast("array<string>"), ", ")).otherwise(blank).alias("pages_sent"),
    )
