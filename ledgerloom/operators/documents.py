"""Contract files: which ones to read, which pages of them, which one is the master."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.documents import filename_date, looks_like_master, signature_score
from ledgerloom.functions.text import contains_any, strip, text_or_blank
from ledgerloom.operators.invoices import top_per

MEGABYTE = 1024 * 1024


def year_cutoff(files: DataFrame, min_year: int = 2022) -> DataFrame:
    """Adds `file_date` and `kept`: the name carries a valid date of `min_year` or later."""
    d = filename_date(F.col("filename"), low=min_year)
    return files.withColumn("file_date", d).withColumn("kept", d.isNotNull())


def drop_suffix_copies(files: DataFrame) -> DataFrame:
    """Drops `stem_X.pdf` where `stem.pdf` is there too; X has no underscore."""
    base = F.concat(F.regexp_extract("filename", r"(?s)^(.+)_([^_]+)\.[^.]{3}$", 1), F.lit(".pdf"))
    names = files.select("client", F.col("filename").alias("_base")).distinct()
    return files.withColumn("_base", base).join(names, ["client", "_base"], "left_anti").drop("_base")


def dedupe_by_pages(files: DataFrame, limit: int = MEGABYTE) -> DataFrame:
    """Of files over `limit`, one per client and date text: the one with most pages. Smaller files stay."""
    text = F.regexp_extract("filename", r"\d{1,2}-\d{1,2}-\d{4}", 0)
    large = files.where(F.col("size") > limit).withColumn("_d", F.when(text != "", text).otherwise(F.col("filename")))
    picked = top_per(large, ["client", "_d"], [F.col("pages").desc(), F.col("filename")], 1).drop("_d")
    return files.where(F.col("size") <= limit).unionByName(picked)


def dedupe_by_size(files: DataFrame, limit: int = MEGABYTE) -> DataFrame:
    """Dated groups of a client with any file over `limit` keep their largest file; others stay whole."""
    groups = files.groupBy("client", "file_date").agg(
        F.max("size").alias("_max"),
        F.min_by("filename", F.struct(-F.col("size"), "filename")).alias("_largest"),
    )
    return (
        files.join(groups.withColumnRenamed("client", "_c").withColumnRenamed("file_date", "_fd"),
                   (F.col("client") == F.col("_c")) & F.col("file_date").eqNullSafe(F.col("_fd")))
        .where(F.col("file_date").isNull() | (F.col("_max") <= limit) | (F.col("filename") == F.col("_largest")))
        .drop("_c", "_fd", "_max", "_largest")
    )


def select_files(files: DataFrame, min_year: int = 2022, fallback_year: int = 2019) -> DataFrame:
    """Files to read per client: those of `min_year` on; without a master or renewal among them,
    also the newest older one (a master or renewal, else an amendment).

    `files` has client, filename, size, pages and `head_text` (the first three pages).
    """
    name = F.lower("filename")
    dated = files.withColumn("file_date", filename_date(F.col("filename")))
    dated = dated.withColumn("_post", F.coalesce(F.year("file_date") >= min_year, F.lit(False))).withColumn(
        "_hint",
        F.when(contains_any(name, fixed.MSA_NAME_WORDS), "MSA")
        .when(contains_any(name, fixed.RENEWAL_WORDS), "Renewal_Amendment")
        .when(contains_any(name, fixed.AMENDMENT_NAME_WORDS), "Amendment_maybe")
        .otherwise("Other"),
    )
    # a client is judged on its newer files, or on its older ones when it has none
    flags = dated.groupBy("client").agg(F.max("_post").alias("_any_post"))
    older = ~F.col("_post") & (F.year("file_date") >= fallback_year)
    pool = dated.join(flags, "client").where(F.when(F.col("_any_post"), F.col("_post")).otherwise(older))
    by_name = pool.groupBy("client").agg(
        F.max(F.col("_hint").isin("MSA", "Renewal_Amendment")).alias("_by_name")
    )
    renewal = contains_any(F.lower(F.coalesce("head_text", F.lit(""))), fixed.RENEWAL_WORDS) | (F.col("pages") > 30)
    typed = pool.join(by_name, "client").withColumn(
        "file_type",
        F.when(F.col("_hint") != "Amendment_maybe", F.col("_hint"))
        .when(F.col("_by_name") | ~renewal, "Amendment")
        .otherwise("Renewal_Amendment"),
    )
    single = dedupe_by_size(typed)
    qualifying = F.col("file_type").isin("MSA", "Renewal_Amendment")
    newest = F.struct(F.unix_date("file_date"), F.col("size"), F.col("filename"))
    decided = single.groupBy("client").agg(
        F.max(F.col("_post") & qualifying).alias("_settled"),
        F.max_by("filename", F.when(~F.col("_post") & qualifying, newest)).alias("_best"),
        F.max_by("filename", F.when(~F.col("_post") & (F.col("file_type") == "Amendment"), newest)).alias("_amend"),
    )
    fallback = F.when(~F.col("_settled"), F.coalesce("_best", "_amend"))
    return (
        single.join(decided, "client")
        .where(F.col("_post") | F.coalesce(F.col("filename") == fallback, F.lit(False)))
        .select("client", "filename", "file_date", "file_type", "size")
    )


def latest_master(inventory: DataFrame, hierarchy: DataFrame, overview: DataFrame) -> DataFrame:
    """Each client's newest master agreement from the first source that knows one.

    Sources in order: hierarchy (contract_type, effective_date, signed_date, duplicate_of),
    overview (contract_type, document_type, agreement_type, effective_date), then file names.
    Only files of the inventory count. An aggregate with map-side combine picks the winner.
    """
    files = inventory.select("client", "filename").distinct()
    by_name = filename_date(F.col("filename"), 1990, 2100)
    first = (
        hierarchy.where(looks_like_master(F.col("contract_type")) & (text_or_blank(F.col("duplicate_of")) == ""))
        .join(files, ["client", "filename"], "left_semi")
        .select("client", "filename", F.lit(1).alias("source"),
                F.coalesce("effective_date", "signed_date", by_name).alias("signing_date"))
    )
    any_master = reduce(
        lambda a, c: a | looks_like_master(F.col(c)), ("contract_type", "document_type", "agreement_type"), F.lit(False)
    )
    second = (
        overview.where(any_master).join(files, ["client", "filename"], "left_semi")
        .select("client", "filename", F.lit(2).alias("source"), F.coalesce("effective_date", by_name).alias("signing_date"))
    )
    third = files.where(looks_like_master(F.col("filename"))).select(
        "client", "filename", F.lit(3).alias("source"), by_name.alias("signing_date")
    )
    best = F.struct(-F.col("source"), F.unix_date("signing_date"), F.col("filename"))
    return (
        first.unionByName(second).unionByName(third)
        .where(F.col("signing_date").isNotNull())
        .groupBy("client")
        .agg(F.max_by(F.struct("filename", "signing_date", "source"), best).alias("m"))
        .select("client", "m.*")
    )


def apply_scope(contracts: DataFrame, allow: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """(agent, client, filename): each agent's allowed contracts; no list for a client means all of them.

    `allow` is (agent, client, filename); a blank filename is an empty pick and lists nothing.
    """
    picked = allow.where(text_or_blank(F.col("filename")) != "").select("agent", "client", "filename").distinct()
    listed = picked.select("agent", "client").distinct().withColumn("_listed", F.lit(True))
    wanted = contracts.select(
        "client", "filename", F.explode(F.array(*[F.lit(a) for a in agents])).alias("agent")
    )
    marked = wanted.join(listed, ["agent", "client"], "left").join(
        picked.withColumn("_in", F.lit(True)), ["agent", "client", "filename"], "left"
    )
    return marked.where(F.col("_listed").isNull() | F.col("_in")).select("agent", "client", "filename")


def rows_with_data(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where any of the columns holds text."""
    return df.where(reduce(lambda a, c: a | (text_or_blank(F.col(c)) != ""), columns, F.lit(False)))


def search_rows(df: DataFrame, text: str, order: list[Column], most: int = 500) -> DataFrame:
    """Rows with the text in any column, case-insensitive, the first `most` in order."""
    low = F.lower(F.lit(text))
    hit = reduce(
        lambda a, c: a | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), low), df.columns, F.lit(False)
    )
    return df.where(hit).orderBy(*order).limit(most)


# ------------------------------------------------------------------ pages


def signature_pages(pages: DataFrame, front: int = 4, back: int = 4, min_score: int = 5) -> DataFrame:
    """Pages to read first: the front pages plus signature pages (else the last pages); all of a short file."""
    keys = ["client", "filename"]
    scored = pages.select(*keys, "page", signature_score(F.col("text")).alias("score"))
    ranked = Window.partitionBy(*keys)
    marked = (
        scored.withColumn("_n", F.count(F.lit(1)).over(ranked))
        .withColumn("_at", F.row_number().over(ranked.orderBy("page")))
        .withColumn("_sig", F.row_number().over(ranked.orderBy((F.col("score") < min_score), F.desc("score"), "page")))
        .withColumn("_is_sig", (F.col("score") >= min_score) & (F.col("_sig") <= back))
        .withColumn("_any_sig", F.max("_is_sig").over(ranked))
    )
    keep = (
        (F.col("_n") <= front + back)
        | (F.col("_at") <= front)
        | F.when(F.col("_any_sig"), F.col("_is_sig")).otherwise(F.col("_at") > F.col("_n") - back)
    )
    return marked.where(keep).select(*keys, "page", "score")


def schedule_pages(pages: DataFrame, schedules: DataFrame, most: int = 12, head: int = 500) -> DataFrame:
    """Pages of each schedule: from its first page until another schedule opens.

    `schedules` is (client, filename, title). The first page names title and "schedule",
    else the title alone.
    """
    keys = ["client", "filename", "title"]
    at = Window.partitionBy("client", "filename").orderBy("page")
    low = pages.withColumn("_low", F.lower(F.coalesce("text", F.lit("")))).withColumn("_at", F.row_number().over(at))
    low = low.select("client", "filename", "page", "_at", "_low",
                     F.contains(F.col("_low"), F.lit("schedule")).alias("_sched"),
                     F.contains(F.col("_low"), F.lit(" schedule to ")).alias("_opens"))
    title = F.lower(strip(F.col("title")))
    joined = low.join(schedules.select(*keys).distinct(), ["client", "filename"]).withColumn(
        "_has", F.contains("_low", title)
    ).withColumn("_stop", F.col("_opens") & ~F.contains(F.substring("_low", 1, head), title))
    starts = joined.where(F.col("_has")).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_sched"), F.col("_at"))), F.min("_at")).alias("_start")
    )
    inside = joined.select(*keys, "page", "_at", "_stop").join(starts, keys).where(
        (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + most)
    )
    stops = inside.where(F.col("_stop") & (F.col("_at") > F.col("_start"))).groupBy(*keys).agg(F.min("_at").alias("_end"))
    return (
        inside.join(stops, keys, "left")
        .where(F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
        .select(*keys, "page")
    )
