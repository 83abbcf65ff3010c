"""Fee items against a code dictionary: pools, stated codes, sections, rosters, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.fuzzy import all_scores
from ledgerloom.functions.money import clean_price, norm_code
from ledgerloom.functions.names import client_signature, entity_tokens, norm_client
from ledgerloom.functions.text import nonblank, squeeze, strip, word_list
from ledgerloom.operators.contains import contains_pairs
from ledgerloom.operators.spread import meet


def billable_items(items: DataFrame) -> DataFrame:
    """Distinct items to match: not explicitly unchecked, not priced at zero."""
    from ledgerloom.functions.money import is_zero_price

    keep = F.coalesce("checkbox", F.lit(True)) & ~is_zero_price(F.col("price")) & F.col("item").isNotNull()
    return items.where(keep).select("item").distinct()


def export_items(items: DataFrame) -> DataFrame:
    """Rows not explicitly unchecked, checked ones marked 'True', with the cleaned price."""
    return items.where(F.coalesce("checkbox", F.lit(True))).withColumn(
        "checked", F.when(F.col("checkbox"), "True")
    ).withColumn("cleaned_price", clean_price(F.col("price")))


def code_by_description(rows: DataFrame, dictionary: DataFrame, description: str = "matched_description") -> DataFrame:
    """Adds the dictionary code of the row's description (trimmed, lower case; the last duplicate wins)."""
    key = F.lower(strip(F.col("description")))
    codes = dictionary.groupBy(key.alias("_d")).agg(F.max_by("code", F.col("position")).alias("code"))
    return rows.withColumn("_d", F.lower(strip(F.col(description)))).join(codes, "_d").drop("_d")


def attach_codes(items: DataFrame, validated: DataFrame, matched: DataFrame) -> DataFrame:
    """Adds `code`: the validated one, its fallback when blank, else the matched one.

    Key is (contract, item, price); of duplicate keys the last by `position` wins.
    """
    keys = ["source_contract", "item", "price"]
    norm = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]
    v = validated.select(*norm, "position", F.coalesce(nonblank(F.col("new_code")), nonblank(F.col("fallback_code"))).alias("_c"))
    m = matched.select(*norm, "position", nonblank(F.col("code")).alias("_c"))
    last = lambda df, name: df.groupBy(*keys).agg(F.max_by(F.struct("_c"), F.col("position")).alias("s")).select(*keys, F.col("s._c").alias(name))
    base = items
    for k in keys:
        base = base.withColumn(f"_{k}", F.coalesce(F.col(k), F.lit("")))
    out = base
    for df, name in ((last(v, "_v"), "_v"), (last(m, "_m"), "_m")):
        for k in keys:
            df = df.withColumnRenamed(k, f"_{k}")
        out = out.join(df, [f"_{k}" for k in keys], "left")
    return out.withColumn("code", F.coalesce("_v", "_m", F.lit(""))).drop("_v", "_m", *[f"_{k}" for k in keys])


def join_ranked(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds a ranking's relevance to (row_id, code); rows nobody ranked are 'dropped'.

    Codes are compared without case and spaces; of repeated answers the highest counts.
    """
    best = ranked.groupBy("row_id", norm_code(F.col("code")).alias("_k")).agg(F.max("relevance").alias("relevance"))
    seen = ranked.select("row_id").distinct().withColumn("_seen", F.lit(True))
    return (
        rows.withColumn("_k", norm_code(F.col("code")))
        .join(best, ["row_id", "_k"], "left").join(seen, "row_id", "left")
        .withColumn("ranking", F.when(F.col("relevance").isNotNull(), "ranked").when(F.col("_seen"), "not listed").otherwise("dropped"))
        .drop("_k", "_seen")
    )


# ------------------------------------------------------------------ sections and pools


def section_canonical(headers: DataFrame, section_map: DataFrame, accept: float = 92.0) -> DataFrame:
    """(header, section, score): exact spelling 100, else the closest spelling from `accept`, else as written.

    `section_map` is (raw, section). The raw header keeps the score it reached.
    """
    known = section_map.groupBy(F.lower(strip(F.col("raw"))).alias("_k")).agg(F.max("section").alias("section"))
    asked = headers.select("header").where(strip(F.coalesce("header", F.lit(""))) != "").distinct().withColumn(
        "_k", F.lower(strip(F.col("header")))
    )
    exact = asked.join(known, "_k").select("header", "section", F.lit(100.0).alias("score"))
    rest = asked.join(known, "_k", "left_anti")
    near = all_scores(rest, known, "_k", "_k", "weighted", 0.0, best_only=True)
    close = near.join(known.withColumnRenamed("_k", "choice"), "choice").select(F.col("text").alias("_k"), "section", "score")
    fuzzy = rest.join(close, "_k", "left").select(
        "header",
        F.when(F.col("score") >= accept, F.col("section")).otherwise(strip(F.col("header"))).alias("section"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return exact.unionByName(fuzzy)


def section_pool(sections: DataFrame, dictionary: DataFrame, accept: float = 75.0) -> DataFrame:
    """(section, dict_section): dictionary sections that contain the section; if none, close ones."""
    asked = sections.select(F.lower(F.col("section")).alias("section")).where(F.col("section") != "").distinct()
    offered = dictionary.select(F.lower(F.col("section")).alias("dict_section")).distinct()
    inside = contains_pairs(offered, asked, "dict_section", "section").select("section", "dict_section")
    rest = asked.join(inside, "section", "left_anti")
    near = all_scores(rest, offered, "section", "dict_section", "partial", accept, best_only=False)
    return inside.unionByName(near.select(F.col("text").alias("section"), F.col("choice").alias("dict_section")))


def anchor_keywords(dictionary: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Keywords of section headers: words of short all-capital headers, and a leading capitalised word."""
    s = dictionary.select(strip(F.col("section")).alias("s")).where(F.col("s") != "").distinct()
    capital = F.rlike("s", F.lit(r"^[A-Z][A-Z0-9 \-]{2,20}$")) & (F.size(word_list(F.col("s"))) <= 3)
    words = F.filter(word_list(F.col("s")), lambda w: (F.length(w) >= 4) & F.rlike(w, F.lit(r"^\p{L}+$")))
    lead = F.regexp_extract("s", r"^([A-Z][a-z]{4,15})(\s|$|®|™)", 1)
    mined = s.select(F.explode(F.concat(F.when(capital, words).otherwise(F.array().cast("array<string>")), F.array(lead))).alias("keyword"))
    out = mined.select(F.lower("keyword").alias("keyword"))
    if extra:
        out = out.unionByName(s.sparkSession.createDataFrame([(w,) for w in extra], "keyword string"))
    return out.where(F.col("keyword") != "").distinct()


def keyword_pool(items: DataFrame, dictionary: DataFrame, keywords: DataFrame) -> DataFrame:
    """(item, position): dictionary rows and items that name the same keyword."""
    asked = items.select("item", F.lower(F.col("item")).alias("_item")).distinct()
    rows = dictionary.select(
        "position", F.concat_ws("\n", F.lower("section"), F.lower("description")).alias("_row")
    )
    named = contains_pairs(asked, keywords, "_item", "keyword").join(asked, "_item").select("item", "keyword")
    held = contains_pairs(rows, keywords, "_row", "keyword").join(rows, "_row").select("position", "keyword")
    # Sets of keywords meet once, then the items and rows that have them: no pair comes twice, none is sorted out later.
    words = lambda df, by, name: df.groupBy(by).agg(F.array_sort(F.collect_set("keyword")).alias(name))
    named, held = words(named, "item", "_asked"), words(held, "position", "_held")
    each = lambda df, name: df.select(name).distinct().withColumn("keyword", F.explode(name))
    sets = each(named, "_asked").join(each(held, "_held"), "keyword").select("_asked", "_held").distinct()
    return meet(named.join(sets, "_asked").select("item", "_held"), held, ["_held"]).select("item", "position")


def candidate_pool(section_rows: DataFrame, keyword_rows: DataFrame, items: DataFrame) -> DataFrame:
    """(item, position, full): both pools together; items without any are marked for the whole dictionary."""
    pool = section_rows.select("item", "position").unionByName(keyword_rows.select("item", "position")).distinct()
    empty = items.select("item").distinct().join(pool.select("item").distinct(), "item", "left_anti")
    return pool.withColumn("full", F.lit(False)).unionByName(
        empty.select("item", F.lit(None).cast("bigint").alias("position"), F.lit(True).alias("full"))
    )


def validate_stated_code(items: DataFrame, pool: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Codes the contract states: in the section's pool (100), in the dictionary (100), else kept (90).

    `items` is (item_id, section, stated_code), `pool` (section, dict_section). First row by position counts.
    """
    first = F.min_by(F.struct("code", "description"), F.col("position"))
    rows = dictionary.withColumn("_k", F.upper("code")).withColumn("dict_section", F.lower("section"))
    by_section = rows.groupBy("_k", "dict_section").agg(first.alias("r"), F.min("position").alias("_p"))
    in_pool = (
        pool.join(by_section, "dict_section").groupBy("section", "_k").agg(F.min_by("r", F.col("_p")).alias("_sec"))
    )
    whole = rows.groupBy("_k").agg(first.alias("_all"))
    stated = items.where(strip(F.coalesce("stated_code", F.lit(""))) != "").withColumn(
        "_k", F.upper(strip(F.col("stated_code")))
    ).withColumn("section", F.lower("section"))
    joined = stated.join(in_pool, ["section", "_k"], "left").join(whole, "_k", "left")
    row = F.coalesce("_sec", "_all")
    return joined.select(
        "item_id",
        F.coalesce(row["code"], F.col("stated_code")).alias("code"),
        F.coalesce(row["description"], F.lit("")).alias("description"),
        F.when(F.col("_sec").isNotNull(), "Contract+Dict (section)").when(F.col("_all").isNotNull(), "Contract+Dict (full)")
        .otherwise("Contract-only (unvalidated)").alias("source"),
        F.when(row.isNotNull(), 100).otherwise(90).alias("confidence"),
    )


def best_candidate(scored: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """The highest-scoring row per item; smallest `tie` on equal scores."""
    best = scored.groupBy(by).agg(F.min_by(F.struct(*scored.columns), F.struct(-F.col(score), F.col(tie))).alias("b"))
    return best.select("b.*")


# ------------------------------------------------------------------ rosters


def roster_match(clients: DataFrame, roster: DataFrame) -> DataFrame:
    """Clients on the roster: same normal form, or distinctive words equal, contained or containing.

    Containment either way needs a common word, so words are the join key; the counts of common
    words against both sizes then decide, once per distinct set of words.
    """
    c = clients.select("client", norm_client(F.col("client")).alias("norm"), client_signature(F.col("client")).alias("sig")).distinct()
    key = norm_client(F.col("name"))
    r = roster.select(key.alias("norm"), client_signature(F.col("name")).alias("rsig")).where(
        (F.length("norm") >= 3) & ~F.rlike(F.replace("norm", F.lit(" "), F.lit("")), F.lit(r"^\d+$"))
    ).distinct()
    exact = c.join(r.select("norm"), "norm", "left_semi").select("client")
    a = c.where(F.size("sig") > 0).select("sig").distinct().withColumn("w", F.explode("sig"))
    b = r.where(F.size("rsig") > 0).select("rsig").distinct().withColumn("w", F.explode("rsig"))
    # a contained set meets the other on its rarest word, so common words need not be joined
    held = a.groupBy("w").agg(F.count(F.lit(1)).alias("n")).unionByName(b.groupBy("w").agg(F.count(F.lit(1)).alias("n"))).groupBy("w").agg(F.sum("n").alias("n"))
    rare = lambda df, s: df.join(held, "w").groupBy(s).agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    inside = rare(a, "sig").join(b, "w").where(F.size(F.array_except("sig", "rsig")) == 0).select("sig")
    around = rare(b, "rsig").join(a, "w").where(F.size(F.array_except("rsig", "sig")) == 0).select("sig")
    close = c.join(inside.unionByName(around).distinct(), "sig", "left_semi").select("client")
    return exact.unionByName(close).distinct()


def derive_client(documents: DataFrame, roster: DataFrame, vendor: tuple[str, ...] = (), review: str = "Needs review") -> DataFrame:
    """(key, engagement, ambiguous): the engagement sharing most distinctive words with the document.

    `roster` is (engagement, alias). Documents are compared once per distinct set of words.
    """
    words = roster.select("engagement", F.explode(entity_tokens(F.array("alias"), None, vendor)).alias("w")).distinct()
    docs = documents.select("key", entity_tokens(F.col("parties"), F.col("filename"), vendor).alias("tokens"))
    sets = docs.select("tokens").distinct().withColumn("w", F.explode("tokens"))
    shared = sets.join(words, "w").groupBy("tokens", "engagement").agg(F.count(F.lit(1)).alias("n"))
    top = shared.groupBy("tokens").agg(F.max("n").alias("top"))
    best = shared.join(top, "tokens").where(F.col("n") == F.col("top")).groupBy("tokens").agg(
        F.min("engagement").alias("engagement"), (F.count(F.lit(1)) > 1).alias("ambiguous")
    )
    return docs.join(best, "tokens", "left").select(
        "key", F.coalesce("engagement", F.lit(review)).alias("engagement"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous")
    )


# ------------------------------------------------------------------ products

_EDGE = ".,;:|/-—_ "


def norm_product(name: Column) -> Column:
    return F.btrim(squeeze(F.lower(F.coalesce(name, F.lit("")))), F.lit(_EDGE))


def product_dictionary(files: DataFrame) -> DataFrame:
    """(norm, canonical) of the newest `_vN` file; the first spelling of a normal form wins.

    `files` is (file, position, term).
    """
    version = F.coalesce(F.regexp_extract("file", r"(?i)_v(\d+)", 1).try_cast("int"), F.lit(0))
    newest = files.agg(F.max_by("file", F.struct(version, F.col("file"))).alias("file"))
    terms = files.join(F.broadcast(newest), "file").withColumn("norm", norm_product(F.col("term"))).where(F.col("norm") != "")
    return terms.groupBy("norm").agg(F.min_by(strip(F.col("term")), F.col("position")).alias("canonical"))


def canonical_products(
    names: DataFrame, dictionary: DataFrame, accept: float = 88.0, suffixes=fixed.PRODUCT_SUFFIXES, close: bool = True
) -> DataFrame:
    """(product, canonical, stage): exact, longest leading name, suffixes stripped, close spelling; else null.

    Each stage only sees what the one before left over.
    """
    asked = names.select("product").distinct().withColumn("norm", norm_product(F.col("product"))).where(F.col("norm") != "")
    keys = dictionary.select("norm", "canonical")
    exact = asked.join(keys, "norm").select("product", "canonical", F.lit("exact").alias("stage"))
    left = asked.join(keys, "norm", "left_anti")

    words = F.split("norm", " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    lead = (
        left.where(F.size(words) > 1).select("product", F.explode(heads).alias("norm"))
        .where(F.length("norm") >= 3).join(keys, "norm")
        .groupBy("product").agg(F.max_by("canonical", F.struct(F.length("norm"), F.col("norm"))).alias("canonical"))
        .withColumn("stage", F.lit("prefix"))
    )
    left = left.join(lead, "product", "left_anti")

    # text after 1, 2, … trailing generic words, the fewest stripped that is known
    tail = rf"[{'.,;:|/—_ '}\-]*\s(?:{'|'.join(suffixes)})$"
    once = lambda text: F.btrim(F.regexp_replace(text, tail, ""), F.lit(" "))
    stripped = F.aggregate(F.sequence(F.lit(1), F.size(words)), F.array("norm"), lambda done, _: F.concat(done, F.array(once(F.element_at(done, -1)))))
    cut = (
        left.select("product", F.posexplode(stripped).alias("n", "norm")).join(keys, "norm")
        .groupBy("product").agg(F.min_by("canonical", F.col("n")).alias("canonical"))
        .withColumn("stage", F.lit("suffix"))
    )
    left = left.join(cut, "product", "left_anti")

    found = exact.unionByName(lead).unionByName(cut)
    if close:
        near = all_scores(left, keys, "norm", "norm", "sequence", accept, best_only=True)
        spelled = left.join(near, left.norm == near.text).join(keys.withColumnRenamed("norm", "choice"), "choice")
        found = found.unionByName(spelled.select("product", "canonical", F.lit("close").alias("stage")))
    return names.select("product").distinct().join(found, "product", "left")


def products_per_contract(products: DataFrame, canonical: DataFrame) -> DataFrame:
    """Sorted distinct raw and canonical product names of every contract."""
    joined = products.join(canonical.select("product", "canonical"), "product", "left")
    return joined.groupBy("client", "key").agg(
        F.array_sort(F.collect_set("canonical")).alias("products"), F.array_sort(F.collect_set(strip(F.col("product")))).alias("products_raw")
    )
