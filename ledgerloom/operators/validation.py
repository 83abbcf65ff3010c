"""Codes checked against the client's own billing: statistics, candidates, funnel, verdict.

Similarity is computed per distinct text, statistics per distinct (client, code); item rows
only meet them by equality joins. Tables
    lines   client, document, invoice_date, material, material_text, net, quantity
    items   client, item_id, item, matched_description, section, price_value, price_text, quantity, frequency, incumbent
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.text import strip
from ledgerloom.operators import similarity as sim
from ledgerloom.operators.contains import merged
from ledgerloom.operators.invoices import top_per
from ledgerloom.operators.medians import exact_median
from ledgerloom.session import cut_lineage

W_PRICE, W_CONTEXT, W_PROBABILITY, W_FREQUENCY = 0.30, 0.40, 0.15, 0.15
TEXT_WEIGHTS = {"item": 0.55, "description": 0.35, "section": 0.10}
GREEN, YELLOW = 0.80, 0.60
BUFFER = 0.25
POOL, TOP5, TOP3 = 30, 5, 3
DESCRIPTION_ANCHOR, PRICE_ANCHOR, CONTEXT_FLOOR = 0.85, 0.40, 0.40
SPECIFIC_CODES, WEAK_PRICE_CAP = 2, 0.6
LEAST_SIMILAR, LEAST_MASS = 0.20, 0.30
KEY = ["client", "code"]


def _amounts(lines: DataFrame) -> DataFrame:
    code = strip(F.col("material"))
    net, qty = money.to_amount(F.col("net")), money.to_amount(F.col("quantity"))
    return lines.where(code != "").select(
        "client", code.alias("code"), strip(F.col("material_text")).alias("text"), "document", "invoice_date",
        net.alias("net"), F.abs(net).alias("abs_net"),
        F.abs(net.cast("double") / F.nullif(qty.cast("double"), F.lit(0.0))).alias("unit"),
    )


def code_stats(lines: DataFrame) -> DataFrame:
    """Per (client, code): lines, texts, ranges and exact medians of net, abs net and unit price, dates, invoices."""
    rows = _amounts(lines)
    base = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_distinct("text").alias("n_texts"),
        F.max("text").alias("sample_text"),
        F.min("net").alias("min_net"), F.max("net").alias("max_net"),
        F.min("abs_net").alias("min_abs_net"), F.max("abs_net").alias("max_abs_net"),
        F.min("unit").alias("min_unit"), F.max("unit").alias("max_unit"),
        F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"),
        F.count_distinct(F.trunc("invoice_date", "month")).alias("n_year_months"),
        F.count_distinct("document").alias("n_invoices"),
    )
    # the three values side by side, so that the lines are read once for all medians; dealt by code at once,
    # so that counts, medians and the join below stay within the tasks
    values = ("net", "abs_net", "unit")
    tall = rows.repartition(*KEY).select(*KEY, F.explode(F.array(*[
        F.struct(F.lit(v).alias("kind"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select(*KEY, "x.*")
    medians = exact_median(tall, [*KEY, "kind"], "value", "m")
    wide = medians.groupBy(*KEY).agg(*[F.max(F.when(F.col("kind") == v, F.col("m"))).alias(f"median_{v}") for v in values])
    return base.join(wide, KEY, "left")


def code_attributes(lines: DataFrame) -> DataFrame:
    """(client, code, kind, value): hierarchies and profit centres a code is billed under, one row each."""
    code = strip(F.col("material"))
    return (
        lines.where(code != "").select(
            "client", code.alias("code"),
            F.explode(F.create_map(F.lit("hierarchy"), "hier_name", F.lit("profit_center"), "profit_center")).alias("kind", "value"),
        ).where(F.coalesce(F.col("value"), F.lit("")) != "").distinct()
    )


def code_corpus(lines: DataFrame) -> DataFrame:
    """(client, code, text, n_lines): distinct texts of every code with their lines."""
    return (
        _amounts(lines).where(F.col("text") != "").groupBy(*KEY, "text").agg(F.count(F.lit(1)).alias("n_lines"))
    )


def code_texts(corpus: DataFrame, most: int = 3) -> DataFrame:
    """The most billed texts per code, most lines first."""
    top = top_per(corpus, KEY, [F.desc("n_lines"), F.col("text")], most)
    return top.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_lines")).alias("n"), "text"))).alias("t")).select(
        *KEY, F.transform("t", lambda x: x["text"]).alias("texts")
    )


def price_hits(lines: DataFrame) -> DataFrame:
    """(client, code, cents, lines, sample_text, min_net, max_net): every amount a code was billed at."""
    return (
        _amounts(lines).withColumn("cents", money.cents(F.col("net"))).where(F.col("cents") > 0)
        .groupBy(*KEY, "cents")
        .agg(F.count(F.lit(1)).alias("lines"), F.max("text").alias("sample_text"), F.min("net").alias("min_net"), F.max("net").alias("max_net"))
    )


def amount_codes(hits: DataFrame) -> DataFrame:
    """(cents, n_codes, n_clients): how many codes and clients share an amount, over the whole table."""
    return hits.groupBy("cents").agg(
        F.count_distinct("code").alias("n_codes"), F.count_distinct("client").alias("n_clients"),
        F.max(F.col("min_net") < 0).alias("has_credit"),
    )


def item_prices(items: DataFrame) -> DataFrame:
    """Adds price per unit, zero and per-unit flags and the cents to look up."""
    price = F.abs(F.coalesce(F.col("price_value").cast("double"), F.lit(0.0)))
    qty = F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))
    per = F.when((price > 0) & (qty > 1), price / qty).otherwise(price)
    return (
        items.withColumn("unit_price", per)
        .withColumn("is_zero", money.is_zero_priced_row(F.col("price_text"), F.col("item"), F.col("price_value").cast("double")))
        .withColumn("per_unit", money.is_per_unit(F.col("frequency"), F.col("item")))
        .withColumn("amounts", F.array_distinct(F.filter(F.array(money.cents(price), money.cents(per)), lambda c: c > 0)))
    )


def price_exact(priced: DataFrame, hits: DataFrame) -> DataFrame:
    """(client, item_id, code, specific): codes billed in scope at the item's exact amount."""
    asked = priced.select("client", "item_id", F.explode("amounts").alias("cents"))
    known = hits.select("client", "code", "cents").distinct()
    shared = amount_codes(hits).select("cents", (F.col("n_codes") <= SPECIFIC_CODES).alias("specific"))
    found = asked.join(known, ["client", "cents"]).select("client", "item_id", "code").distinct()
    rare = asked.join(shared, "cents").groupBy("client", "item_id").agg(F.max("specific").alias("specific"))
    return found.join(rare, ["client", "item_id"])


def outside_scope(priced: DataFrame, hits: DataFrame) -> DataFrame:
    """(client, item_id): the item's amount is billed, but only to other clients."""
    cents = money.cents(F.col("price_value"))
    asked = priced.select("client", "item_id", cents.alias("cents")).where(F.col("cents") > 0)
    mine = hits.select("client", "cents").distinct()
    return asked.join(hits.select("cents").distinct(), "cents", "left_semi").join(mine, ["client", "cents"], "left_anti").select(
        "client", "item_id"
    )


def price_band_codes(priced: DataFrame, stats: DataFrame, buffer: float = BUFFER) -> DataFrame:
    """(client, item_id, code): median amount or unit price within the buffer of the item's price.

    A logarithmic bucket is the join key: the buffered range spans at most two buckets.
    """
    base = (1 + buffer) / (1 - buffer)
    bucket = lambda c: F.floor(F.log(c) / F.log(F.lit(base)))
    low, high = F.col("p") * (1 - buffer), F.col("p") * (1 + buffer)
    both = F.array_distinct(F.filter(F.array(F.col("median_abs_net").cast("double"), F.col("median_unit")), lambda m: m > 0))
    medians = stats.select(*KEY, both.alias("ms")).select(*KEY, "ms", F.explode("ms").alias("m")).withColumn("b", bucket(F.col("m")))
    prices = priced.select("client", "item_id", F.col("unit_price").alias("p")).where(F.col("p") > 0)
    # a code whose two medians are both near meets the item at the lower one only
    lower = F.exists("ms", lambda o: (o < F.col("m")) & (o >= low))
    return (
        prices.withColumn("b", F.explode(F.sequence(bucket(low), bucket(high))))
        .join(merged(medians), ["client", "b"]).where((F.col("m") >= low) & (F.col("m") <= high) & ~lower)
        .select("client", "item_id", "code")
    )


TEXT_PARTS = {"item": "item", "description": "matched_description", "section": "section"}
TEXT_COLUMNS = [f"t_{n}" for n in TEXT_PARTS]


def item_texts(items: DataFrame) -> DataFrame:
    """Adds the cleaned item, description and section texts."""
    return items.withColumns({f"t_{n}": sim.legal_clean(F.col(c)) for n, c in TEXT_PARTS.items()})


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Unique row ids, written at once so that a re-run of a lost task cannot change them."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def corpus_vectors(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit vectors, idf) of a client's code texts; `c` numbers the corpus rows."""
    rows = corpus.select("client", "c", sim.legal_clean(F.col("text")).alias("text"))
    counts = sim.gram_counts(rows, ["client", "c"], "text")
    idf = sim.gram_idf(counts, ["client", "c"], ["client"])
    return sim.unit_vectors(counts, idf, ["client", "c"], ["client"]), idf


def text_similarity(texts: DataFrame, corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """(client, q, code, text, n_lines, cosine): all pairs from 0.20 up, and the `wanted` (client, q, code) pairs.

    `texts` is (client, q, cleaned texts) and `corpus` (client, code, text, n_lines, c).
    """
    vectors, idf = (cut_lineage(x) for x in corpus_vectors(corpus))
    parts = texts.select("client", "q", F.explode(F.create_map(
        *[x for n in TEXT_PARTS for x in (F.lit(n), F.col(f"t_{n}"))])).alias("part", "text"))
    queries = cut_lineage(sim.blended_queries(parts, idf, ["client"], TEXT_WEIGHTS))
    near = cut_lineage(sim.similar_pairs_blocked(queries, vectors, LEAST_SIMILAR, ["client"]))
    asked = wanted.join(corpus.select("client", "code", "c"), ["client", "code"]).select("client", "q", "c").distinct()
    low = sim.cosine_of(asked.join(near, ["client", "q", "c"], "left_anti"), queries, vectors, ["client"])
    return near.unionByName(low).join(corpus, ["client", "c"]).drop("c")


def best_by_code(similar: DataFrame) -> DataFrame:
    return similar.groupBy("client", "q", "code").agg(F.max("cosine").alias("lexical"))


def candidate_pool(items: DataFrame, lines: DataFrame, most: int = POOL):
    """(pool, similar): each item's candidate codes with price and lexical scores, the first `most` kept.

    Candidates are billed codes of the client only: billed at the exact amount, near the amount,
    with a similar text, or the code the item already has.
    """
    # each of these is read several times below; they are the job's intermediate tables
    stats = cut_lineage(code_stats(lines))
    corpus = numbered(code_corpus(lines), "c")
    hits = price_hits(lines)
    cleaned = item_texts(items)
    texts = numbered(cleaned.select("client", *TEXT_COLUMNS).distinct(), "q")
    priced = cut_lineage(item_prices(cleaned).join(texts, ["client", *TEXT_COLUMNS]))
    exact = cut_lineage(price_exact(priced, hits))
    band = price_band_codes(priced, stats)
    billed = stats.select("client", "code")
    incumbent = priced.select("client", "item_id", strip(F.coalesce("incumbent", F.lit(""))).alias("code")).join(
        billed, ["client", "code"], "left_semi")

    def tag(df, name):
        return df.select("client", "item_id", "code", F.lit(name).alias("tag"))

    by_price = cut_lineage(tag(exact, "exact-price").unionByName(tag(band, "buffer-price")).unionByName(tag(incumbent, "incumbent")))
    keys = priced.select("client", "item_id", "q")
    wanted = by_price.select("client", "item_id", "code").join(keys, ["client", "item_id"]).select("client", "q", "code").distinct()
    similar = cut_lineage(text_similarity(texts, corpus, wanted))
    lexical = best_by_code(similar)
    described = top_per(lexical.where(F.col("lexical") >= LEAST_SIMILAR), ["client", "q"], [F.desc(F.round("lexical", 9)), F.col("code")], most)
    by_text = tag(keys.join(described, ["client", "q"]), "description")
    tags = by_price.unionByName(by_text).groupBy("client", "item_id", "code").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    scored = (
        tags.join(priced, ["client", "item_id"])
        .join(lexical, ["client", "q", "code"], "left")
        .join(stats, ["client", "code"], "left")
        .join(exact.withColumn("is_exact", F.lit(True)), ["client", "item_id", "code"], "left")
        .withColumn("is_exact", F.coalesce("is_exact", F.lit(False)))
        .withColumn("specific", F.coalesce("specific", F.lit(False)))
        .withColumn("lexical", money.clamp01(F.col("lexical")))
    )
    median = lambda c: F.col(c).cast("double")
    signal = money.price_signal(
        F.when(F.col("is_zero"), 0.0).otherwise(F.col("price_value").cast("double")), F.col("n_lines").isNotNull(),
        F.col("is_zero"), F.col("per_unit"), F.col("is_exact"),
        {c: median(c) for c in ("median_unit", "min_unit", "max_unit", "median_abs_net", "min_abs_net", "max_abs_net")},
    )
    ranked = scored.withColumn("price", signal).withColumn("prelim", F.round(0.6 * F.col("lexical") + 0.4 * F.col("price"), 9))
    return top_per(ranked, ["client", "item_id"], [F.desc("prelim"), F.col("code")], most), similar


def context_score(relevance: Column, lexical: Column) -> Column:
    """Model relevance blended with the lexical score; a near-exact text anchors it."""
    blend = F.when(relevance.isNotNull(), 0.7 * relevance + 0.3 * lexical).otherwise(lexical)
    return money.clamp01(F.when(lexical >= DESCRIPTION_ANCHOR, F.greatest(blend, lexical)).otherwise(blend))


def score_funnel(pool: DataFrame, similar: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """The last three candidates of each item with their final score and place.

    Five by context and price, re-ranked with the probability of the code given the text, three
    of them scored with the billing cadence. `ranked` is (row_id, code, relevance 0..1).
    """
    rows = pool
    if ranked is not None:
        best = ranked.groupBy(F.col("row_id").alias("item_id"), money.norm_code(F.col("code")).alias("_k")).agg(F.max("relevance").alias("relevance"))
        rows = pool.withColumn("_k", money.norm_code(F.col("code"))).join(best, ["item_id", "_k"], "left").drop("_k")
    else:
        rows = pool.withColumn("relevance", F.lit(None).cast("double"))
    weak = F.col("is_exact") & (F.col("context") < PRICE_ANCHOR) & ~F.col("specific")
    rows = (
        rows.withColumn("context", context_score(F.col("relevance"), F.col("lexical")))
        .withColumn("price", money.clamp01(F.when(weak, F.least("price", F.lit(WEAK_PRICE_CAP))).otherwise(F.col("price"))))
        .withColumn("s5", F.round(W_CONTEXT * F.col("context") + W_PRICE * F.col("price"), 9))
    )
    item = ["client", "item_id"]
    five = top_per(rows, item, [F.desc("s5"), F.col("code")], TOP5)
    mass = similar.where(F.col("cosine") >= LEAST_MASS).groupBy("client", "q", "code").agg(
        F.sum(F.col("cosine") * F.col("n_lines")).alias("mass"))
    over = Window.partitionBy(*item)
    five = (
        five.join(mass, ["client", "q", "code"], "left")
        .withColumn("mass", F.coalesce("mass", F.lit(0.0)))
        .withColumn("_m", F.sum("mass").over(over)).withColumn("_l", F.sum("n_lines").over(over))
        .withColumn("probability", money.clamp01(
            F.when(F.col("_m") > 0, F.col("mass") / F.col("_m")).when(F.col("_l") > 0, F.col("n_lines") / F.col("_l")).otherwise(0.0)))
        .withColumn("s3", F.round(F.col("s5") + W_PROBABILITY * F.col("probability"), 9))
        .drop("_m", "_l", "mass")
    )
    three = top_per(five, item, [F.desc("s3"), F.desc("s5"), F.col("code")], TOP3)
    cadence = money.infer_cadence(F.col("first_date"), F.col("last_date"), F.col("n_invoices"), F.col("n_year_months"))
    final = (
        W_PRICE * F.col("price") + W_CONTEXT * F.col("context") + W_PROBABILITY * F.col("probability") + W_FREQUENCY * F.col("cadence_score")
    )
    return (
        three.withColumn("cadence", cadence)
        .withColumn("cadence_score", money.clamp01(money.frequency_signal(F.col("frequency"), F.col("item"), F.col("cadence"))))
        .withColumn("final", F.round(final, 9))
        .withColumn("place", F.row_number().over(over.orderBy(F.desc("final"), F.desc("s3"), F.desc("s5"), F.col("code"))))
    )


def tier_consensus(three: DataFrame) -> DataFrame:
    """(client, item_id, code): items of one base fee and section move to the group's best code when it is
    among their last three but not first."""
    group = ["client", "_fee", "_section"]
    rows = three.withColumn("_fee", money.base_fee(F.col("item"))).withColumn("_section", F.lower(strip(F.coalesce("section", F.lit("")))))
    sizes = rows.groupBy(*group).agg(F.count_distinct("item_id").alias("_items"))
    sums = rows.groupBy(*group, "code").agg(F.round(F.sum("final"), 6).alias("_sum"))
    best = sums.groupBy(*group).agg(F.min_by("code", F.struct(-F.col("_sum"), F.col("code"))).alias("code")).join(
        sizes.where(F.col("_items") >= 2), group
    )
    return rows.join(best, [*group, "code"]).where(F.col("place") > 1).select("client", "item_id", "code")


def route_label(tiered: Column) -> Column:
    strong = F.col("context") >= PRICE_ANCHOR
    return (
        F.when(tiered, "tier-consistent")
        .when(F.col("is_exact") & strong, "exact-price-anchor")
        .when(F.col("lexical") >= DESCRIPTION_ANCHOR, "description-anchor")
        .when(F.col("is_exact"), "exact-price+weak-semantic")
        .when((F.col("price") >= 0.7) & (F.col("context") >= 0.4), "price+semantic")
        .otherwise("semantic")
    )


def validated(items: DataFrame, three: DataFrame, texts: DataFrame, outside: DataFrame, billed: DataFrame) -> DataFrame:
    """One verdict per item: code, score, band, route, reason, fallback and the last three candidates."""
    item = ["client", "item_id"]
    three = cut_lineage(three)
    items = items.select(*item, "matched_description", "price_value", "incumbent")
    override = tier_consensus(three).withColumn("_tiered", F.lit(True))
    marked = three.join(override, [*item, "code"], "left").withColumn("_tiered", F.coalesce("_tiered", F.lit(False)))
    shown = F.concat(F.col("code"), F.lit(":"), F.bround("final", 2).cast("string"))
    order = F.struct((~F.col("_tiered")).alias("t"), "place")
    fields = ["code", "final", "context", "lexical", "price", "probability", "cadence_score", "cadence", "is_exact", "_tiered", "place"]
    picked = marked.groupBy(*item).agg(
        F.min_by(F.struct(*fields), order).alias("c"),
        F.array_sort(F.collect_list(F.struct("place", "code", shown.alias("shown")))).alias("_l"),
    )
    flat = picked.select(*item, "c.*", "_l").withColumn(
        "fallback_code", F.coalesce(F.get(F.filter("_l", lambda x: x["code"] != F.col("code")), F.lit(0))["code"], F.lit(""))
    ).withColumn("top_candidates", F.array_join(F.transform("_l", lambda x: x["shown"]), ", "))
    anchored = F.col("is_exact") | (F.col("lexical") >= DESCRIPTION_ANCHOR)
    gate = F.when(~anchored & (F.col("context") < CONTEXT_FLOOR), F.col("context") / CONTEXT_FLOOR).otherwise(1.0)
    verdict = flat.withColumn("score", F.col("final") * gate).withColumn("route", route_label(F.col("_tiered")))
    incumbent = strip(F.coalesce("incumbent", F.lit("")))
    joined = (
        items.join(verdict, item, "left").join(texts, KEY, "left")
        .join(outside.withColumn("_outside", F.lit(True)), item, "left")
        .withColumn("_inc", incumbent)
        .join(billed.select("client", F.col("code").alias("_inc"), F.lit(True).alias("_billed")), ["client", "_inc"], "left")
    )
    none = F.col("code").isNull()
    band = F.when(none, "RED").when(F.col("score") >= GREEN, "GREEN").when(F.col("score") >= YELLOW, "YELLOW").otherwise("RED")
    amount = F.concat(F.lit("$"), F.format_number(F.abs(F.col("price_value").cast("double")), 2))
    elsewhere = F.when(F.col("_outside"), F.concat(amount, F.lit(" is billed only outside this scope")))
    why = F.when(band == "RED", F.lit("low-confidence, weak evidence")).otherwise(F.concat_ws(
        "; ",
        F.when(F.col("context") >= 0.75, "strong match to billed descriptions").when(F.col("context") < 0.4, "weak semantic match"),
        F.when(F.col("is_exact"), "billed at the exact amount").when(F.col("price") >= 0.85, "price aligns with history"),
        F.when(F.col("cadence_score") >= 0.85, "cadence matches"),
        F.when(F.col("code") != F.col("_inc"), "history favours this code"),
    ))
    nothing = F.when((F.col("_inc") != "") & F.col("_billed").isNull(), F.concat(F.lit("code "), F.col("_inc"), F.lit(" has no billing in scope"))).otherwise(
        "no billed candidate in scope")
    return joined.select(
        *item, F.col("_inc").alias("old_code"),
        F.coalesce("code", "_inc").alias("new_code"),
        F.when(none, F.coalesce("matched_description", F.lit(""))).otherwise(F.get("texts", F.lit(0))).alias("new_description"),
        F.when(none, 0.0).otherwise(F.bround("score", 4)).alias("score"), band.alias("band"),
        F.coalesce("fallback_code", F.lit("")).alias("fallback_code"),
        F.coalesce("route", F.lit("no-candidate")).alias("route"), F.coalesce("cadence", F.lit("")).alias("cadence"),
        F.concat_ws("; ", F.when(none, nothing).otherwise(why), elsewhere).alias("reason"),
        F.bround("price", 3).alias("v_price"), F.bround("context", 3).alias("v_context"),
        F.bround("probability", 3).alias("v_probability"), F.bround("cadence_score", 3).alias("v_frequency"),
        F.coalesce("top_candidates", F.lit("")).alias("top_candidates"),
    )


def band_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("band") == b).alias(b.lower()) for b in ("GREEN", "YELLOW", "RED")],
        F.count_if(F.col("new_code") != F.col("old_code")).alias("changed"),
    )


def validate_codes(items: DataFrame, lines: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """The whole check, all clients at once."""
    pool, similar = candidate_pool(items, lines)
    three = score_funnel(pool, similar, ranked)
    texts = code_texts(code_corpus(lines))
    hits = price_hits(lines)
    outside = outside_scope(item_prices(items), hits)
    billed = hits.select("client", "code").distinct()
    return validated(items, three, texts, outside, billed)
