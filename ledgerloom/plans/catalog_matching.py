"""Registered queries of item matching and code validation."""

from pyspark.sql import functions as F

from ledgerloom.functions import fixed, fuzzy
from ledgerloom.functions.money import safe_amount
from ledgerloom.operators import matching as m
from ledgerloom.operators import similarity as sim
from ledgerloom.operators import validation as v
from ledgerloom.operators.medians import exact_median
from ledgerloom.operators.spread import meet
from ledgerloom.plans import ducksql as d
from ledgerloom.plans.catalog_hierarchy import TOKENS, VENDOR, forest_of  # noqa: F401
from ledgerloom.plans.catalog_invoices import client_lines
from ledgerloom.plans.catalog_scalars import CLEAN, ZERO
from ledgerloom.plans.registry import query, stage

# ---- items and codes


@query("billable_items", f"SELECT DISTINCT item FROM fee_items WHERE coalesce(checkbox, true) AND NOT {ZERO}")
def billable_items(t):
    return m.billable_items(t.fee_items)


@query("export_items", f"SELECT item_id, CASE WHEN checkbox THEN 'True' END AS checked, {CLEAN} AS cleaned_price FROM fee_items WHERE coalesce(checkbox, true)")
def export_items(t):
    return m.export_items(t.fee_items).select("item_id", "checked", "cleaned_price")


@query("code_by_description", """
WITH k AS (SELECT lower(trim(description)) AS dd, arg_max(code, position) AS code FROM dictionary GROUP BY ALL)
SELECT item_id, code FROM checked_items JOIN k ON lower(trim(matched_description)) = dd""")
def code_by_description(t):
    return m.code_by_description(t.checked_items, t.dictionary).select("item_id", "code")


@query("attach_codes", """
WITH last_v AS (SELECT source_contract, item, coalesce(price, '') AS price, arg_max({'c': CASE WHEN l_partkey % 3 = 0 THEN nullif(incumbent, '') ELSE coalesce(CASE WHEN l_partkey % 3 = 1 THEN material END, nullif(incumbent, '')) END}, item_id) AS c
                FROM checked_items WHERE page <= 4 GROUP BY ALL),
last_m AS (SELECT source_contract, item, coalesce(price, '') AS price, arg_max({'c': 'M' || material}, item_id) AS c FROM checked_items GROUP BY ALL)
SELECT i.item_id, coalesce(v.c.c, x.c.c, '') AS code FROM checked_items i
LEFT JOIN last_v v ON v.source_contract = i.source_contract AND v.item = i.item AND v.price = coalesce(i.price, '')
LEFT JOIN last_m x ON x.source_contract = i.source_contract AND x.item = i.item AND x.price = coalesce(i.price, '')""")
def attach_codes(t):
    items = t.checked_items
    checked = items.where(F.col("page") <= 4).select(
        "source_contract", "item", "price", F.col("item_id").alias("position"),
        F.when(F.col("l_partkey") % 3 == 1, F.col("material")).alias("new_code"), F.col("incumbent").alias("fallback_code"),
    )
    matched = items.select("source_contract", "item", "price", F.col("item_id").alias("position"), F.concat(F.lit("M"), "material").alias("code"))
    return m.attach_codes(items, checked, matched).select("item_id", "code")


@query("join_ranked", """
WITH r AS (SELECT item_id AS row_id, replace(upper(material), ' ', '') AS k, max(l_partkey % 100 / 100.0) AS relevance FROM checked_items WHERE page = 1 GROUP BY ALL)
SELECT i.item_id AS row_id, material AS code, cast(relevance AS double) AS relevance,
  CASE WHEN relevance IS NOT NULL THEN 'ranked' WHEN i.item_id IN (SELECT row_id FROM r) THEN 'not listed' ELSE 'dropped' END AS ranking
FROM checked_items i LEFT JOIN r ON r.row_id = i.item_id AND r.k = material""")
def join_ranked(t):
    ranked = t.checked_items.where(F.col("page") == 1).select(
        F.col("item_id").alias("row_id"), F.concat(F.lit(" "), F.lower("material")).alias("code"),
        (F.col("l_partkey") % 100 / 100.0).alias("relevance"))
    rows = t.checked_items.select(F.col("item_id").alias("row_id"), F.col("material").alias("code"))
    return m.join_ranked(rows, ranked)


# ---- sections and pools

POOL_SQL = """offered AS (SELECT DISTINCT lower(section) AS dict_section FROM dictionary),
asked AS (SELECT DISTINCT lower(p_type) AS section FROM fee_items UNION SELECT DISTINCT left(lower(p_type), 4) FROM fee_items),
pool AS (SELECT section, dict_section FROM asked JOIN offered ON contains(dict_section, section))"""


def pool_sections(t):
    low = F.lower("p_type")
    return t.fee_items.select(F.explode(F.array(low, F.substring(low, 1, 4))).alias("section")).distinct()


@query("section_pool", f"WITH {POOL_SQL} SELECT * FROM pool")
def section_pool(t):
    return m.section_pool(pool_sections(t), t.dictionary)


@query("section_pool_close")
def section_pool_close(t):
    misspelled = t.fee_items.select(F.concat(F.lower("p_type"), F.lit(" x"), F.substring("p_name", 1, 1)).alias("section"))
    return m.section_pool(misspelled, t.dictionary)


@query("section_canonical")
def section_canonical(t):
    headers = t.fee_items.select(F.col("section_header").alias("header"))
    return m.section_canonical(headers, t.dictionary.select(F.col("section").alias("raw"), F.col("section")))


KEYWORDS = """keywords AS (
  SELECT DISTINCT lower(unnest(list_filter(string_split(section, ' '), lambda w: length(w) >= 4))) AS keyword FROM dictionary
  WHERE regexp_full_match(section, '[A-Z][A-Z0-9 \\-]{2,20}') UNION SELECT unnest(['gizmo', 'red']))"""


@query("anchor_keywords", f"WITH {KEYWORDS} SELECT keyword FROM keywords")
def anchor_keywords(t):
    return m.anchor_keywords(t.dictionary, ("gizmo", "red"))


@query("keyword_pool", f"""
WITH {KEYWORDS}, items AS (SELECT DISTINCT item FROM fee_items)
SELECT DISTINCT item, position FROM items JOIN keywords ON contains(lower(item), keyword)
JOIN dictionary ON contains(lower(section), keyword) OR contains(lower(description), keyword)""")
def keyword_pool(t):
    return m.keyword_pool(t.fee_items, t.dictionary, m.anchor_keywords(t.dictionary, ("gizmo", "red")))


@query("candidate_union", f"""
WITH {KEYWORDS}, items AS (SELECT DISTINCT item, p_type FROM fee_items),
kw AS (SELECT DISTINCT item, position FROM items JOIN keywords ON contains(lower(item), keyword)
  JOIN dictionary ON (contains(lower(section), keyword) OR contains(lower(description), keyword)) AND item NOT LIKE '%ring%'),
sec AS (SELECT DISTINCT item, position FROM items JOIN dictionary ON section = p_type AND item LIKE '%plate%'),
pool AS (SELECT * FROM kw UNION SELECT * FROM sec)
SELECT item, position, false AS "full" FROM pool UNION ALL SELECT DISTINCT item, NULL, true FROM items WHERE item NOT IN (SELECT item FROM pool)""")
def candidate_union(t):
    items = t.fee_items
    kw = m.keyword_pool(items.where(~F.contains("item", F.lit("ring"))), t.dictionary, m.anchor_keywords(t.dictionary, ("gizmo", "red")))
    typed = items.where(F.contains("item", F.lit("plate"))).select("item", F.col("p_type").alias("section")).distinct()
    sec = meet(typed, t.dictionary.select("section", "position"), ["section"])
    return m.candidate_pool(sec, kw, items)


STATED = "CASE l_partkey % 3 WHEN 0 THEN lower(material) WHEN 1 THEN concat(' ', material, ' ') ELSE concat('Q', material) END"


@query("validate_stated_code", f"""
WITH {POOL_SQL}, st AS (SELECT item_id, lower(CASE WHEN page <= 2 THEN p_type ELSE 'zzz' END) AS section, {STATED} AS stated, upper(trim({STATED})) AS k FROM fee_items),
sec AS (SELECT pool.section, upper(code) AS k, arg_min({{'c': code, 'd': description}}, position) AS r FROM pool JOIN dictionary x ON lower(x.section) = dict_section GROUP BY ALL),
al AS (SELECT upper(code) AS k, arg_min({{'c': code, 'd': description}}, position) AS r FROM dictionary GROUP BY ALL)
SELECT item_id, coalesce(sec.r.c, al.r.c, stated) AS code, coalesce(sec.r.d, al.r.d, '') AS description,
  CASE WHEN sec.r IS NOT NULL THEN 'Contract+Dict (section)' WHEN al.r IS NOT NULL THEN 'Contract+Dict (full)' ELSE 'Contract-only (unvalidated)' END AS source,
  CASE WHEN sec.r IS NOT NULL OR al.r IS NOT NULL THEN 100 ELSE 90 END AS confidence
FROM st LEFT JOIN sec USING (section, k) LEFT JOIN al USING (k)""")
def validate_stated_code(t):
    k = F.col("l_partkey") % 3
    items = t.fee_items.select(
        "item_id", F.when(F.col("page") <= 2, F.col("p_type")).otherwise("zzz").alias("section"),
        F.when(k == 0, F.lower("material")).when(k == 1, F.concat(F.lit(" "), "material", F.lit(" "))).otherwise(F.concat(F.lit("Q"), "material")).alias("stated_code"),
    )
    pool = m.section_pool(pool_sections(t), t.dictionary)
    return m.validate_stated_code(items, pool, t.dictionary)


# ---- rosters and products


@query("roster_match", f"""
WITH n AS (SELECT DISTINCT {d.squeeze("regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g')")} AS rn FROM roster)
SELECT DISTINCT client FROM clients WHERE {d.squeeze("regexp_replace(lower(client), '[^a-z0-9 ]', ' ', 'g')")} IN (SELECT rn FROM n)
 OR EXISTS (SELECT 1 FROM roster WHERE (SELECT list_sort(list_distinct(list_filter(string_split({d.squeeze("regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g')")}, ' '),
   lambda w: w <> '' AND w NOT IN {d.in_list(fixed.ROSTER_GENERIC)} AND NOT regexp_full_match(w, '[0-9]+'))))) = (SELECT list_sort(list_distinct(list_filter(string_split({d.squeeze("regexp_replace(lower(client), '[^a-z0-9 ]', ' ', 'g')")}, ' '),
   lambda w: w <> '' AND w NOT IN {d.in_list(fixed.ROSTER_GENERIC)} AND NOT regexp_full_match(w, '[0-9]+'))))))""")
def roster_match(t):
    return m.roster_match(t.clients, t.roster)


@query("derive_client", f"""
WITH r AS (SELECT DISTINCT engagement, lower(unnest(string_split(alias, ' ')[1:1])) AS a FROM roster),
w AS (SELECT DISTINCT engagement, unnest(string_split(regexp_replace(a, '[,.\\-_/]+', ' ', 'g'), ' ')) AS w FROM r),
docs AS (SELECT key, {TOKENS} AS tokens FROM contract_meta),
s AS (SELECT key, engagement, count(*) AS n FROM (SELECT key, unnest(tokens) AS w FROM docs) JOIN w USING (w) GROUP BY ALL),
b AS (SELECT key, min(engagement) AS engagement, count(*) > 1 AS ambiguous FROM (SELECT * FROM s QUALIFY n = max(n) OVER (PARTITION BY key)) GROUP BY key)
SELECT key, coalesce(engagement, 'Needs review') AS engagement, coalesce(ambiguous, false) AS ambiguous FROM docs LEFT JOIN b USING (key)""")
def derive_client(t):
    return m.derive_client(t.contract_meta, t.roster, VENDOR)


NORMP = r"trim(regexp_replace(trim(lower({})), '\s+', ' ', 'g'), '.,;:|/-—_ ')"


@query("product_dictionary", f"""
SELECT {NORMP.format('term')} AS norm, arg_min(trim(term), position) AS canonical FROM product_terms WHERE file = 'terms_v3.csv' GROUP BY ALL""")
def product_dictionary(t):
    return m.product_dictionary(t.product_terms)


@query("canonical_products_exact", rf"""
WITH keys AS (SELECT {NORMP.format('term')} AS norm, arg_min(trim(term), position) AS canonical FROM product_terms WHERE file = 'terms_v3.csv' GROUP BY ALL),
n AS (SELECT DISTINCT product, {NORMP.format('product')} AS norm FROM raw_products),
ex AS (SELECT product, canonical, 'exact' AS stage FROM n JOIN keys USING (norm)),
pre AS (SELECT product, arg_max(canonical, length(keys.norm)) AS canonical, 'prefix' AS stage FROM n JOIN keys ON starts_with(n.norm, keys.norm || ' ') AND length(keys.norm) >= 3
        WHERE product NOT IN (SELECT product FROM ex) GROUP BY product)
SELECT product, canonical, stage FROM n LEFT JOIN (SELECT * FROM ex UNION ALL SELECT * FROM pre) USING (product)""")
def canonical_products_exact(t):
    return m.canonical_products(t.raw_products, m.product_dictionary(t.product_terms), close=False)


@query("canonical_products")
def canonical_products(t):
    return m.canonical_products(t.raw_products, m.product_dictionary(t.product_terms))


@query("products_per_contract", """
SELECT client, key, array_to_string(list_sort(list(DISTINCT lower(product))), '; ') AS products, array_to_string(list_sort(list(DISTINCT product)), '; ') AS products_raw
FROM contract_products GROUP BY ALL""")
def products_per_contract(t):
    canonical = t.contract_products.select("product", F.lower("product").alias("canonical")).distinct()
    return m.products_per_contract(t.contract_products, canonical)


# ---- similarity

NOISE = "trim(regexp_replace(regexp_replace({}, " + d.lit(fixed.LEGAL_NOISE) + r", ' ', 'g'), '\s+', ' ', 'g'))"


@query("legal_clean", f"""
SELECT item_id, {NOISE.format("item || ' dated SUBJECT TO the agreements, schedule'")} AS cleaned FROM fee_items""")
def legal_clean(t):
    return t.fee_items.select("item_id", sim.legal_clean(F.concat("item", F.lit(" dated SUBJECT TO the agreements, schedule"))).alias("cleaned"))


def gram_sql(src, key, text, out):
    words = rf"list_filter(string_split_regex(lower({text}), '\s+'), lambda w: w <> '')"
    parts = " || ".join(
        f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2 - {n} + 2), lambda i: substr(' ' || w || ' ', i, {n}))))"
        for n in (2, 3, 4))
    return f"{out} AS (SELECT {key}, gram, 1 + ln(count(*)) AS tf FROM (SELECT {key}, unnest({parts}) AS gram FROM {src}) GROUP BY ALL)"


TFIDF = f"""qt AS (SELECT DISTINCT {NOISE.format('item')} AS q FROM fee_items),
ct AS (SELECT DISTINCT {NOISE.format('description')} AS c FROM dictionary),
{gram_sql('qt', 'q', 'q', 'qg')}, {gram_sql('ct', 'c', 'c', 'cg')},
docs AS (SELECT 'q' || q AS doc, gram FROM qg UNION ALL SELECT 'c' || c, gram FROM cg),
idf AS (SELECT gram, ln((1 + (SELECT count(DISTINCT doc) FROM docs)) / (1 + count(*))) + 1 AS idf FROM docs GROUP BY gram),
qv AS (SELECT q, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY q)) AS w FROM qg JOIN idf USING (gram)),
cv AS (SELECT c, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY c)) AS w FROM cg JOIN idf USING (gram)),
sims AS (SELECT q, c, sum(qv.w * cv.w) AS cosine FROM qv JOIN cv USING (gram) GROUP BY ALL)"""


def item_text_rows(t):
    q = t.fee_items.select(sim.legal_clean(F.col("item")).alias("q")).distinct().withColumn("text", F.col("q"))
    c = t.dictionary.select(sim.legal_clean(F.col("description")).alias("c")).distinct().withColumn("text", F.col("c"))
    return q, c


@query("tfidf_pairs", f"WITH {TFIDF} SELECT q, c, round(cosine, 6) AS cosine FROM sims WHERE cosine >= 0.3")
def tfidf_pairs(t):
    q, c = item_text_rows(t)
    return sim.tfidf_pairs(q, c, 0.3).select("q", "c", F.round("cosine", 6).alias("cosine"))


@query("best_text_match", f"""
WITH {TFIDF} SELECT q, c, round(round(cosine, 9), 6) AS cosine FROM sims WHERE cosine >= 0.5
QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(cosine, 9) DESC, c) = 1""")
def best_text_match(t):
    q, c = item_text_rows(t)
    pairs = sim.tfidf_pairs(q, c, 0.5).withColumn("cosine", F.round("cosine", 9))
    return m.best_candidate(pairs, "q", "cosine", "c").select("q", "c", F.round("cosine", 6).alias("cosine"))


@query("embedding_top1", """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS best_id, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cosine
      FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT id, best_id, round(cosine, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, best_id) = 1""")
def embedding_top1(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return sim.embedding_top1(rows, rows, same_ids=True).select("id", "best_id", F.round("cosine", 6).alias("cosine"))


CONFLICT = "(regexp_matches(a, '(?i)monthly') AND regexp_matches(b, '(?i)(one.?time|setup|set.?up|implementation)'))"
HYBRID = f"""{TFIDF},
it AS (SELECT DISTINCT item, p_name, {NOISE.format('item')} AS q FROM fee_items),
di AS (SELECT DISTINCT p_name || ' ' || p_type AS description, p_name, {NOISE.format("p_name || ' ' || p_type")} AS c FROM part),
sc AS (SELECT it.item, di.description, 0.6 * list_cosine_similarity(list_transform(x.vector, lambda e: cast(e AS double)), list_transform(y.vector, lambda e: cast(e AS double))) + 0.4 * cosine AS score
   FROM sims JOIN it USING (q) JOIN di USING (c) JOIN name_vectors x ON x.p_name = it.p_name JOIN name_vectors y ON y.p_name = di.p_name),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, description) = 1),
hyb AS (SELECT item, CASE WHEN score >= 0.9 AND NOT (regexp_matches(item, '(?i)monthly') AND regexp_matches(description, '(?i)setup')) THEN description END AS matched_description, score FROM best)"""


def hybrid_sides(t):
    items = t.fee_items.select("item", "p_name").distinct().join(t.name_vectors, "p_name").select(F.col("item").alias("text"), "vector")
    descriptions = t.part.select(F.concat("p_name", F.lit(" "), "p_type").alias("text"), "p_name").distinct().join(t.name_vectors, "p_name").select("text", "vector")
    return items, descriptions


@query("hybrid_match", f"""
WITH {HYBRID}
SELECT item, matched_description, CASE WHEN matched_description IS NOT NULL THEN cast(round_even(score * 100, 0) AS int) END AS confidence,
  CASE WHEN matched_description IS NOT NULL THEN 'auto' ELSE 'review' END AS status FROM hyb""")
def hybrid_match(t):
    return sim.hybrid_match(*hybrid_sides(t))


@query("match_source_counts", f"""
WITH {HYBRID} SELECT CASE WHEN matched_description IS NOT NULL THEN 'auto' ELSE 'review' END AS status, count(*) AS items FROM hyb GROUP BY ALL""")
def match_source_counts(t):
    return sim.hybrid_match(*hybrid_sides(t)).groupBy("status").agg(F.count(F.lit(1)).alias("items"))


@query("fuzzy_scores")
def fuzzy_scores(t):
    a, b = F.col("a"), F.col("b")
    pairs = t.part.select(F.concat("p_name", F.lit(" "), "p_type").alias("a"), F.concat("p_type", F.lit(" of "), "p_name").alias("b")).distinct()
    return pairs.select("a", "b", *[F.round(fuzzy.similarity(k, a, b), 6).alias(k) for k in fuzzy.SCORERS])


# ---- validation

LINES = """l AS (SELECT c_name AS client, material AS code, material_text AS text, hier_name, document, invoice_date, net, abs(net) AS abs_net,
  abs(cast(net AS double) / nullif(cast(quantity AS double), 0)) AS unit FROM invoice_core JOIN customer ON o_custkey = c_custkey)"""


def billed(t):
    return client_lines(t)


@query("code_stats", f"""
WITH {LINES}
SELECT client, code, count(*) AS n_lines, count(DISTINCT text) AS n_texts, max(text) AS sample_text, cast(min(net) AS double) AS min_net, cast(max(net) AS double) AS max_net,
  cast(min(abs_net) AS double) AS min_abs_net, cast(max(abs_net) AS double) AS max_abs_net, round(min(unit), 8) AS min_unit, round(max(unit), 8) AS max_unit,
  cast(min(invoice_date) AS varchar) AS first_date, cast(max(invoice_date) AS varchar) AS last_date, count(DISTINCT strftime(invoice_date, '%Y-%m')) AS n_year_months,
  count(DISTINCT document) AS n_invoices, round(median(cast(net AS double)), 4) AS median_net, round(median(cast(abs_net AS double)), 4) AS median_abs_net, round(median(unit), 8) AS median_unit
FROM l GROUP BY ALL""")
def code_stats(t):
    s = v.code_stats(billed(t))
    six = {c: F.round(c, 8) for c in ("min_unit", "max_unit", "median_unit")}
    four = {c: F.round(F.col(c).cast("double"), 4) for c in ("median_net", "median_abs_net")}
    return s.withColumns({**six, **four})


@query("amount_medians", """
SELECT material, round(median(cast(net AS double)), 4) AS median_net, count(*) AS n FROM invoice_core GROUP BY material""")
def amount_medians(t):
    med = exact_median(t.invoice_core, ["material"], "net", "median_net")
    n = t.invoice_core.groupBy("material").agg(F.count(F.lit(1)).alias("n"))
    return med.join(n, "material").withColumn("median_net", F.round(F.col("median_net").cast("double"), 4))


@query("code_attributes", """
SELECT DISTINCT c_name AS client, material AS code, 'hierarchy' AS kind, hier_name AS value FROM invoice_lines JOIN customer ON o_custkey = c_custkey
UNION SELECT DISTINCT c_name, material, 'profit_center', profit_center FROM invoice_lines JOIN customer ON o_custkey = c_custkey""")
def code_attributes(t):
    lines = t.invoice_lines.join(t.customer.select("c_custkey", F.col("c_name").alias("client")), F.col("o_custkey") == F.col("c_custkey"))
    return v.code_attributes(lines)


@query("code_texts", f"""
WITH {LINES}, c AS (SELECT client, code, text, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY client, code ORDER BY n DESC, text) AS rn FROM c)
SELECT client, code, string_agg(text, '; ' ORDER BY rn) AS texts FROM r WHERE rn <= 3 GROUP BY ALL""")
def code_texts(t):
    return v.code_texts(v.code_corpus(billed(t)))


PRICES = f"""{LINES}, hits AS (SELECT client, code, cast(round(abs(net) * 100, 0) AS bigint) AS cents, count(*) AS lines, max(text) AS sample_text, min(net) AS min_net, max(net) AS max_net
  FROM l WHERE net <> 0 GROUP BY ALL)"""


@query("price_hits", f"WITH {PRICES} SELECT client, code, cents, lines, sample_text, cast(min_net AS double) AS min_net, cast(max_net AS double) AS max_net FROM hits")
def price_hits(t):
    return v.price_hits(billed(t))


@query("amount_codes", f"""
WITH {PRICES} SELECT cents, count(DISTINCT code) AS n_codes, count(DISTINCT client) AS n_clients, bool_or(min_net < 0) AS has_credit FROM hits GROUP BY cents""")
def amount_codes(t):
    return v.amount_codes(v.price_hits(billed(t)))


PRICED = """priced AS (SELECT client, item_id, item, abs(cast(price_value AS double)) AS p,
  CASE WHEN price_value <> 0 AND cast(quantity AS double) > 1 THEN abs(cast(price_value AS double)) / cast(quantity AS double) ELSE abs(cast(price_value AS double)) END AS unit_price FROM checked_items)"""


@query("price_exact", f"""
WITH {PRICES}, {PRICED}, a AS (SELECT DISTINCT client, item_id, unnest([cast(round(cast(p AS decimal(38,4)) * 100, 0) AS bigint), cast(round(cast(unit_price AS decimal(38,4)) * 100, 0) AS bigint)]) AS cents FROM priced),
n AS (SELECT cents, count(DISTINCT code) AS n_codes FROM hits GROUP BY cents),
sp AS (SELECT client, item_id, bool_or(n_codes <= 2) AS specific FROM a JOIN n USING (cents) WHERE cents > 0 GROUP BY ALL)
SELECT DISTINCT client, item_id, code, specific FROM a JOIN hits USING (client, cents) JOIN sp USING (client, item_id) WHERE cents > 0""")
def price_exact(t):
    return v.price_exact(v.item_prices(t.checked_items), v.price_hits(billed(t)))


@query("price_band_codes", f"""
WITH {LINES}, {PRICED}, s AS (SELECT client, code, median(cast(abs_net AS double)) AS a, median(unit) AS b FROM l GROUP BY ALL)
SELECT DISTINCT client, item_id, code FROM priced JOIN s USING (client)
WHERE unit_price > 0 AND (a BETWEEN unit_price * 0.75 AND unit_price * 1.25 OR b BETWEEN unit_price * 0.75 AND unit_price * 1.25)""")
def price_band_codes(t):
    return v.price_band_codes(v.item_prices(t.checked_items), v.code_stats(billed(t)))


@query("outside_scope", f"""
WITH {PRICES}, {PRICED}, a AS (SELECT client, item_id, cast(round(cast(p AS decimal(38,4)) * 100, 0) AS bigint) AS cents FROM priced)
SELECT client, item_id FROM a WHERE cents > 0 AND cents IN (SELECT cents FROM hits) AND (client, cents) NOT IN (SELECT (client, cents) FROM hits)""")
def outside_scope(t):
    return v.outside_scope(v.item_prices(t.checked_items), v.price_hits(billed(t)))


@stage("pool")
def pool_of(t):
    pool, similar = v.candidate_pool(t.checked_items, billed(t))
    _SIMILAR[(t.spark.sparkContext.applicationId, t.folder)] = similar
    return pool


_SIMILAR: dict = {}


@query("candidate_pool")
def candidate_pool(t):
    out = pool_of(t)
    return out.select("client", "item_id", "code", "tags", F.round("lexical", 6).alias("lexical"), F.round("price", 6).alias("price"), "prelim")


@stage("three")
def three_of(t):
    pool = pool_of(t)
    return v.score_funnel(pool, _SIMILAR[(t.spark.sparkContext.applicationId, t.folder)])


@query("score_funnel")
def score_funnel(t):
    return three_of(t).select("client", "item_id", "code", "place", "final", "cadence", F.round("probability", 6).alias("probability"))


@query("tier_consensus")
def tier_consensus(t):
    return v.tier_consensus(three_of(t))


@stage("validated")
def validated_items(t):
    lines = billed(t)
    hits = v.price_hits(lines)
    outside = v.outside_scope(v.item_prices(t.checked_items), hits)
    texts = v.code_texts(v.code_corpus(lines))
    return v.validated(t.checked_items, three_of(t), texts, outside, hits.select("client", "code").distinct())


@query("validate_codes")
def validate_codes(t):
    return validated_items(t)


@query("band_counts")
def band_counts(t):
    return v.band_counts(validated_items(t))
