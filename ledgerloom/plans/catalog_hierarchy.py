"""Registered queries over the contract forest."""

from pyspark.sql import functions as F

from ledgerloom.functions import contracts as fc
from ledgerloom.functions import fixed
from ledgerloom.operators import hierarchy as h
from ledgerloom.operators import parents as p
from ledgerloom.plans import ducksql as d
from ledgerloom.plans.catalog_scalars import _norm_party
from ledgerloom.plans.registry import query, stage

VENDOR = ("vendorco", "vendorco solutions")

# ---- oracle: contracts with resolved type, dates, entity words, parties

BODY = "CASE WHEN coalesce(contract_type, '') = '' THEN 'Unknown' " + " ".join(
    f"WHEN lower(trim(contract_type)) IN {d.in_list(names)} THEN {d.lit(t)}" for t, names in fixed.TYPE_NAMES
) + " ELSE contract_type END"
NAMED = "CASE " + " ".join(
    f"WHEN regexp_matches(translate(filename, '_.', '  '), {d.lit('(?i)' + pat)}) THEN {d.lit(t)}" for pat, t in fixed.FILENAME_TYPES
) + " END"
FILE_DATE = r"cast(try_strptime(nullif(regexp_extract(filename, '(\d{1,2})-(\d{1,2})-(\d{4})'), ''), '%m-%d-%Y') AS date)"
REFINED = f"(body IN {d.in_list(fixed.GENERIC_TYPES)} AND coalesce(named IN {d.in_list((*fixed.SPECIFIC_ROOT_TYPES, 'Termination Agreement'))}, false))"


def _rank(ranks):
    return "CASE " + " ".join(f"WHEN type IN {d.in_list(ts)} THEN {r}" for r, ts in ranks) + " ELSE 99 END"


TOKENS = f"""list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(list_transform(
    list_append(coalesce(parties, []), regexp_replace(string_split(filename, '_')[1], '\\.[^.]*$', '')), lambda p: {_norm_party('p')}),
    lambda p: string_split(p, ' ')[1] <> 'vendorco'), lambda p: string_split(p, ' '))),
  lambda w: w <> '' AND w NOT IN {d.in_list(fixed.PARTY_GENERIC)})))"""
PARTIES = f"list_sort(list_distinct(list_filter(list_transform(coalesce(parties, []), lambda p: {_norm_party('p')}), lambda p: p <> '')))"
PREP = f"""prep0 AS (SELECT *, {BODY} AS body, {NAMED} AS named, {FILE_DATE} AS fdate, effective_date AS e0, signed_date AS s0 FROM contract_meta),
prep1 AS (SELECT * EXCLUDE (effective_date, signed_date), CASE WHEN (body = 'Unknown' AND named IS NOT NULL) OR {REFINED} THEN named ELSE body END AS type,
  CASE WHEN body = 'Unknown' AND named IS NOT NULL THEN 'type taken from filename: ' || named WHEN {REFINED} THEN 'type refined by filename: ' || body || ' to ' || named
       WHEN named <> body THEN 'filename suggests ' || named || ', body says ' || body ELSE '' END AS type_note,
  CASE WHEN abs(e0 - fdate) > 90 THEN fdate ELSE coalesce(e0, fdate) END AS effective_date,
  coalesce(s0, CASE WHEN abs(e0 - fdate) > 90 THEN fdate ELSE coalesce(e0, fdate) END) AS signed_date,
  CASE WHEN abs(e0 - fdate) > 90 THEN 'filename date preferred, ' || abs(e0 - fdate) || ' days apart' ELSE '' END AS date_note,
  {TOKENS} AS tokens, {PARTIES} AS party_set,
  CASE WHEN extraction_score BETWEEN 0 AND 100 THEN extraction_score ELSE CASE extraction_confidence WHEN 'high' THEN 85 WHEN 'medium' THEN 55 ELSE 25 END END AS xscore
  FROM prep0),
prep AS (SELECT *, {_rank(fixed.PARENT_RANKS)} AS rank, {_rank(fixed.TYPE_RANKS)} AS hrank,
  CASE WHEN type IN {d.in_list(fixed.ROOT_TYPES)} THEN 0 END AS root_level FROM prep1)"""
SAME_ENTITY = "(len(a.tokens) = 0 OR len(b.tokens) = 0 OR list_has_any(a.tokens, b.tokens))"


@stage("contracts")
def prepared(t):
    return h.prepare_contracts(t.contract_meta, VENDOR)


@query("resolve_types", f"WITH {PREP} SELECT key, type, type_note, rank, hrank FROM prep")
def resolve_types(t):
    return prepared(t).select("key", "type", "type_note", "rank", "hrank")


@query("resolve_dates", f"WITH {PREP} SELECT key, cast(effective_date AS varchar) AS effective_date, cast(signed_date AS varchar) AS signed_date, date_note FROM prep")
def resolve_dates(t):
    return prepared(t).select("key", "effective_date", "signed_date", "date_note")


@query("contract_entities", f"WITH {PREP} SELECT key, array_to_string(tokens, '; ') AS tokens, array_to_string(party_set, '; ') AS party_set FROM prep")
def contract_entities(t):
    return prepared(t).select("key", "tokens", "party_set")


LONG = r"list_transform(regexp_extract_all(quote, '(?i)\b([A-Za-z]+ \d{1,2}[,\s]+\d{4})\b', 1), lambda x: cast(coalesce(try_strptime(regexp_replace(x, '[,\s]+', ' ', 'g'), '%b %d %Y'), try_strptime(regexp_replace(x, '[,\s]+', ' ', 'g'), '%B %d %Y')) AS date))"
US = r"list_transform(regexp_extract_all(quote, '\b(\d{1,2}/\d{1,2}/\d{4})\b', 1), lambda x: cast(try_strptime(x, '%m/%d/%Y') AS date))"
ISO = r"list_transform(regexp_extract_all(quote, '\b(\d{4}-\d{2}-\d{2})\b', 1), lambda x: try_cast(x AS date))"
DASH = r"list_transform(regexp_extract_all(quote, '\b(\d{1,2}-\d{1,2}-\d{4})\b', 1), lambda x: cast(try_strptime(x, '%m-%d-%Y') AS date))"
DATES = f"list_filter(flatten([{LONG}, {US}, {ISO}, {DASH}]), lambda x: x IS NOT NULL)"
NUMBERS = f"""list_distinct(list_filter(list_concat(regexp_extract_all(quote, {d.lit(fixed.AGREEMENT_NUMBER)}, 1),
  regexp_extract_all(quote, {d.lit(fixed.AGREEMENT_NUMBER)}, 2)), lambda x: x <> ''))"""


@query("cited_dates", f"""
SELECT key, position, array_to_string(list_transform(list_sort(list_distinct({DATES})), lambda x: cast(x AS varchar)), '; ') AS dates,
       array_to_string(list_sort({NUMBERS}), '; ') AS numbers FROM citations""")
def cited_dates(t):
    q = F.col("quote")
    return t.citations.select("key", "position", F.array_sort(F.array_distinct(fc.cited_dates(q))).alias("dates"),
                              F.array_sort(fc.cited_numbers(q)).alias("numbers"))


# ---- codes

LABEL = f"regexp_matches(value, {d.lit(fixed.CUSTOMER_LABEL)})"
STAMP = " OR ".join(f"regexp_matches(value, {d.lit(x)})" for x in (fixed.REVISION_STAMP, fixed.SIGNING_ENVELOPE, fixed.MARKETING_CODE))
GUID = f"(contains(lower(value), 'docusign') OR contains(lower(value), 'envelope') OR regexp_matches(lower(value), {d.lit(fixed.GUID_LIKE)}))"
POSITION = f"CASE WHEN lower(trim(position)) IN {d.in_list((*fixed.HIGH_VALUE_POSITIONS, *fixed.LOW_VALUE_POSITIONS))} THEN lower(trim(position)) ELSE 'unknown' END"
HIGH = f"({POSITION} IN {d.in_list(fixed.HIGH_VALUE_POSITIONS)})"


@query("code_noise", f"""
SELECT key, value, {LABEL} AS customer_label, ({STAMP}) AS template_mark, {GUID} AS guid, {POSITION} AS position,
  array_to_string(CASE WHEN {GUID} THEN [] ELSE list_sort(list_distinct(list_filter(regexp_extract_all(value, '\\d{{3,}}'), lambda r: NOT regexp_full_match(r, '0+')))) END, '; ') AS numbers
FROM doc_codes""")
def code_noise(t):
    v = F.col("value")
    return t.doc_codes.select(
        "key", "value", fc.is_customer_label(v).alias("customer_label"), fc.is_template_mark(v).alias("template_mark"),
        fc.is_guid(v).alias("guid"), fc.code_position(F.col("position")).alias("position"),
        F.array_sort(fc.code_numbers(v)).alias("numbers"),
    )


CLEAN = f"""clean AS (SELECT client, key, trim(value) AS value, bool_or({HIGH}) AS high FROM doc_codes
  WHERE NOT {LABEL} AND NOT ({STAMP}) AND trim(value) <> '' GROUP BY ALL),
sizes AS (SELECT client, count(*) AS contracts FROM contract_meta GROUP BY client),
freq AS (SELECT client, value, count(*) AS documents, any_value(contracts) AS contracts,
   greatest(8, cast(round_even(any_value(contracts) * 0.25, 0) AS int)) AS threshold FROM clean JOIN sizes USING (client) GROUP BY ALL),
numbers AS (SELECT DISTINCT client, key, unnest(list_filter(regexp_extract_all(value, '\\d{{3,}}'), lambda r: NOT regexp_full_match(r, '0+'))) AS token
  FROM doc_codes WHERE {HIGH} AND NOT {GUID} AND NOT {LABEL} AND NOT ({STAMP})),
all_numbers AS (SELECT DISTINCT client, key, unnest(list_filter(regexp_extract_all(value, '\\d{{3,}}'), lambda r: NOT regexp_full_match(r, '0+'))) AS token
  FROM doc_codes WHERE {HIGH} AND NOT {GUID})"""


@query("code_frequency", f"WITH {CLEAN} SELECT client, value, documents, contracts, threshold, documents >= threshold AS boilerplate FROM freq")
def code_frequency(t):
    return p.code_frequency(t.contract_meta, t.doc_codes)


# ---- parent finders

REFS = f"""{PREP}, {CLEAN},
quotes AS (SELECT c.client, c.key, c.position, c.source, c.quote FROM citations c),
tier_a AS (
  SELECT a.key, b.key AS cand, b.rank, abs(b.effective_date - q.cited) AS gap, q.position, q.source, q.quote
  FROM (SELECT key, position, source, quote, unnest(list_distinct({DATES})) AS cited FROM quotes) q
  JOIN prep a USING (key) JOIN prep b ON b.client = a.client AND b.key <> a.key AND abs(b.effective_date - q.cited) <= 7
  WHERE coalesce(q.cited <> a.effective_date, true) AND coalesce(q.cited <> a.signed_date, true) AND {SAME_ENTITY}),
tier_b AS (
  SELECT a.key, b.key AS cand, b.rank, 0 AS gap, q.position, q.source, q.quote
  FROM (SELECT key, position, source, quote, unnest({NUMBERS}) AS token FROM quotes) q
  JOIN prep a USING (key) JOIN all_numbers n ON n.client = a.client AND n.token = q.token JOIN prep b ON b.key = n.key AND b.key <> a.key
  WHERE {SAME_ENTITY} AND a.key NOT IN (SELECT key FROM tier_a)),
tiers AS (SELECT *, 'A' AS tier FROM tier_a UNION ALL SELECT *, 'B' FROM tier_b),
best AS (SELECT * FROM tiers QUALIFY (rank, gap) = min((rank, gap)) OVER (PARTITION BY key)),
cand AS (SELECT key, tier, cand, min({{'p': position, 's': source, 'q': quote}}) AS cite FROM best GROUP BY ALL),
stat AS (
  SELECT c.key, c.tier, count(*) AS n, count(DISTINCT CASE WHEN len(b.party_set) > 0 THEN b.party_set END) AS n_parties, bool_or(len(b.party_set) = 0) AS unnamed,
         count(DISTINCT b.type) AS n_types, max(b.effective_date) - min(b.effective_date) AS span, bool_or(b.effective_date IS NULL) AS undated,
         min({{'f': b.filename, 'k': b.key, 'd': b.effective_date}}) AS all_pick,
         min(CASE WHEN len(b.party_set) > 0 AND b.party_set = a.party_set THEN {{'f': b.filename, 'k': b.key, 'd': b.effective_date}} END) AS own_pick,
         min(cite) AS cite
  FROM cand c JOIN prep b ON b.key = c.cand JOIN prep a ON a.key = c.key GROUP BY ALL),
common AS (
  SELECT DISTINCT key FROM (
    SELECT c.key, tok, count(*) AS held, any_value(a.tokens) AS own FROM (SELECT key, cand, unnest(tokens) AS tok FROM (SELECT cand.key, cand.cand, prep.tokens FROM cand JOIN prep ON prep.key = cand.cand)) c
    JOIN prep a ON a.key = c.key GROUP BY ALL) JOIN stat USING (key)
  WHERE held = n AND (len(own) = 0 OR list_contains(own, tok))),
verdict AS (
  SELECT key, tier, cite, CASE WHEN n = 1 THEN all_pick WHEN own_pick IS NOT NULL THEN own_pick WHEN n_parties = 1 AND NOT unnamed THEN all_pick
    WHEN n_parties = 0 THEN all_pick WHEN n_types = 1 AND NOT undated AND span <= 7 AND key IN (SELECT key FROM common) THEN all_pick END AS chosen FROM stat),
refs AS (SELECT key, chosen.k AS parent_key, chosen.d AS parent_date, chosen IS NULL AS is_ambiguous, cite.s AS source, cite.q AS quote, tier FROM verdict)"""


@stage("references")
def references(t):
    return p.parents_by_reference(prepared(t), t.citations, t.doc_codes)


@query("parents_by_reference", f"WITH {REFS} SELECT key, parent_key, cast(parent_date AS varchar) AS parent_date, is_ambiguous, source, quote, tier FROM refs")
def parents_by_reference(t):
    return references(t)


CODES = """feat AS (
  SELECT client, key, 'value' AS kind, value AS code, high FROM clean JOIN freq USING (client, value) WHERE high OR documents < threshold
  UNION ALL SELECT client, key, 'number', token, true FROM numbers),
cfeat AS (SELECT client, key, 'value' AS kind, value AS code FROM clean UNION ALL SELECT client, key, 'number', token FROM numbers),
code_pairs AS (
  SELECT a.key, b.key AS cand, b.filename, CASE WHEN b.root_level = 0 THEN 0 ELSE 99 END AS lvl, b.rank, b.effective_date AS day,
         min(CASE WHEN f.high THEN 0 ELSE 1 END) AS hv, bool_or(f.kind = 'number') AS via_number,
         bool_or((CASE WHEN f.kind = 'number' THEN 'agreement' ELSE string_split(f.code, ' ')[1] END) IN
                 (SELECT value FROM clean h WHERE h.key = a.key AND h.high)) AS high_value
  FROM feat f JOIN cfeat g ON f.client = g.client AND f.kind = g.kind AND f.code = g.code AND f.key <> g.key
  JOIN prep a ON a.key = f.key JOIN prep b ON b.key = g.key
  WHERE SAME_ENTITY AND (b.effective_date < a.effective_date OR (b.root_level = 0 AND b.effective_date = a.effective_date)) GROUP BY ALL),
code_best AS (SELECT * FROM code_pairs QUALIFY row_number() OVER (PARTITION BY key ORDER BY lvl, hv, rank, day DESC, filename) = 1)""".replace("SAME_ENTITY", SAME_ENTITY)


def rooted(t):
    """Contracts with the level their type alone gives them."""
    return prepared(t).withColumn("level", F.when(F.col("type").isin(*fixed.ROOT_TYPES), 0))


@query("parents_by_doc_code", f"""
WITH {PREP}, {CLEAN}, {CODES}
SELECT key, cand AS parent_key, via_number, high_value FROM code_best WHERE key IN (SELECT key FROM prep WHERE root_level IS NULL)""")
def parents_by_doc_code(t):
    c = rooted(t)
    return p.parents_by_doc_code(c, c.where(F.col("level").isNull()), t.doc_codes)


PRODUCTS = """psets AS (SELECT client, key, list_sort(list(DISTINCT lower(trim(product)))) AS ps FROM contract_products GROUP BY ALL),
prod_pairs AS (
  SELECT a.key, b.key AS cand, len(list_intersect(x.ps, y.ps)) AS shared, len(list_intersect(x.ps, y.ps)) / least(len(x.ps), len(y.ps)) AS ratio
  FROM prep a JOIN psets x ON x.key = a.key JOIN prep b ON b.client = a.client AND b.root_level = 0 AND b.effective_date < a.effective_date
  JOIN psets y ON y.key = b.key WHERE list_has_any(x.ps, y.ps) AND SAME_ENTITY),
prod_best AS (SELECT key, cand FROM prod_pairs WHERE ratio >= 0.5 QUALIFY (ratio, shared) = max((ratio, shared)) OVER (PARTITION BY key)),
prods AS (SELECT key, CASE WHEN count(*) = 1 THEN min(cand) END AS parent_key, count(*) > 1 AS is_ambiguous FROM prod_best GROUP BY key)""".replace("SAME_ENTITY", SAME_ENTITY)


@query("parents_by_products", f"""
WITH {PREP}, {PRODUCTS} SELECT * FROM prods WHERE key IN (SELECT key FROM prep WHERE root_level IS NULL)""")
def parents_by_products(t):
    c = rooted(t)
    return p.parents_by_products(c, c.where(F.col("level").isNull()), t.contract_products)


PHRASES = "list_distinct(flatten([" + ", ".join(
    f"CASE WHEN regexp_matches(quote, {d.lit('(?i)' + pat)}) THEN [{', '.join(d.lit(x) for x in ts)}] ELSE [] END" for pat, ts in fixed.GENERIC_PARENT_PHRASES
) + "]))"
UNIQUE = f"""allowed AS (SELECT DISTINCT key, unnest({PHRASES}) AS type FROM citations WHERE source = 'parent_reference'),
uni AS (
  SELECT a.key, b.key AS cand, b.filename, b.type, b.tokens, b.effective_date AS day, min(b.effective_date) OVER (PARTITION BY a.key) AS oldest
  FROM prep a JOIN allowed w ON w.key = a.key JOIN prep b ON b.client = a.client AND b.type = w.type AND b.root_level = 0 AND b.effective_date < a.effective_date
  WHERE len(a.tokens) > 0 AND {SAME_ENTITY}),
uniq AS (SELECT key, arg_min(cand, filename) FILTER (day <= oldest + 180) AS parent_key FROM uni GROUP BY key HAVING count(DISTINCT (type, tokens)) = 1)"""


@query("parents_by_unique_root", f"""
WITH {PREP}, {UNIQUE} SELECT * FROM uniq WHERE key IN (SELECT key FROM prep WHERE root_level IS NULL)""")
def parents_by_unique_root(t):
    c = rooted(t)
    return p.parents_by_unique_root(c, c.where(F.col("level").isNull()), t.citations)


@query("parent_by_nearest_date", f"""
WITH {PREP}, x AS (
  SELECT a.key, b.key AS cand, b.hrank, b.effective_date AS day, row_number() OVER (PARTITION BY a.key ORDER BY b.hrank DESC, b.effective_date DESC, b.filename) AS rn
  FROM prep a JOIN prep b ON b.client = a.client AND b.hrank < a.hrank AND b.effective_date < a.effective_date),
f AS (SELECT * FROM x WHERE rn = 1)
SELECT f.key, f.cand AS parent_key, count(*) > 1 AS is_ambiguous FROM f JOIN x ON x.key = f.key AND x.hrank = f.hrank AND f.day - x.day <= 90 GROUP BY ALL""")
def parent_by_nearest_date(t):
    c = prepared(t)
    return p.parent_by_nearest_date(c, c)


PASS1 = f"""{REFS},
pass1 AS (
  SELECT a.*, CASE WHEN bundled THEN r_parent END AS parent1, CASE WHEN root_level = 0 AND NOT bundled THEN 0 END AS level1,
    CASE WHEN bundled THEN 'reference' WHEN type = 'MSA' THEN 'root' WHEN root_level = 0 THEN 'miscellaneous' END AS method1,
    CASE WHEN bundled THEN CASE extraction_confidence WHEN 'high' THEN 'high' ELSE 'medium-high' END WHEN root_level = 0 THEN 'high' END AS confidence1
  FROM (SELECT prep.*, refs.parent_key AS r_parent, coalesce(root_level = 0 AND type <> 'MSA' AND refs.parent_key IS NOT NULL
          AND abs(prep.effective_date - refs.parent_date) <= 90, false) AS bundled FROM prep LEFT JOIN refs USING (key)) a)"""


@query("first_pass", f"WITH {PASS1} SELECT key, level1 AS level, parent1 AS parent_key, method1 AS method, confidence1 AS confidence FROM pass1")
def first_pass(t):
    out = h.first_pass(prepared(t), references(t))
    return out.select("key", "level", "parent_key", "method", "confidence")


PASS2 = f"""{PASS1}, prep_b AS (SELECT * EXCLUDE (root_level), level1 AS root_level FROM pass1),
{CODES.replace('prep ', 'prep_b ')}, {PRODUCTS.replace('prep ', 'prep_b ')}, {UNIQUE.replace('prep ', 'prep_b ')},
pass2 AS (
  SELECT x.*, coalesce(parent1, CASE WHEN level1 IS NULL THEN coalesce(r.parent_key, cb.cand, pr.parent_key, u.parent_key) END) AS parent2,
    coalesce(method1, CASE WHEN r.parent_key IS NOT NULL THEN 'reference' WHEN cb.cand IS NOT NULL THEN 'doc_code' WHEN pr.parent_key IS NOT NULL THEN 'products'
       WHEN u.parent_key IS NOT NULL THEN 'single_msa_fallback' ELSE 'orphan' END) AS method2,
    coalesce(method1 IS NULL AND r.parent_key IS NULL AND cb.via_number, false) AS via_number,
    coalesce(r.is_ambiguous, false) OR coalesce(pr.is_ambiguous, false) AS refused
  FROM pass1 x LEFT JOIN refs r USING (key) LEFT JOIN code_best cb USING (key) LEFT JOIN prods pr USING (key) LEFT JOIN uniq u USING (key)),
pass2b AS (SELECT * EXCLUDE (parent2), CASE WHEN method2 <> 'orphan' THEN parent2 END AS parent2,
    CASE WHEN level1 = 0 THEN 0 WHEN method2 = 'orphan' THEN -1 END AS level2 FROM pass2)"""


@stage("linked")
def second(t):
    contracts, refs = prepared(t), references(t)
    return h.second_pass(h.first_pass(contracts, refs), refs, t.citations, t.doc_codes, t.contract_products)


@query("second_pass", f"WITH {PASS2} SELECT key, parent2 AS parent_key, method2 AS method, level2 AS level, via_number, method2 = 'orphan' AND refused AS is_ambiguous FROM pass2b")
def second_pass(t):
    return second(t).select("key", "parent_key", "method", "level", "via_number", "is_ambiguous")


PROMOTED = f"""{PASS2},
anchors AS (SELECT DISTINCT parent2 AS key FROM pass2b WHERE via_number),
promoted AS (SELECT * EXCLUDE (level2, method2), CASE WHEN level2 = -1 AND key IN (SELECT key FROM anchors) THEN 0 ELSE level2 END AS level3,
   CASE WHEN level2 = -1 AND key IN (SELECT key FROM anchors) THEN 'chain_root' ELSE method2 END AS method3 FROM pass2b)"""


@query("promote_chain_roots", f"WITH {PROMOTED} SELECT key, level3 AS level, method3 AS method FROM promoted")
def promote_chain_roots(t):
    return h.promote_chain_roots(second(t)).select("key", "level", "method")


def _levels(src, level, parent, out):
    return f"""{out} AS (
  SELECT key, 0 AS lvl FROM {src} WHERE {level} = 0
  UNION ALL
  SELECT c.key, r.lvl + 1 FROM {src} c JOIN {out} r ON c.{parent} = r.key WHERE c.{level} IS NULL AND r.lvl < 20)"""


@query("assign_levels", f"""
WITH RECURSIVE {PROMOTED}, {_levels('promoted', 'level3', 'parent2', 'lv')}
SELECT p.key, coalesce(lv.lvl, CASE WHEN level3 = -1 THEN -1 END) AS level FROM promoted p LEFT JOIN lv USING (key)""")
def assign_levels(t):
    return leveled_of(t).select("key", "level")


SALVAGED = f"""{PROMOTED}, {_levels('promoted', 'level3', 'parent2', 'lv')},
leveled AS (SELECT p.*, coalesce(lv.lvl, CASE WHEN level3 = -1 THEN -1 END) AS level4 FROM promoted p LEFT JOIN lv USING (key)),
salv AS (
  SELECT a.key, arg_min(b.key, (b.effective_date IS NULL, b.effective_date, b.filename)) AS root FROM leveled a
  JOIN numbers n ON n.key = a.key JOIN numbers m ON m.client = n.client AND m.token = n.token JOIN leveled b ON b.key = m.key
  WHERE a.method3 <> 'chain_root' AND (a.level4 IS NULL OR a.level4 < 0) AND b.method3 = 'chain_root' AND b.key <> a.key
    AND {SAME_ENTITY} AND coalesce(b.effective_date < a.effective_date, true) GROUP BY a.key),
salvaged AS (SELECT l.* EXCLUDE (parent2, method3, level4), coalesce(s.root, parent2) AS parent5, CASE WHEN s.root IS NOT NULL THEN 'doc_code' ELSE method3 END AS method5,
   CASE WHEN s.root IS NULL THEN CASE WHEN level4 = 0 OR level4 = -1 THEN level4 END END AS level5, s.root IS NOT NULL AS saved FROM leveled l LEFT JOIN salv s USING (key)),
{_levels('salvaged', 'level5', 'parent5', 'lv2')},
broken AS (SELECT s.* EXCLUDE (parent5, method5), coalesce(lv2.lvl, -1) AS level, CASE WHEN lv2.lvl IS NULL AND level5 IS NULL THEN 'orphan' ELSE method5 END AS method6,
   CASE WHEN lv2.lvl IS NULL AND level5 IS NULL THEN NULL ELSE parent5 END AS parent6 FROM salvaged s LEFT JOIN lv2 USING (key)),
dups AS (
  SELECT key, first_value(key) OVER w AS original FROM (SELECT *, list_sort(list_distinct(list_filter(list_transform(coalesce(parties, []), lambda p: lower(trim(p))), lambda p: p <> ''))) AS names FROM broken
    WHERE level = 0 AND effective_date IS NOT NULL) WINDOW w AS (PARTITION BY client, type, effective_date, names ORDER BY filename)),
forest0 AS (SELECT b.*, CASE WHEN original <> b.key THEN original END AS duplicate_of FROM broken b LEFT JOIN dups USING (key)),
forest1 AS (SELECT f.* EXCLUDE (method6, parent6), CASE WHEN f.duplicate_of IS NOT NULL THEN 'duplicate' ELSE f.method6 END AS method, coalesce(g.duplicate_of, f.parent6) AS parent_key,
   g.duplicate_of IS NOT NULL AS relinked FROM forest0 f LEFT JOIN forest0 g ON f.parent6 = g.key),
forest AS (SELECT * EXCLUDE (relinked), relinked,
   CASE WHEN method = 'orphan' THEN 0 ELSE cast(round_even((CASE method {' '.join(f"WHEN '{m}' THEN {s}" for m, s in fixed.METHOD_SCORES)} END + xscore) / 2.0, 0) AS int) END AS score FROM forest1),
hier AS (SELECT *, CASE WHEN method = 'orphan' THEN NULL WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS bucket,
   CASE WHEN duplicate_of IS NOT NULL THEN 'Duplicate' WHEN level = -1 THEN 'Orphan' WHEN level = 0 THEN 'Parent' ELSE 'Child' END AS status FROM forest)"""


@stage("leveled")
def leveled_of(t):
    return h.assign_levels(h.promote_chain_roots(second(t)))


@stage("forest")
def forest_of(t):
    return h.finish_forest(leveled_of(t), t.doc_codes)


@query("resolve_hierarchy", f"WITH RECURSIVE {SALVAGED} SELECT key, type, level, parent_key, method, duplicate_of, score, bucket, status FROM hier")
def resolve_hierarchy(t):
    return forest_of(t).select("key", "type", "level", "parent_key", "method", "duplicate_of", "score", "bucket", "status")


@query("salvage_and_break", f"WITH RECURSIVE {SALVAGED} SELECT key, level, method6 AS method, parent6 AS parent_key FROM broken")
def salvage_and_break(t):
    return h.salvage_and_break(leveled_of(t), t.doc_codes).select("key", "level", "method", "parent_key")


@query("mark_duplicates", f"WITH RECURSIVE {SALVAGED} SELECT key, duplicate_of, relinked FROM forest1")
def mark_duplicates(t):
    return forest_of(t).select("key", "duplicate_of", "relinked")


@query("hierarchy_rows", f"""
WITH RECURSIVE {SALVAGED}
SELECT a.filename, a.client, a.type AS contract_type, cast(a.signed_date AS varchar) AS signed_date, cast(a.effective_date AS varchar) AS effective_date,
  coalesce(b.filename, 'None') AS parent_contract, coalesce(c.filename, '') AS duplicate_of, a.level, a.status,
  CASE a.method WHEN 'miscellaneous' THEN 'standalone' ELSE a.method END AS method, a.score, coalesce(a.bucket, '') AS bucket, a.xscore AS extraction_score,
  coalesce(array_to_string(a.parties, '; '), '') AS parties
FROM hier a LEFT JOIN hier b ON a.parent_key = b.key LEFT JOIN hier c ON a.duplicate_of = c.key""")
def hierarchy_rows(t):
    return h.hierarchy_rows(forest_of(t)).drop("confidence", "is_ambiguous", "notes")


@query("hierarchy_summary", f"""
WITH RECURSIVE {SALVAGED}
SELECT type, count(*) AS contracts, count(*) FILTER (level = 0) AS roots, count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2,
  count(*) FILTER (level > 2) AS deeper, count(*) FILTER (level = -1) AS orphans, count(*) FILTER (bucket = 'high') AS high,
  count(*) FILTER (bucket = 'medium') AS medium, count(*) FILTER (bucket = 'low') AS low FROM hier GROUP BY type""")
def hierarchy_summary(t):
    return h.hierarchy_summary(forest_of(t), ("type",)).drop("ambiguous")


CLASS = "CASE WHEN level = 0 THEN 'Parent' WHEN level = 1 THEN 'Amendment' WHEN level = 2 THEN 'Sub-Amendment' WHEN level > 2 THEN 'Others' ELSE 'Orphan' END"


@query("classification_grid", f"""
WITH RECURSIVE {SALVAGED}, c AS (SELECT {CLASS} AS document_class, coalesce(bucket, 'unknown') AS bucket, CASE method WHEN 'miscellaneous' THEN 'Standalone' ELSE method END AS method FROM hier)
SELECT document_class, bucket, method, count(*) AS contracts FROM c GROUP BY GROUPING SETS ((document_class, bucket, method), (document_class, bucket))""")
def classification_grid(t):
    return h.classification_grid(forest_of(t))


@query("keep_contracts", f"""
WITH RECURSIVE {SALVAGED}
SELECT key, level, bucket, type FROM hier WHERE (bucket IS NULL OR bucket = 'medium') AND (level <> 0 OR type IN ('MSA', 'Software Agreement')) AND {CLASS} IN ('Parent', 'Amendment', 'Orphan')""")
def keep_contracts(t):
    kept = h.keep_contracts(forest_of(t), ("medium", None), ("MSA", "Software Agreement"), ("Parent", "Amendment", "Orphan"))
    return kept.select("key", "level", "bucket", "type")


@query("root_type_counts", f"WITH RECURSIVE {SALVAGED} SELECT type, count(*) AS contracts FROM hier WHERE level = 0 GROUP BY type")
def root_type_counts(t):
    return h.root_type_counts(forest_of(t))


@query("era_counts", f"""
WITH RECURSIVE {SALVAGED}
SELECT level, CASE WHEN signed_date IS NULL THEN 'unknown' WHEN year(signed_date) < 2011 THEN 'Era 1' WHEN year(signed_date) < 2016 THEN 'Era 2' WHEN year(signed_date) < 2021 THEN 'Era 3' ELSE 'Era 4' END AS era, count(*) AS contracts
FROM hier GROUP BY ALL""")
def era_counts(t):
    return h.era_counts(forest_of(t))


@query("graph_edges", f"""
WITH RECURSIVE {SALVAGED} SELECT a.client, b.filename AS parent, a.filename AS child, a.method FROM hier a JOIN hier b ON a.parent_key = b.key""")
def graph_edges(t):
    return h.graph_edges(forest_of(t))


@query("product_lineage", f"""
WITH RECURSIVE {SALVAGED}, n AS (SELECT DISTINCT client, key, trim(product) AS product FROM contract_products),
s AS (SELECT product, count(*) AS contracts, row_number() OVER (ORDER BY count(*) DESC, lower(product), product) AS position FROM n GROUP BY product)
SELECT product, position, contracts, row_number() OVER (PARTITION BY product ORDER BY coalesce(signed_date, DATE '1900-01-01'), client, filename, key) AS step,
  client, filename, cast(signed_date AS varchar) AS signed_date, level
FROM n JOIN s USING (product) JOIN (SELECT key, filename, signed_date, level FROM hier) USING (key) WHERE position <= 30""")
def product_lineage(t):
    return h.product_lineage(forest_of(t), t.contract_products)


STATUS = f"""{SALVAGED}, kids AS (SELECT DISTINCT parent_key AS key FROM hier WHERE parent_key IS NOT NULL),
statuses AS (SELECT x.*, CASE WHEN is_active = false THEN 'SUPERSEDED' WHEN status = 'Orphan' THEN 'ORPHAN'
   WHEN status = 'Parent' OR key IN (SELECT key FROM kids) THEN CASE WHEN level = 0 OR method IN ('root', 'miscellaneous') THEN 'ROOT-PARTIAL' ELSE 'SUPERSEDED' END
   WHEN status = 'Duplicate' THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS contract_status FROM hier x)"""


@query("contract_status", f"WITH RECURSIVE {STATUS} SELECT key, contract_status FROM statuses")
def contract_status(t):
    return h.contract_status(t.contract_meta.select("key", "is_active"), forest_of(t)).select("key", "contract_status")
