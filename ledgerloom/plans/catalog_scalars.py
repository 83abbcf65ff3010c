"""Registered queries of column functions over fee items, contracts and amounts."""

from pyspark.sql import functions as F

from ledgerloom.functions import documents as doc
from ledgerloom.functions import fixed
from ledgerloom.functions import money
from ledgerloom.functions.names import entity_tokens, norm_party, party_set
from ledgerloom.functions.text import strip
from ledgerloom.operators import loadrows
from ledgerloom.plans import ducksql as d
from ledgerloom.plans.registry import query

S = "trim(coalesce(price, ''))"
KEY = ("item_id",)
MONEY_TEXT = (
    f"(CASE WHEN trim(replace({S}, '$', '')) LIKE '(%' THEN '-$' ELSE '$' END || "
    + "format('{:,.2f}', "
    + rf"cast(regexp_extract(regexp_replace({S}, '[$,()]', '', 'g'), '\d+\.?\d*') AS double)))"
)
HAS_NUMBER = rf"regexp_extract(regexp_replace({S}, '[$,()]', '', 'g'), '\d+\.?\d*') <> ''"
THRESHOLD = rf"(regexp_matches({S}, {d.lit(fixed.OVER_THRESHOLD)}) OR regexp_matches({S}, {d.lit(fixed.MAGNITUDE)}))"
ZERO = rf"""(CASE WHEN price IS NULL THEN false WHEN lower({S}) IN {d.in_list(fixed.ZERO_LABELS)} THEN true
  WHEN {THRESHOLD} THEN true
  ELSE coalesce(try_cast(regexp_extract(trim(regexp_replace({S}, '[$,]', '', 'g')), '-?\d+\.?\d*') AS double) = 0, false) END)"""


@query("zero_price", f"SELECT item_id, price, {ZERO} AS zero FROM fee_items")
def zero_price(t):
    return t.fee_items.select("item_id", "price", money.is_zero_price(F.col("price")).alias("zero"))


CLEAN = f"(CASE WHEN lower({S}) = 'no charge' OR {THRESHOLD} OR NOT {HAS_NUMBER} THEN '' ELSE {MONEY_TEXT} END)"


@query("clean_price", f"SELECT item_id, {CLEAN} AS cleaned FROM fee_items")
def clean_price(t):
    return t.fee_items.select("item_id", money.clean_price(F.col("price")).alias("cleaned"))


@query("clean_price_labels", f"""
SELECT item_id, CASE WHEN {d.any_word(f'lower({S})', (*fixed.KEPT_LABELS, '%'))} OR {THRESHOLD} OR NOT {HAS_NUMBER} THEN {S}
  ELSE {MONEY_TEXT} END AS cleaned FROM fee_items""")
def clean_price_labels(t):
    return t.fee_items.select("item_id", money.clean_price_keep_labels(F.col("price")).alias("cleaned"))


@query("pricing_type", f"""
SELECT item_id, CASE WHEN {S} = '' THEN '' WHEN contains({S}, '%') THEN 'percentage' WHEN {S} ILIKE '%waived%' THEN 'waived'
  WHEN {S} ILIKE '%included%' THEN 'included' WHEN {S} ILIKE '%no charge%' OR {S} ILIKE '%free%' OR {S} ILIKE '%complimentary%'
    OR {S} ILIKE '%n/a%' THEN 'no charge' WHEN {S} ILIKE '%tbd%' OR {S} ILIKE '%to be determined%' THEN 'tbd'
  WHEN regexp_matches({S}, '[0-9]') THEN 'flat' ELSE 'unknown' END AS pricing_type,
  CASE WHEN lower({S}) IN ('', 'nan') THEN '' WHEN {S} ILIKE '%included%' THEN 'included' WHEN {S} ILIKE '%prev paid%' THEN 'prev_paid'
  WHEN {S} ILIKE '%waived%' THEN 'waived' WHEN {S} ILIKE '%by quote%' THEN 'by_quote' WHEN {S} ILIKE '%no charge%' THEN 'no_charge'
  WHEN {S} ILIKE '%tbd%' THEN 'tbd' WHEN regexp_matches({S}, '[$0-9]') THEN 'dollar' ELSE 'other' END AS fee_class
FROM fee_items""")
def pricing_type(t):
    return t.fee_items.select(
        "item_id", money.pricing_type(F.col("price")).alias("pricing_type"), money.fee_class(F.col("price")).alias("fee_class")
    )


@query("tier_range", rf"""
SELECT item_id, CASE WHEN {d.any_word("lower(item)", fixed.TIER_WORDS)} THEN coalesce(
  nullif(trim(regexp_extract(trim(item), '(?i)(up to\s*[\d,]+(?:\s*(?:{'|'.join(fixed.TIER_WORDS)}))?)', 1)), ''),
  nullif(trim(regexp_extract(trim(item), '(\d{{1,3}}(?:,\d{{3}})+\s*(?:to|[-–])\s*\d{{1,3}}(?:,\d{{3}})+)', 1)), ''),
  nullif(trim(regexp_extract(trim(item), '(\d{{3,}}\s*(?:to|[-–])\s*\d{{3,}})', 1)), ''),
  nullif(trim(regexp_extract(trim(item), '(?i)(over\s*[\d,]+)', 1)), ''), '') ELSE '' END AS tier FROM fee_items""")
def tier_range(t):
    return t.fee_items.select("item_id", money.tier_range(F.col("item")).alias("tier"))


def _infer(words):
    out = "frequency"
    for label, ws in reversed(words):
        out = f"CASE WHEN {d.any_word('lower(item)', ws)} THEN '{label}' ELSE {out} END"
    return out


CANON = {
    c: f"""(CASE WHEN {d.any_word(f"lower(trim(coalesce({c}, '')))", fixed.MONTHLY_WORDS)} THEN 'Monthly'
  WHEN {d.any_word(f"lower(trim(coalesce({c}, '')))", fixed.ANNUAL_WORDS)} THEN 'Annual'
  WHEN {d.any_word(f"lower(trim(coalesce({c}, '')))", fixed.ONE_TIME_WORDS)} THEN 'One-Time' END)"""
    for c in ("frequency", "item")
}


@query("frequency", f"""
SELECT item_id, CASE WHEN trim(coalesce(frequency, '')) <> '' THEN frequency ELSE {_infer(fixed.FREQUENCY_WORDS)} END AS inferred,
       {CANON['frequency']} AS canonical, {CANON['item']} AS hinted FROM fee_items""")
def frequency(t):
    f, i = F.col("frequency"), F.col("item")
    return t.fee_items.select(
        "item_id", money.infer_frequency(f, i).alias("inferred"), money.canon_frequency(f).alias("canonical"),
        money.canon_frequency(i).alias("hinted"),
    )


CODE_DATES = """code_dates AS (
  SELECT material, count(DISTINCT document) AS n, count(DISTINCT strftime(invoice_date, '%Y-%m')) AS m,
         min(invoice_date) AS f, max(invoice_date) AS l, max(invoice_date) - min(invoice_date) AS span
  FROM invoice_parties GROUP BY billto, material),
cadences AS (
  SELECT *, CASE WHEN n <= 1 OR span < 45 THEN 'One-Time'
         WHEN m / greatest(span / 30.44, 1.0) >= 0.6 OR span / greatest(n - 1, 1) <= 45 THEN 'Monthly'
         WHEN span / greatest(n - 1, 1) >= 300 THEN 'Annual' ELSE 'Unknown' END AS cadence FROM code_dates)"""


def _agree(f):
    step = lambda c: f"(CASE {c} WHEN 'One-Time' THEN 0 WHEN 'Monthly' THEN 1 WHEN 'Annual' THEN 2 END)"
    return f"""(CASE WHEN {f} IS NULL OR cadence = 'Unknown' THEN 0.5 WHEN {f} = cadence THEN 1.0
      WHEN abs({step(f)} - {step('cadence')}) = 1 THEN 0.6 ELSE 0.3 END)"""


@query("cadence", f"WITH {CODE_DATES} SELECT cadence, count(*) AS codes, cast(sum(n) AS bigint) AS invoices FROM cadences GROUP BY cadence")
def cadence(t):
    return code_cadence(t).groupBy("cadence").agg(F.count(F.lit(1)).alias("codes"), F.sum("n").alias("invoices"))


def code_cadence(t):
    stats = t.invoice_parties.groupBy("billto", "material").agg(
        F.countDistinct("document").alias("n"),
        F.countDistinct(F.date_format("invoice_date", "yyyy-MM")).alias("m"),
        F.min("invoice_date").alias("f"), F.max("invoice_date").alias("l"),
    )
    return stats.withColumn("cadence", money.infer_cadence(F.col("f"), F.col("l"), F.col("n"), F.col("m")))


@query("frequency_signal", f"""
WITH {CODE_DATES}, c AS (SELECT material, min(cadence) AS cadence FROM cadences GROUP BY material)
SELECT item_id, cadence, round(cast(CASE
  WHEN {CANON['frequency']} IS NOT NULL AND {CANON['item']} IS NOT NULL THEN 0.7 * {_agree(CANON['frequency'])} + 0.3 * {_agree(CANON['item'])}
  WHEN {CANON['frequency']} IS NOT NULL THEN {_agree(CANON['frequency'])} WHEN {CANON['item']} IS NOT NULL THEN {_agree(CANON['item'])}
  ELSE 0.5 END AS double), 6) AS signal FROM fee_items JOIN c USING (material)""")
def frequency_signal(t):
    c = code_cadence(t).groupBy("material").agg(F.min("cadence").alias("cadence"))
    signal = money.frequency_signal(F.col("frequency"), F.col("item"), F.col("cadence"))
    return t.fee_items.join(c, "material").select("item_id", "cadence", F.round(signal, 6).alias("signal"))


@query("row_flags", rf"""
SELECT item_id,
  ({d.any_word("lower(coalesce(price, '') || ' ' || item)", fixed.ZERO_ROW_WORDS)}
   OR lower(regexp_replace({S}, '[$, ]', '', 'g')) IN ('0', '0.0', '0.00', '0.000', '-')
   OR coalesce(abs(try_cast(regexp_replace({CLEAN}, '[$,]', '', 'g') AS double)) < 0.005 AND lower({S}) NOT IN ('', 'nan', 'none'), false)) AS zero_priced,
  regexp_matches(coalesce(frequency, '') || ' ' || item, {d.lit(fixed.PER_UNIT)}) AS per_unit,
  regexp_replace(lower(trim(regexp_replace(trim(regexp_replace(trim(item), {d.lit(fixed.TIER_PARENTHESIS)}, '')),
    {d.lit(fixed.TIER_TRAILING_RANGE)}, ''))), '\s+', ' ', 'g') AS base_fee
FROM fee_items""")
def row_flags(t):
    cleaned = F.translate(money.clean_price(F.col("price")), "$,", "").try_cast("double")
    return t.fee_items.select(
        "item_id", money.is_zero_priced_row(F.col("price"), F.col("item"), cleaned).alias("zero_priced"),
        money.is_per_unit(F.col("frequency"), F.col("item")).alias("per_unit"),
        money.base_fee(F.col("item")).alias("base_fee"),
    )


@query("amounts", rf"""
SELECT item_id, cast(CASE WHEN {S} LIKE '($%)' THEN -try_cast(regexp_replace({S}, '[$,()]', '', 'g') AS decimal(38,4))
       WHEN regexp_full_match(trim(regexp_replace({S}, '[$,]', '', 'g')), '[+-]?(\d+\.?\d*|\.\d+)')
       THEN cast(trim(regexp_replace({S}, '[$,]', '', 'g')) AS decimal(38,4)) ELSE 0 END AS double) AS safe,
       cast(try_cast(regexp_replace(price, '[^0-9.-]', '', 'g') AS decimal(38,4)) AS double) AS amount,
       cast(round(abs(amount) * 100, 0) AS bigint) AS cents,
       upper(regexp_replace(' ' || material || ' x', '\s+', '', 'g')) AS code_key
FROM fee_items""")
def amounts(t):
    return t.fee_items.select(
        "item_id", money.safe_amount(F.col("price")).alias("safe"), money.to_amount(F.col("price")).alias("amount"),
        money.cents(F.col("amount")).alias("cents"),
        money.norm_code(F.concat(F.lit(" "), "material", F.lit(" x"))).alias("code_key"),
    )


@query("formats", r"""
SELECT item_id, format('{:,.2f}', cast(amount AS double)) AS money_text,
       CASE WHEN page % 3 = 0 THEN '' ELSE cast(page AS varchar) END AS page_text
FROM fee_items""")
def formats(t):
    page = F.when(F.col("page") % 3 == 0, F.lit("0")).otherwise(F.concat(F.col("page").cast("string"), F.lit(".0")))
    return t.fee_items.select(
        "item_id", money.format_money(F.col("amount")).alias("money_text"), money.format_page(page).alias("page_text")
    )


BAND = """(CASE WHEN abs(p - med) <= 0.02 * greatest(abs(med), 1.0) THEN 1.0 WHEN p BETWEEN lo AND hi THEN 0.9
  WHEN p BETWEEN lo * 0.75 AND hi * 1.25 THEN 0.7 WHEN abs(p - med) <= 0.25 * greatest(abs(med), 1.0) THEN 0.7
  ELSE greatest(0.0, 0.7 * (1.0 - (CASE WHEN p < lo THEN lo - p ELSE p - hi END) / (3.0 * greatest(hi - lo, abs(med), 1.0)))) END)"""


@query("price_band", f"""
WITH s AS (SELECT material, cast(min(abs(net)) AS double) AS lo, cast(max(abs(net)) AS double) / 2 AS hi,
                  (cast(min(abs(net)) AS double) + cast(max(abs(net)) AS double)) / 3 AS med FROM invoice_core GROUP BY material)
SELECT item_id, round(cast({BAND} AS double), 6) AS band FROM (
  SELECT item_id, cast(amount AS double) * 1.2 AS p, lo, hi, med FROM fee_items JOIN s USING (material))""")
def price_band(t):
    net = F.abs(F.col("net"))
    s = t.invoice_core.groupBy("material").agg(
        F.min(net).cast("double").alias("lo"), (F.max(net).cast("double") / 2).alias("hi"),
        ((F.min(net).cast("double") + F.max(net).cast("double")) / 3).alias("med"),
    )
    band = money.price_band(F.col("amount").cast("double") * 1.2, F.col("med"), F.col("lo"), F.col("hi"))
    return t.fee_items.join(s, "material").select("item_id", F.round(band, 6).alias("band"))


# ---- filenames


@query("contract_names", rf"""
SELECT filename, cast(try_strptime(nullif(regexp_extract(filename, '(\d{{1,2}})-(\d{{1,2}})-(\d{{4}})'), ''), '%m-%d-%Y') AS date)::varchar AS file_date,
       regexp_extract(filename, '(\d{{1,2}}[_-]\d{{1,2}}[_-]\d{{4}})', 1) AS date_text,
       CASE WHEN filename ILIKE '%master%' THEN 'Master Agreement' WHEN filename ILIKE '%amend%' THEN 'Amendment'
            WHEN filename ILIKE '%services%' THEN 'Services' ELSE '' END AS name_type,
       (filename ILIKE '%master%' OR filename ILIKE '%amendment%' OR filename ILIKE '%services%') AS clause_document,
       ({d.any_word('lower(filename)', fixed.MASTER_WORDS)} AND NOT {d.any_word('lower(filename)', fixed.NOT_MASTER_WORDS)}) AS master
FROM files""")
def contract_names(t):
    f = F.col("filename")
    return t.files.select(
        "filename", doc.filename_date(f).alias("file_date"), doc.filename_date_text(f).alias("date_text"),
        doc.type_from_name(f).alias("name_type"), doc.is_clause_document(f).alias("clause_document"),
        doc.looks_like_master(f).alias("master"),
    )


# ---- parties

VENDOR = ("vendorco", "vendorco solutions")
PARTY_VIEW = "SELECT filename, ['Vendorco Solutions, Inc.', client || ', N.A. Holdings', 'The ' || soldto || ' Savings Bank'] AS parties FROM (SELECT filename, client, 'Region' || (o_orderkey % 7) AS soldto FROM contracts)"


def _norm_party(x):
    p = "|".join(fixed.PARTY_SUFFIXES)
    return d.squeeze(rf"regexp_replace(regexp_replace(lower({x}), '[,.\-_/]+', ' ', 'g'), '\b({p})\b', ' ', 'g')")


def with_parties(t):
    place = F.concat(F.lit("Region"), (F.col("o_orderkey") % 7).cast("string"))
    return t.contracts.select(
        "filename",
        F.array(F.lit("Vendorco Solutions, Inc."), F.concat("client", F.lit(", N.A. Holdings")),
                F.concat(F.lit("The "), place, F.lit(" Savings Bank"))).alias("parties"),
    )


@query("party_set", f"""
SELECT filename, array_to_string(list_sort(list_distinct(list_filter(list_transform(parties, lambda p: {_norm_party('p')}), lambda p: p <> ''))), '; ') AS parties
FROM ({PARTY_VIEW})""")
def party_set_query(t):
    return with_parties(t).select("filename", party_set(F.col("parties")).alias("parties"))


@query("entity_tokens", f"""
SELECT filename, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(list_transform(
    list_append(parties, regexp_replace(string_split(filename, '_')[1], '\\.[^.]*$', '')), lambda p: {_norm_party('p')}),
    lambda p: string_split(p, ' ')[1] <> 'vendorco'), lambda p: string_split(p, ' '))),
  lambda w: w <> '' AND w NOT IN {d.in_list(fixed.PARTY_GENERIC)}))), '; ') AS tokens
FROM ({PARTY_VIEW})""")
def entity_tokens_query(t):
    return with_parties(t).select("filename", entity_tokens(F.col("parties"), F.col("filename"), VENDOR).alias("tokens"))


# ---- load row pieces


@query("item_category", f"""
SELECT item_id, CASE WHEN {d.any_word("lower(coalesce(frequency, ''))", ('one time', 'one-time', 'onetime'))} THEN 'ZINL'
  WHEN {d.any_word("lower(coalesce(frequency, ''))", ('monthly', '/month', 'per month', 'annual', 'per year'))}
   AND NOT {d.any_word("lower(coalesce(frequency, ''))", ('per ', '/trans', 'each'))} THEN 'ZINM' ELSE 'ZINR' END AS category,
  CASE WHEN p_type = 'ECONOMY' OR item ILIKE '%postage%' THEN 'No' ELSE 'Yes' END AS cpi,
  cast(try_cast(replace(regexp_extract(coalesce(pricing_condition, ''), '(?i)minimum[^$]*\\$?\\s*([\\d,]+\\.?\\d*)', 1), ',', '') AS decimal(18,2)) AS double) AS minimum
FROM fee_items""")
def item_category(t):
    category = F.when(F.col("p_type") == "ECONOMY", "ZINL").otherwise("")
    return t.fee_items.select(
        "item_id", loadrows.item_category(F.col("frequency")).alias("category"),
        loadrows.cpi_eligible(F.col("item"), category).alias("cpi"),
        loadrows.minimum_fee(F.col("pricing_condition")).alias("minimum"),
    )


PARSED = rf"regexp_replace({S}, '[$,]|USD', '', 'g')"


@query("parse_price", rf"""
SELECT item_id, cast(CASE WHEN regexp_full_match(trim({PARSED}), '[+-]?(\d+\.?\d*|\.\d+)') THEN trim({PARSED}) END AS double) AS number,
       CASE WHEN trim({PARSED}) = '' OR regexp_full_match(trim({PARSED}), '[+-]?(\d+\.?\d*|\.\d+)') THEN '' ELSE {S} END AS status
FROM fee_items""")
def parse_price(t):
    number, status = loadrows.parse_price(F.col("price"))
    return t.fee_items.select("item_id", number.alias("number"), status.alias("status"))


# ---- escalation

VIEW_SNIPPETS = """(SELECT o_orderkey, client, contract_type,
    '(File: a.pdf - Page ' || (o_orderkey % 9) || ') The fees rise by ' || (o_orderkey % 7) || '.5% or ' || (o_orderkey % 4) || ' percent'
    || CASE o_orderkey % 5 WHEN 0 THEN ', whichever is greater' WHEN 1 THEN ' of the Consumer Price Index' WHEN 2 THEN ' of CPI limited to the cap'
       ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' with 30 days notice' ELSE '' END AS snippet,
    CASE o_orderkey % 4 WHEN 0 THEN 'January 1, 2024' WHEN 1 THEN '3/15/99' WHEN 2 THEN '' ELSE '12/31/2025' END AS increase,
    replace(regexp_extract(filename, '(\\d{1,2}-\\d{1,2}-\\d{4})', 1), '-', '_') AS contract_date FROM contracts)"""
TRIMMED = "trim(substr(snippet, instr(snippet, ')') + 1))"
FEE = rf"(CASE WHEN len(regexp_extract_all({TRIMMED}, '(?i)(\d+(?:\.\d+)?)\s*(%|percent)', 1)) > 0 THEN array_to_string(list_transform(regexp_extract_all({TRIMMED}, '(?i)(\d+(?:\.\d+)?)\s*(%|percent)', 1), lambda x: x || '%'), ', ') ELSE 'NA' END)"


@query("escalation_fields", rf"""
SELECT o_orderkey,
  CASE WHEN {TRIMMED} ILIKE '%whichever is greater%' THEN '> CPI-U or ' || {FEE}
       WHEN {TRIMMED} NOT ILIKE '%cpi%' AND {TRIMMED} NOT ILIKE '%consumer price index%' THEN 'Max ' || {FEE}
       ELSE '< CPI-U or ' || {FEE} END AS cpi_terms,
  CASE increase WHEN 'January 1, 2024' THEN '2024' WHEN '3/15/99' THEN '2099' WHEN '' THEN cast(cast(right(contract_date, 4) AS int) + 1 AS varchar) ELSE '2025' END AS eligibility_year,
  CASE increase WHEN 'January 1, 2024' THEN 'January' WHEN '3/15/99' THEN 'March' WHEN '' THEN '' ELSE 'December' END AS eligibility_month,
  '30 Days' AS notice_requirement,
  CASE WHEN {TRIMMED} ILIKE '%limited%' THEN substr({TRIMMED}, instr({TRIMMED}, 'limited')) WHEN contains({TRIMMED}, '30') THEN {TRIMMED} ELSE '' END AS specific_language,
  CASE WHEN contains({TRIMMED}, '30') THEN {TRIMMED} ELSE '' END AS language,
  CASE WHEN contains({TRIMMED}, '30') THEN '' ELSE {TRIMMED} END AS language_for_review
FROM {VIEW_SNIPPETS}""")
def escalation_fields(t):
    s = t.sql(f"SELECT * FROM contracts JOIN {VIEW_SNIPPETS.replace('FROM contracts', 'FROM contracts')} USING (o_orderkey)".replace(
        "regexp_extract(filename, '(\\d{1,2}-\\d{1,2}-\\d{4})', 1)", "regexp_extract(filename, '([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})', 1)"))
    fields = doc.escalation_fields(F.col("snippet"), F.col("increase"), F.col("contract_date"))
    return s.select("o_orderkey", *[c.alias(n) for n, c in fields.items()])


@query("local_fields", rf"""
SELECT o_orderkey, regexp_extract(increase || ' ' || snippet, {d.lit(fixed.ESCALATION_DATE)}) AS date_text,
       trim(regexp_extract(snippet, {d.lit(fixed.ESCALATION_PERCENT)})) AS percent_text
FROM {VIEW_SNIPPETS}""")
def local_fields(t):
    s = t.sql(f"SELECT * FROM contracts JOIN {VIEW_SNIPPETS} USING (o_orderkey)".replace("\\d", "[0-9]"))
    return s.select("o_orderkey", doc.first_date_text(F.concat_ws(" ", "increase", "snippet")).alias("date_text"),
                    doc.first_percent_text(F.col("snippet")).alias("percent_text"))


@query("capital_names", r"""
SELECT filename, array_to_string(list_filter(string_split_regex(upper(left(client, 8)) || '-PDF ' || filename, '[\s-]+'),
   lambda p: regexp_matches(p, '[A-Za-z]') AND p = upper(p) AND p <> 'PDF'), ' ') AS name FROM contracts""")
def capital_names(t):
    name = F.concat(F.upper(F.substring("client", 1, 8)), F.lit("-PDF "), "filename")
    return t.contracts.select("filename", doc.capital_words(name).alias("name"))


OPEN, CLOSE = "that", ("the", "and")


@query("span_extract", r"""
WITH p AS (SELECT client, filename, page, text, instr(lower(text), 'that') AS s FROM pages_text),
r AS (SELECT *, substr(lower(text), s) AS region FROM p WHERE s > 0),
c AS (SELECT *, least(nullif(instr(region, 'the'), 0), nullif(instr(region, 'and'), 0)) AS k FROM r)
SELECT client, filename, page,
       trim(substr(text, s, CASE WHEN instr(substr(region, k), '.') > 0 THEN k + instr(substr(region, k), '.') - 1 ELSE length(text) - s + 1 END)) AS span
FROM c WHERE k IS NOT NULL""")
def span_extract(t):
    span = doc.span_after(F.col("text"), OPEN, CLOSE)
    return t.pages_text.select("client", "filename", "page", span.alias("span")).where(F.col("span").isNotNull())
