"""Registered queries over contract files, load rows and product modules."""

from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.documents import signature_score
from ledgerloom.operators import documents as docs
from ledgerloom.operators import loadrows, modules
from ledgerloom.plans import ducksql as d
from ledgerloom.plans.registry import query

MIN_YEAR, FALLBACK_YEAR = 2001, 1998
FILE_DATE = r"cast(try_strptime(nullif(regexp_extract(filename, '(\d{1,2})-(\d{1,2})-(\d{4})'), ''), '%m-%d-%Y') AS date)"


@query("year_cutoff", f"""
SELECT client, filename, cast(CASE WHEN year({FILE_DATE}) >= {MIN_YEAR} THEN {FILE_DATE} END AS varchar) AS file_date,
       coalesce(year({FILE_DATE}) >= {MIN_YEAR}, false) AS kept FROM files""")
def year_cutoff(t):
    return docs.year_cutoff(t.files, MIN_YEAR).select("client", "filename", "file_date", "kept")


@query("drop_suffix_copies", r"""
SELECT client, filename, size FROM files f
WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.client = f.client
  AND g.filename = regexp_extract(f.filename, '^(.+)_([^_]+)\.pdf$', 1) || '.pdf')""")
def drop_suffix_copies(t):
    return docs.drop_suffix_copies(t.files).select("client", "filename", "size")


@query("dedupe_by_pages", r"""
WITH k AS (SELECT *, coalesce(nullif(regexp_extract(filename, '\d{1,2}-\d{1,2}-\d{4}'), ''), filename) AS dt FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY client, dt, size > 1048576 ORDER BY pages DESC, filename) AS rn FROM k)
SELECT client, filename, size, pages FROM r WHERE size <= 1048576 OR rn = 1""")
def dedupe_by_pages(t):
    return docs.dedupe_by_pages(t.files).select("client", "filename", "size", "pages")


@query("dedupe_by_size", f"""
WITH k AS (SELECT *, {FILE_DATE} AS fd FROM files),
r AS (SELECT *, max(size) OVER (PARTITION BY client, fd) AS mx, row_number() OVER (PARTITION BY client, fd ORDER BY size DESC, filename) AS rn FROM k)
SELECT client, filename, size FROM r WHERE fd IS NULL OR mx <= 1048576 OR rn = 1""")
def dedupe_by_size(t):
    from ledgerloom.functions.documents import filename_date

    dated = t.files.withColumn("file_date", filename_date(F.col("filename")))
    return docs.dedupe_by_size(dated).select("client", "filename", "size")


@query("select_files", f"""
WITH k AS (SELECT *, {FILE_DATE} AS fd, coalesce(year({FILE_DATE}) >= {MIN_YEAR}, false) AS post,
  CASE WHEN {d.any_word('lower(filename)', fixed.MSA_NAME_WORDS)} THEN 'MSA'
       WHEN {d.any_word('lower(filename)', fixed.RENEWAL_WORDS)} THEN 'Renewal_Amendment'
       WHEN {d.any_word('lower(filename)', fixed.AMENDMENT_NAME_WORDS)} THEN 'maybe' ELSE 'Other' END AS hint FROM files),
p AS (SELECT *, bool_or(post) OVER (PARTITION BY client) AS anyp FROM k),
q AS (SELECT *, bool_or(hint IN ('MSA', 'Renewal_Amendment')) OVER (PARTITION BY client) AS byname FROM p
      WHERE CASE WHEN anyp THEN post ELSE NOT post AND year(fd) >= {FALLBACK_YEAR} END),
ty AS (SELECT *, CASE WHEN hint <> 'maybe' THEN hint WHEN byname OR NOT ({d.any_word('lower(head_text)', fixed.RENEWAL_WORDS)} OR pages > 30)
       THEN 'Amendment' ELSE 'Renewal_Amendment' END AS file_type FROM q),
dd AS (SELECT *, max(size) OVER (PARTITION BY client, fd) AS mx, row_number() OVER (PARTITION BY client, fd ORDER BY size DESC, filename) AS rn FROM ty),
s AS (SELECT * FROM dd WHERE mx <= 1048576 OR rn = 1),
w AS (SELECT *, bool_or(post AND file_type IN ('MSA', 'Renewal_Amendment')) OVER (PARTITION BY client) AS settled,
      row_number() OVER (PARTITION BY client ORDER BY (post OR file_type = 'Other'), (file_type = 'Amendment'), fd DESC, size DESC, filename DESC) AS pick FROM s)
SELECT client, filename, cast(fd AS varchar) AS file_date, file_type, size FROM w
WHERE post OR (NOT settled AND pick = 1 AND file_type <> 'Other')""")
def select_files(t):
    return docs.select_files(t.files, MIN_YEAR, FALLBACK_YEAR)


MASTER = lambda c: f"({d.any_word(f'lower({c})', fixed.MASTER_WORDS)} AND NOT {d.any_word(f'lower({c})', fixed.NOT_MASTER_WORDS)})"


@query("latest_master", f"""
WITH c AS (
  SELECT client, filename, 1 AS source, coalesce(effective_date, signed_date) AS dt FROM hierarchy_source
  WHERE {MASTER('contract_type')} AND duplicate_of = ''
  UNION ALL
  SELECT client, filename, 2, coalesce(effective_date, {FILE_DATE}) FROM overview
  WHERE {MASTER('contract_type')} OR {MASTER('document_type')} OR coalesce({MASTER('agreement_type')}, false)
  UNION ALL
  SELECT client, filename, 3, {FILE_DATE} FROM contracts WHERE {MASTER('filename')}),
r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY source, dt DESC, filename DESC) AS rn FROM c)
SELECT client, filename, cast(dt AS varchar) AS signing_date, source FROM r WHERE rn = 1""")
def latest_master(t):
    return docs.latest_master(t.contracts, t.hierarchy_source, t.overview)


@query("apply_scope", """
WITH allow AS (
  SELECT 'cpi' AS agent, client, CASE WHEN contract_type = 'Amendment' THEN filename ELSE '' END AS filename FROM contracts
  UNION ALL SELECT 'clauses', client, filename FROM contracts WHERE contract_type = 'Master Agreement'),
agents AS (SELECT unnest(['cpi', 'clauses', 'overview']) AS agent),
listed AS (SELECT DISTINCT agent, client FROM allow WHERE filename <> '')
SELECT a.agent, c.client, c.filename FROM contracts c CROSS JOIN agents a
WHERE (a.agent, c.client) NOT IN (SELECT (agent, client) FROM listed)
   OR (a.agent, c.client, c.filename) IN (SELECT (agent, client, filename) FROM allow)""")
def apply_scope(t):
    c = t.contracts
    allow = c.select(
        F.lit("cpi").alias("agent"), "client",
        F.when(F.col("contract_type") == "Amendment", F.col("filename")).otherwise("").alias("filename"),
    ).unionByName(
        c.where(F.col("contract_type") == "Master Agreement").select(F.lit("clauses").alias("agent"), "client", "filename")
    )
    return docs.apply_scope(c, allow, ("cpi", "clauses", "overview"))


@query("rows_with_data", """
SELECT item_id FROM fee_items WHERE (trim(coalesce(price, '')) <> '' AND lower(trim(price)) <> 'nan') OR trim(coalesce(frequency, '')) <> ''""")
def rows_with_data(t):
    return docs.rows_with_data(t.fee_items, ["price", "frequency"]).select("item_id")


@query("search_rows", """
SELECT client, source_contract, item_id, item FROM fee_items
WHERE contains(lower(client), 'ring up') OR contains(lower(source_contract), 'ring up') OR contains(lower(item_id), 'ring up') OR contains(lower(item), 'ring up')
ORDER BY item_id LIMIT 500""")
def search_rows(t):
    rows = t.fee_items.select("client", "source_contract", "item_id", "item")
    return docs.search_rows(rows, "Ring UP", [F.col("item_id")])


@query("signature_score", f"""
SELECT client, filename, page, cast({' + '.join(f"CASE WHEN contains(lower(text), {d.lit(w)}) THEN 5 ELSE 0 END" for w in ("that the", "of the", "and the"))}
  + CASE WHEN w >= 2 THEN 3 * w ELSE 0 END AS int) AS score
FROM (SELECT *, {' + '.join(f"CASE WHEN regexp_matches(lower(text), {d.lit(p)}) THEN 1 ELSE 0 END" for p in ("^the", "er[.]", "tion"))} AS w FROM pages_text)""")
def signature_score_query(t):
    score = signature_score(F.col("text"), ("that the", "of the", "and the"), ("^the", "er[.]", "tion"))
    return t.pages_text.select("client", "filename", "page", score.alias("score"))


SIGNED = """signed AS (
  SELECT client, filename, page, text, CASE WHEN contains(lower(text), 'license') THEN 'IN WITNESS WHEREOF' ELSE '' END || text AS t FROM pages_text),
scored AS (SELECT client, filename, page, CASE WHEN contains(lower(t), 'in witness whereof') THEN 5 ELSE 0 END AS score FROM signed)"""


@query("signature_pages", f"""
WITH {SIGNED},
r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY page) AS ix,
      row_number() OVER (w ORDER BY score < 5, score DESC, page) AS sig, max(score) OVER w >= 5 AS anysig
      FROM scored WINDOW w AS (PARTITION BY client, filename))
SELECT client, filename, page, score FROM r
WHERE n <= 8 OR ix <= 4 OR CASE WHEN anysig THEN score >= 5 AND sig <= 4 ELSE ix > n - 4 END""")
def signature_pages(t):
    marked = F.concat(
        F.when(F.contains(F.lower("text"), F.lit("license")), F.lit("IN WITNESS WHEREOF")).otherwise(""), F.col("text")
    )
    return docs.signature_pages(t.pages_text.withColumn("text", marked))


TITLES = ("ednd", "hath", "inat")


@query("schedule_pages", """
WITH tp AS (SELECT client, filename, page, lower(replace(replace(text, 'the ', 'schedule '), 'and of', 'a schedule to ')) AS low FROM pages_text),
titles AS (SELECT unnest(['ednd', 'hath', 'inat']) AS title),
j AS (SELECT tp.*, title, row_number() OVER (PARTITION BY client, filename, title ORDER BY page) AS ix FROM tp CROSS JOIN titles),
st AS (SELECT client, filename, title, coalesce(min(ix) FILTER (contains(low, title) AND contains(low, 'schedule')), min(ix) FILTER (contains(low, title))) AS s FROM j GROUP BY ALL),
i AS (SELECT j.*, s FROM j JOIN st USING (client, filename, title) WHERE ix >= s AND ix < s + 12),
e AS (SELECT client, filename, title, min(ix) AS e FROM i WHERE ix > s AND contains(low, ' schedule to ') AND NOT contains(left(low, 500), title) GROUP BY ALL)
SELECT i.client, i.filename, i.title, i.page FROM i LEFT JOIN e USING (client, filename, title) WHERE e IS NULL OR ix < e""")
def schedule_pages(t):
    text = F.regexp_replace(F.regexp_replace("text", "the ", "schedule "), "and of", "a schedule to ")
    pages = t.pages_text.withColumn("text", text)
    titles = t.documents.select(
        F.col("source").alias("client"), F.concat("doc_id", F.lit(".pdf")).alias("filename"),
        F.explode(F.array(*[F.lit(x) for x in TITLES])).alias("title"),
    )
    return docs.schedule_pages(pages, titles)


# ---- load rows

VENDOR = "vendorco"


@query("split_legal_items", f"""
SELECT item_id, regexp_matches(concat_ws(' ', item, section_header, coalesce(pricing_condition, ''), explanation),
  '(?i)(vendorco\\s+will\\s+credit|late\\s+payment\\s+commitment)') AS legal FROM fee_items""")
def split_legal_items(t):
    return loadrows.split_legal_items(t.fee_items, VENDOR).select("item_id", "legal")


@query("group_dictionary", """
WITH x AS (SELECT code, description, min(position) AS ix FROM dictionary GROUP BY ALL),
f AS (SELECT code, arg_min({'a': item_category, 'b': condition_type, 'c': cpi_eligible}, position) AS f FROM dictionary GROUP BY code)
SELECT code, string_agg(description, '; ' ORDER BY ix) AS descriptions, f.a AS item_category, f.b AS condition_type, f.c AS cpi_eligible
FROM x JOIN f USING (code) GROUP BY ALL""")
def group_dictionary(t):
    return loadrows.group_dictionary(t.dictionary)


MATCHED = """matched AS (
  SELECT f.*, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN concat('F', material) ELSE material END AS code,
         CASE WHEN l_partkey % 2 = 0 THEN concat(' ', lower(p_name), ' ', p_type) ELSE '' END AS picked_description,
         CASE WHEN l_partkey % 3 = 0 THEN 'ZINR' ELSE '' END AS model_category,
         CASE WHEN l_partkey % 5 = 1 THEN 'fallback' ELSE 'primary' END AS source_dict
  FROM fee_items f)"""
PICKED = f"""{MATCHED},
prim AS (SELECT code, description, position, upper(trim(description)) AS k, item_category, condition_type, cpi_eligible FROM dictionary),
firsts AS (SELECT * FROM prim QUALIFY row_number() OVER (PARTITION BY code ORDER BY position) = 1),
exacts AS (SELECT * FROM prim QUALIFY row_number() OVER (PARTITION BY code, k ORDER BY position) = 1),
masters AS (SELECT concat('F', code) AS code, arg_min(description, position) AS description FROM dictionary GROUP BY ALL),
picked AS (
  SELECT m.*, coalesce(nullif(CASE WHEN f.code IS NOT NULL THEN coalesce(e.description, f.description)
                      WHEN x.code IS NOT NULL THEN coalesce(nullif(trim(picked_description), ''), x.description) END, ''), trim(m.item)) AS final_description,
         nullif(CASE WHEN e.code IS NOT NULL THEN e.item_category ELSE f.item_category END, '') AS dict_category,
         CASE WHEN f.code IS NOT NULL THEN coalesce(nullif(CASE WHEN e.code IS NOT NULL THEN e.condition_type ELSE f.condition_type END, ''), 'ZPRM') END AS dict_condition,
         CASE WHEN e.code IS NOT NULL THEN e.cpi_eligible ELSE f.cpi_eligible END AS dict_cpi
  FROM matched m LEFT JOIN firsts f ON m.code = f.code
  LEFT JOIN exacts e ON m.code = e.code AND e.k = nullif(upper(trim(picked_description)), '')
  LEFT JOIN masters x ON m.code = x.code)"""


def picked_items(t):
    part = F.col("l_partkey")
    matched = t.fee_items.select(
        "*",
        F.when(part % 5 == 0, None).when(part % 5 == 1, F.concat(F.lit("F"), "material")).otherwise(F.col("material")).alias("code"),
        F.when(part % 2 == 0, F.concat(F.lit(" "), F.lower("p_name"), F.lit(" "), "p_type")).otherwise("").alias("picked_description"),
        F.when(part % 3 == 0, "ZINR").otherwise("").alias("model_category"),
        F.when(part % 5 == 1, "fallback").otherwise("primary").alias("source_dict"),
    )
    fallback = t.dictionary.withColumn("code", F.concat(F.lit("F"), "code"))
    return loadrows.dictionary_pick(matched, t.dictionary, fallback)


@query("dictionary_pick", f"WITH {PICKED} SELECT item_id, code, final_description, dict_category, dict_condition, dict_cpi FROM picked")
def dictionary_pick(t):
    return picked_items(t).select("item_id", "code", "final_description", "dict_category", "dict_condition", "dict_cpi")


PN = r"trim(regexp_replace(trim(coalesce(price, '')), '[$,]|USD', '', 'g'))"
NUM = rf"(CASE WHEN regexp_full_match({PN}, '[+-]?(\d+\.?\d*|\.\d+)') THEN cast({PN} AS decimal(18,2)) END)"
MINF = r"try_cast(replace(regexp_extract(coalesce(pricing_condition, ''), '(?i)minimum[^$]*\$?\s*([\d,]+\.?\d*)', 1), ',', '') AS decimal(18,2))"
FREQ = "lower(coalesce(frequency, ''))"
CAT = f"""coalesce(dict_category, nullif(model_category, ''), CASE WHEN {d.any_word(FREQ, ('one time', 'one-time', 'onetime'))} THEN 'ZINL'
  WHEN {d.any_word(FREQ, ('monthly', '/month', 'per month', 'annual', 'per year'))} AND NOT {d.any_word(FREQ, ('per ', '/trans', 'each'))} THEN 'ZINM' ELSE 'ZINR' END)"""


@query("load_rows", f"""
WITH {PICKED}, c AS (
  SELECT *, {NUM} AS number, {MINF} AS fee, {CAT} AS category,
    {d.any_word("lower(concat_ws(' ', item, section_header))", fixed.PASS_THROUGH_WORDS)} AND {NUM} IS NULL AS passed,
    cast(date_trunc('month', signed_date) + INTERVAL 1 MONTH AS date) AS start,
    'AGRMNT DTD ' || month(signed_date) || '/' || day(signed_date) || '/' || year(signed_date) AS note FROM picked)
SELECT client, item_id, coalesce(code, '') AS material, final_description AS description, coalesce(nullif(quantity, ''), '1') AS quantity,
  category AS item_category, cast(start AS varchar) AS start_date,
  cast(CASE WHEN category = 'ZINL' THEN last_day(start) ELSE cast(start + INTERVAL 10 YEAR AS date) END AS varchar) AS end_date,
  CASE WHEN code IS NULL OR passed THEN '' ELSE coalesce(dict_condition, 'ZPRM') END AS condition_type,
  cast(number AS double) AS price, CASE WHEN number IS NOT NULL THEN 'USDN' ELSE '' END AS currency,
  CASE WHEN fee IS NOT NULL THEN '*PMIN ' || cast(fee AS varchar) || '*' || note ELSE note END AS customer_note,
  CASE WHEN code IS NOT NULL AND category <> 'ZINL' AND NOT passed AND coalesce(dict_cpi, 'Yes') = 'Yes' THEN 'CPI' ELSE '' END AS cpi,
  cast(signed_date AS varchar) AS contract_signed, CASE WHEN category = 'ZINL' THEN cast(start AS varchar) END AS bill_plan_date,
  CASE WHEN checkbox THEN 'Picked' WHEN NOT checkbox THEN 'Not Picked' ELSE 'Does Not Exist' END AS checkbox,
  CASE WHEN {PN} = '' OR number IS NOT NULL THEN '' ELSE trim(price) END AS price_status,
  fee IS NOT NULL AS manual_flag,
  CASE WHEN code IS NULL THEN 'no match' WHEN NOT checkbox THEN 'not picked' WHEN source_dict = 'fallback' THEN 'fallback'
       WHEN passed THEN 'pass-through' ELSE 'ok' END AS fill_class
FROM c""")
def load_rows(t):
    return loadrows.load_rows(picked_items(t).withColumn("signing_date", F.col("signed_date")))


# ---- modules

NORMAL = "lower(trim(coalesce({}, '')))"
REAL = f"""({NORMAL.format('module')} NOT IN ('', 'nan', 'none') AND {NORMAL.format('parent')} IN {d.in_list(fixed.MODULE_PARENTS)}
  AND {NORMAL.format('level')} = 'schedule' AND ({NORMAL.format('product')} = '' OR {NORMAL.format('product')} <> {NORMAL.format('module')})
  AND {NORMAL.format('module')} NOT IN {d.in_list(fixed.NOT_MODULES)})"""


@query("real_modules", f"SELECT client, filename, parent, level, product, module FROM module_rows WHERE {REAL}")
def real_modules(t):
    keep = modules.is_real_module(F.col("parent"), F.col("level"), F.col("product"), F.col("module"))
    return t.module_rows.where(keep)


@query("missing_schedules", f"""
SELECT DISTINCT m.client, m.filename, m.parent, schedule_title, concat(schedule_title, ' Schedule to ', m.parent) AS product FROM manifest m
WHERE NOT EXISTS (SELECT 1 FROM module_rows r WHERE r.client = m.client AND r.filename = m.filename AND r.parent = m.parent
  AND r.product = concat(schedule_title, ' Schedule to ', m.parent) AND {REAL.replace('parent', 'r.parent')})""")
def missing_schedules(t):
    return modules.missing_schedules(t.manifest, t.module_rows)


LOW_TITLE = "lower(coalesce(agreement_type, 'a License Agreement page ' || o_orderkey))"
DOCS = f"""docs AS (
  SELECT client, filename, schedules AS s0, {LOW_TITLE} AS t,
    ({d.any_word(LOW_TITLE, fixed.LICENSE_TITLES)} OR (contains({LOW_TITLE}, 'license agreement') AND NOT contains({LOW_TITLE}, 'master services')
     AND NOT contains({LOW_TITLE}, 'account processing'))) AS lic,
    CASE o_orderkey % 4 WHEN 0 THEN 'MasterAgreement' WHEN 1 THEN 'SOW' WHEN 2 THEN 'Order' ELSE 'Other' END AS dt FROM overview),
routed AS (SELECT client, filename, CASE WHEN lic THEN 'LicenseAgreement' ELSE dt END AS document_type, CASE WHEN lic THEN 0 ELSE s0 END AS schedules,
    CASE WHEN NOT lic AND s0 > 0 THEN 'strict' WHEN lic THEN 'license' WHEN dt = 'SOW' THEN 'sow' WHEN dt = 'Order' THEN 'order' ELSE 'generic' END AS route FROM docs)"""


def routed_documents(t):
    k = F.col("o_orderkey") % 4
    docs_ = t.overview.select(
        "client", "filename", "agreement_type", "schedules",
        F.concat(F.lit("a License Agreement page "), "o_orderkey").alias("first_page"),
        F.when(k == 0, "MasterAgreement").when(k == 1, "SOW").when(k == 2, "Order").otherwise("Other").alias("document_type"),
    )
    return modules.with_route(modules.license_override(docs_))


@query("extraction_routes", f"WITH {DOCS} SELECT client, filename, document_type, schedules, route FROM routed")
def extraction_routes(t):
    return routed_documents(t).select("client", "filename", "document_type", "schedules", "route")


@query("product_modules", f"""
WITH {DOCS}
SELECT DISTINCT client, filename, CASE WHEN filename ILIKE '%master%' THEN 'Master Agreement' WHEN filename ILIKE '%amend%' THEN 'Amendment' ELSE '' END AS contract_type,
  document_type, CASE WHEN route = 'license' THEN 'Agreement' ELSE parent END AS parent, CASE WHEN route = 'license' THEN 'Exhibit' ELSE level END AS level, product, module
FROM module_rows JOIN routed USING (client, filename)
WHERE CASE WHEN route = 'strict' THEN {REAL} WHEN route = 'license' THEN trim(product) <> '' AND trim(module) <> '' ELSE trim(product) <> '' END""")
def product_modules(t):
    return modules.product_modules(t.module_rows, routed_documents(t))


@query("engagements", f"""
WITH {DOCS}, o AS (SELECT *, contract_type <> 'Purchase Order' AS ok FROM overview JOIN routed USING (client, filename))
SELECT client, filename, CASE WHEN filename ILIKE '%master%' THEN 'Master Agreement' WHEN filename ILIKE '%amend%' THEN 'Amendment' ELSE '' END AS contract_type,
  regexp_extract(filename, '(\\d{{1,2}}[_-]\\d{{1,2}}[_-]\\d{{4}})', 1) AS contract_effective_date,
  CASE WHEN ok THEN routed.document_type ELSE '' END AS document_type, CASE WHEN ok THEN coalesce(agreement_type, '') ELSE '' END AS type_of_agreement,
  CASE WHEN ok THEN coalesce(cast(effective_date AS varchar), '') ELSE '' END AS effective_date, {', '.join(f"'' AS {f}" for f in modules.ENGAGEMENT_FIELDS[2:])},
  CASE WHEN ok THEN '1, 2, ' || (3 + o_orderkey % 5) ELSE '' END AS pages_sent
FROM (SELECT * EXCLUDE (document_type) FROM o) JOIN routed USING (client, filename)""".replace("SELECT *, contract_type <> 'Purchase Order' AS ok FROM overview", "SELECT overview.*, contract_type <> 'Purchase Order' AS ok FROM overview"))
def engagements(t):
    overview = t.overview.where(F.col("contract_type") != "Purchase Order").select(
        "client", "filename", F.col("agreement_type").alias("type_of_agreement"), F.col("effective_date").cast("string").alias("effective_date")
    )
    pages = t.overview.select("client", "filename", F.explode(F.array(F.lit(2), F.lit(1), (3 + F.col("o_orderkey") % 5).cast("int"))).alias("page"))
    return modules.engagements(t.contracts, overview, pages, routed_documents(t))
