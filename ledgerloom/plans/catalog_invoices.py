"""Registered queries over invoice lines."""

from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.names import client_signature, name_variants, norm_company, norm_strict
from ledgerloom.functions.questions import invoice_numbers, is_invoice_question, question_filters
from ledgerloom.operators import invoices as inv
from ledgerloom.plans import ducksql as d
from ledgerloom.plans.registry import query, stage

# ---- shared oracle fragments

SCORED = f"""
variants AS (SELECT DISTINCT client, unnest({d.variants('client')}) AS v FROM clients),
stored AS (SELECT DISTINCT billto, trim(billto_name) AS billto_name FROM invoice_parties),
scored AS (
  SELECT client, billto, billto_name,
         max(CASE WHEN {d.strict('v')} = {d.strict('billto_name')} THEN 100
                  WHEN contains({d.strict('billto_name')}, {d.strict('v')}) THEN 95
                  WHEN contains(lower(billto_name), lower(v)) THEN 90 ELSE 0 END) AS score
  FROM stored JOIN variants ON contains({d.strict('billto_name')}, {d.strict('v')})
                            OR contains(lower(billto_name), lower(v))
  WHERE {d.strict('v')} <> '' AND {d.strict('billto_name')} <> ''
  GROUP BY ALL)"""

COUNTRY_SCOPE = f"""
names AS (SELECT DISTINCT soldto, soldto_name FROM invoice_parties),
scope AS (
  SELECT DISTINCT client, soldto FROM countries JOIN names
    ON contains({d.strict('soldto_name')}, {d.strict('client')}))"""

HISTORY = f"""{COUNTRY_SCOPE},
history AS (
  SELECT client, material AS material_code, item_category,
         min(material_text) AS material_description, min(gl_category) AS gl_category, min(hier_name) AS product_hierarchy,
         count(*) AS line_count, count(DISTINCT document) AS invoice_doc_count,
         count(DISTINCT date_trunc('month', invoice_date)) AS distinct_months,
         min(invoice_date) AS first_billed, max(invoice_date) AS last_billed,
         sum(net) AS total_net, sum(tax) AS total_tax, sum(quantity) AS total_quantity,
         min(net) AS min_net, max(net) AS max_net,
         CASE WHEN count(DISTINCT date_trunc('month', invoice_date)) >= 6 THEN 'RECURRING'
              WHEN count(DISTINCT date_trunc('month', invoice_date)) >= 2 THEN 'PERIODIC' ELSE 'ONE_TIME' END AS billing_type
  FROM invoice_parties JOIN scope USING (soldto)
  WHERE trim(material) <> ''
  GROUP BY ALL)"""


def country_scope(t):
    return inv.resolve_scope(t.countries, t.parties)


def country_lines(t):
    return inv.lines_in_scope(t.invoice_parties, country_scope(t), t.parties)


@stage("billtos")
def billtos_of(t):
    """The bill-tos of all lines: matching reads them several times, the lines once."""
    return inv.distinct_billto(t.invoice_parties)


@stage("line_parties")
def parties_of(t):
    return inv.party_pairs(t.invoice_parties)


def own_scope(t):
    """(client, billto) found by name."""
    return inv.bridge_names(t.clients, billtos_of(t)).select("client", "billto")


@query("billing_history", f"""
WITH {HISTORY}
SELECT client, material_code, item_category, material_description, gl_category, product_hierarchy, line_count,
       invoice_doc_count, distinct_months, cast(first_billed AS varchar) AS first_billed,
       cast(last_billed AS varchar) AS last_billed, cast(total_net AS double) AS total_net,
       cast(total_tax AS double) AS total_tax, cast(total_quantity AS double) AS total_quantity,
       cast(min_net AS double) AS min_net, cast(max_net AS double) AS max_net, billing_type FROM history""")
def billing_history(t):
    return inv.billing_history(country_lines(t), by=("client",)).orderBy("client", *inv.history_order())


@query("billing_history_filtered", f"""
WITH {COUNTRY_SCOPE},
codes AS (SELECT DISTINCT n_name AS soldto_name, trim(code) AS material
          FROM contract_codes JOIN customer ON client = c_name JOIN nation ON c_nationkey = n_nationkey)
SELECT soldto_name, material AS material_code, item_category, count(*) AS line_count,
       count(DISTINCT document) AS invoice_doc_count, cast(sum(net) AS double) AS total_net
FROM invoice_parties JOIN codes USING (soldto_name, material)
WHERE invoice_date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30'
GROUP BY ALL""")
def billing_history_filtered(t):
    nations = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    codes = t.contract_codes.join(nations, F.col("client") == F.col("c_name")).select(
        F.col("n_name").alias("soldto_name"), F.trim("code").alias("material")
    )
    return inv.billing_history(
        t.invoice_parties, by=("soldto_name",), codes=codes,
        date_from=F.lit("1996-01-01").cast("date"), date_to=F.lit("1999-06-30").cast("date"),
    ).select("soldto_name", "material_code", "item_category", "line_count", "invoice_doc_count", "total_net")


@query("history_coverage", f"""
WITH {HISTORY}
SELECT client, count(*) AS codes, cast(sum(line_count) AS bigint) AS lines,
       cast(sum(invoice_doc_count) AS bigint) AS doc_code_pairs, cast(sum(total_net) AS double) AS net,
       count(*) FILTER (billing_type = 'ONE_TIME') AS one_time,
       count(*) FILTER (billing_type = 'PERIODIC') AS periodic,
       count(*) FILTER (billing_type = 'RECURRING') AS recurring
FROM history GROUP BY client""")
def history_coverage(t):
    return inv.history_coverage(inv.billing_history(country_lines(t), by=("client",)), by=("client",))


@query("distinct_billto", "SELECT DISTINCT billto, billto_name FROM invoice_parties WHERE billto_name IS NOT NULL")
def distinct_billto(t):
    return inv.distinct_billto(t.invoice_parties)


@query("norm_company", f"""
SELECT billto, billto_name, {d.norm_company("billto_name || ' & Sons, F.C.U. Natl Assn of the N.A.'")} AS norm,
       {d.strict('billto_name')} AS strict
FROM (SELECT DISTINCT billto, billto_name FROM invoice_parties)""")
def norm_company_query(t):
    noisy = F.concat(F.col("billto_name"), F.lit(" & Sons, F.C.U. Natl Assn of the N.A."))
    return inv.distinct_billto(t.invoice_parties).select(
        "billto", "billto_name", norm_company(noisy).alias("norm"), norm_strict(F.col("billto_name")).alias("strict")
    )


@query("name_variants", f"""
SELECT client_id, client, array_to_string(list_sort(list_distinct({d.variants('client')})), '; ') AS variants FROM clients""")
def name_variants_query(t):
    return t.clients.select("client_id", "client", name_variants(F.col("client")).alias("variants"))


@query("client_signature", f"""
SELECT client_id, array_to_string(list_sort(list_distinct(list_filter(
         string_split({d.squeeze("regexp_replace(lower(client), '[^a-z0-9 ]', ' ', 'g')")}, ' '),
         lambda w: w <> '' AND w NOT IN {d.in_list(fixed.ROSTER_GENERIC)} AND NOT regexp_full_match(w, '[0-9]+')))), '; ') AS signature
FROM (SELECT client_id, client || ' Ltd ' || client_id || ' Kappa of Region' || client_id AS client FROM clients)""")
def client_signature_query(t):
    name = F.concat("client", F.lit(" Ltd "), "client_id", F.lit(" Kappa of Region"), "client_id")
    return t.clients.select("client_id", client_signature(name).alias("signature"))


@query("bridge_names", f"""
WITH {SCORED}
SELECT client, billto, billto_name, score,
       row_number() OVER (PARTITION BY client ORDER BY score DESC, length({d.strict('billto_name')}), billto_name, billto) AS position
FROM scored WHERE score >= 90""")
def bridge_names(t):
    return inv.bridge_names(t.clients, billtos_of(t))


@query("resolve_scope", f"""
WITH {SCORED},
soldtos AS (
  SELECT DISTINCT s.client, p.soldto AS value FROM scored s JOIN invoice_parties p USING (billto) WHERE score >= 90
  UNION
  SELECT DISTINCT client, soldto FROM (SELECT DISTINCT client, v FROM variants)
  JOIN (SELECT DISTINCT soldto, soldto_name FROM invoice_parties) ON contains({d.strict('soldto_name')}, {d.strict('v')}))
SELECT client, 'soldto' AS kind, value FROM soldtos
UNION ALL
SELECT DISTINCT client, 'billto', billto FROM scored WHERE client NOT IN (SELECT client FROM soldtos)""")
def resolve_scope(t):
    return inv.resolve_scope(t.clients, parties_of(t))


@query("resolve_scope_countries", f"""
WITH {COUNTRY_SCOPE}
SELECT client, 'soldto' AS kind, soldto AS value FROM scope""")
def resolve_scope_countries(t):
    return inv.resolve_scope(t.countries, parties_of(t))


@query("scope_labels", f"""
WITH {COUNTRY_SCOPE}, r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY soldto) AS rn FROM scope)
SELECT client, 'soldto' AS kind, count(*) AS n_values,
       'sold-to ' || string_agg(soldto, ', ' ORDER BY soldto) FILTER (rn <= 4) AS label FROM r GROUP BY client""")
def scope_labels(t):
    return inv.scope_labels(country_scope(t))


LINE = ("client", "document", "invoice_date", "line_no", "material", "net")
LINE_SQL = "document, cast(invoice_date AS varchar) AS invoice_date, line_no, material, cast(net AS double) AS net"
NEWEST_SQL = "invoice_date DESC, document, line_no, material, net"


@query("invoice_recent", f"""
WITH {COUNTRY_SCOPE}, r AS (
  SELECT client, p.*, row_number() OVER (PARTITION BY client ORDER BY {NEWEST_SQL}) AS rn
  FROM invoice_parties p JOIN scope USING (soldto))
SELECT client, {LINE_SQL} FROM r WHERE rn <= 400""")
def invoice_recent(t):
    lines = t.invoice_parties
    billtos = lines.select("soldto", "billto").distinct()
    scope = country_scope(t).join(billtos, F.col("value") == F.col("soldto")).select("client", "billto")
    return inv.invoice_recent(lines, scope).select(*LINE)


def asked_documents(t):
    return t.questions.select("question_id", F.explode(invoice_numbers(F.col("text"))).alias("document"))


NUMBERS = d.ordered_distinct(f"regexp_extract_all(text, {d.lit(fixed.INVOICE_NUMBER)}, 1)")
ASKED_DOCS = f"asked AS (SELECT question_id, unnest(list_slice({NUMBERS}, 1, 10)) AS document FROM questions)"


@query("invoice_by_document", f"""
WITH {ASKED_DOCS}, r AS (SELECT question_id, p.* FROM invoice_core p JOIN asked USING (document))
SELECT question_id, {LINE_SQL} FROM r""")
def invoice_by_document(t):
    return inv.invoice_by_document(t.invoice_core, asked_documents(t)).select("question_id", *LINE[1:])


def asked_codes(t):
    known = t.contract_codes.select("code")
    return inv.question_codes(t.questions, known)


TOKENS = d.ordered_distinct(
    f"list_filter(regexp_extract_all(upper(text), {d.lit(fixed.CODE_TOKEN)}), "
    "lambda t: regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]'))"
)
# every known code is one token, so naming it verbatim means holding it as a token
ASKED_CODES = f"""
shaped AS (SELECT question_id, unnest(l) AS code, generate_subscripts(l, 1) AS p
           FROM (SELECT question_id, {TOKENS} AS l FROM questions)),
named AS (
  SELECT DISTINCT question_id, k.code FROM (
    SELECT question_id, unnest(regexp_extract_all(upper(text), '\\b\\w+\\b')) AS code FROM questions) q
  JOIN (SELECT DISTINCT upper(trim(code)) AS code FROM contract_codes) k USING (code)),
merged AS (
  SELECT question_id, code, min(r) AS r, min(p) AS p FROM (
    SELECT question_id, code, 0 AS r, p FROM shaped UNION ALL SELECT question_id, code, 1, 0 FROM named
      WHERE (question_id, code) NOT IN (SELECT (question_id, code) FROM shaped)) GROUP BY ALL),
asked AS (SELECT * FROM (SELECT question_id, code, row_number() OVER (PARTITION BY question_id ORDER BY r, p, code) AS position
          FROM merged) WHERE position <= 12)"""


@query("question_codes", f"WITH {ASKED_CODES} SELECT question_id, code, position FROM asked")
def question_codes(t):
    return asked_codes(t)


@query("invoice_by_material", f"""
WITH {ASKED_CODES}, r AS (SELECT question_id, code, p.* FROM invoice_core p JOIN asked ON upper(trim(material)) = code)
SELECT question_id, {LINE_SQL} FROM r""")
def invoice_by_material(t):
    asked = asked_codes(t).select("question_id", "code")
    return inv.invoice_by_material(t.invoice_core, asked).select("question_id", *LINE[1:])


@query("invoice_by_material_scoped", f"""
WITH {COUNTRY_SCOPE}, {ASKED_CODES}, who AS (
  SELECT question_id, replace(n_name, '_', ' ') AS client FROM questions JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
r AS (
  SELECT question_id, client, p.*
  FROM invoice_parties p JOIN scope USING (soldto) JOIN who USING (client) JOIN asked USING (question_id)
  WHERE upper(trim(material)) = code)
SELECT question_id, client, {LINE_SQL} FROM r""")
def invoice_by_material_scoped(t):
    asked = asked_codes(t).select("question_id", "code").join(question_countries(t), "question_id")
    return inv.invoice_by_material(country_lines(t), asked, by_client=True).select("question_id", *LINE)


def question_countries(t):
    home = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.questions.join(home, F.col("o_custkey") == F.col("c_custkey")).select(
        "question_id", F.translate("n_name", "_", " ").alias("client")
    )


@query("is_invoice_question", f"""
SELECT question_id, regexp_matches(text, {d.lit('(?i)' + '|'.join(fixed.INVOICE_TRIGGERS))}) AS is_invoice FROM questions""")
def is_invoice(t):
    return t.questions.select("question_id", is_invoice_question(F.col("text")).alias("is_invoice"))


QDATES = rf"""list_filter(list_transform(regexp_extract_all(text, {d.lit(fixed.QUESTION_DATE)}, 1),
  lambda x: CASE WHEN regexp_matches(x, '^\d{{4}}') THEN try_strptime(replace(x, '/', '-'), '%Y-%m-%d')
                 ELSE try_strptime(replace(x, '/', '-'), '%m-%d-%Y') END), lambda d: d IS NOT NULL)"""


@query("extract_filters", f"""
WITH f AS (
  SELECT question_id, text,
         {d.ordered_distinct(f"list_transform(regexp_extract_all(upper(text), {d.lit(fixed.CONTRACT_ID)}, 1), lambda m: regexp_replace(m, '[ _]+', '-', 'g'))")} AS ids,
         {QDATES} AS dates,
         regexp_matches(text, {d.lit(fixed.SINCE_INCEPTION)}) AS unbounded,
         nullif(regexp_extract(text, {d.lit(fixed.SINCE_YEAR)}, 1), '') AS since
  FROM questions)
SELECT question_id, array_to_string(ids, '; ') AS contract_ids,
       CASE WHEN unbounded THEN NULL WHEN len(dates) > 0 THEN cast(cast(list_min(dates) AS date) AS varchar)
            ELSE since || '-01-01' END AS date_from,
       CASE WHEN NOT unbounded AND len(dates) > 1 THEN cast(cast(list_max(dates) AS date) AS varchar) END AS date_to
FROM f""")
def extract_filters(t):
    f = t.questions.select("question_id", question_filters(F.col("text")).alias("f"))
    return f.select("question_id", "f.contract_ids", "f.date_from", "f.date_to")


@query("extract_invoice_numbers", f"""
SELECT question_id, array_to_string(list_slice({NUMBERS}, 1, 10), '; ') AS numbers FROM questions""")
def extract_invoice_numbers(t):
    return t.questions.select("question_id", invoice_numbers(F.col("text")).alias("numbers"))


@query("missing_documents", f"""
WITH {ASKED_DOCS}
SELECT DISTINCT question_id, document FROM asked WHERE document NOT IN (SELECT document FROM invoice_core)""")
def missing_documents(t):
    return inv.missing_documents(asked_documents(t), t.invoice_core)


@query("cross_client_documents", f"""
WITH {ASKED_DOCS}
SELECT DISTINCT a.question_id, i.billto, a.document FROM asked a
JOIN questions q USING (question_id) JOIN invoice_parties i USING (document)
WHERE i.billto <> cast(q.o_custkey AS varchar)""")
def cross_client_documents(t):
    focus = t.questions.select("question_id", F.col("o_custkey").cast("string").alias("billto"))
    return inv.cross_client_documents(asked_documents(t), t.invoice_parties, focus)


@query("billed_or_not", f"""
WITH {COUNTRY_SCOPE}, {ASKED_CODES}, who AS (
  SELECT question_id, replace(n_name, '_', ' ') AS client FROM questions JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT *, upper(trim(material)) AS code FROM invoice_parties),
hits AS (SELECT client, code, count(*) AS lines FROM l JOIN scope USING (soldto) GROUP BY ALL),
firsts AS (SELECT code, trim(billto_name) AS b, row_number() OVER (PARTITION BY code, trim(billto_name) ORDER BY {NEWEST_SQL}) AS rn,
                  row_number() OVER (PARTITION BY code ORDER BY {NEWEST_SQL}) AS pos FROM l),
ranked_b AS (SELECT code, b, pos, row_number() OVER (PARTITION BY code ORDER BY pos) AS k FROM firsts WHERE rn = 1),
others AS (SELECT code, string_agg(b, ', ' ORDER BY pos) AS others FROM ranked_b WHERE k <= 3 GROUP BY code)
SELECT question_id, client, code, coalesce(lines, 0) AS lines,
       CASE WHEN lines IS NOT NULL THEN 'billed' WHEN others IS NOT NULL THEN 'other customers' ELSE 'nowhere' END AS status,
       CASE WHEN lines IS NULL THEN coalesce(others, '') ELSE '' END AS others
FROM asked JOIN who USING (question_id) LEFT JOIN hits USING (client, code) LEFT JOIN others USING (code)""")
def billed_or_not(t):
    asked = asked_codes(t).select("question_id", "code").join(question_countries(t), "question_id")
    return inv.billed_or_not(asked, t.invoice_parties, country_scope(t), t.parties)


@query("url_registry", """
SELECT document, arg_min(url, (line_no, material, net, url)) AS url FROM invoice_core GROUP BY document""")
def url_registry(t):
    return inv.url_registry(t.invoice_core)


@query("invoice_totals", """
SELECT document, cast(sum(net) AS double) AS net, cast(sum(tax) AS double) AS tax, cast(sum(net + tax) AS double) AS gross,
       count(*) AS lines FROM invoice_parties GROUP BY ROLLUP (document)""")
def invoice_totals(t):
    return inv.invoice_totals(t.invoice_parties)


@query("invoice_codes", """
SELECT document, trim(material) AS code, count(*) AS lines,
       coalesce(left(arg_min(nullif(trim(material_text), ''), (line_no, net, material_text)), 40), '') AS text
FROM invoice_core GROUP BY ALL""")
def invoice_codes(t):
    return inv.invoice_codes(t.invoice_core)


@query("code_hits", f"""
WITH docs AS (
  SELECT material AS code, document, max(invoice_date) AS dt, sum(net) AS net, count(*) AS lines,
         min(line_no) AS ln, arg_min(material_text, (line_no, net)) AS txt
  FROM invoice_core GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC, document) AS rn FROM docs)
SELECT code, cast(sum(lines) AS bigint) AS lines, count(*) AS documents, cast(sum(net) AS double) AS net,
       left(arg_min(txt, rn), 50) AS sample_text,
       string_agg(document || ' (' || cast(dt AS varchar) || ', net $' || format('{{:,.2f}}', cast(net AS double)) || ')', '; ' ORDER BY rn)
         FILTER (rn <= 3) AS examples
FROM r GROUP BY code""")
def code_hits(t):
    hits = t.invoice_core.withColumn("code", F.col("material"))
    return inv.code_hits(hits)


DETAIL = f"""{COUNTRY_SCOPE}, l AS (SELECT client, p.* FROM invoice_parties p JOIN scope USING (soldto)),
docs AS (SELECT client, document, max(invoice_date) AS dt, count(*) AS lines, count(DISTINCT material) AS codes,
                sum(net) AS net, sum(tax) AS tax FROM l GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY dt DESC, document) AS position,
                  count(*) OVER (PARTITION BY client) AS n FROM docs)"""


@query("invoice_detail_headers", f"""
WITH {DETAIL}
SELECT client, document, cast(dt AS varchar) AS invoice_date, position, lines, codes, cast(net AS double) AS net,
       cast(tax AS double) AS tax, cast(net + tax AS double) AS gross, greatest(lines - 15, 0) AS hidden_lines,
       greatest(n - 20, 0) AS skipped_invoices, position = 1 AS most_recent
FROM ranked WHERE position <= 20""")
def invoice_detail_headers(t):
    return inv.invoice_detail(country_lines(t))[0]


@query("invoice_detail_lines", f"""
WITH {DETAIL}, d AS (
  SELECT l.*, row_number() OVER (PARTITION BY client, document ORDER BY {NEWEST_SQL}) AS rn
  FROM l SEMI JOIN (SELECT * FROM ranked WHERE position <= 20) USING (client, document))
SELECT client, {LINE_SQL} FROM d WHERE rn <= 15""")
def invoice_detail_lines(t):
    return inv.invoice_detail(country_lines(t))[1].select(*LINE)


# ---- contract codes against billing

ROWS = f"""
code_rows AS (
  SELECT client, source_contract, trim(code) AS code, trim(description) AS description, item, price, page,
         CASE WHEN trim(description) <> '' THEN trim(description) ELSE item END AS named
  FROM contract_codes WHERE trim(code) <> ''),
rows_n AS (SELECT *, {d.norm_company('named')} AS norm FROM code_rows)"""

BILLED = f"""
billed AS (SELECT c_name AS client, document, invoice_date, line_no, material AS code, material_text AS text, hier_name AS hier, net,
                  {d.norm_company('material_text')} AS norm
           FROM invoice_core JOIN customer ON o_custkey = c_custkey),
by_code AS (SELECT client, code, count(DISTINCT document) AS docs,
                   arg_min({{'t': text, 'h': hier}}, (-(invoice_date - DATE '1970-01-01'), document, line_no, code, net)) AS f
            FROM billed GROUP BY ALL),
by_norm AS (SELECT client, norm, count(DISTINCT document) AS docs,
                   arg_min({{'c': code, 't': text}}, (-(invoice_date - DATE '1970-01-01'), document, line_no, code, net)) AS f
            FROM billed WHERE norm <> '' GROUP BY ALL)"""

RECONCILED = f"""{ROWS}, {BILLED},
pages AS (SELECT client, code, source_contract, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages
          FROM rows_n GROUP BY ALL),
walked AS (
  SELECT r.*, pages, CASE WHEN c.docs IS NOT NULL THEN 'MATCH' WHEN n.docs IS NOT NULL THEN 'MISMATCH' ELSE 'CONTRACT_ONLY' END AS bucket,
         CASE WHEN c.docs IS NOT NULL THEN r.code ELSE n.f.c END AS invoice_code,
         CASE WHEN c.docs IS NOT NULL THEN c.f.t ELSE n.f.t END AS invoice_text,
         coalesce(c.docs, n.docs) AS invoice_docs
  FROM rows_n r LEFT JOIN by_code c USING (client, code) LEFT JOIN by_norm n USING (client, norm)
  LEFT JOIN pages USING (client, code, source_contract)),
reconciled AS (
  SELECT bucket, client, code, named AS description, source_contract, price, pages AS contract_pages, invoice_code, invoice_text, invoice_docs
  FROM walked
  UNION ALL
  SELECT 'INVOICE_ONLY', client, NULL, f.h, NULL, NULL, NULL, code, f.t, docs FROM by_code
  WHERE (client, code) NOT IN (SELECT (client, code) FROM walked)
    AND (client, code) NOT IN (SELECT (client, invoice_code) FROM walked WHERE invoice_code IS NOT NULL))"""


def client_lines(t):
    return t.client_lines


@query("reconcile_codes", f"WITH {RECONCILED} SELECT * FROM reconciled")
def reconcile_codes(t):
    return inv.reconcile(t.contract_codes, client_lines(t))


@query("reconcile_documents", f"""
WITH {RECONCILED}
SELECT DISTINCT r.client, bucket, r.invoice_code AS code, b.document FROM reconciled r JOIN billed b
  ON r.client = b.client AND r.invoice_code = b.code WHERE bucket IN ('MATCH', 'INVOICE_ONLY')
UNION
SELECT DISTINCT r.client, bucket, r.code, b.document FROM walked r JOIN billed b
  ON r.client = b.client AND r.norm = b.norm WHERE bucket = 'MISMATCH'""")
def reconcile_documents(t):
    lines = client_lines(t)
    return inv.reconcile_documents(inv.reconcile(t.contract_codes, lines), lines)


@query("contract_code_map", f"""
WITH {ROWS}, f AS (
  SELECT client, code, count(*) AS rows, arg_min({{'n': named, 's': source_contract, 'i': item, 'p': price}},
         (source_contract, page, named, item, price)) AS r FROM rows_n GROUP BY ALL)
SELECT client, code, r.n AS named, r.s AS source_contract, r.i AS item, r.p AS price, rows FROM f""")
def contract_code_map(t):
    return inv.contract_code_map(inv.contract_rows(t.contract_codes))


@query("code_by_norm", f"""
WITH {ROWS}
SELECT client, norm, arg_min(code, (source_contract, page, named, item, price, code)) AS code FROM rows_n WHERE norm <> '' GROUP BY ALL""")
def code_by_norm(t):
    return inv.code_by_norm(inv.contract_rows(t.contract_codes))


@query("code_pages", f"""
WITH {ROWS}
SELECT client, code, source_contract, array_to_string(list_sort(list_distinct(list(page))), '; ') AS pages FROM rows_n GROUP BY ALL""")
def code_pages(t):
    return inv.code_pages(inv.contract_rows(t.contract_codes))
