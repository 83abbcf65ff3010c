"""Registered queries over page text, messages and model replies."""

from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.operators import clauses as cl
from ledgerloom.operators import portfolio as pf
from ledgerloom.plans import ducksql as d
from ledgerloom.plans.registry import query, stage
from ledgerloom.sources import files as src
from ledgerloom.sources import model_output as mo

# ---- snippets: the corpus is invented words, so its words stand in for the clause terms

FAMILIES = {
    "alpha": (("license", "lytion"), ("that the", "of the of"), 12),
    "beta": (("whou", "inat"), ("and the",), 8),
}
HITS = r"""tk AS (SELECT client, filename, page, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS tk FROM pages_text),
nm AS (SELECT *, list_transform(tk, lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))) AS nm FROM tk),
po AS (SELECT *, unnest(range(1, len(tk) + 1)) AS i FROM nm),
hits AS (
  SELECT client, filename, page, 'alpha' AS family, i - 1 AS pos, tk[greatest(i - 12, 1):least(i + 12, len(tk))] AS s FROM po
  WHERE nm[i] IN ('license', 'lytion') OR (nm[i] = 'that' AND nm[i + 1] = 'the') OR (nm[i] = 'of' AND nm[i + 1] = 'the' AND nm[i + 2] = 'of')
  UNION ALL
  SELECT client, filename, page, 'beta', i - 1, tk[greatest(i - 8, 1):least(i + 8, len(tk))] FROM po
  WHERE nm[i] IN ('whou', 'inat') OR (nm[i] = 'and' AND nm[i + 1] = 'the'))"""


@stage("hits")
def hits_of(t):
    return cl.keyword_hits(t.pages_text, FAMILIES)


@query("keyword_hits", f"""
WITH {HITS} SELECT client, filename, family, page, pos AS "at", '(File: ' || filename || ' - Page ' || page || ') ' || array_to_string(s, ' ') AS snippet FROM hits""")
def keyword_hits(t):
    return cl.keyword_hits(t.pages_text, FAMILIES)


@query("first_hit_page", f"WITH {HITS} SELECT client, filename, family, min(page) AS page FROM hits GROUP BY ALL")
def first_hit_page(t):
    return cl.first_hit_page(hits_of(t))


@query("clause_families", f"""
WITH tk AS (SELECT client, filename, page, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))) AS nm FROM pages_text),
po AS (SELECT *, unnest(nm) AS w, generate_subscripts(nm, 1) AS i FROM tk),
terms AS (SELECT * FROM (VALUES {', '.join(f"({d.lit(f)}, {d.lit(x)})" for f, (ts, _, _) in fixed.CLAUSE_FAMILIES.items() for x in ts)}) v(family, term)),
phr AS (SELECT * FROM (VALUES {', '.join(f"({d.lit(f)}, {[''.join(ch for ch in w if ch.isalnum()) for w in p.split()]})" for f, (_, ps, _) in fixed.CLAUSE_FAMILIES.items() for p in ps)}) v(family, words)),
h AS (SELECT client, filename, page, family, i FROM po JOIN terms ON w = term
  UNION SELECT client, filename, page, family, i FROM po JOIN phr ON w = words[1] AND nm[i:i + len(words) - 1] = words)
SELECT client, filename, family, page, count(*) AS hits FROM h GROUP BY ALL""")
def clause_families(t):
    pages = t.pages_text
    return cl.keyword_hits(pages).groupBy("client", "filename", "family", "page").agg(F.count(F.lit(1)).alias("hits"))


@query("norm_tokens", r"""
SELECT client, filename, page, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS norm FROM pages_text""")
def norm_tokens(t):
    return t.pages_text.select("client", "filename", "page", cl.norm_token(F.col("text")).alias("norm"))


@stage("snippets")
def snippets_of(t):
    return cl.dedupe_snippets(hits_of(t))


@query("dedupe_snippets")
def dedupe_snippets(t):
    return snippets_of(t)


@query("clause_rows")
def clause_rows(t):
    hits = snippets_of(t).withColumn("family", F.when(F.col("family") == "alpha", "sla").otherwise("termination"))
    named = F.concat(F.lit("Master "), F.col("filename"))
    contracts = t.documents.select(F.col("source").alias("client"), F.concat(F.lit("Master "), "doc_id", F.lit(".pdf")).alias("filename"))
    answers = t.documents.select(
        F.col("source").alias("client"), F.concat(F.lit("Master "), "doc_id", F.lit(".pdf")).alias("filename"), F.lit(0).alias("seq"),
        F.lit("uptime_commitment").alias("field"), F.concat("n_chars", F.lit("%")).alias("value"))
    return cl.clause_rows(contracts, hits.withColumn("filename", named), answers, "sla")


@query("join_values", """
WITH v AS (SELECT client, key, chunk AS seq, field, value FROM (
  SELECT client, key, chunk, 'a' AS field, CASE WHEN (o_orderkey + chunk) % 3 = 0 THEN ' null' WHEN chunk = 2 THEN concat(' x', o_orderkey % 5) ELSE concat('x', o_orderkey % 5, ' ') END AS value FROM model_replies
  UNION ALL SELECT client, key, chunk, 'b', CASE WHEN chunk = 1 THEN NULL ELSE concat('y', chunk) END FROM model_replies) u),
f AS (SELECT client, key, field, trim(value) AS value, min(seq) AS seq FROM v WHERE value NOT IN ('', 'null') GROUP BY ALL)
SELECT client, key, field, string_agg(value, ' | ' ORDER BY seq, value) AS text FROM f GROUP BY ALL""")
def join_values(t):
    r = t.model_replies
    x = F.concat(F.lit("x"), F.col("o_orderkey") % 5)
    a = r.select("client", "key", F.col("chunk").alias("seq"), F.lit("a").alias("field"),
                 F.when((F.col("o_orderkey") + F.col("chunk")) % 3 == 0, " null").when(F.col("chunk") == 2, F.concat(F.lit(" "), x)).otherwise(F.concat(x, F.lit(" "))).alias("value"))
    b = r.select("client", "key", F.col("chunk").alias("seq"), F.lit("b").alias("field"),
                 F.when(F.col("chunk") != 1, F.concat(F.lit("y"), "chunk")).alias("value"))
    return cl.join_values(a.unionByName(b), ["client", "key"])


@query("escalation_snippets")
def escalation_snippets(t):
    return cl.escalation_snippets(t.pages_text, term="license", opening="that", closings=("the ", "and "), fallback="of the the")


@query("escalation_rows")
def escalation_rows(t):
    s = cl.escalation_snippets(t.pages_text, term="license", opening="that", closings=("the ", "and "), fallback="of the the", window=10)
    named = s.withColumn("filename", F.concat(F.lit("ACME-Master 3-4-2019 "), "filename")).withColumn("position", F.col("page") * 100000 + F.col("at"))
    contracts = t.documents.select(F.col("source").alias("client"), F.concat(F.lit("ACME-Master 3-4-2019 "), "doc_id", F.lit(".pdf")).alias("filename"))
    told = contracts.select("*", F.lit(0).alias("seq"), F.lit("minimum").alias("field"), F.lit("3%").alias("value"))
    return cl.escalation_rows(contracts, named, told)


# ---- citations

SAID = r"""said AS (SELECT message_id, CASE WHEN regexp_matches(text, '(?im)^[ \t]*(?:#+\s*|\*+\s*)?sources?\s*:?\s*(?:\*+\s*)?$')
  THEN regexp_replace(text, '(?ims)\A.*?^[ \t]*(?:#+\s*|\*+\s*)?sources?\s*:?\s*(?:\*+\s*)?$', '') ELSE text END AS said FROM messages),
cited AS (SELECT message_id, client, filename AS name, said, lower(regexp_replace(filename, '\.[^.]*$', '')) AS stem FROM said JOIN contracts
  ON contains(lower(said), lower(regexp_replace(filename, '\.[^.]*$', ''))))"""


@query("cited_documents", rf"""
WITH {SAID}
SELECT message_id, client, name, list_min(list_transform(regexp_extract_all(substr(said, CASE WHEN instr(lower(said), lower(name)) > 0 THEN instr(lower(said), lower(name)) ELSE instr(lower(said), stem) END, 200),
  'p\.\s*(\d+)', 1), lambda x: cast(x AS int))) AS page FROM cited""")
def cited_documents(t):
    return cl.cited_documents(t.messages, t.contracts.select("client", F.col("filename").alias("name")))


@query("cited_invoices", r"""
WITH reg AS (SELECT DISTINCT document, arg_min(url, (line_no, material, net, url)) AS url FROM invoice_core GROUP BY document),
named AS (SELECT DISTINCT message_id, document, url FROM messages JOIN reg ON contains(lower(text), document) OR (url <> '' AND contains(lower(text), lower(url)))),
tagged AS (SELECT DISTINCT message_id, rtrim(unnest(regexp_extract_all(text, '(?is)\[invoice\].{0,51}?(https?://\S+)', 1)), ').,;"''') AS url FROM messages)
SELECT * FROM named UNION ALL SELECT message_id, '(invoice)', url FROM tagged WHERE (message_id, url) NOT IN (SELECT (message_id, url) FROM named)""")
def cited_invoices(t):
    from ledgerloom.operators.invoices import url_registry

    return cl.cited_invoices(t.messages, url_registry(t.invoice_core))


HL = """targets0 AS (SELECT filename, lower(left(text, 30)) AS target, 'Extracted fee' AS tag, 0 AS priority FROM pages_text WHERE page = 2
  UNION SELECT filename, lower(left(string_split_regex(text, '[.!?]\\s')[1], 120)), 'CPI', 1 FROM pages_text WHERE page = 1),
targets AS (SELECT DISTINCT filename, trim(regexp_replace(target, '\\s+', ' ', 'g')) AS target, tag, priority FROM targets0 WHERE length(trim(regexp_replace(target, '\\s+', ' ', 'g'))) >= 4),
marked AS (SELECT filename, page, page AS line_no, min({'p': priority, 't': tag, 'x': target}) AS b FROM pages_text JOIN targets USING (filename) WHERE contains(lower(text), target) GROUP BY ALL)"""


def marked_lines(t):
    pages = t.pages_text
    items = pages.where(F.col("page") == 2).select("filename", F.substring("text", 1, 30).alias("item"))
    spans = pages.where(F.col("page") == 1).select("filename", F.col("text").alias("snippet"))
    none = spans.select("filename", "snippet", F.lit("x").alias("family")).where(F.lit(False))
    targets = cl.highlight_targets(items, spans, none)
    return cl.highlight_lines(pages.select("filename", "page", F.col("page").alias("line_no"), F.col("text").alias("line")), targets)


@query("highlight_lines", f"WITH {HL} SELECT filename, page, line_no, b.t AS tag, b.x AS target FROM marked")
def highlight_lines(t):
    return marked_lines(t)


@query("highlight_counts", f"WITH {HL} SELECT filename, count(*) AS highlights FROM marked GROUP BY filename")
def highlight_counts(t):
    return cl.highlight_counts(marked_lines(t))


# ---- model replies

ITEM = "row_id bigint, code string, price string"
REPLIED = """r AS (SELECT *, (o_orderkey + chunk) % 5 AS k FROM model_replies),
items AS (
  SELECT client, key, chunk, o_orderkey, 0 AS position, o_orderkey AS row_id, concat('A', chunk) AS code, concat('$', o_orderkey % 100) AS price FROM r WHERE k IN (0, 1, 2)
  UNION ALL SELECT client, key, chunk, o_orderkey, 1, chunk, 'B', NULL FROM r WHERE k IN (0, 1, 2)
  UNION ALL SELECT client, key, chunk, o_orderkey, 0, o_orderkey, concat('C', chunk), '$1' FROM r WHERE k = 3)"""


@query("parse_model_output", f"WITH {REPLIED} SELECT client, key, chunk, o_orderkey, position, row_id, code, price FROM items")
def parse_model_output(t):
    return mo.parse_model_output(t.model_replies, "reply", ITEM)[0]


@query("unreadable_replies", "SELECT client, key, chunk, reply FROM model_replies WHERE (o_orderkey + chunk) % 5 = 4")
def unreadable_replies(t):
    return mo.parse_model_output(t.model_replies, "reply", ITEM)[1].drop("o_orderkey")


def merged(t):
    chunks = t.chunk_replies.withColumn("r", mo.parse_object(F.col("reply"), mo.CONTRACT_TYPE))
    return mo.merge_chunks(chunks.select("client", "key", "chunk", "r.*"), ["client", "key"])


CONF = "list_max([CASE (o_orderkey + c) % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END for c in [0, 1, 2]])"


@query("merge_chunks", f"""
SELECT key, contract_type, '2000-01-01' AS effective_date, 'P0' AS parties, concat('ref 0; own ', o_orderkey, '; ref 1') AS parent_references, 'old paper 1' AS supersedes_text,
  concat('77', o_orderkey % 3, ':printed_body; X0:printed_stamp; X1:printed_stamp; X2:printed_stamp') AS codes,
  concat('• Fees [Ledger]', chr(10), '    — One :: a0, b, a1', chr(10), '• S0', chr(10), '• S1', chr(10), '• S2') AS sections, 'Ledger; a0; b; a1' AS products,
  CASE {CONF} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS confidence,
  list_max(list_filter([o_orderkey % 90, o_orderkey % 90 + 10, o_orderkey % 90 + 20], lambda s: s <= 100)) AS score
FROM contract_meta""")
def merge_chunks(t):
    r = merged(t)
    return r.select(
        "key", "contract_type", "effective_date", F.array_join("parties", "; ").alias("parties"), F.array_join("parent_references", "; ").alias("parent_references"),
        "supersedes_text", F.array_join(F.transform("internal_doc_codes", lambda c: F.concat(c["value"], F.lit(":"), c["position"])), "; ").alias("codes"),
        mo.render_sections(F.col("section_structure")).alias("sections"), F.array_join(mo.walk_products(F.col("section_structure")), "; ").alias("products"),
        F.col("extraction_confidence").alias("confidence"), F.col("extraction_confidence_score").alias("score"),
    )


@query("normal_doc_codes", """
SELECT key, CASE o_orderkey % 4 WHEN 0 THEN '12345:unknown; x:unknown' WHEN 1 THEN '12345:printed_body; 77:unknown; 9:unknown' ELSE '' END AS codes FROM old_records""")
def normal_doc_codes(t):
    codes = mo.codes_from_json(F.col("codes_json"))
    return t.old_records.select("key", F.array_join(F.transform(codes, lambda c: F.concat(c["value"], F.lit(":"), c["position"])), "; ").alias("codes"))


@query("flat_sections", """
SELECT key, concat('• Fees [Ledger]', chr(10), '• Terms ', o_orderkey % 3) AS sections FROM contract_meta""")
def flat_sections(t):
    terms = F.concat(F.lit(" Terms "), F.col("o_orderkey") % 3)
    flat = mo.normal_sections(
        F.array().cast(mo.SECTION_TYPE), F.array(F.lit("Fees"), terms, F.lit(" "), F.lit("Fees ")), F.array(F.lit(" Ledger "), F.lit("None")))
    return t.contract_meta.select("key", mo.render_sections(flat).alias("sections"))


BODY_TYPE = "CASE WHEN lower(trim(contract_type)) = 'purchase order' OR contract_type IN ('Amendment', 'Statement of Work') THEN 'child' WHEN contract_type = 'Master Agreement' THEN 'MSA' ELSE 'other' END"


@query("stale_records", f"""
WITH s AS (SELECT *, {BODY_TYPE} AS kind, CASE WHEN filename LIKE '%Master Agreement%' THEN 'MSA' WHEN filename LIKE '%Software Agreement%' THEN 'root' END AS named FROM old_records WHERE NOT failed),
x AS (SELECT key, array_to_string(list_filter([CASE WHEN NOT references_attempted AND kind = 'child' AND n_references = 0 THEN 'no parent reference' END,
  CASE WHEN NOT type_attempted AND named IS NOT NULL AND (kind = 'child' OR (named = 'MSA' AND kind <> 'MSA')) THEN 'type mismatch' END,
  CASE WHEN NOT codes_attempted AND o_orderkey % 4 = 0 THEN 'flat codes' END,
  CASE WHEN NOT sections_attempted AND n_nested = 0 AND n_flat > 0 THEN 'flat sections' END], lambda r: r IS NOT NULL), '; ') AS triggers FROM s)
SELECT * FROM x WHERE triggers <> ''""")
def stale_records(t):
    return mo.stale_records(t.old_records).select("key", "triggers")


# ---- files

@query("scan_contracts", r"""
SELECT split_part(path, '/', 3) AS client, split_part(path, '/', 4) AS filename, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS extension, size,
  cast(cast(try_strptime(nullif(regexp_extract(path, '(\d{1,2})-(\d{1,2})-(\d{4})'), ''), '%m-%d-%Y') AS date) AS varchar) AS filename_date, concat(split_part(path, '/', 3), '/', split_part(path, '/', 4)) AS key
FROM file_paths WHERE path NOT LIKE '%.xlsx' AND split_part(path, '/', 3) IN (SELECT replace(c_name, '#', '-') FROM customer WHERE c_acctbal > 0)""")
def scan_contracts(t):
    asked = t.customer.where(F.col("c_acctbal") > 0).select(F.translate("c_name", "#", "-").alias("client"))
    return src.scan_contracts(t.file_paths, asked)[0].drop("path")


@query("unknown_clients", """
SELECT DISTINCT concat(replace(c_name, '#', '-'), CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END) AS client FROM customer
WHERE c_custkey % 2 = 0 OR replace(c_name, '#', '-') NOT IN (SELECT split_part(path, '/', 3) FROM file_paths WHERE path NOT LIKE '%.xlsx')""")
def unknown_clients(t):
    asked = t.customer.select(F.concat(F.translate("c_name", "#", "-"), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("")).alias("client"))
    return src.scan_contracts(t.file_paths, asked)[1]


@query("scan_contracts_flat", r"""
SELECT 'GRP-' || (o_orderkey % 3) || '---' || filename AS filename, 'GRP-' || (o_orderkey % 3) AS file_group FROM contracts""")
def scan_contracts_flat(t):
    paths = t.contracts.select(F.concat(F.lit("/flat/GRP-"), F.col("o_orderkey") % 3, F.lit("---"), "filename").alias("path"), "size")
    return src.scan_contracts_flat(paths).select("filename", "file_group")


@query("pick_dictionary", """
SELECT core, arg_max(path, {'d': contains(lower(path), 'dict'), 's': size, 'p': path}) AS path FROM dictionary_files GROUP BY core
UNION ALL SELECT 'OTHER', '/override/other.csv'""")
def pick_dictionary(t):
    overrides = t.customer.select(F.explode(F.array(F.lit("OTHER"), F.col("c_mktsegment"))).alias("core")).distinct().withColumn("path", F.concat(F.lit("/override/"), F.lower("core"), F.lit(".csv")))
    return src.pick_dictionary(t.dictionary_files, overrides)


@query("dictionary_for", """
SELECT client, CASE WHEN client_id IN (SELECT cast(c_custkey AS varchar) FROM customer WHERE c_nationkey < 5) THEN 'abroad' ELSE 'home' END AS dictionary FROM clients""")
def dictionary_for(t):
    abroad = t.clients.join(t.customer.where(F.col("c_nationkey") < 5), F.col("client_id") == F.col("c_custkey").cast("string")).select("client")
    return src.dictionary_for(t.clients.select("client"), abroad, "home", "abroad")


@query("load_dictionary", "SELECT code, description FROM dictionary WHERE item_category <> ''")
def load_dictionary(t):
    wrong = t.part.select("p_name")
    right = t.dictionary.select("code", F.when(F.col("item_category") != "", F.col("description")).alias("description"))
    return src.load_dictionary([("Sheet1", wrong), ("Final", right)], ("code", "description"), ("Sheet1",))


@query("load_roster", r"""
SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(n), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM (
  SELECT c_name AS n FROM customer UNION ALL SELECT cast(c_custkey AS varchar) FROM customer UNION ALL SELECT c_mktsegment || ', Ltd.' FROM customer) u
WHERE NOT regexp_full_match(n, '[0-9]+')""")
def load_roster(t):
    c = t.customer
    rows = c.select(F.explode(F.array("c_name", F.col("c_custkey").cast("string"), F.concat("c_mktsegment", F.lit(", Ltd.")))).alias("name"))
    return src.load_roster(rows)


@query("load_section_map", "SELECT DISTINCT section_header AS raw, p_type AS section FROM fee_items")
def load_section_map(t):
    return src.load_section_map(t.fee_items.select(F.concat(F.lit(" "), "section_header").alias("raw"), F.concat("p_type", F.lit(" ")).alias("section")))


@query("conform", "SELECT document AS invoice_document, material, material_text AS description, '' AS sales_office FROM invoice_core")
def conform(t):
    rows, _ = src.conform(
        t.invoice_core.withColumnRenamed("document", "inv_doc"), ["invoice_document", "material", "description", "sales_office"],
        {"invoice_document": ["doc_no", "INV_DOC"], "description": ["material_text"], "sales_office": ["office"]}, required=("material",))
    return rows


@query("knowledge_sections", r"""
WITH k AS (SELECT doc_id, concat(chr(10), '## 1. ', replace(text, chr(10), concat(chr(10), '## 8. '))) AS t FROM documents),
s AS (SELECT doc_id AS doc, unnest(string_split(t, concat(chr(10), '## '))) AS part, generate_subscripts(string_split(t, concat(chr(10), '## ')), 1) - 1 AS position FROM k)
SELECT doc, '8' AS number, position, concat('## ', part) AS section FROM s WHERE part LIKE '8. %'""")
def knowledge_sections(t):
    text = F.concat(F.lit("\n## 1. "), F.regexp_replace("text", "\n", "\n## 8. "))
    return src.knowledge_sections(t.documents.select(F.col("doc_id").alias("doc"), text.alias("text")), ("8", "9"))


@query("null_hygiene", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def null_hygiene(t):
    return src.null_hygiene(t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("value")))


@query("drop_placeholders", "SELECT client, filename, product FROM module_rows WHERE trim(product) <> ''")
def drop_placeholders(t):
    return src.drop_placeholders(t.module_rows, "product").select("client", "filename", "product")


@query("failure_summary", """
WITH m AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'empty reply' WHEN 1 THEN concat('rate limit ', o_orderkey % 2) ELSE concat('bad ', repeat('x', 240)) END AS r FROM contracts)
SELECT r AS reason, count(*) AS chunks FROM m GROUP BY r""")
def failure_summary(t):
    k = F.col("o_orderkey")
    why = F.when(k % 3 == 0, "empty reply").when(k % 3 == 1, F.concat(F.lit("rate limit "), k % 2)).otherwise(F.concat(F.lit("bad "), F.repeat(F.lit("x"), 240)))
    return pf.failure_summary(t.contracts.select(F.concat("filename", F.lit(": chunk "), k, F.lit(": "), why).alias("message")))
