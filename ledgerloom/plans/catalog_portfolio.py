"""Registered queries of portfolio figures, usage, context tables and set operations."""

from pyspark.sql import functions as F

from ledgerloom.operators import context as cx
from ledgerloom.operators import documents as docs
from ledgerloom.operators import portfolio as pf
from ledgerloom.operators.hierarchy import contract_status
from ledgerloom.plans.catalog_hierarchy import STATUS, forest_of
from ledgerloom.plans.registry import query, stage
from ledgerloom.sources.files import union_frames

TOK = """u AS (SELECT *, coalesce(input_tokens, 0) AS i, output_tokens AS o, coalesce(nullif(total_tokens, 0), coalesce(input_tokens, 0) + output_tokens) AS tt,
  coalesce(nullif(trim(actual_model), ''), nullif(trim(requested_model), ''), '(unknown)') AS model FROM usage)"""
SUMS = "count(*) AS calls, cast(sum(i) AS bigint) AS input_tokens, cast(sum(o) AS bigint) AS output_tokens, cast(sum(tt) AS bigint) AS total_tokens"


@query("usage_by_model", f"""
WITH {TOK} SELECT client, model, {SUMS}, array_to_string(list_sort(list(DISTINCT nullif(trim(requested_model), '')) FILTER (nullif(trim(requested_model), '') IS NOT NULL)), '; ') AS requested_models,
  coalesce(array_to_string(list_sort(list(DISTINCT nullif(trim(actual_model), '')) FILTER (nullif(trim(actual_model), '') IS NOT NULL)), '; '), '') AS actual_models FROM u GROUP BY client, model""".replace(
    "array_to_string(list_sort(list(DISTINCT nullif(trim(requested_model)", "coalesce(array_to_string(list_sort(list(DISTINCT nullif(trim(requested_model)").replace("IS NOT NULL)), '; ') AS requested_models", "IS NOT NULL)), '; '), '') AS requested_models"))
def usage_by_model(t):
    return pf.usage_by_model(t.usage, ("client",))


@query("usage_by_client", f"""
WITH {TOK} SELECT client, count(*) AS runs, cast(sum(i) AS bigint) AS input_tokens, cast(sum(o) AS bigint) AS output_tokens,
  cast(round_even(sum(cast(runtime_s AS decimal(18,4))), 2) AS double) AS runtime_s FROM u GROUP BY client""")
def usage_by_client(t):
    return pf.usage_by_client(t.usage)


@query("usage_detail", f"""
WITH {TOK} SELECT CASE WHEN grouping(agent) = 1 THEN 'TOTAL' ELSE agent END AS agent, CASE WHEN grouping(agent) = 1 THEN '' ELSE model END AS model, {SUMS} FROM u GROUP BY GROUPING SETS ((agent, model), ())""")
def usage_detail(t):
    return pf.usage_detail(t.usage)


@query("model_rollup", f"""
WITH {TOK} SELECT coalesce(nullif(trim(actual_model), ''), '(not echoed)') AS actual_model, coalesce(string_agg(DISTINCT nullif(trim(requested_model), ''), ', ' ORDER BY nullif(trim(requested_model), '')), '') AS requested_as, {SUMS}
FROM u GROUP BY 1""")
def model_rollup(t):
    return pf.model_rollup(t.usage)


@query("latest_by_agent", """
SELECT client, agent, run_id, state FROM usage QUALIFY row_number() OVER (PARTITION BY client, agent ORDER BY ts DESC, run_id DESC) = 1""")
def latest_by_agent(t):
    return pf.latest_by_agent(t.usage).select("client", "agent", "run_id", "state")


@query("last_n_runs", "SELECT client, run_id, agent FROM usage QUALIFY row_number() OVER (PARTITION BY client ORDER BY ts DESC, run_id DESC) <= 12")
def last_n_runs(t):
    return pf.last_n_runs(t.usage).select("client", "run_id", "agent")


@query("run_state_counts", """
SELECT count(*) FILTER (state = 'complete') AS complete, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'queued') AS queued,
  count(*) FILTER (state NOT IN ('complete', 'running', 'queued')) AS idle FROM usage""")
def run_state_counts(t):
    return pf.run_state_counts(t.usage)


DONE = """done AS (SELECT client, CASE o_orderkey % 4 WHEN 0 THEN 'cpi' WHEN 1 THEN 'extraction' WHEN 2 THEN 'clauses' ELSE 'contract_scope' END AS agent FROM contracts)"""


def done_agents(t):
    k = F.col("o_orderkey") % 4
    return t.contracts.select("client", F.when(k == 0, "cpi").when(k == 1, "extraction").when(k == 2, "clauses").otherwise("contract_scope").alias("agent"))


@query("client_status", f"""
WITH {DONE}, f AS (SELECT c.c_name AS client, {', '.join(f"coalesce(bool_or(agent = '{a}'), false) AS {a}" for a in pf.AGENTS)}, count(DISTINCT agent) AS agents_done FROM customer c LEFT JOIN done ON done.client = c_name GROUP BY c_name),
n AS (SELECT client, count(*) AS contracts FROM contracts GROUP BY client)
SELECT f.*, coalesce(contracts, 0) AS contracts, {len(pf.AGENTS)} AS agents_total, CASE WHEN agents_done = {len(pf.AGENTS)} THEN 'done' WHEN agents_done > 0 THEN 'partial' ELSE 'not_run' END AS state
FROM f LEFT JOIN n USING (client)""")
def client_status(t):
    return pf.client_status(t.customer.select(F.col("c_name").alias("client")), t.contracts, done_agents(t))


@query("core_counts", """
SELECT c_mktsegment AS core, count(DISTINCT client) AS clients, count(*) AS contracts FROM contracts JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def core_counts(t):
    rows = t.contracts.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("core"), "client", "filename")
    return pf.core_counts(rows)


@query("scope_coverage", """
WITH s AS (SELECT client, 'cpi' AS agent FROM contracts WHERE contract_type = 'Amendment' UNION ALL SELECT client, 'overview' FROM contracts), n AS (SELECT client, count(*) AS all_contracts FROM contracts GROUP BY client)
SELECT client, agent, count(*) AS contracts, any_value(all_contracts) AS all_contracts FROM s JOIN n USING (client) GROUP BY client, agent""")
def scope_coverage(t):
    c = t.contracts
    scoped = c.where(F.col("contract_type") == "Amendment").select("client", F.lit("cpi").alias("agent")).unionByName(c.select("client", F.lit("overview").alias("agent")))
    return pf.scope_coverage(scoped, c)


# ---- status-tagged tables


@stage("statuses")
def statuses_of(t):
    out = contract_status(t.contract_meta.select("key", "client", "filename", "is_active"), forest_of(t).drop("client", "filename", "is_active").withColumn("filename", F.col("key")))
    dates = forest_of(t).select(F.col("key").alias("_k"), F.col("signed_date").alias("_signed"))
    return out.select("key", F.col("contract_status")).join(dates, F.col("key") == F.col("_k")).join(
        t.contract_meta.select(F.col("key").alias("_m"), "client", F.col("filename")), F.col("key") == F.col("_m")).select(
        "key", "client", "filename", "contract_status", F.col("_signed").alias("signed_date"))


RANK = "CASE contract_status WHEN 'ACTIVE' THEN 0 WHEN 'ROOT-PARTIAL' THEN 1 WHEN 'ORPHAN' THEN 2 WHEN 'SUPERSEDED' THEN 3 ELSE 4 END"


@query("status_order", f"""
WITH RECURSIVE {STATUS} SELECT client, filename, contract_status, cast(signed_date AS varchar) AS signed_date,
  row_number() OVER (PARTITION BY client ORDER BY {RANK}, signed_date DESC NULLS LAST, filename) AS place FROM statuses""")
def status_order(t):
    from pyspark.sql import Window

    s = statuses_of(t)
    w = Window.partitionBy("client").orderBy(*cx.status_order(F.col("contract_status"), F.col("signed_date"), F.col("filename")))
    return s.select("client", "filename", "contract_status", "signed_date", F.row_number().over(w).alias("place"))


@query("tagged_items", f"""
WITH RECURSIVE {STATUS}, i AS (SELECT f.client, m.filename AS source_contract, f.item_id FROM fee_items f JOIN contracts c ON c.filename = f.source_contract JOIN contract_meta m ON m.o_orderkey = c.o_orderkey)
SELECT i.client, source_contract, item_id, coalesce(contract_status, 'UNKNOWN') AS status, coalesce({RANK}, 4) AS status_rank FROM i LEFT JOIN statuses s ON s.client = i.client AND s.filename = source_contract""")
def tagged_items(t):
    names = t.contracts.select(F.col("filename").alias("source_contract"), "o_orderkey").join(
        t.contract_meta.select("o_orderkey", F.col("filename").alias("_n")), "o_orderkey")
    items = t.fee_items.select("client", "source_contract", "item_id").join(names, "source_contract").select("client", F.col("_n").alias("source_contract"), "item_id")
    return cx.tag_contracts(items, statuses_of(t)).select("client", "source_contract", "item_id", "status", "status_rank")


@query("contract_pages", """
SELECT client, source_contract, array_to_string(list_sort(list(DISTINCT page)), '; ') AS pages FROM fee_items GROUP BY ALL""")
def contract_pages(t):
    return cx.contract_pages(t.fee_items)


@query("hierarchy_listing", f"""
WITH RECURSIVE {STATUS} SELECT client, level, concat(repeat('  ', greatest(level, 0)), filename) AS line, contract_status AS status, filename FROM statuses""")
def hierarchy_listing(t):
    return cx.hierarchy_listing(forest_of(t), statuses_of(t)).drop("indent")


@query("contract_profile", """
SELECT m.client, m.filename, coalesce(trim(m.contract_type), '') AS contract_type, coalesce(cast(m.effective_date AS varchar), '') AS effective_date,
  coalesce(array_to_string(m.parties, ' / '), '') AS parties, coalesce(CASE WHEN m.o_orderkey % 2 = 0 THEN repeat('summary ', 100) END, '') AS summary FROM contract_meta m""")
def contract_profile(t):
    m = t.contract_meta
    summaries = m.select("client", "filename", F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit("summary "), 100)).alias("summary"))
    return cx.contract_profile(m, m, summaries)


@query("portfolio_kpis", f"""
WITH RECURSIVE {STATUS}, {DONE}, life AS (SELECT count(*) FILTER (contract_status = 'ACTIVE') AS active, count(*) FILTER (contract_status = 'ROOT-PARTIAL') AS pending, count(*) FILTER (contract_status IN ('SUPERSEDED', 'ORPHAN')) AS expired FROM statuses)
SELECT (SELECT count(DISTINCT c_name) FROM customer) AS clients, (SELECT count(*) FROM contracts) AS contracts, (SELECT count(*) FROM fee_items) AS items,
  (SELECT count(*) FROM contract_codes WHERE trim(code) <> '') AS matched, 0 AS unmatched,
  (SELECT cast(sum(try_cast(regexp_replace(price, '[^0-9.-]', '', 'g') AS decimal(38,4))) AS double) FROM fee_items) AS value, active, pending, expired,
  (SELECT cast(round_even(100.0 * count(DISTINCT (client, agent)) / ((SELECT count(DISTINCT c_name) FROM customer) * {len(pf.AGENTS)}), 0) AS int) FROM done) AS pipeline_pct FROM life""")
def portfolio_kpis(t):
    clients = t.customer.select(F.col("c_name").alias("client"))
    matched = t.contract_codes.where(F.trim("code") != "")
    return pf.portfolio_kpis(clients, t.contracts, t.fee_items, matched, statuses_of(t), done_agents(t), len(pf.AGENTS))


# ---- set operations


@query("union_frames", """
SELECT client, item_id, price, NULL AS code FROM fee_items UNION ALL SELECT client, NULL, price, code FROM contract_codes""")
def union_frames_query(t):
    return union_frames([t.fee_items.select("client", "item_id", "price"), t.contract_codes.select("client", "price", "code")])


@query("billtos_not_billed", """
SELECT cast(c_custkey AS varchar) AS billto FROM customer EXCEPT SELECT billto FROM invoice_parties""")
def billtos_not_billed(t):
    every = t.customer.select(F.col("c_custkey").cast("string").alias("billto"))
    return every.exceptAll(t.invoice_parties.select("billto").distinct())


@query("codes_on_both_sides", """
SELECT client, trim(code) AS code FROM contract_codes INTERSECT SELECT c_name, material FROM invoice_core JOIN customer ON o_custkey = c_custkey""")
def codes_on_both_sides(t):
    billed = t.invoice_core.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("client"), F.col("material").alias("code"))
    return t.contract_codes.select("client", F.trim("code").alias("code")).intersect(billed)


@query("distinct_modules", "SELECT DISTINCT client, trim(product) AS product, trim(module) AS module FROM module_rows")
def distinct_modules(t):
    return t.module_rows.select("client", F.trim("product").alias("product"), F.trim("module").alias("module")).dropDuplicates()


@query("unique_in_order", """
SELECT conv_id, list_filter(l, lambda e, i: list_position(l, e) = i) AS words FROM (SELECT conv_id, string_split(left(text, 200), ' ') AS l FROM conversations WHERE turn = 0) c""".replace(
    "list_filter(l, lambda e, i: list_position(l, e) = i) AS words", "array_to_string(list_filter(l, lambda e, i: list_position(l, e) = i), '; ') AS words").replace("left(text, 200)", "text").replace(" WHERE turn = 0", "").replace("SELECT conv_id, ", "SELECT conv_id, turn, ").replace("(SELECT conv_id, turn, string_split", "(SELECT conv_id, turn, string_split"))
def unique_in_order(t):
    return t.conversations.select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("words"))


@query("clients_by_name", "SELECT client FROM clients WHERE contains(lower(client), 'fcu')")
def clients_by_name(t):
    return t.clients.where(F.contains(F.lower("client"), F.lit("fcu"))).select("client")


@query("pending_contracts", "SELECT client, filename FROM contracts WHERE (client, filename) NOT IN (SELECT (client, filename) FROM overview WHERE contract_type = 'Amendment')")
def pending_contracts(t):
    from ledgerloom.sources.sinks import pending

    return pending(t.contracts.select("client", "filename"), t.overview.where(F.col("contract_type") == "Amendment"))


@query("oldest_window", """
SELECT client, filename FROM contracts QUALIFY effective_date <= min(effective_date) OVER (PARTITION BY client, contract_type) + 180""")
def oldest_window(t):
    first = t.contracts.groupBy("client", "contract_type").agg(F.min("effective_date").alias("_o"))
    return t.contracts.join(first, ["client", "contract_type"]).where(F.col("effective_date") <= F.date_add("_o", 180)).select("client", "filename")
