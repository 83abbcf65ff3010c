"""Jobs: the operators put together, from input tables to result tables. Nothing runs until a result is used,
except where a stage is written because several later steps read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import clean_price, infer_frequency, pricing_type, tier_range
from ledgerloom.functions.questions import invoice_numbers, is_invoice_question, question_filters
from ledgerloom.functions.text import strip
from ledgerloom.operators import clauses as cl
from ledgerloom.operators import documents as docs
from ledgerloom.operators import invoices as inv
from ledgerloom.operators import loadrows, matching, modules
from ledgerloom.operators import pools as pl
from ledgerloom.operators import portfolio as pf
from ledgerloom.operators import similarity as sim
from ledgerloom.operators.contains import contains_pairs, merged
from ledgerloom.session import cut_lineage
from ledgerloom.sources import sinks
from ledgerloom.sources.model_output import parse_model_output


def codes_of_ids(lookups: DataFrame, ids: DataFrame, codes: DataFrame) -> DataFrame:
    """(_ids, _code): upper-case codes of the contracts whose name contains one of a list's ids, once a list."""
    named = contains_pairs(codes.select(F.upper("source_contract").alias("_contract")), ids, "_contract", "_id")
    id_codes = (
        codes.select(F.upper("source_contract").alias("_contract"), F.upper(F.trim("code")).alias("_code")).distinct()
        .join(merged(named), "_contract").select("_id", "_code").distinct()
    )
    return lookups.select("_ids").distinct().withColumn("_id", F.explode("_ids")).join(merged(id_codes), "_id").select("_ids", "_code").distinct()


def billing_report(questions: DataFrame, parties: DataFrame, lines: DataFrame, codes: DataFrame) -> DataFrame:
    """Billing history for every billing question (question_id, client, text), all in one plan.

    Clients are found by name; dates and contract ids come from the text. When a contract id is
    part of a source contract's name, only that contract's codes count, else the whole history.
    """
    asked = questions.where(is_invoice_question(F.col("text"))).select(
        "question_id", "client", question_filters(F.col("text")).alias("f")
    ).select("question_id", "client", "f.contract_ids", "f.date_from", "f.date_to")
    scope = inv.bridge_names(asked.select("client"), parties).select("client", "billto")
    # Questions of one client with the same dates and ids have one answer: lines meet the distinct ones, not every question.
    of_question = F.array_sort(F.array_distinct(F.flatten(F.collect_list("contract_ids").over(Window.partitionBy("question_id")))))
    asks = F.array_sort(F.collect_list(F.struct("date_from", "date_to"))).alias("_asks")
    per_question = (
        asked.withColumn("_ids", F.when(F.col("question_id").isNotNull(), of_question).otherwise(F.array().cast("array<string>")))
        .groupBy("question_id", "client", "_ids").agg(asks)
        .withColumn("_ask", F.min("question_id").over(Window.partitionBy("client", "_asks", "_ids")))
    )
    lookups = per_question.select("client", "_ask", "_asks", "_ids").distinct()

    ids = asked.select(F.explode("contract_ids").alias("_id")).distinct()
    narrowed = codes_of_ids(lookups, ids, codes)
    limited = narrowed.select("_ids").distinct()
    billed = lines.join(merged(scope), "billto")

    def rows(some):
        dated = some.select("client", "_ask", "_ids", F.explode("_asks").alias("d")).select("client", "_ask", "_ids", "d.*")
        return (
            dated.join(merged(billed), "client")
            .where(F.col("date_from").isNull() | (F.col("invoice_date") >= F.col("date_from")))
            .where(F.col("date_to").isNull() | (F.col("invoice_date") <= F.col("date_to")))
            .withColumn("_code", F.upper(F.trim("material")))
        )

    whole = rows(lookups.join(limited, "_ids", "left_anti"))
    partial = rows(lookups.join(limited, "_ids", "left_semi")).join(merged(narrowed), ["_ids", "_code"], "left_semi")
    history = inv.billing_history(whole, by=("client", "_ask")).unionByName(inv.billing_history(partial, by=("client", "_ask")))
    same = (F.col("q.client") == F.col("h.client")) & F.col("q._ask").eqNullSafe(F.col("h._ask"))
    kept = [f"h.{c}" for c in history.columns if c not in ("client", "_ask")]
    return per_question.alias("q").join(merged(history.alias("h")), same).select("q.question_id", "q.client", *kept)


def code_hits_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Code hits of every (question_id, code): a code's lines are summed up once, however many questions ask for it."""
    asked = wanted.where("question_id IS NOT NULL").select("question_id", F.upper(strip(F.col("code"))).alias("code")).distinct()
    # the codes stand for the questions, so that a line meets its code once
    of_code = inv.code_hits(inv.invoice_by_material(lines, asked.select(F.col("code").alias("question_id"), "code").distinct()))
    return asked.join(merged(of_code), "code").select("question_id", *of_code.columns)


def invoice_workbook(clients: DataFrame, questions: DataFrame, lines: DataFrame, parties: DataFrame, codes: DataFrame) -> dict[str, DataFrame]:
    """Everything an invoice question needs, as tables: reconciliation, totals and lookups over all lines in scope.

    `recent` is a preview of each client's newest lines; nothing else is derived from it.
    """
    scope = inv.bridge_names(clients, parties).select("client", "billto")
    recent = inv.invoice_recent(lines, scope)
    scoped = lines.join(merged(scope.distinct()), "billto")
    headers, details = inv.invoice_detail(scoped)
    asked = questions.select("question_id", F.explode(invoice_numbers(F.col("text"))).alias("document"))
    found = inv.invoice_by_document(lines, asked)
    wanted = inv.question_codes(questions, codes.select("code")).join(questions.select("question_id", "client"), "question_id")
    sold = inv.resolve_scope(clients, parties)
    return {
        "scope": scope, "recent": recent, "headers": headers, "details": details,
        "totals": inv.invoice_totals(scoped), "codes": inv.invoice_codes(scoped), "reconciled": inv.reconcile(codes, scoped),
        "documents": found, "missing": inv.missing_documents(asked, lines),
        "code_hits": code_hits_of(lines, wanted),
        "billed": inv.billed_or_not(wanted.select("question_id", "client", "code"), lines, sold, parties),
        "urls": inv.url_registry(scoped.select(*lines.columns).unionByName(found.select(*lines.columns))),
    }


def fee_items(replies: DataFrame, files: DataFrame, item: str, min_year: int, fallback_year: int) -> tuple[DataFrame, DataFrame]:
    """(items, unreadable replies) of the selected files; `replies` is (client, filename, chunk, reply)."""
    chosen = docs.select_files(docs.drop_suffix_copies(files), min_year, fallback_year)
    rows, bad = parse_model_output(replies.join(chosen.select("client", "filename"), ["client", "filename"], "left_semi"), "reply", item)
    if "frequency" in rows.columns:
        rows = rows.withColumn("frequency", infer_frequency(F.col("frequency"), F.col("item")))
    return rows, bad


def match_items(items: DataFrame, item_vectors: DataFrame, dictionary: DataFrame, dictionary_vectors: DataFrame,
                ranked: DataFrame | None = None) -> DataFrame:
    """Fee items with their dictionary description, code and confidence; items without a code drop out.

    `ranked` (item, matched_description, confidence) answers what the similarity stage left for review.
    """
    wanted = matching.billable_items(items)
    sides = (
        wanted.select(F.col("item").alias("text")).join(item_vectors, "text"),
        dictionary.select(F.col("description").alias("text")).distinct().join(dictionary_vectors, "text"),
    )
    found = sim.hybrid_match(*sides).where(F.col("status") == "auto").select("item", "matched_description", "confidence")
    if ranked is not None:
        later = ranked.join(found.select("item"), "item", "left_anti").groupBy("item").agg(
            F.max_by(F.struct("matched_description", "confidence"), F.struct("confidence", "matched_description")).alias("r"))
        found = found.unionByName(later.select("item", "r.matched_description", "r.confidence"))
    rows = matching.export_items(items).join(found, "item")
    return matching.code_by_description(rows, dictionary).withColumn("match_confidence", F.col("confidence") / 100.0)


def match_items_by_section(items: DataFrame, section_map: DataFrame, dictionary: DataFrame, item_vectors: DataFrame, dictionary_vectors: DataFrame,
                           keywords: DataFrame, ranked: DataFrame | None = None, accept: float = 0.90) -> DataFrame:
    """Every kept fee item with a code: stated in the contract, or the best row of its section's and keywords' pool.

    `items` is (item_id, item, section_header, stated_code, price, checkbox), `section_map` (raw, section), the vectors
    (text, vector) of cleaned items and of descriptions. Below `accept` the answers in `ranked` (item_id, scope, code,
    description, confidence) come first: those of scope 'pool', or where they are missing or under 70 those of scope 'full'
    if higher; without an answer the best row stays, marked as fallback. An item without a pool has the whole dictionary.
    """
    kept = items.where(F.coalesce("checkbox", F.lit(True)) & (strip(F.coalesce("item", F.lit(""))) != ""))
    canon = matching.section_canonical(kept.select(F.col("section_header").alias("header")), section_map)
    base = kept.join(canon.select(F.col("header").alias("section_header"), "section"), "section_header", "left").withColumn("text", sim.legal_clean(F.col("item")))
    # Several later steps read the items with their sections, the sections' rows and the pools; each is written once.
    base = cut_lineage(base.select("item_id", "item", "section", "stated_code", "price", "text"))
    sections = cut_lineage(matching.section_pool(base.select("section").where("section IS NOT NULL"), dictionary))
    stated = matching.validate_stated_code(base.select("item_id", "section", "stated_code"), sections, dictionary)
    # A section without rows stands for the whole dictionary, so that a code found there is a code of the section.
    open_items = base.withColumn("_s", F.lower("section")).join(sections.select(F.col("section").alias("_s")).distinct(), "_s", "left_anti").select("item_id", F.lit(True).alias("_open"))
    stated = stated.join(open_items, "item_id", "left").select(
        "item_id", "code", "description",
        F.when(F.col("_open") & (F.col("source") == "Contract+Dict (full)"), "Contract+Dict (section)").otherwise(F.col("source")).alias("source"), "confidence",
    )

    rest = base.where(strip(F.coalesce("stated_code", F.lit(""))) == "")
    empty = rest.where(F.col("text") == "").select("item_id", F.lit("").alias("code"), F.lit("").alias("description"), F.lit("Empty item").alias("source"), F.lit(0).alias("confidence"))
    todo = rest.where(F.col("text") != "")
    asked, pools = map(cut_lineage, pl.item_pools(todo.select("text", "section"), dictionary, sections, keywords))
    texts = asked.select("pool", "text").distinct().join(item_vectors, "text", "left")
    rows = dictionary.join(dictionary_vectors.withColumnRenamed("text", "description"), "description", "left")
    best = cut_lineage(pl.best_in_pool(texts, pools, rows.select("position", "description", "vector"))).join(dictionary.select("position", "code", "description"), "position")
    same_section = F.col("i.section").eqNullSafe(F.col("a.section")) & (F.col("i.text") == F.col("a.text"))
    found = todo.alias("i").join(asked.alias("a"), same_section).select("i.item_id", "a.text", "a.pool").join(best, ["pool", "text"])
    full = F.col("pool") == pl.WHOLE
    scored = found.withColumn("_auto", F.col("score") >= accept).withColumn("_suffix", F.when(full, " - full").otherwise(""))
    own = F.struct("code", "description", F.concat(F.when(F.col("_auto"), "Hybrid (auto)").otherwise("Hybrid (fallback)"), "_suffix").alias("source"),
                   F.bround(F.col("score") * 100, 0).cast("int").alias("confidence"))
    if ranked is None:
        matched = scored.select("item_id", own.alias("r")).select("item_id", "r.*")
    else:
        answer = F.max_by(F.struct("code", "description", F.col("confidence").cast("int").alias("confidence")), F.struct("confidence", "code", "description"))
        of = lambda scope: ranked.where(F.col("scope") == scope).groupBy("item_id").agg(answer.alias(f"_{scope}"))
        both = scored.join(of("pool"), "item_id", "left").join(of("full"), "item_id", "left")
        first, second = F.col("_pool"), F.col("_full")
        better = ~full & (F.coalesce(first["confidence"], F.lit(0)) < 70) & (second["confidence"] > F.coalesce(first["confidence"], F.lit(0)))
        named = lambda r, label: F.struct(r["code"].alias("code"), r["description"].alias("description"), label.alias("source"), r["confidence"].alias("confidence"))
        chosen = F.when(F.col("_auto"), own).when(better, named(second, F.lit("AI - full (fallback)"))).when(first.isNotNull(), named(first, F.concat(F.lit("AI"), F.col("_suffix")))).otherwise(own)
        matched = both.select("item_id", chosen.alias("r")).select("item_id", "r.*")
    codes = stated.unionByName(empty).unionByName(matched)
    return base.join(codes, "item_id").select(
        "item_id", "item", "section", "code", "description", "source", "confidence", (F.col("confidence") / 100.0).alias("match_confidence"),
        clean_price(F.col("price")).alias("cleaned_price"), pricing_type(F.col("price")).alias("pricing_type"), tier_range(F.col("item")).alias("tier_range"),
    )


def master_load_rows(inventory: DataFrame, hierarchy: DataFrame, overview: DataFrame, items: DataFrame, matches: DataFrame,
                     primary: DataFrame, fallback: DataFrame, vendor: str | None = None) -> DataFrame:
    """Load rows of each client's newest master agreement, legal wording left out."""
    master = docs.latest_master(inventory, hierarchy, overview).select("client", F.col("filename").alias("source_contract"), "signing_date")
    fees = loadrows.split_legal_items(items, vendor).where(~F.col("legal")).join(master, ["client", "source_contract"])
    picked = loadrows.dictionary_pick(fees.join(matches, "item_id", "left").withColumn(
        "source_dict", F.coalesce("source_dict", F.lit("none"))), primary, fallback)
    return loadrows.load_rows(picked)


def clause_table(contracts: DataFrame, pages: DataFrame, values: DataFrame, family: str, allow: DataFrame | None = None) -> DataFrame:
    """Clause rows of one family over the scoped clause documents."""
    scoped = contracts
    if allow is not None:
        scoped = docs.apply_scope(contracts, allow, (family,)).select("client", "filename")
    wanted = scoped.where(F.lower("filename").rlike("master|amendment|services")).select("client", "filename").distinct()
    hits = cl.keyword_hits(pages.join(wanted, ["client", "filename"], "left_semi"))
    return cl.clause_rows(scoped, cl.dedupe_snippets(hits.where(F.col("family") == family)), values, family)


def product_table(rows: DataFrame, documents: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean product rows, schedules that need another pass)."""
    routed = modules.with_route(modules.license_override(documents))
    return modules.product_modules(rows, routed), modules.missing_schedules(manifest, rows)


def dashboards(runs: DataFrame) -> dict[str, DataFrame]:
    return {
        "by_client": pf.usage_by_client(runs), "by_model": pf.usage_by_model(runs, ("client",)), "detail": pf.usage_detail(runs),
        "rollup": pf.model_rollup(runs), "latest": pf.latest_by_agent(runs), "recent": pf.last_n_runs(runs),
    }


def incremental(contracts: DataFrame, done: DataFrame, process, path: str, stage: str, cutoff_year: Column | int | None = None,
                force: bool = False) -> DataFrame:
    """Processes contracts without output, replaces their clients' partitions, returns the run metadata.

    A client is written whole: its finished contracts are read back and kept.
    """
    todo = sinks.pending(contracts, done, force)
    fresh = process(todo)
    kept = done.join(todo.select("client").distinct(), "client", "left_semi").join(
        todo.select("client", "filename"), ["client", "filename"], "left_anti")
    rows = cut_lineage(fresh.unionByName(kept.select(*fresh.columns), allowMissingColumns=True))
    sinks.write_stage(rows, path)
    return sinks.run_meta(rows.withColumnRenamed("filename", "source_contract"), stage, cutoff_year)
