"""The contract forest: roots, parents, levels, duplicates, confidence, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.contracts import (
    confidence_score,
    era,
    extraction_score,
    filename_type,
    normal_type,
    rank_of,
    resolved_dates,
    resolved_type,
    score_bucket,
)
from ledgerloom.functions.documents import filename_date
from ledgerloom.functions.names import entity_tokens, party_set
from ledgerloom.operators import parents as finders
from ledgerloom.operators.invoices import top_per
from ledgerloom.session import cut_lineage


def prepare_contracts(meta: DataFrame, vendor: tuple[str, ...] = ()) -> DataFrame:
    """Resolved type and dates, entity words, party set and ranks of every contract."""
    # columns of their own: the type and its note name them many times
    meta = meta.withColumns({"_body": normal_type(F.col("contract_type")), "_named": filename_type(F.col("filename"))})
    kind, type_note = resolved_type(F.col("_body"), F.col("_named"))
    effective, signed, date_note = resolved_dates(
        F.col("effective_date"), filename_date(F.col("filename")), F.col("signed_date")
    )
    out = meta.select(
        "client", "key", "filename", "parties", "is_active", "extraction_confidence",
        extraction_score(F.col("extraction_score"), F.col("extraction_confidence")).alias("extraction_score"),
        kind.alias("type"), type_note.alias("type_note"),
        effective.alias("effective_date"), signed.alias("signed_date"), date_note.alias("date_note"),
        entity_tokens(F.col("parties"), F.col("filename"), vendor).alias("tokens"),
        party_set(F.col("parties")).alias("party_set"),
    )
    return out.withColumn("rank", rank_of(F.col("type"), fixed.PARENT_RANKS)).withColumn(
        "hrank", rank_of(F.col("type"), fixed.TYPE_RANKS)
    )


def first_pass(contracts: DataFrame, references: DataFrame) -> DataFrame:
    """Adds level, parent_key, method, confidence and is_ambiguous for roots and bundle members.

    Master agreements are roots. Other root-eligible types are roots too, unless their cited
    parent is within the bundle window. Everything else stays open (level and parent null).
    """
    ref = references.select(
        "key", F.col("parent_key").alias("_parent"), F.col("parent_date").alias("_pdate"), F.col("is_ambiguous").alias("_amb")
    )
    eligible = F.col("type").isin(*fixed.ROOT_TYPES)
    master = F.col("type") == "MSA"
    bundled = eligible & ~master & F.col("_parent").isNotNull() & finders.bundle_gate(F.col("effective_date"), F.col("_pdate"))
    cited = F.when(F.col("extraction_confidence") == "high", "high").otherwise("medium-high")
    return (
        contracts.join(ref, "key", "left")
        .withColumn("_bundled", F.coalesce(bundled, F.lit(False)))
        .withColumn("level", F.when(eligible & ~F.col("_bundled"), 0))
        .withColumn("parent_key", F.when(F.col("_bundled"), F.col("_parent")))
        .withColumn("method", F.when(F.col("_bundled"), "reference").when(master, "root").when(eligible, "miscellaneous"))
        .withColumn("confidence", F.when(F.col("_bundled"), cited).when(eligible, "high"))
        .withColumn("is_ambiguous", F.coalesce(F.col("_bundled") & F.col("_amb"), F.lit(False)))
        .drop("_parent", "_pdate", "_amb", "_bundled")
    )


def second_pass(passed: DataFrame, references: DataFrame, citations: DataFrame, codes: DataFrame, products: DataFrame) -> DataFrame:
    """Parents of the open contracts: reference, then code, then products, then the unique root; else orphan.

    Every finder looks at the first pass only, so they run side by side and the first answer counts.
    """
    passed = cut_lineage(passed)  # every finder reads it, some twice
    still = F.col("level").isNull() & F.col("parent_key").isNull()
    children = passed.where(still)
    ref = finders.tagged(references.select("key", "parent_key", "is_ambiguous"), "ref")
    code = finders.tagged(finders.parents_by_doc_code(passed, children, codes), "code")
    prod = finders.tagged(finders.parents_by_products(passed, children, products), "prod")
    root = finders.tagged(finders.parents_by_unique_root(passed, children, citations), "root")
    cited = F.when(F.col("extraction_confidence") == "high", "high").otherwise("medium-high")
    joined = children.join(ref, "key", "left").join(code, "key", "left").join(prod, "key", "left").join(root, "key", "left")
    parent = F.coalesce("ref_parent_key", "code_parent_key", "prod_parent_key", "root_parent_key")
    method = (
        F.when(F.col("ref_parent_key").isNotNull(), "reference")
        .when(F.col("code_parent_key").isNotNull(), "doc_code")
        .when(F.col("prod_parent_key").isNotNull(), "products")
        .when(F.col("root_parent_key").isNotNull(), "single_msa_fallback")
        .otherwise("orphan")
    )
    refused = F.coalesce("ref_is_ambiguous", F.lit(False)), F.coalesce("prod_is_ambiguous", F.lit(False))
    found = joined.select(
        *[c for c in passed.columns if c not in ("level", "parent_key", "method", "confidence", "is_ambiguous")],
        F.when(method == "orphan", -1).alias("level"),
        parent.alias("parent_key"), method.alias("method"),
        F.when(method == "reference", cited)
        .when(method == "doc_code", F.when(F.col("code_high_value"), "medium-high").otherwise("medium"))
        .when(method != "orphan", "low").alias("confidence"),
        ((method == "orphan") & (refused[0] | refused[1])).alias("is_ambiguous"),
        F.coalesce((method == "doc_code") & F.col("code_via_number"), F.lit(False)).alias("via_number"),
        F.when(method != "orphan", "")
        .when(refused[0], "parent reference is ambiguous")
        .when(refused[1], "product overlap is ambiguous")
        .otherwise("no parent signal found").alias("note"),
    )
    settled = passed.where(~still).withColumn("via_number", F.lit(False)).withColumn("note", F.lit(""))
    return settled.unionByName(found)


def promote_chain_roots(linked: DataFrame) -> DataFrame:
    """Orphans that others reach through a shared number become level 0."""
    anchors = linked.where(F.col("via_number")).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("linked"))
    up = F.col("linked").isNotNull() & (F.col("level") == -1)
    return (
        linked.join(anchors, "key", "left")
        .withColumn("_up", up)
        .withColumn("level", F.when(F.col("_up"), 0).otherwise(F.col("level")))
        .withColumn("method", F.when(F.col("_up"), "chain_root").otherwise(F.col("method")))
        .withColumn("confidence", F.when(F.col("_up"), "low").otherwise(F.col("confidence")))
        .withColumn("is_ambiguous", F.col("is_ambiguous") & ~F.col("_up"))
        .withColumn("note", F.when(F.col("_up"), "chain root, true master not on file").otherwise(F.col("note")))
        .drop("linked", "_up")
    )


def assign_levels(linked: DataFrame) -> DataFrame:
    """Level of every contract below a root, null where no root is reached (cycles, missing parents).

    Pointer doubling: after k rounds a contract knows its ancestor 2^k steps up. If a round
    brings no further contract to its root, none lies deeper, since depths have no gaps.
    """
    nodes = linked.select(
        "key", F.when(F.col("level") == 0, F.col("key")).otherwise(F.col("parent_key")).alias("up"),
        F.when(F.col("level") == 0, 0).otherwise(1).alias("steps"), (F.col("level") == 0).alias("root"),
    ).withColumn("root", F.coalesce("root", F.lit(False)))
    roots = nodes.where(F.col("root")).select(F.col("key").alias("up"))
    reach, settled = nodes, -1
    while True:
        hop = reach.select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        # roots point to themselves with 0 steps; a missing parent ends the chain
        reach = cut_lineage(
            reach.join(hop, "up", "left").select("key", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), "root")
        )
        there = reach.join(roots, "up", "left_semi").count()
        if there == settled:
            break
        settled = there
    levels = reach.join(roots, "up", "left_semi").select("key", F.col("steps").alias("_level"))
    return (
        linked.join(levels, "key", "left")
        .withColumn("level", F.coalesce("_level", F.when(F.col("level") == -1, F.lit(-1))).cast("int"))
        .drop("_level")
    )


def break_chains(leveled: DataFrame) -> DataFrame:
    """Contracts whose chain reaches no root become orphans and lose their parent."""
    lost = F.col("level").isNull()
    return (
        leveled.withColumn("_lost", lost)
        .withColumn("level", F.coalesce("level", F.lit(-1)))
        .withColumn("method", F.when(F.col("_lost"), "orphan").otherwise(F.col("method")))
        .withColumn("confidence", F.when(F.col("_lost"), "low").otherwise(F.col("confidence")))
        .withColumn("parent_key", F.when(~F.col("_lost"), F.col("parent_key")))
        .withColumn("note", F.when(F.col("_lost"), "parent chain reaches no root").otherwise(F.col("note")))
        .drop("_lost")
    )


def mark_duplicates(forest: DataFrame) -> DataFrame:
    """Adds `duplicate_of`: level-0 copies (client, type, date, parties) point to the smallest filename."""
    names = F.array_sort(F.array_distinct(F.filter(
        F.transform(F.coalesce("parties", F.array().cast("array<string>")), lambda p: F.lower(F.trim(p))), lambda p: p != "")))
    cluster = ["client", "type", "effective_date", "_names"]
    roots = forest.where((F.col("level") == 0) & F.col("effective_date").isNotNull()).select(
        "key", "filename", "client", "type", "effective_date", names.alias("_names")
    )
    firsts = roots.groupBy(*cluster).agg(F.min(F.struct("filename", "key")).alias("first"))
    copies = roots.join(firsts, cluster).where(F.col("first.key") != F.col("key")).select(
        "key", F.col("first.key").alias("duplicate_of")
    )
    return (
        forest.join(copies, "key", "left")
        .withColumn("method", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("method")))
        .withColumn("note", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("note")))
    )


def relink_duplicates(forest: DataFrame) -> DataFrame:
    """Parents that are copies are replaced by their original."""
    moved = forest.where(F.col("duplicate_of").isNotNull()).select(
        F.col("key").alias("parent_key"), F.col("duplicate_of").alias("_original")
    )
    return (
        forest.join(moved, "parent_key", "left")
        .withColumn("relinked", F.col("_original").isNotNull())
        .withColumn("parent_key", F.coalesce("_original", "parent_key"))
        .drop("_original")
    )


def with_confidence(forest: DataFrame) -> DataFrame:
    score = confidence_score(F.col("method"), F.col("extraction_score"))
    return forest.withColumn("score", score).withColumn(
        "bucket", F.when(F.col("method") != "orphan", score_bucket(F.col("score")))
    )


def hierarchy_status(level: Column, duplicate_of: Column) -> Column:
    return (
        F.when(duplicate_of.isNotNull(), "Duplicate").when(level == -1, "Orphan").when(level == 0, "Parent").otherwise("Child")
    )


def salvage_and_break(leveled: DataFrame, codes: DataFrame) -> DataFrame:
    """Unresolved members join promoted chain roots; what still reaches no root is an orphan."""
    promoted = leveled.where(F.col("method") == "chain_root")
    open_ = leveled.where((F.col("method") != "chain_root") & (F.col("level").isNull() | (F.col("level") < 0)))
    saved = finders.tagged(finders.salvage_chains(open_, promoted, codes), "saved")
    # a member below the first pass keeps its link and is walked again with the salvaged ones
    salvaged = (
        leveled.join(saved, "key", "left")
        .withColumn("_s", F.col("saved_parent_key").isNotNull())
        .withColumn("parent_key", F.coalesce("saved_parent_key", "parent_key"))
        .withColumn("level", F.when(~F.col("_s") & F.col("level").isin(0, -1), F.col("level")))
        .withColumn("method", F.when(F.col("_s"), "doc_code").otherwise(F.col("method")))
        .withColumn("confidence", F.when(F.col("_s"), "low").otherwise(F.col("confidence")))
        .withColumn("is_ambiguous", F.col("is_ambiguous") & ~F.col("_s"))
        .withColumn("note", F.when(F.col("_s"), "salvaged into a chain root").otherwise(F.col("note")))
        .drop("_s", "saved_parent_key")
    )
    return break_chains(assign_levels(cut_lineage(salvaged)))


def finish_forest(leveled: DataFrame, codes: DataFrame) -> DataFrame:
    """Salvage, orphans, copies, confidence and status."""
    linked = relink_duplicates(mark_duplicates(cut_lineage(salvage_and_break(leveled, codes))))
    notes = F.array(
        F.nullif(F.col("note"), F.lit("")), F.when(F.col("relinked"), F.lit("parent is a duplicate, moved to its original")),
        F.nullif(F.col("date_note"), F.lit("")), F.nullif(F.col("type_note"), F.lit("")),
    )
    return (
        with_confidence(linked)
        .withColumn("status", hierarchy_status(F.col("level"), F.col("duplicate_of")))
        .withColumn("notes", F.array_join(F.array_compact(notes), " | "))
    )


def resolve_hierarchy(
    meta: DataFrame, citations: DataFrame, codes: DataFrame, products: DataFrame, vendor: tuple[str, ...] = ()
) -> DataFrame:
    """The whole forest, all clients at once. Each pass is written before the next reads it."""
    contracts = cut_lineage(prepare_contracts(meta, vendor))
    references = cut_lineage(finders.parents_by_reference(contracts, citations, codes))
    linked = cut_lineage(second_pass(first_pass(contracts, references), references, citations, codes, products))
    leveled = cut_lineage(assign_levels(promote_chain_roots(linked)))
    return finish_forest(leveled, codes)


# ------------------------------------------------------------------ views of the forest


def with_parent_name(forest: DataFrame) -> DataFrame:
    """Adds `parent_filename` and `has_children`."""
    names = forest.select(F.col("key").alias("parent_key"), F.col("filename").alias("parent_filename"))
    used = forest.where(F.col("parent_key").isNotNull()).select(F.col("parent_key").alias("key")).distinct().withColumn(
        "has_children", F.lit(True)
    )
    return forest.join(names, "parent_key", "left").join(used, "key", "left").withColumn(
        "has_children", F.coalesce("has_children", F.lit(False))
    )


def hierarchy_rows(forest: DataFrame) -> DataFrame:
    """Reporting rows: filenames for pointers, joined lists, yes/no flags."""
    names = forest.select(F.col("key").alias("duplicate_of"), F.col("filename").alias("_dup"))
    return with_parent_name(forest).join(names, "duplicate_of", "left").select(
        "filename", "client", F.col("type").alias("contract_type"),
        F.coalesce(F.col("signed_date").cast("string"), F.lit("")).alias("signed_date"),
        F.coalesce(F.col("effective_date").cast("string"), F.lit("")).alias("effective_date"),
        F.when(F.col("parent_key").isNull(), "None").otherwise(F.coalesce("parent_filename", "parent_key")).alias("parent_contract"),
        F.coalesce("_dup", F.lit("")).alias("duplicate_of"),
        "level", "status",
        F.when(F.col("method") == "miscellaneous", "standalone").otherwise(F.coalesce("method", F.lit(""))).alias("method"),
        "score", F.coalesce("bucket", F.lit("")).alias("bucket"), F.coalesce("confidence", F.lit("")).alias("confidence"),
        "extraction_score", F.when(F.col("is_ambiguous"), "yes").otherwise("no").alias("is_ambiguous"),
        F.array_join(F.coalesce("parties", F.array().cast("array<string>")), "; ").alias("parties"), "notes",
    )


def hierarchy_summary(forest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    n = lambda c: F.count_if(c)
    lvl = F.col("level")
    return forest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("contracts"),
        n(lvl == 0).alias("roots"), n(lvl == 1).alias("level_1"), n(lvl == 2).alias("level_2"), n(lvl > 2).alias("deeper"),
        n(lvl == -1).alias("orphans"), n(F.col("is_ambiguous")).alias("ambiguous"),
        n(F.col("bucket") == "high").alias("high"), n(F.col("bucket") == "medium").alias("medium"), n(F.col("bucket") == "low").alias("low"),
    )


def document_class(level: Column) -> Column:
    return (
        F.when(level == 0, "Parent").when(level == 1, "Amendment").when(level == 2, "Sub-Amendment")
        .when(level > 2, "Others").otherwise("Orphan")
    )


def classification_grid(forest: DataFrame) -> DataFrame:
    """Contracts per document class, confidence bucket and method, with cell totals (method null)."""
    method = F.when(F.col("method") == "miscellaneous", "Standalone").otherwise(F.coalesce("method", F.lit("unknown")))
    cells = forest.select(
        document_class(F.col("level")).alias("document_class"), F.coalesce("bucket", F.lit("unknown")).alias("bucket"), method.alias("method")
    )
    return cells.groupingSets(
        [["document_class", "bucket", "method"], ["document_class", "bucket"]], "document_class", "bucket", "method"
    ).agg(F.count(F.lit(1)).alias("contracts"))


def keep_contracts(forest: DataFrame, buckets=None, root_types=None, classes=None) -> DataFrame:
    """Filters of the forest view; a None inside `buckets` stands for contracts without a bucket."""
    out = forest
    if buckets is not None:
        named = [b for b in buckets if b is not None]
        keep = F.col("bucket").isin(*named) if named else F.lit(False)
        out = out.where(F.coalesce(keep, F.lit(False)) | (F.col("bucket").isNull() if None in buckets else F.lit(False)))
    if root_types is not None:
        out = out.where((F.col("level") != 0) | F.col("type").isin(*root_types))
    if classes is not None:
        out = out.where(document_class(F.col("level")).isin(*classes))
    return out


def root_type_counts(forest: DataFrame) -> DataFrame:
    return forest.where(F.col("level") == 0).groupBy("type").agg(F.count(F.lit(1)).alias("contracts"))


def era_counts(forest: DataFrame) -> DataFrame:
    return forest.groupBy("level", era(F.col("signed_date")).alias("era")).agg(F.count(F.lit(1)).alias("contracts"))


def graph_edges(forest: DataFrame) -> DataFrame:
    """(client, parent, child, method) where the parent is on file."""
    up = forest.select("client", F.col("key").alias("parent_key"), F.col("filename").alias("parent"))
    return forest.join(up, ["client", "parent_key"]).select("client", "parent", F.col("filename").alias("child"), "method")


def product_lineage(forest: DataFrame, products: DataFrame, most: int = 30) -> DataFrame:
    """The products named by most contracts, with their contracts in signed-date order, undated first.

    Positions come from counting per day first, so a product held by a third of all contracts
    is never sorted in one task.
    """
    names = products.select("client", "key", F.trim("product").alias("product")).where(F.col("product") != "").distinct()
    sizes = names.groupBy("product").agg(F.count(F.lit(1)).alias("contracts"))
    top = sizes.orderBy(F.desc("contracts"), F.lower("product"), "product").limit(most)
    w = Window.orderBy(F.desc("contracts"), F.lower("product"), "product")
    ranked = top.withColumn("position", F.row_number().over(w))
    placed = names.join(F.broadcast(ranked), "product").join(
        forest.select("key", "client", "filename", "signed_date", "level"), ["client", "key"]
    ).withColumn("_day", F.coalesce("signed_date", F.lit("1900-01-01").cast("date")))
    days = placed.groupBy("product", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("product").orderBy("_day")) - F.col("_n")
    in_day = Window.partitionBy("product", "_day").orderBy("client", "filename", "key")
    return placed.join(days.withColumn("_before", before), ["product", "_day"]).select(
        "product", "position", "contracts", (F.col("_before") + F.row_number().over(in_day)).alias("step"),
        "client", "filename", "signed_date", "level",
    )


# ------------------------------------------------------------------ status


def contract_status(contracts: DataFrame, forest: DataFrame) -> DataFrame:
    """ACTIVE, ROOT-PARTIAL, ORPHAN, SUPERSEDED or UNKNOWN per contract.

    The inactive flag wins; without a forest row only the flag speaks. A childless root whose
    status reads Parent is ROOT-PARTIAL.
    """
    rows = with_parent_name(forest).select("key", "status", "method", "level", "has_children", F.lit(True).alias("_row"))
    parent = (F.col("status") == "Parent") | F.col("has_children")
    partial = (F.col("level") == 0) | F.col("method").isin("root", "miscellaneous")
    status = (
        F.when(F.col("is_active") == F.lit(False), "SUPERSEDED")
        .when(F.col("_row").isNull(), F.when(F.col("is_active"), "ACTIVE").otherwise("UNKNOWN"))
        .when((F.col("status") == "Orphan") | (F.col("level") == -1), "ORPHAN")
        .when(parent, F.when(partial, "ROOT-PARTIAL").otherwise("SUPERSEDED"))
        .when(F.col("status") == "Duplicate", "SUPERSEDED")
        .otherwise("ACTIVE")
    )
    return contracts.join(rows, "key", "left").withColumn("contract_status", status)
