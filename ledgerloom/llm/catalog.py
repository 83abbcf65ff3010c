"""The registered queries of this package, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, exactdedup, htmltext, lm, merkle, mixing, pii, setjoin, simhash, suffixdedup, toxicity, urlfilter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, oracle: str | None = None):
    """Register `fn(spark, sf_dir)` under `name`."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op10_exact_dedup",
    f"""
    WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM texts
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents")).drop("row")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op3_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    item_windows AS (
        SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0))
    ),
    doc_windows AS (
        SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
    ),
    hits AS (SELECT doc_id, s, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
    found AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


_FLAGGED = "|".join(urlfilter.FLAGGED_WORDS)


@query(
    "op8_url_filter",
    f"""
    WITH p AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
        FROM pages
    ),
    rules(verdict, name, host, path) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}')" for v, r in urlfilter.STATED)}),
    fits AS (
        SELECT page_id, max_by(r.name, length(r.name)) AS rule, max_by(r.verdict, length(r.name)) AS verdict
        FROM p JOIN rules r ON ('.' || p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[^0-9a-z])({_FLAGGED})([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN fits USING (page_id)
    """,
)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("row")


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, spans = pii.span_texts()
    counts = [pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return pii.find_private(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.drop_repeats(table(spark, sf_dir, "documents"), texts=False)


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


_MERKLE_LEVELS = 8
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""


def _merkle_leaf(text: str) -> str:
    fields = ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({fields}))"


def _merkle_tree(name: str, first: str) -> str:
    """Levels 0 to _MERKLE_LEVELS of the trees (tree, pos, hash) of `first`; a level with one node stays as it is."""
    levels = [f"{name}0 AS (SELECT tree, pos, hash, count(*) OVER (PARTITION BY tree) AS n FROM {first})"]
    for k in range(_MERKLE_LEVELS):
        levels.append(f"{name}_run{k} AS (SELECT tree, pos // 16 AS pos, list(hash ORDER BY pos) AS run, any_value(n) AS n FROM {name}{k} GROUP BY 1, 2)")
        levels.append(f"{name}{k + 1} AS (SELECT tree, pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash, count(*) OVER (PARTITION BY tree) AS n FROM {name}_run{k})")
    return ",\n    ".join(levels)


def _merkle_climb(name: str, tree: str, pos: str, start: str) -> str:
    """Each document's siblings and fold, one level after the other."""
    steps, last = [], start
    for k in range(_MERKLE_LEVELS):
        at = f"d.{pos} >> {4 * k}"
        others = f"array_to_string(list_concat(run[1 : ({at}) % 16], run[({at}) % 16 + 2 :]), '')"
        folded = f"sha256(concat(array_to_string(run[1 : ({at}) % 16], ''), folded, array_to_string(run[({at}) % 16 + 2 :], '')))"
        steps.append(
            f"{name}_up{k} AS (SELECT d.* EXCLUDE (proof, folded), proof || CASE WHEN r.n = 1 THEN '' ELSE {others} END AS proof, CASE WHEN r.n = 1 THEN folded ELSE {folded} END AS folded "
            f"FROM {last} d JOIN {name}_run{k} r ON r.tree = d.{tree} AND r.pos = (d.{pos} >> {4 * (k + 1)}))"
        )
        last = f"{name}_up{k}"
    return ",\n    ".join(steps)


@query(
    "op12_merkle_manifest",
    f"""
    WITH texts AS (
        SELECT *, CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM documents
    ),
    hashed AS (SELECT doc_id, source, {_merkle_leaf("text")} AS leaf, {_merkle_leaf("changed")} AS claimed FROM texts),
    numbered AS (
        SELECT doc_id, leaf, claimed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM hashed
    ),
    docs0 AS (SELECT tree, pos, leaf AS hash FROM numbered),
    {_merkle_tree("doc", "docs0")},
    subroots AS (SELECT 0 AS tree, tree AS pos, hash FROM doc{_MERKLE_LEVELS}),
    {_merkle_tree("src", "subroots")},
    begun AS (SELECT doc_id, leaf, tree, pos, 0 AS top, '' AS proof, claimed AS folded FROM numbered),
    {_merkle_climb("doc", "tree", "pos", "begun")},
    {_merkle_climb("src", "top", "tree", f"doc_up{_MERKLE_LEVELS - 1}")}
    SELECT d.doc_id, d.leaf, s.hash AS subroot, r.hash AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = r.hash AS verified
    FROM src_up{_MERKLE_LEVELS - 1} d JOIN doc{_MERKLE_LEVELS} s ON s.tree = d.tree JOIN src{_MERKLE_LEVELS} r ON r.tree = d.top
    """,
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_digests(merkle.prove(table(spark, sf_dir, "documents"), claim=tampered()))


def tampered() -> dict[str, Column]:
    """The claim of op12: where 5 divides the CRC of the doc_id, the text's capitals are small."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return {"text": F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}


def merkle_digests(proved: DataFrame) -> DataFrame:
    text = lambda c: F.lower(F.hex(c))
    return proved.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


@query("op13_jaccard_join")
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = whitening.Whitening(table(spark, sf_dir, "embeddings"))
    shares = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values]).cast("array<double>")
    rows = fitted.transform().select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )
