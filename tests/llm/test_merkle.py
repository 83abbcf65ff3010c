import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from ledgerloom.llm import merkle
from ledgerloom.llm.catalog import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, Tree string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(doc_id, source, lang, n_chars, text):
    return H(*map(said, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """All levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    """The runs from a node upward, each with the node's place in it."""
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield run, at % 16
        at //= 16


def slow(rows):
    """rows: (doc_id, text, lang, source, n_chars) to a sorted list of the query's rows."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        key = (source is not None, (source or "").encode())
        groups.setdefault(key, []).append(((doc_id is not None, doc_id or 0), leaf_of(doc_id, source, lang, n_chars, text), leaf_of(doc_id, source, lang, n_chars, changed), doc_id))
    trees = [(sorted(groups[k], key=lambda x: (x[0], x[1])), None) for k in sorted(groups)]
    trees = [(leaves, climb([x[1] for x in leaves])) for leaves, _ in trees]
    top = climb([levels[-1][0] for _, levels in trees])
    out = []
    for t, (leaves, levels) in enumerate(trees):
        for i, (_, leaf, claimed, doc_id) in enumerate(leaves):
            runs = [*path(levels, i), *path(top, t)]
            fold = claimed
            for run, at in runs:
                fold = H(*run[:at], fold, *run[at + 1 :])
            proof = H(*(x for run, at in runs for k, x in enumerate(run) if k != at))
            out.append((doc_id, leaf, levels[-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return sorted(out, key=str)


def query_rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def run(spark, rows, partition_leaves):
    """The query over rows with columns that clash with the operator's own."""
    from ledgerloom.llm import catalog

    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return query_rows(catalog.merkle_digests(merkle.prove(frame, claim=catalog.tampered(), partition_leaves=partition_leaves)))


def test_against_brute_force_with_nulls_ties_and_long_texts(spark):
    random.seed(2)
    rows = [(i, f"Text Ä {i} " * (i % 7), "en", random.choice(["a", "a", "a", "b", "é", "", None]), i) for i in range(700)]
    rows += [(1000 + i, None, None, f"s{i}", None) for i in range(40)]
    rows += [(5, "again", "en", "a", 1)] * 20 + [(None, "No Id", "en", "a", 1), (None, None, None, None, None), (3000, "LONG words " * 200_000, "en", "b", 5)]
    random.shuffle(rows)
    want = slow(rows)
    for partition_leaves in (7, 4096):
        assert run(spark, rows, partition_leaves) == want


def test_small_tables(spark):
    for n in (1, 17, 257):
        rows = [(i, f"T{i}", "en", "one", 1) for i in range(n)]
        assert run(spark, rows, 4) == slow(rows), n
    for n in (16, 300):
        rows = [(i, f"T{i}", "en", f"s{i:04}", 1) for i in range(n)]
        assert run(spark, rows, 5) == slow(rows), n
    empty = merkle.prove(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "root" in empty.columns


def test_only_what_cannot_be_derived_is_fetched(spark):
    spans = spark.createDataFrame([(0, 0, 20, 40, 1000), (1, 1, 0, 5, 5), (2, 2, 16, 32, 40)], "part long, tree long, lo long, hi long, size long")
    got = {}
    for r in merkle._asked(spans, 3).collect():
        got.setdefault(r.part, set()).add((r.level, r.pos))
    assert got[0] == {(0, x) for x in [*range(16, 20), *range(40, 48)]} | {(1, x) for x in [0, *range(3, 16)]} | {(2, x) for x in (1, 2, 3)}
    assert 1 not in got
    assert got[2] == {(1, 0), (1, 2)}


def test_claims_that_change_nothing_verify(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "one", 1) for i in range(100)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = merkle.prove(frame, claim={"text": F.lower("text")}).collect()
    assert {r.doc_id for r in out if r.folded == r.root} == {i for i in range(0, 100, 2)}
    assert all(r.derived == r.root for r in out)


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert query_rows(QUERIES["op12_merkle_manifest"](spark, folder)) == slow(rows)
