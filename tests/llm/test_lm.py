import binascii
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lm
from ledgerloom.llm.buffers import deltas, pack, undeltas, unpack
from ledgerloom.llm.catalog import QUERIES
from ledgerloom.llm.eliasfano import EliasFano
from ledgerloom.llm.stages import written

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII))


def slow(rows):
    """doc -> (held, n_tokens, n_known, N, base, score) for (doc, text, held)."""
    uni, bi, after = Counter(), Counter(), {}
    for _, text, held in rows:
        if not held:
            tokens = [*split(text), "\n"]
            uni.update(tokens)
            for pair in zip([" ", *tokens], tokens):
                bi[pair] += 1
                after.setdefault(pair[0], set()).add(pair[1])
    context = Counter()
    for (v, _), n in bi.items():
        context[v] += n
    total, size = sum(uni.values()), len(uni)
    p = lambda w: math.log10((uni[w] + 1) / (total + size + 1))
    out = []
    for doc, text, held in rows:
        tokens, score = [*split(text), "\n"], 0.0
        for v, w in zip([" ", *tokens], tokens):
            own = 10 ** p(w)
            if v in context:
                own = max(bi[v, w] - lm.DISCOUNT, 0) / context[v] + lm.DISCOUNT * len(after[v]) / context[v] * own
            score += math.log10(own)
        out.append((doc, held, len(tokens), sum(uni[w] > 0 for w in tokens), total, sum(map(p, tokens)), score))
    return out


def compare(got, want, step):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= step * w[2]


def test_sequences():
    rng = np.random.default_rng(1)
    for n, top in [(0, 1), (1, 1), (5, 10), (1000, 1 << 57), (3000, 2000), (20000, 1 << 40)]:
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        sequence = EliasFano(*EliasFano.parts(values))
        assert (sequence.get(np.arange(n)) == values).all()
        asked = np.concatenate([rng.integers(0, top, 300).astype(np.uint64), values[:300], np.array([0, top + 5], np.uint64)])
        index, found = sequence.successor(asked)
        assert (index == np.searchsorted(values, asked)).all() and (found == np.isin(asked, values)).all()
        assert (unpack(pack(values)) == values).all()
    odd = np.array([5, 3, -7, 100, 1 << 40])
    assert (undeltas(unpack(pack(deltas(odd)))) == odd).all()


@pytest.mark.parametrize("heavy", [0, 1])
def test_scores(spark, heavy):
    rng = random.Random(4)
    vocabulary = [f"W{i}é" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.choice([0, 1, 5, 80]))), i % 5 == 1) for i in range(150)]
    rows += [(200, None, False), (201, " \t\n", True), (202, "unheard of words", True), (203, "la " * 4000, False), (3, rows[3][1], False), (204, "x" * 2_000_000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    df = written(df.repartition(3), "docs")
    got = sorted(tuple(r) for r in lm.score_documents(df, F.col("held"), heavy).collect())
    compare(got, sorted(slow(rows)), 0.04)
    assert lm.score_documents(df.where("false"), F.col("held")).count() == 0


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, binascii.crc32(str(r.doc_id).encode()) % 7 == 2) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op7_lm_scoring"](spark, folder).collect())
    compare(got, sorted(slow(rows)), 0.04)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


@pytest.mark.parametrize("others", [0, 40])
def test_split_contexts_are_exact_in_every_shard(spark, others):
    """A hot word with few successors, and held-out copies where others follow it: slices without a learnt bigram of it."""
    rows = [(i, "hot a hot b", False) for i in range(100)] + [(200, " ".join(f"hot new{i}" for i in range(30)), True), (201, "hot odd", True)]
    rows += [(300 + i, f"c{i} d{i} e{i}", False) for i in range(others)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3), "docs")
    got = sorted(tuple(r) for r in lm.score_documents(df, F.col("held"), 1).collect())
    compare(got, sorted(slow(rows)), 0.04)


def test_every_context_adds_up_to_one(spark):
    """p(w | v) out of scores alone: after an unheard of word u stands p(w), so score(u v w) holds p(w | v) and known parts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    learnt = [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(12)], k=rng.randint(1, 9))) for _ in range(120)]
    all_words = [*vocabulary, "u2"]
    asked = ["", "u", *all_words, *(f"u {w}" for w in all_words), *(f"u {v} {w}" for v in vocabulary for w in all_words)]
    rows = [(i, t, False) for i, t in enumerate(learnt)] + [(1000 + i, t, True) for i, t in enumerate(asked)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3), "docs")
    text = {1000 + i: t for i, t in enumerate(asked)}
    scores = {text[r.doc_id]: r for r in lm.score_documents(df, F.col("held")).collect() if r.doc_id >= 1000}
    score = lambda t: scores[t].score
    p_end = scores[""].base_score
    p = {w: scores[w].base_score - p_end for w in all_words}
    head = score("u") - p_end
    end = {w: score(f"u {w}") - head - p[w] for w in all_words}
    for v in vocabulary:
        total = 10 ** end[v] + sum(10 ** (score(f"u {v} {w}") - head - p[v] - end[w]) for w in all_words)
        assert total == pytest.approx(1, abs=0.03)
