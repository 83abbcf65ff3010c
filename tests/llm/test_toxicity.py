import binascii
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity
from ledgerloom.llm.catalog import QUERIES


def corpus(n, seed):
    rng = random.Random(seed)
    clean = [a + b + c for a in ("th", "re", "on", "an", "ti") for b in ("", "in", "er", "st") for c in ("ed", "ing", "at", "ou")]
    rude = ["scoundrel", "nitwitted", "blockhead"]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.choice([20, 80, 300]))
        if i % 4 == 0:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        texts.append(" ".join(words))
        labels.append(float(i % 4 == 0))
    return texts, np.array(labels)


def score(model, texts):
    return toxicity.text_scores(model, pa.array(texts, pa.string()))


def test_learns_words_and_misspellings():
    texts, labels = corpus(400, 1)
    model = toxicity.fit(pa.array(texts), labels, np.arange(400) % 5 == 4)
    other, truth = corpus(200, 2)
    got = score(model, other)
    assert ((got >= 0.7) == (truth == 1)).mean() > 0.95
    spelled = [t.replace("scoundrel", "scoundrell").replace("blockhead", "blokhead").replace("nitwitted", "nitwited") for t in other]
    got = score(model, spelled)
    assert np.mean([a > b for a in got[truth == 1] for b in got[truth == 0]]) > 0.9


def test_edges():
    one = toxicity.fit(pa.array(["a", "b"]), np.zeros(2), np.zeros(2, bool))
    assert score(one, [None, "", "x" * 3_000_000]).max() < 1e-9
    assert len(toxicity.fit(pa.array([], pa.string()), np.zeros(0), np.zeros(0, bool))) == toxicity.BUCKETS + 2


def test_query_scores_every_row_and_learns_only_other_folds(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op1_toxicity"](spark, folder).collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good = [s for s, y in held if y]
    assert np.mean([g > s for g in good for s, y in held if not y]) > 0.8


def test_stage_keeps_columns(spark):
    texts, labels = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, None, 1), (7, "", 1)], "doc_id long, text string, row int")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(500, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.drop_toxic(docs, marks, F.lit(False))
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert None in left and len(left & {i for i, y in enumerate(labels) if y}) <= 5 and len(left) >= 295
    assert toxicity.drop_toxic(docs.where("false"), marks, F.lit(False)).count() == 0
