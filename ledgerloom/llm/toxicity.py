"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's features are the byte n-grams of its words (one boundary on either side included) and its whole words, hashed
into `BUCKETS`. Their embeddings are averaged and a two-class linear softmax reads the mean. Embeddings and softmax are
trained together by Adam on a bounded sample of labelled rows: the `TRAIN_ROWS` rows of smallest hash of their doc_id
(whole texts: the bound is on rows, not on bytes). Misspellings that training never saw share n-grams, and so vectors,
with words that it did see. Each of `FOLDS` parts of the sample is scored by a fit on the others, in tasks of their own;
these out-of-fold scores choose the shrinkage and place the score 0.7 where F1 is best. The model is then fitted on all.

With two classes the softmax depends on one number per bucket, embedding times weight difference. Only these numbers
(1 MB, whatever the corpus) leave training, one task does the fitting, and scoring is one gather and sum over the bytes
of each whole text.

Null and empty texts have no features and get the score of the bias. Rows with a null label, or labels without a
document, are not used; a doc_id that repeats counts once for each row. Without labels of both classes every score is
the share of toxic rows (0 if there are none). Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.stages import written
from ledgerloom.llm.textbytes import LOWER, WORD, prefix_sums, runs, span_hashes, words

BUCKETS = 1 << 18
GRAMS = (4, 5, 6, 7, 8)
DIMENSION = 8
TRAIN_ROWS = 5000
EPOCHS = 50
FOLDS = 3
BATCH = 256
BLOCK = 1 << 14  # vectors that Adam changes at a time
RATE = 0.1
SHRINKAGE = (0.6, 2.5)  # the better one out of fold
MIN_ROWS = 10
THRESHOLD = 0.7


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) arrays of a run of texts, one pair for each n-gram length and one for whole words."""
    data = LOWER[data]
    upper = np.zeros(len(data), bool)
    if len(data):
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = np.where(upper, data + 0x20, data).astype(np.uint8)
    starts, ends, first = words(data, offsets, WORD)
    data = np.where(WORD[data], data, 0x20).astype(np.uint8)
    sums = prefix_sums(data)
    yield (span_hashes(sums, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 0x20, out=breaks[1:])
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in GRAMS:
        if len(data) < n:
            continue
        inside = breaks[n - 1 : len(data)] == breaks[1 : len(data) - n + 2]
        at = np.flatnonzero(inside & (row_of[: len(data) - n + 1] == row_of[n - 1 :]))
        yield (span_hashes(sums, at, at + n) & np.uint64(BUCKETS - 1)).astype(np.int64), row_of[at]


def _bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, bucket, share of the distinct features of each run of texts, in row order."""
    for first, data, offsets in runs(texts):
        found = list(features(data, offsets))
        key, count = np.unique(np.concatenate([row * BUCKETS + bucket for bucket, row in found]), return_counts=True)
        row = key // BUCKETS
        total = np.bincount(row, weights=count, minlength=len(offsets) - 1)
        yield (row + first).astype(np.int32), (key % BUCKETS).astype(np.int32), (count / total[row]).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _adam(bucket: np.ndarray, weight: np.ndarray, edges: np.ndarray, width: int, labels: np.ndarray, train: np.ndarray, shrinkage: float) -> tuple[np.ndarray, float]:
    """One number per bucket (embedding times softmax) and the bias, after EPOCHS over the rows of `train`."""
    rng = np.random.default_rng(0)
    table = np.ascontiguousarray(rng.normal(0, 0.1, (width, DIMENSION)).astype(np.float32).T)
    slope, bias = rng.normal(0, 1, DIMENSION).astype(np.float32), 0.0
    first, second = np.zeros_like(table), np.zeros_like(table)
    moments = [[np.zeros_like(slope), np.zeros_like(slope)], [0.0, 0.0]]
    positive = labels[train].mean()
    cost = np.where(labels == 1, min(0.5 / max(positive, 0.05), 10), min(0.5 / max(1 - positive, 0.05), 10))
    batch = min(BATCH, max(16, len(train) // 10))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(train)
        rate = RATE * (1 - epoch / EPOCHS)
        for low in range(0, len(order), batch):
            part = order[low : low + batch]
            sizes = edges[part + 1] - edges[part]
            spans = [slice(a, b) for a, b in zip(edges[part].tolist(), edges[part + 1].tolist())]
            buckets, weights = np.concatenate([bucket[s] for s in spans]), np.concatenate([weight[s] for s in spans])
            mean, some = np.zeros(len(part)), sizes > 0
            if some.any():
                mean[some] = np.add.reduceat(weights * (slope @ table)[buckets], (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
            error = (_sigmoid(mean + bias) - labels[part]) * cost[part] / len(part)
            pull = np.bincount(buckets, weights=weights * np.repeat(error.astype(np.float32), sizes), minlength=width).astype(np.float32)
            step += 1
            fresh, settled = 1 - 0.9**step, 1 - 0.999**step
            changes = []
            for pair, gradient in zip(moments, (table @ pull, error.sum())):
                pair[0] = 0.9 * pair[0] + 0.1 * gradient
                pair[1] = 0.999 * pair[1] + 0.001 * gradient * gradient
                changes.append(rate * (pair[0] / fresh) / (np.sqrt(pair[1] / settled) + 1e-8))
            for at in range(0, width, BLOCK):
                span = slice(at, at + BLOCK)
                _step(table[:, span], first[:, span], second[:, span], slope[:, None] * pull[span], rate / fresh, settled**-0.5, rate * shrinkage)
            slope, bias = slope - changes[0], bias - changes[1]
    return slope @ table, float(bias)


def _step(table: np.ndarray, first: np.ndarray, second: np.ndarray, gradient: np.ndarray, rate: float, scale: float, shrink: float) -> None:
    """Adam's step for a block of vectors (columns), in place, while it is in the processor's cache."""
    first *= 0.9
    first += 0.1 * gradient
    second *= 0.999
    np.multiply(gradient, gradient, out=gradient)
    gradient *= 0.001
    second += gradient
    spread = np.sqrt(second, out=gradient)
    spread *= scale
    spread += 1e-8
    np.divide(first, spread, out=spread)
    spread *= rate
    table -= spread
    # Vectors that little evidence holds up shrink to zero, else rare n-grams of single texts are learnt by heart.
    table *= np.maximum(0, 1 - shrink / np.maximum(np.sqrt(np.einsum("ij,ij->j", table, table)), 1e-9))


class _Sample:
    """The distinct features of the sample's texts that enough rows have, and the fits on parts of it."""

    def __init__(self, texts: pa.Array, labels: np.ndarray, counted: np.ndarray):
        bags, rows_with = [], np.zeros(BUCKETS, np.int64)
        for row, bucket, weight in _bags(texts):
            rows_with += np.bincount(bucket if counted.all() else bucket[counted[row]], minlength=BUCKETS)
            bags.append((row, bucket, weight))
        self.common = np.flatnonzero(rows_with >= min(MIN_ROWS, 1 + len(labels) // 100))
        place = np.full(BUCKETS, -1, np.int32)
        place[self.common] = np.arange(len(self.common))
        for i, (row, bucket, weight) in enumerate(bags):
            bucket = place[bucket]
            keep = bucket >= 0
            bags[i] = row[keep], bucket[keep], weight[keep]
        self.row, self.bucket, self.weight = (np.concatenate([bag[i] for bag in bags]) for i in range(3))
        self.edges, self.labels = np.searchsorted(self.row, np.arange(len(labels) + 1)), labels

    def fit(self, train: np.ndarray, shrinkage: float) -> tuple[np.ndarray, float, np.ndarray]:
        """Effects, bias, and the logits of all rows, learnt from the rows of `train`."""
        effect, bias = _adam(self.bucket, self.weight, self.edges, len(self.common), self.labels, train, shrinkage)
        return effect, bias, np.bincount(self.row, weights=self.weight * effect[self.bucket], minlength=len(self.labels)) + bias

    def model(self, effect: np.ndarray, bias: float, cut: float) -> np.ndarray:
        out = np.zeros(BUCKETS + 2, np.float32)
        out[self.common], out[BUCKETS], out[BUCKETS + 1] = effect, bias, cut
        return out


def _without(labels: np.ndarray) -> np.ndarray | None:
    """The model where one class is missing: every score is the share of toxic rows."""
    share = labels.mean() if len(labels) else 0.0
    model = np.zeros(BUCKETS + 2, np.float32)
    model[BUCKETS] = -40 if share == 0 else 40
    return model if share in (0.0, 1.0) else None


def fit(texts: pa.Array, labels: np.ndarray, held: np.ndarray) -> np.ndarray:
    """BUCKETS + 2 numbers: one per bucket, the bias, and the logit that is to score 0.7, with one part held back."""
    model = _without(labels)
    if model is not None:
        return model
    sample, train = _Sample(texts, labels, ~held), np.flatnonzero(~held)
    test = held if held.any() and 0 < labels[held].sum() < held.sum() else np.ones(len(labels), bool)
    best = -1.0
    for shrinkage in SHRINKAGE:
        effect, bias, logit = sample.fit(train, shrinkage)
        quality, cut = _best_cut(logit[test], labels[test])
        if quality > best:
            best, model = quality, sample.model(effect, bias, cut)
    return model


def fold_of(n: int) -> np.ndarray:
    return np.arange(n) % FOLDS


def trial(texts: pa.Array, labels: np.ndarray, fold: int, shrinkage: float) -> np.ndarray:
    """The logits that the other folds give the rows of `fold`."""
    mine = fold_of(len(labels)) == fold
    if _without(labels[~mine]) is not None:
        return np.zeros(int(mine.sum()))
    return _Sample(texts, labels, ~mine).fit(np.flatnonzero(~mine), shrinkage)[2][mine]


def fit_chosen(texts: pa.Array, labels: np.ndarray, logits: list[np.ndarray]) -> np.ndarray:
    """The model fitted on all rows. Shrinkage and cut are those that are best on the out-of-fold logits, given for each
    value of SHRINKAGE."""
    model = _without(labels)
    if model is not None:
        return model
    found = [(*_best_cut(x, labels), shrinkage) for x, shrinkage in zip(logits, SHRINKAGE)]
    _, cut, shrinkage = max(found, key=lambda f: f[0])
    every = np.ones(len(labels), bool)
    sample = _Sample(texts, labels, every)
    effect, bias, _ = sample.fit(np.flatnonzero(every), shrinkage)
    return sample.model(effect, bias, cut)


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The best F1 of any cut, and the mean of the logits whose F1, as cuts, is within a hundredth of it."""
    order = np.argsort(-logits)
    score = 2 * np.cumsum(labels[order]) / (np.arange(1, len(order) + 1) + labels.sum())
    return float(score.max()), float(logits[order][score >= score.max() - 0.01].mean())


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row: the model fitted on (doc_id, text, toxic), as bytes."""
    rank = F.xxhash64("doc_id")
    sample = labelled.where("toxic IS NOT NULL").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), rank.alias("rank")).orderBy("rank").limit(train_rows)

    sample = written(sample, "sample")

    def ordered(group: pd.DataFrame) -> tuple[pa.Array, np.ndarray]:
        group = group.sort_values(["rank", "doc_id", "text", "toxic"], kind="stable")
        return pa.array(group["text"], pa.string()), group["toxic"].to_numpy(np.float64)

    def tried(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        texts, labels = ordered(group)
        way, fold = divmod(key[0], FOLDS)
        logits = trial(texts, labels, fold, SHRINKAGE[way])
        return pd.DataFrame({"way": way, "place": np.flatnonzero(fold_of(len(labels)) == fold), "logit": logits})

    def chosen(group: pd.DataFrame, trials: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame({"model": []})
        texts, labels = ordered(group)
        trials = trials.sort_values(["way", "place"])
        model = fit_chosen(texts, labels, [trials["logit"][trials["way"] == way].to_numpy() for way in range(len(SHRINKAGE))])
        return pd.DataFrame({"model": [model.tobytes()]})

    every = F.explode(F.sequence(F.lit(0), F.lit(FOLDS * len(SHRINKAGE) - 1)))
    dealt = sample.withColumn("trial", every).repartition(FOLDS * len(SHRINKAGE), "trial")
    trials = written(dealt.groupBy("trial").applyInPandas(tried, "way int, place bigint, logit double"), "trials")
    one = F.lit(0).alias("all")
    return sample.groupBy(one).cogroup(trials.groupBy(one)).applyInPandas(chosen, "model binary")


def text_scores(model: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The probability of label 1 of every text; the cut of the model scores THRESHOLD."""
    effect, bias, cut = model[:BUCKETS], float(model[BUCKETS]), float(model[BUCKETS + 1])
    shift = bias - cut + np.log(THRESHOLD / (1 - THRESHOLD)) * (abs(bias) < 40)
    scores = np.empty(len(texts))
    for first, data, offsets in runs(texts):
        rows = len(offsets) - 1
        total, count = np.zeros(rows), np.zeros(rows)
        for bucket, row in features(data, offsets):
            total += np.bincount(row, weights=effect[bucket], minlength=rows)
            count += np.bincount(row, minlength=rows)
        scores[first : first + rows] = _sigmoid(total / np.maximum(count, 1) + shift)
    return scores


def _model(labelled: DataFrame) -> np.ndarray:
    """The fitted numbers, read on the driver (1 MB); without labelled rows a model that scores 0."""
    row = written(train(labelled), "toxicity").first()
    if row:
        return np.frombuffer(row["model"], np.float32)
    return fit(pa.array([], pa.string()), np.zeros(0), np.zeros(0, bool))


def _labelled(documents: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select("doc_id", "toxic").where("toxic IS NOT NULL").where(~held_out)
    # The sample is drawn before texts are fetched: at most TRAIN_ROWS labels are broadcast, no other text moves.
    return docs.join(F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "toxic").limit(TRAIN_ROWS)), "doc_id")


def score_held_out(documents: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score of every document; labels of rows where `held_out` is true are never learnt."""
    model = _model(_labelled(documents, labels, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(text_scores(model, batch.column("text")))], ["doc_id", "held_out", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double")


def drop_toxic(documents: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """`documents` that score below the threshold, all columns as they were."""
    model = _model(_labelled(documents, labels, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(text_scores(model, batch.column("text")) < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
