import math

import numpy as np
import pytest

from ledgerloom.llm import whitening
from ledgerloom.llm.catalog import QUERIES


def slow(vectors, components=32):
    """vectors: lists of doubles. n, deviations, eigenvalues, components, whitened."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    y = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    order = order[values[order] > 1e-12 * values.max()]
    return n, deviation, values[order] / np.trace(cov), y @ axes[:, order] / np.sqrt(values[order])


def check(rows, ids, vectors):
    n, deviation, explained, white = slow(vectors)
    k = len(explained)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(ids) and len(rows) == len(ids) * k
    assert {r.n for r in rows} == {n}
    assert [got[i][1].deviation for i in ids] == deviation
    assert all(r.identity_error <= 1e-9 for r in rows) and len({r.identity_error for r in rows}) == 1
    matrix = np.array([[got[i][c + 1].whitened for c in range(k)] for i in ids])
    assert np.allclose([got[ids[0]][c + 1].explained for c in range(k)], explained, rtol=1e-9)
    signs = np.sign((matrix * white).sum(axis=0))
    assert np.abs(matrix - white * signs).max() < 1e-6


def run(spark, vectors, schema="vec_id long, embedding array<float>, Size int, n int"):
    from ledgerloom.llm import catalog

    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], schema)
    saved = catalog.table
    catalog.table = lambda *_: frame
    try:
        return QUERIES["op11_embedding_whitening"](spark, "").collect()
    finally:
        catalog.table = saved


def test_dropped_vectors_and_small_dimensions(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).astype(np.float32).tolist()) for i in range(60)]
    good += [(100 + i, good[3][1]) for i in range(30)]
    bad = [(200, None), (201, []), (202, [1.0] * 4), (203, [1.0] * 6), (204, [1.0, None, 1.0, 1.0, 1.0]), (205, [math.nan] + [1.0] * 4), (206, [math.inf] + [1.0] * 4)]
    check(run(spark, good + bad), [i for i, _ in good], [v for _, v in good])


def test_flat_table_empty_table_and_errors(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [] and run(spark, [(1, [])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(20)]
    check(run(spark, line), [i for i, _ in line], [v for _, v in line])
    null_id = run(spark, [(None, [1.0, 2.0]), (2, [3.0, 5.0])])
    assert {r.vec_id for r in null_id} == {None, 2}
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30, 2.0]), (2, [1.0, 2.0])])


@pytest.mark.parametrize("kind", ["flat", "steep", "tied", "poor", "far"])
def test_filtered_iteration_against_dense(kind):
    rng = np.random.default_rng(2)
    d, k = 120, 10
    values = {
        "flat": 1 + 0.2 * rng.random(d), "steep": 10.0 ** -np.arange(d, dtype=float), "tied": np.repeat([5.0, 3.0, 1.0, 0.5], d // 4),
        "poor": np.r_[np.arange(1, 7.0), np.zeros(d - 6)], "far": np.r_[1e8, 1 + 0.1 * rng.random(d - 1)],
    }[kind]
    axes = np.linalg.qr(rng.normal(size=(d, d)))[0]
    matrix = (axes * values) @ axes.T
    got, vectors, passes = whitening.leading(lambda q: matrix @ q, d, k)
    want = np.sort(values)[::-1][:k]
    want = want[want > 1e-12 * want[0]]
    assert passes < 150 and len(got) == len(want)
    assert np.abs(got - want).max() <= 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * got).max() <= 1e-11 * want[0]


def test_large_entries_are_exact(spark):
    vectors = [(i, [float((-1) ** i * (i + 1) * 2**10), float(i * i)]) for i in range(50)]
    check(run(spark, vectors), [i for i, _ in vectors], [v for _, v in vectors])


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    good = [(r.vec_id, list(r.embedding)) for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(QUERIES["op11_embedding_whitening"](spark, folder).collect(), [i for i, _ in good], [v for _, v in good])
