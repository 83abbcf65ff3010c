import random

import pytest

from ledgerloom.llm.catalog import QUERIES
from ledgerloom.llm.mixing import mix, sized, targets


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    left = total
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, sizes):
    want = slow_targets(sizes)
    taken, largest = {}, {}
    for source, size, source_size, target, t in rows:
        assert source_size == sizes[source] and target == pytest.approx(want[source], rel=1e-9, abs=1e-9)
        assert 0 <= t <= 3 * size
        taken[source] = taken.get(source, 0) + t
        largest[source] = max(largest.get(source, 0), size)
    for source in taken:
        assert abs(taken[source] - want[source]) <= 0.5 * largest[source] + 1e-3 * want[source] + 1e-6, source


@pytest.mark.parametrize("seed", range(2))
def test_targets_and_copies(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "é", "", None, "Z", "hot", "hot", "hot"]), rng.choice([0, 1, 5, 40, 900])) for i in range(400)] + [(900, "none", 0), (None, "a", 3), (901, "tiny", 1)]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)
    first = sorted(map(tuple, mix(df).collect()), key=str)
    check([(r[1], r[2], r[3], r[4], r[6]) for r in first], sizes)
    if seed == 0:
        assert first == sorted(map(tuple, mix(df.repartition(2)).collect()), key=str)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", " \t"), (3, "a", "x\u00a0y z")], "doc_id long, source string, text string")
    assert sorted(r.size for r in sized(df).collect()) == [0, 0, 2]
    assert mix(sized(df.where("false"))).count() == 0
    assert [r.taken for r in mix(sized(df.limit(1))).collect()] == [0]
    assert targets(sized(df)).count() == 2


def test_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()}
    rows = QUERIES["op4_mixing"](spark, folder).collect()
    sizes = {}
    for r in rows:
        sizes[docs[r.doc_id]] = sizes.get(docs[r.doc_id], 0) + r.size
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check([(docs[r.doc_id], r.size, r.source_size, r.target, r.taken) for r in rows], sizes)
