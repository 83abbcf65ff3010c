import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm.catalog import QUERIES
from ledgerloom.llm.stages import written
from ledgerloom.llm.suffixdedup import drop_repeats, longest_previous


def slow(rows, span=100):
    """(doc, bytes, removed, runs, digest) by a set of all strings seen so far."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - span + 1):
            s = data[p : p + span]
            if s in seen:
                gone[p : p + span] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(frame):
    return sorted(tuple(r)[:5] for r in frame.collect())


@pytest.mark.parametrize("crowded", [4096, 1])
def test_covered_bytes(spark, crowded):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé ñ\n", k=rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = [(i, text(rng.choice([0, 3, 40, 200]))) for i in range(40)]
    rows += [(100 + i, text(20) + rng.choice(shared) + text(rng.choice([0, 30]))) for i in range(40)]
    rows += [(200 + i, t.replace("a", "b", rng.choice([0, 1, 2]))) for i, t in rows[:40] if t]
    rows += [(50, "x" * 5000), (51, "ab" * 300 + "x" * 150), (52, "La " * 900), (53, None), (54, ""), (55, "x" * 99), (56, "y" * 100), (57, "y" * 100), (58, "a\x00" * 120), (59, "\x00" * 130)]
    rows += [(-3, shared[0]), (300, shared[0][:99]), (301, shared[1] + shared[1])]
    rng.shuffle(rows)
    df = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "docs")
    assert rows_of(drop_repeats(df, crowded=crowded)) == sorted(slow(rows))


def test_edges(spark):
    df = spark.createDataFrame([(None, "z" * 200, 1), (4, "z" * 150, 2)], "doc_id long, text string, row int")
    assert sorted((str(r.doc_id), r.n_removed, r.kept.decode()) for r in drop_repeats(df).collect()) == [("4", 149, "z"), ("None", 200, "")]
    assert drop_repeats(df.where("false")).count() == 0


def test_longest_previous_factors():
    rng = np.random.default_rng(2)
    strings, group, position = rng.integers(0, 2, (60, 6)).astype(np.uint8), rng.integers(0, 3, 60), rng.permutation(60)
    got = longest_previous(group, strings, position)
    for i in range(60):
        lengths = [next((k for k in range(6) if strings[i, k] != strings[j, k]), 6) for j in range(60) if group[j] == group[i] and position[j] < position[i]]
        assert got[i] == max(lengths, default=0)


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(QUERIES["op5_suffix_dedup"](spark, folder)) == sorted(slow(rows))
