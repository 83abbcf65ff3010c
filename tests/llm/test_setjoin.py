import random
import re

import pytest

from ledgerloom.llm import setjoin
from ledgerloom.llm.catalog import QUERIES


def slow_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_components(sets, percent):
    """sets: name -> set; which names are connected."""
    root = {n: n for n in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for name, tokens in sets.items():
        for t in tokens:
            holders.setdefault(t, []).append(name)
    for a in sets:
        common = {}
        for t in sets[a]:
            for b in holders[t]:
                if b < a:
                    common[b] = common.get(b, 0) + 1
        for b, n in common.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in sets}


def edited(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    """Unrelated texts, chains and stars of near copies at all similarities, passages shared by many, short texts."""
    vocabulary = [f"w{i}é" for i in range(300)]
    fresh = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = fresh(40)
    texts = [fresh(rng.choice([1, 2, 3, 5, 11, 12, 13, 60, 200])) for _ in range(80)]
    texts += [f"{passage} {fresh(30)}" for _ in range(40)]
    for length, edits in ((200, 1), (200, 2), (200, 3), (60, 1), (30, 1), (13, 1)):
        base = fresh(length)
        texts += [base, base.upper(), *(edited(base, edits, rng) for _ in range(30))]
        chain = [fresh(length)]
        for _ in range(8):
            chain.append(edited(chain[-1], 1, rng))
        texts += chain
    for n in range(9, 13):
        line = [f"s{n}x{i}" for i in range(n + 2)]
        texts += [" ".join(line), " ".join(line[:-1]), " ".join(line[1:])]
    texts += [None, "", " \t\n", "one", "One", "two words", "TWO  words\n", "x " * 500]
    return texts


@pytest.mark.parametrize("words,percent,small", [(3, 90, True), (3, 90, False), (5, 80, True)])
def test_against_brute_force(spark, monkeypatch, words, percent, small):
    if small:
        monkeypatch.setattr(setjoin, "GROUP_SETS", 4)
        monkeypatch.setattr(setjoin, "GROUP_TOKENS", 1000)
    rng = random.Random(4)
    texts = corpus(rng)
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, grp string, Token int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_sets(frame, words, percent).collect()}
    sets = {i: slow_set(t, words) for i, t in enumerate(texts)}
    want = slow_components(sets, percent)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_nulls_repeated_rows_and_keepers(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(None, text), (7, text), (7, text), (5, text.replace("word9 ", "other ")), (3, None), (3, None), (None, None), (None, "alone"), (9, "long " + " ".join(map(str, range(300_000))))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = setjoin.near_sets(frame, 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.keeper) for r in out) == sorted(
        [("None", 398, "5", False), ("7", 398, "5", False), ("7", 398, "5", False), ("5", 398, "5", True), ("3", 0, "3", True), ("3", 0, "3", True), ("None", 0, "None", True), ("None", 1, "None", True), ("9", 299_999, "9", True)]
    )
    kept = setjoin.drop_near_sets(frame)
    assert kept.columns == ["doc_id", "text"] and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "5", "9", "None", "None"]
    assert setjoin.near_sets(frame.where("false")).count() == 0


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    sets = {r.doc_id: slow_set(r.text, 3) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = slow_components(sets, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op13_jaccard_join"](spark, folder).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
