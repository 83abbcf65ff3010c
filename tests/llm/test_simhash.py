import random

import xxhash

from ledgerloom.llm.catalog import QUERIES
from ledgerloom.llm.simhash import components, drop_near_copies, links, near_groups


def slow_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes):
    """nodes: id -> fingerprint."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark):
    random.seed(3)
    vocabulary = [f"w{i}é" for i in range(50)]
    rows = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 2, 3, 30, 300])))) for i in range(60)]
    rows += [(100 + i, t.replace("w7é", "W8É", 1)) for i, t in rows[:40]]
    rows += [(200, None), (201, " \n\t"), (202, "One  two"), (203, "one two"), (204, "x " * 3000)]
    got = {r.doc_id: (r.print & (1 << 64) - 1, r.component_id) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: slow_print(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == prints
    assert {i: g[1] for i, g in got.items()} == slow_components(prints)


def test_crowded_signatures_lose_no_link(spark):
    random.seed(5)
    base = random.getrandbits(64)
    spots = random.sample(range(64), 14)
    prints = set()
    while len(prints) < 300:
        prints.add(base ^ sum(1 << s for s in random.sample(spots, random.randint(0, 9))))
    prints |= {random.getrandbits(64) for _ in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long").repartition(3)
    want = slow_components({p: p & (1 << 64) - 1 for p in signed})
    for limit in (128, 2048):
        roots = {r.node: r.root for r in components(links(frame, limit)).collect()}
        got = {p: roots.get(p, p) for p in signed}
        classes = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
        assert classes(got) == classes(want)


def test_one_of_each_component_stays(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text, 1), (3, text.upper(), 2), (9, text.replace("word77 ", "other "), 3), (None, "", 4), (7, None, 5), (7, None, 5), (11, "some else text", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    out = drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 7, 11]
    assert drop_near_copies(df.where("false")).count() == 0


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: slow_print(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = slow_components(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_near_dedup"](spark, folder).collect()}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in docs.items()}
