import random
import re

from ledgerloom.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(ASCII))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(ASCII))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((doc, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


def test_every_shared_window_is_found(spark):
    rng = random.Random(2)
    words = ["a", "B", "é", "x1", "dog", "Straße"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 6, 9, 10, 11, 30]))) for i in range(25)] + [(90, None), (91, "zz zz zz"), (91, "zz zz zz"), (92, "a " * 40)]
    docs = [(i, text(rng.choice([0, 3, 20, 60]))) for i in range(60)]
    docs += [(100 + i, f"{text(12)}{t or ''} {text(5)}") for i, (_, t) in enumerate(items)]
    docs += [(200, None), (None, "zz ZZ-zz"), (201, "a " * 5000), (201, "a " * 5000), (202, "q" * 3_000_000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(d, b).collect()), key=str)
    assert got == expected(docs, items)
    kept = drop_contaminated(d, b)
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(x[0]) for x in expected(docs, items) if not x[2])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, row int"), spark.createDataFrame([], "item_id long, text string")
    assert drop_contaminated(docs, items).columns == docs.columns
    assert [(r.n_words, r.n_hit) for r in contamination(docs, items).collect()] == [(2, 0)]
    assert contamination(docs.where("false"), items).count() == 0
