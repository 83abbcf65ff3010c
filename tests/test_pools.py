"""Section-aware matching against a plain evaluation of every pair."""

import math
import random
from collections import Counter

from ledgerloom.operators import pools as pl
from ledgerloom.plans import jobs


def grams(text):
    out = Counter()
    for word in text.lower().split():
        padded = f" {word} "
        for n in (2, 3, 4):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def slow_scores(text, vector, rows):
    """rows: (position, description, vector) to position -> score, tf-idf fitted on the rows and the text."""
    docs = [grams(text), *(grams(d) for _, d, _ in rows)]
    df = Counter(g for doc in docs for g in doc)
    weigh = lambda doc: {g: n * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in doc.items()}
    vectors = [weigh(d) for d in docs]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    lexical = [sum(x * v.get(g, 0) for g, x in vectors[0].items()) / ((norm(vectors[0]) * norm(v)) or 1) for v in vectors[1:]]
    top = max(lexical)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if a and b else 0.0
    return {p: 0.6 * cos(vector, v) + 0.4 * (x / top if top > 0 else 0) for (p, _, v), x in zip(rows, lexical)}


def test_best_in_pool_against_all_pairs(spark):
    rng = random.Random(1)
    words = ["monthly", "setup", "fee", "card", "loan", "a", "é", "report", "wire", "alerts"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 5)))
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    rows = [(i, text(), vector() if i % 9 else None) for i in range(60)]
    rows += [(60 + i, rows[i][1], rows[i][2]) for i in range(10)] + [(70, "", vector())]
    pools = {"p": [r for r in rows if r[0] % 2], "q": rows, "r": rows[:1]}
    items = [(p, text() + f" x{i}", vector() if i % 7 else None) for i, p in enumerate(["p", "q", "r"] * 12)] + [("p", "zzz", vector())]
    frames = (
        spark.createDataFrame(items, "pool string, text string, vector array<double>"),
        spark.createDataFrame([(p, r[0]) for p, rs in pools.items() for r in rs], "pool string, position long"),
        spark.createDataFrame(rows, "position long, description string, vector array<double>"),
    )
    for block in (5, 512):
        got = {(r.pool, r.text): (r.position, r.score) for r in pl.best_in_pool(*frames, block=block).collect()}
        assert len(got) == len(items)
        for pool, t, v in items:
            scores = slow_scores(t, v, pools[pool])
            best = min(scores, key=lambda p: (-round(scores[p], 9), p))
            assert got[pool, t][0] == best and abs(got[pool, t][1] - scores[best]) < 1e-9


def test_sources_of_section_matches(spark):
    items = spark.createDataFrame(
        [("1", "Card fee", "CARDS", "", "$5", None), ("2", "Card fee", "Cards", "m1", "$5", True), ("3", "Wire", None, "zz", None, None), ("4", "card unchecked", "Cards", "", "1", False),
         ("5", "Loan report", "nowhere", "", "TBD", None), ("6", "  ", "Cards", "", "1", None), ("7", "Odd thing", "Cards", "", "1", None), ("8", "Other thing", "Cards", "", "1", None),
         ("9", "Loan gadget", None, "m2", "1", None)],
        "item_id string, item string, section_header string, stated_code string, price string, checkbox boolean")
    rows = [(1, "M1", "Card fee", "Cards"), (2, "M2", "Card setup", "Cards"), (3, "M3", "Loan report", "Loans"), (4, "M4", "Wire transfer", "Wires")]
    dictionary = spark.createDataFrame(rows, "position long, code string, description string, section string")
    section_map = spark.createDataFrame([("cards", "Cards")], "raw string, section string")
    unit = {"Card fee": [1.0, 0.0], "Loan report": [0.0, 1.0], "Card setup": [0.8, 0.6], "Wire transfer": [-1.0, 0.0]}
    vectors = spark.createDataFrame(list(unit.items()), "text string, vector array<double>")
    keywords = spark.createDataFrame([("gadget",)], "keyword string")
    ranked = spark.createDataFrame([("7", "pool", "M2", "Card setup", 65), ("7", "full", "M4", "Wire transfer", 90), ("8", "pool", "M2", "Card setup", 80), ("8", "full", "M4", "Wire transfer", 99)],
                                   "item_id string, scope string, code string, description string, confidence int")
    out = {r.item_id: (r.section, r.code, r.source, r.confidence) for r in jobs.match_items_by_section(items, section_map, dictionary, vectors, vectors, keywords, ranked).collect()}
    assert out == {
        "1": ("Cards", "M1", "Hybrid (auto)", 100), "2": ("Cards", "M1", "Contract+Dict (section)", 100), "3": (None, "zz", "Contract-only (unvalidated)", 90),
        "5": ("nowhere", "M3", "Hybrid (auto) - full", 100), "7": ("Cards", "M4", "AI - full (fallback)", 90), "8": ("Cards", "M2", "AI", 80),
        "9": (None, "M2", "Contract+Dict (section)", 100),
    }
