import hashlib
import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import pii
from ledgerloom.llm.catalog import QUERIES

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), kind == 2 and 13 <= len(digits) <= 19 and luhn(digits), kind == 3 and 9 <= len(digits) <= 15)
            if good[kind]:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choices("aZ@@..-_é%+ (012345 ", k=rng.randint(0, 30)))
        assert pii.base_spans(text) == slow_spans(text), text
    for text in ("4337166598464399", "x 4337 1665-9846 4399, 1.2.3.4.5.6.7.8 256.1.1.1 +1 (988) 555-2485", "a@b.c_d@e.f@g.h", "7" * 300, "a" * 500 + "@", "1." * 200):
        assert pii.base_spans(text) == slow_spans(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("7" * 200_000) == pii.base_spans("a" * 200_000 + "@") == []
    assert len(pii.base_spans("1." * 40_000)) == 10_000


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(1)
    common = [f"w{i}x" for i in range(40)]
    fill = lambda k: " ".join(rng.choices(common, k=k))
    rows = [(i, fill(30)) for i in range(200)]
    rows += [(300 + i, f"{fill(20)} Zylphia {fill(2)} zz.top@mail.example.com {fill(20)}") for i in range(5)]
    rows += [(400 + i, "Onceonly near some@where.example.org and more") for i in range(30)]
    rows += [(500, None), (501, ""), (None, "x 8.8.8.8 y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_private(df).collect()}
    assert len(out) == len(rows)
    text = dict(rows)
    for i in range(300, 305):
        assert [text[i][t.start : t.end] for t in out[i].terms] == ["Zylphia"]
    assert not any(out[i].terms for i in out if i is None or not 300 <= i < 305)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[name]" in clean[300] and "[email]" in clean[300] and "zz.top" not in clean[300]
    assert clean[None] == "x [ip] y" and clean[500] == "" and clean[0] == text[0]
    assert pii.find_private(df.where("false")).count() == 0


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op6_pii"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        spans = slow_spans(docs[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]


def test_disclosing_terms_in_copies_and_far_away(spark):
    rng = random.Random(2)
    fill = lambda k: " ".join(rng.choices([f"w{i}x" for i in range(40)], k=k))
    texts = [f"w1x Quillon, {fill(30)} far@mail.example.com {fill(60)} quillon {fill(5)}" for _ in range(3)]
    rows = [(i, fill(30)) for i in range(200)] + [(1000 + i, texts[i % 3]) for i in range(180)]
    out = {r.doc_id: r for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert [text[t.start : t.end] for t in out[i].terms] == (["Quillon", "quillon"] if i >= 1000 else [])


def slow_terms(texts):
    """text -> places of the terms that give an entity of that text away, by the definition, over the different texts."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, seen, both, docs = {}, Counter(), Counter(), Counter()
    for text in {t or "" for t in texts}:
        lowered, spans = text.translate(ascii_lower), slow_spans(text)
        entities = {(k, lowered[a:b] if k < 2 else re.sub("[^0-9]", "", lowered[a:b])) for k, a, b in spans}
        free = [m for m in word.finditer(lowered) if not m.group().isdigit() and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        held[text] = entities, free
        docs.update(set(word.findall(lowered)))
        seen.update(entities)
        both.update((e, t) for e in entities for t in {m.group() for m in free})
    n = len(held)
    tells = {
        (e, t) for (e, t), k in both.items()
        if k >= pii.SUPPORT and seen[e] < n and math.log2(k * n / (seen[e] * docs[t])) >= pii.DISCLOSURE * math.log2(n / seen[e])
    }
    return {text: [m.span() for m in free if any((e, m.group()) in tells for e in entities)] for text, (entities, free) in held.items()}


@pytest.mark.parametrize("slots", [pii.SLOTS, 64])
def test_terms_against_brute_force(spark, monkeypatch, slots):
    """With 64 slots, texts without copies share marked slots with copied ones."""
    monkeypatch.setattr(pii, "SLOTS", slots)
    rng = random.Random(6)
    names, common = [f"Name{i}" for i in range(30)], [f"c{i}x" for i in range(25)]
    texts = [None, "", "8.8.8.8", "Name1 8.8.8.8"]
    for i in range(260):
        who = rng.randrange(30)
        parts = rng.choices(common, k=rng.randint(1, 12)) + rng.choices(names, k=rng.randint(0, 2))
        if rng.random() < 0.6:
            parts += [f"n{who}@mail.example.org", names[who]] + [f"10.0.0.{who % 4}"] * (who % 3 == 0)
        rng.shuffle(parts)
        texts += [" ".join(parts)] * rng.choice([1, 1, 1, 2, 30])
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_terms(texts)
    got = {r.doc_id: [(t.start, t.end) for t in r.terms] for r in pii.find_private(df).collect()}
    assert got == {i: want[t or ""] for i, t in enumerate(texts)} and sum(map(bool, got.values())) > 50


def test_terms_of_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = slow_terms(texts.values())
    for r in pii.find_private(docs).collect():
        assert [(t.start, t.end) for t in r.terms] == want[texts[r.doc_id] or ""]
