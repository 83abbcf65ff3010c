"""Keyword hits and escalation wording against brute force, on pages that are folded only where a term can be."""

import re
import unicodedata

from ledgerloom.functions.unicode import COMPAT
from ledgerloom.operators.clauses import escalation_snippets, keyword_hits

FAMILIES = {"a": (("cpi", "index"), ("price of living",), 2), "b": (("late",), ("of the",), 1)}
TEXTS = [
    "The C.P.I. rises, (index) too", "ＣＰＩ and   cpı", "price of -- living price of  living.", "price of\nliving", "cpi", "cpindex latest",
    "indexed by subindex", "́cpí late", "  leading late ", "of the of the", "", None, "´cpi", "indﬁ Ⅰndex i-n-d-e-x", "of the- late",
]


def norm(word):
    return re.sub("[^A-Za-z0-9]", "", unicodedata.normalize("NFKC", word)).lower()


def brute(text):
    words = [norm(w) for w in re.split(r"\s+", text or "") if w]
    for family, (terms, phrases, _) in FAMILIES.items():
        for i in range(len(words)):
            if any(words[i:i + len(x)] == x for x in ([norm(w) for w in t.split()] for t in (*terms, *phrases))):
                yield family, i


def pages(spark):
    return spark.createDataFrame([("c", f"{i}.pdf", 1, t) for i, t in enumerate(TEXTS)], "client string, filename string, page int, text string")


def test_keyword_hits_equal_brute_force(spark):
    got = {(int(r.filename[:-4]), r.family, r.at) for r in keyword_hits(pages(spark), FAMILIES).collect()}
    assert got == {(i, *x) for i, t in enumerate(TEXTS) for x in brute(t)}
    assert keyword_hits(pages(spark), FAMILIES).count() == len(got)


def test_escalation_reads_pages_for_hits_once(spark):
    out = escalation_snippets(pages(spark), term="late", opening="price of", closings=("living",), fallback="of living", window=1)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1
    assert {(r.filename, r.source) for r in out.collect()} == {
        ("7.pdf", "keyword"), ("8.pdf", "keyword"), ("14.pdf", "keyword"), ("2.pdf", "fallback"), ("3.pdf", "fallback")}


def test_ascii_never_reaches_the_ranges():
    assert COMPAT.startswith(r"(?=[^\x00-\x7f])[")
