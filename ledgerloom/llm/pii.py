"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Four kinds of spans are found by pattern (leftmost, not overlapping within a kind) and checked: e-mail and IP addresses,
card numbers (Luhn) and phone numbers. Their values are the protected entities. The corpus then tells how much the terms
of its texts reveal of an entity: with counts over different texts,

    PMI(entity; term) = log2(P(entity, term) / (P(entity) P(term))),    IC(entity) = -log2 P(entity),

and a term whose PMI reaches `DISCLOSURE` of the entity's information content gives it away: whoever reads the term can
tell the entity. Such terms are spans of kind `term` wherever they stand in a text that holds that entity. `sanitise` generalises them
to their shape and removes the pattern spans behind a label.

Texts, entities, terms and pairs are all counted in different texts, so that copies of one text count once, and at least
`SUPPORT` of them are needed: a chance neighbour is no evidence. Pairs are those of whole texts, for entities that have
the support. Term frequencies come from one pass over all words, added up in each task before the shuffle. Texts that
stand once are counted where they are; only those whose hash falls into a marked slot, of `SLOTS` that texts with copies
mark, go through a shuffle that tells the one to count, each task sending one of its copies. Slots that others share
cost a shuffle of more texts, never a wrong count.

Null texts count as empty; an empty text has no spans. Repeated rows are handled each; they add no evidence. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.stages import written
from ledgerloom.llm.textbytes import LOWER, WORD, prefix_sums, runs, span_hashes, words

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
DISCLOSURE = 0.8
SLOTS = 1 << 26  # the table of marked slots has at most SLOTS / 64 rows of two longs

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches of the next two end with the last of their digits, so a match never starts inside a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.ASCII)
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as a local part reaches: linear, and the same spans as the pattern's."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    spans = [(0, *s) for s in _emails(text)]
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    spans += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
    if "+" in text:
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return spans


def _outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of the words (of text in lower case) that no span touches, without numbers."""
    covered = sorted((s, e) for _, s, e in spans)
    out, at, reach = [], 0, 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][0] < b:
            reach = max(reach, covered[at][1])
            at += 1
        if reach <= a and any(not c.isdigit() for c in text[a:b]):
            out.append((a, b))
    return out


def term_hashes(terms: list[str]) -> list[int]:
    data = np.frombuffer("".join(terms).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in terms])
    return span_hashes(prefix_sums(data), np.append(0, ends[:-1]), ends).view(np.int64).tolist()


_SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32())])
_WORD = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = "row bigint, doc_id bigint, same bigint, spans array<struct<kind:tinyint,start:int,end:int>>, entities array<bigint>, words array<struct<term:bigint,start:int,end:int>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of every text; of texts that have any, the different entities and all words outside of spans."""
    for batch in batches:
        spans_out, entities_out, words_out = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            entities, places = set(), []
            if spans:
                lowered = text.translate(_ASCII_LOWER)
                for kind, start, end in spans:
                    value = lowered[start:end] if kind < 2 else _digits(lowered[start:end])
                    entities.add(xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63))
                if places := _outside(lowered, spans):
                    places = [(h, a, b) for h, (a, b) in zip(term_hashes([lowered[a:b] for a, b in places]), places)]
            spans_out.append(spans)
            entities_out.append(list(entities))
            words_out.append(places)
        columns = batch.column("same"), pa.array(spans_out, pa.list_(_SPAN)), pa.array(entities_out, pa.list_(pa.int64())), pa.array(words_out, pa.list_(_WORD))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], ["row", "doc_id", "same", "spans", "entities", "words"])


_HELD_TERMS = 1 << 20


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to (term, documents that have it), added up while a task holds at most about `_HELD_TERMS` of them."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        terms, docs = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(docs)], ["term", "docs"])

    for batch in batches:
        for _, data, offsets in runs(batch.column("text")):
            lowered = LOWER[data]
            starts, ends, first = words(lowered, offsets, WORD)
            hashes = span_hashes(prefix_sums(lowered), starts, ends)
            order = np.lexsort((hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(first))))
            sorted_, row = hashes[order], np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            once = np.append(True, (sorted_[1:] != sorted_[:-1]) | (row[1:] != row[:-1])) if len(sorted_) else np.zeros(0, bool)
            held.append(sorted_[once])
            size += int(once.sum())
            if size > 4 * _HELD_TERMS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows with the same hash the first one; rows come in order, so it is the only one that can be kept."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for same in batch.column("same").to_pylist():
            fresh.append(same not in seen)
            seen.add(same)
        yield batch.filter(pa.array(fresh, pa.bool_())).select(["row", "text"])


def _different_texts(docs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each text of `docs` once: those that stand in no marked slot, and the first of each group among the others."""
    slot = F.pmod("same", F.lit(SLOTS))
    word, bit = F.shiftright(slot, 6), (slot % 64).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    marked = groups.where(F.col("rows") > 1).groupBy(word.alias("word")).agg(F.bit_or(mark).alias("bits"))
    told = docs.withColumn("word", word).join(F.broadcast(written(marked, "marked")), "word", "left")
    copied = F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    one_a_task = told.where(copied).select("row", "same", "text").mapInArrow(_first_copies, "row bigint, text string")
    first = groups.select("first_row").hint("shuffle_hash")
    return told.where(~copied).select("text"), one_a_task.join(first, F.col("row") == F.col("first_row"), "left_semi").select("text")


def find_private(documents: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """row, doc_id, spans (pattern spans: kind, start, end), terms (start, end of disclosing terms) of every document."""
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("same", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = written(docs.mapInArrow(_find, _FOUND), "private")
    groups = written(found.groupBy("same").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("rows")), "groups")
    firsts = groups.select("first_row")
    texts = float(max(groups.count(), 1))
    first = F.col("row") == F.col("first_row")
    held = found.where(F.size("entities") > 0)
    named = held.select("row", F.explode("entities").alias("entity"))
    seen = named.join(firsts, first, "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("seen")).where((F.col("seen") >= support) & (F.col("seen") < texts))
    entities = written(seen, "entities")
    asked = named.join(entities, "entity").groupBy("row").agg(F.collect_list("entity").alias("asked"))
    whole = written(held.select("row", "words").join(asked, "row").join(firsts, first, "left").select("row", "asked", "words", F.col("first_row").isNotNull().alias("first")), "asked")
    evidence = whole.where("first").select(F.explode("asked").alias("entity"), "words")
    pairs = evidence.select("entity", F.explode(F.array_distinct("words.term")).alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    alone, copied = _different_texts(docs, groups)
    counted = [part.mapInArrow(_frequencies, "term bigint, docs bigint") for part in (alone, copied)]
    frequency = counted[0].unionByName(counted[1]).groupBy("term").agg(F.sum("docs").alias("docs"))
    content = F.log2(F.lit(texts) / F.col("seen"))
    pmi = F.log2(F.col("both") * F.lit(texts) / (F.col("seen") * F.col("docs")))
    revealing = pairs.join(entities, "entity").join(frequency, "term").where(pmi >= disclosure * content).select("entity", "term")
    places = whole.select("row", F.explode("asked").alias("entity"), "words").select("row", "entity", F.explode("words").alias("w")).select("row", "entity", "w.*")
    terms = places.join(revealing, ["entity", "term"]).select("row", F.struct("start", "end").alias("t")).groupBy("row").agg(F.array_sort(F.collect_set("t")).alias("terms"))
    return found.select("row", "doc_id", "spans").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")))


def count_of(kind: str):
    """Column for `find_private`: the pattern spans of one kind."""
    number = KINDS.index(kind)
    return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")


def span_texts(kinds=KINDS):
    """Columns for `find_private`: the pattern spans, and all spans, as kind:start:end joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    base = F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"].cast("int") + 1), s["start"].cast("string"), s["end"].cast("string")))
    more = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    return F.array_join(base, ","), F.array_join(F.concat(base, more), ",")


def sanitise(documents: DataFrame) -> DataFrame:
    """row, doc_id, text: pattern spans replaced by their kind, disclosing terms by a word for their shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "terms"))):
                cuts = sorted([(s["start"], s["end"], f"[{KINDS[s['kind']]}]") for s in spans] + [(t["start"], t["end"], "[name]" if text[t["start"]].isupper() else "[term]") for t in terms])
                parts, done = [], 0
                for start, end, label in cuts:
                    if start >= done:
                        parts += [text[done:start], label]
                    done = max(done, end)
                out.append("".join([*parts, (text or "")[done:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(out, pa.string())], ["row", "doc_id", "text"])

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return numbered.join(find_private(documents), "row").mapInArrow(run, "row bigint, doc_id bigint, text string")
