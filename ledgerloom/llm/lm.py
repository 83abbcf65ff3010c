"""LM scoring with an Elias-Fano n-gram trie.

A bigram model over words (A-Z lowered, split at the six ASCII white spaces) and one end token a text. Training counts
of all non-held-out texts give, with absolute discounting interpolated with add-one unigrams,

    p(w | v) = max(c(v w) - D, 0) / c(v) + D * n(v) / c(v) * p(w)  if v was seen,   p(w)  otherwise,

where n(v) is the number of different successors. Over the vocabulary and one word for all unheard of ones, every
context's probabilities add up to one (but for the rounding of the codes). Every text is scored whole.

Counting and scoring are one exchange. A task takes a buffer of texts, finds its different contexts and bigrams, and
sends each shard (chosen by the context's hash) the bigrams with their training counts. A shard sums the counts and
builds its part of the trie: level one holds the contexts' hashes, level two the successors of each context, made
monotone by the context's number, both as Elias-Fano sequences with Elias-Fano pointers between them, the discounted
parts of bigrams and the weights of contexts in one byte each, all in memory-mapped arrays. Each requested bigram is
looked up by successor search within its context's range; one byte goes back, and one for each context. The buffer's texts, as word numbers, meet the answers and are added up. So texts never
travel more than once, a bigram that a third of all rows share costs one entry a buffer, and no shard holds more than
its part of the vocabulary. Contexts with over 1 / (`HEAVY` * shards) of all tokens are split over the shards by their
successors; their training counts are a table of at most HEAVY * shards rows. Each bigram of such a context lies in one
shard, so n(v) is the sum of what the shards counted, and its weight is set when answers meet texts.

Words are 64-bit hashes; successors are told apart within a context by 40 bits. Null texts count as empty and have the
end token only; a null doc_id is learnt from. Repeated rows are counted and scored each. An empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.buffers import HELD_BYTES, buffers, pack, unpack
from ledgerloom.llm.eliasfano import EliasFano
from ledgerloom.llm.stages import written
from ledgerloom.llm.textbytes import LOWER, NOT_SPACE, mix, prefix_sums, runs, span_hashes, words

DISCOUNT = 0.75
HEAVY = 8
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_U = np.uint64
_SUCCESSOR_BITS = 40
_UNSEEN = 255  # the code of bigrams and contexts that were not seen; 0 to 254 are even steps of the logarithm


class Codes:
    """One-byte codes: steps reach from one to the least share that `tokens` training tokens allow, so none is cut off."""

    def __init__(self, tokens: int):
        self.seen_step = np.log10(max(tokens, 1) / (1 - DISCOUNT)) / (_UNSEEN - 1)
        self.weight_step = np.log10(max(tokens, 1) / DISCOUNT) / (_UNSEEN - 1)

    def seen(self, count: np.ndarray, total: np.ndarray) -> np.ndarray:
        return self._code((count - DISCOUNT) / total, self.seen_step)

    def weights(self, different: np.ndarray, total: np.ndarray) -> np.ndarray:
        return self._code(DISCOUNT * different / total, self.weight_step)

    @staticmethod
    def _code(share: np.ndarray, step: float) -> np.ndarray:
        return np.clip(np.rint(-np.log10(share) / step), 0, _UNSEEN - 1).astype(np.uint8)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """What codes stand for: discounted parts (0 of unseen bigrams) and weights (1 of unseen contexts)."""
        steps = np.arange(_UNSEEN)
        return np.append(10.0 ** (-self.seen_step * steps), 0.0), np.append(10.0 ** (-self.weight_step * steps), 1.0)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a buffer, START first and END last in every text, and each text's number of tokens besides START."""
    column = table.column("text").combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    hashes, counts = [], []
    for _, data, offsets in runs(column):
        lowered = LOWER[data]
        starts, ends, first = words(lowered, offsets, NOT_SPACE)
        n = np.diff(first)
        out = np.empty(len(starts) + 2 * len(n), np.uint64)
        heads = first[:-1] + 2 * np.arange(len(n))
        out[heads], out[heads + n + 1] = START, END
        inside = np.ones(len(out), bool)
        inside[heads] = inside[heads + n + 1] = False
        out[inside] = span_hashes(prefix_sums(lowered), starts, ends)
        hashes.append(out)
        counts.append(n + 1)
    return np.concatenate(hashes), np.concatenate(counts)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(hashes ^ _U(0xA5A5A5A5)) % _U(shards)).astype(np.int64)


def _successor(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes) >> _U(64 - _SUCCESSOR_BITS)


class _Buffer:
    """A buffer's words numbered by (shard, hash), its texts as numbers, and its different bigrams in order."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, shards: int):
        words_, first = np.unique(hashes, return_inverse=True)
        shard = _shard_of(words_, shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.edges = words_[order], np.searchsorted(shard[order], np.arange(shards + 1))
        self.ids, self.counts = place[first], counts

    @staticmethod
    def pairs(ids: np.ndarray, counts: np.ndarray):
        """Keys (context number << 32 | successor number) of all tokens, and the text of each."""
        row = np.repeat(np.arange(len(counts)), counts)
        follows = np.ones(len(ids), bool)
        follows[np.cumsum(counts + 1) - counts - 1] = False
        at = np.flatnonzero(follows)
        return ids[at - 1] << 32 | ids[at], row


def _dealt(keys: np.ndarray, edges: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each bigram and the order that puts the bigrams of one shard together."""
    context, successor = keys >> 32, keys & 0xFFFFFFFF
    decides = np.where(np.isin(context, heavy), successor, context)
    shard = np.searchsorted(edges, decides, "right") - 1
    return shard, np.argsort(shard, kind="stable")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, learnt, all: each buffer's words with their training count and their count in all texts."""
    for table in buffers(batches):
        hashes, counts = _tokens(table)
        learn = np.repeat(~table.column("held_out").to_numpy(), counts + 1)
        values, where = np.unique(hashes, return_inverse=True)
        learnt = np.bincount(where, weights=learn, minlength=len(values)).astype(np.int64)
        for at in range(0, len(values), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(values[part].view(np.int64)), pa.array(learnt[part]), pa.array(np.bincount(where, minlength=len(values))[part])], ["word", "learnt", "all"])


_REQUEST = "buffer bigint, shard int, contexts binary, sizes binary, successors binary, counts binary"


def _requests(shards: int, heavy_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buffers(batches):
            name = table.column("row")[0].as_py()
            hashes, counts = _tokens(table)
            buffer = _Buffer(hashes, counts, shards)
            heavy = np.flatnonzero(np.isin(buffer.words, heavy_words.value))
            keys, row = buffer.pairs(buffer.ids, counts)
            learn = ~table.column("held_out").to_numpy()[row]
            keys, where = np.unique(keys, return_inverse=True)
            learnt = np.bincount(where, weights=learn, minlength=len(keys)).astype(np.uint64)
            shard, order = _dealt(keys, buffer.edges, heavy)
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                part = order[edges[s] : edges[s + 1]]
                context = keys[part] >> 32
                heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                blobs = (buffer.words[context[heads]], np.diff(np.append(heads, len(part))), _successor(buffer.words[keys[part] & 0xFFFFFFFF]), learnt[part])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([s], pa.int32()), *(pa.array([pack(b)], pa.binary()) for b in blobs)], ["buffer", "shard", "contexts", "sizes", "successors", "counts"])

    return run


class Trie:
    """Two levels in memory-mapped arrays; the file is unlinked as soon as it is mapped, so nothing is left behind."""

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, seen: np.ndarray, weights: np.ndarray):
        owner = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(pointers))
        parts = [*EliasFano.parts(contexts), *EliasFano.parts(pointers.astype(np.uint64)), *EliasFano.parts(owner << _U(_SUCCESSOR_BITS) | successors), seen, weights]
        places, size = [], 0
        for part in parts:
            size = -(-size // 8) * 8
            places.append(size)
            size += part.nbytes
        handle, path = tempfile.mkstemp(prefix="trie-")
        try:
            with os.fdopen(handle, "r+b") as file:
                file.truncate(max(size, 1))
                for place, part in zip(places, parts):
                    file.seek(place)
                    file.write(part.tobytes())
                file.flush()
                mapped = np.memmap(file, np.uint8, "r")
        finally:
            os.unlink(path)
        levels = [np.ndarray(p.shape, p.dtype, mapped, place) for p, place in zip(parts, places)]
        self.contexts, self.pointers, self.successors = (EliasFano(*levels[i : i + 4]) for i in (0, 4, 8))
        self.seen, self.weights = levels[12:]

    def context(self, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.contexts.successor(words_)

    def codes(self, place: np.ndarray, known: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The code of each bigram, given its context's number (where known) and successor."""
        out = np.full(len(place), _UNSEEN, np.uint8)
        at = np.flatnonzero(known)
        if len(at):
            place = place[at]
            index, exact = self.successors.successor(place.astype(np.uint64) << _U(_SUCCESSOR_BITS) | successors[at])
            inside = exact & (index < self.pointers.get(place + 1).astype(np.int64))
            out[at] = np.where(inside, self.seen[np.minimum(index, max(len(self.seen) - 1, 0))], _UNSEEN)
        return out


_SPREAD = pa.list_(pa.struct([("word", pa.int64()), ("successors", pa.int64())]))
_ANSWER = "buffer bigint, shard int, codes binary, times binary, weights binary, spread array<struct<word:bigint,successors:bigint>>"


def _answers(book: Codes, heavy_words, heavy_counts):
    """Codes of the requested bigrams, counts and weights of the contexts; a shard's first row has its successors of split contexts.

    Counts and weights of split contexts are those of a slice here; `_score` puts the whole ones in their place.
    """

    def solve(name: int, shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        contexts = [unpack(r[1]) for r in rows]
        sizes = [unpack(r[2]).astype(np.int64) for r in rows]
        context = np.concatenate([np.repeat(c, n) for c, n in zip(contexts, sizes)])
        successor = np.concatenate([unpack(r[3]) for r in rows])
        count = np.concatenate([unpack(r[4]) for r in rows]).astype(np.int64)
        order = np.lexsort((successor, context))
        context, successor, count = context[order], successor[order], count[order]
        fresh = np.append(True, (context[1:] != context[:-1]) | (successor[1:] != successor[:-1]))
        heads = np.flatnonzero(fresh)
        pair = np.cumsum(fresh) - 1
        context, successor, count = context[heads], successor[heads], np.add.reduceat(count, heads)
        kept = count > 0
        level, pointer = np.unique(context[kept], return_index=True)
        pointers = np.append(pointer, kept.sum()).astype(np.int64)
        seen_count, different = count[kept], np.diff(pointers).astype(np.float64)
        total = np.add.reduceat(seen_count, pointers[:-1]).astype(np.float64) if len(level) else np.zeros(0)
        spread = []
        if len(heavy_words.value) and len(level):
            spot = np.minimum(np.searchsorted(heavy_words.value, level), len(heavy_words.value) - 1)
            heavy = heavy_words.value[spot] == level
            total = np.where(heavy, heavy_counts.value[spot], total)
            spread = [{"word": w, "successors": int(n)} for w, n in zip(level[heavy].view(np.int64).tolist(), different[heavy].tolist())]
        owner = np.repeat(np.arange(len(level)), np.diff(pointers))
        trie = Trie(level, pointers, successor[kept], book.seen(seen_count, total[owner]), book.weights(different, total))
        place, known = trie.context(context)
        code = np.empty(len(order), np.uint8)
        code[order] = trie.codes(place, known, successor)[pair]
        at = 0
        for (buffer, *_), asked, n in zip(rows, contexts, sizes):
            place, known = trie.context(asked)
            place = np.minimum(place, max(len(total) - 1, 0))
            times = np.where(known, total[place] if len(total) else 0, 0).astype(np.uint64)
            weights = np.where(known, trie.weights[place] if len(total) else 0, _UNSEEN).astype(np.uint8)
            more = int(n.sum())
            blobs = (pa.array([pack(b)], pa.binary()) for b in (code[at : at + more], times, weights))
            yield pa.RecordBatch.from_arrays([pa.array([buffer]), pa.array([shard], pa.int32()), *blobs, pa.array([None if at else spread], _SPREAD)], ["buffer", "shard", "codes", "times", "weights", "spread"])
            at += more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard, held = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for buffer, s, *blobs in zip(*(batch.column(c).to_pylist() for c in ("buffer", "shard", "contexts", "sizes", "successors", "counts"))):
                if s != shard and held:
                    yield from solve(name, shard, held)
                    held = []
                shard = s
                held.append((buffer, *blobs))
        if held:
            yield from solve(name, shard, held)

    return run


_PART = "buffer bigint, shard int, a binary, b binary, c binary"


def _texts(shards: int, heavy_words):
    """Each buffer as word numbers, with what is needed to read the answers: shard -1 (numbers) and -2 (documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buffers(batches):
            name = table.column("row")[0].as_py()
            hashes, counts = _tokens(table)
            buffer = _Buffer(hashes, counts, shards)
            heavy = np.flatnonzero(np.isin(buffer.words, heavy_words.value))
            last = np.searchsorted(buffer.words[buffer.edges[e := _shard_of(np.array([END]), shards)[0]] : buffer.edges[e + 1]], END) + buffer.edges[e]
            place = np.searchsorted(heavy_words.value, buffer.words[heavy])
            ids = table.select(["doc_id", "held_out"]).combine_chunks().to_batches()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids[0].schema) as stream:
                stream.write_batch(ids[0])
            rows = [(-2, pack(buffer.edges), pack(heavy), pack(np.append([last, len(buffer.words)], place))), (-1, pack(buffer.ids), pack(counts), sink.getvalue().to_pybytes())]
            for s, *blobs in rows:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([s], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], ["buffer", "shard", "a", "b", "c"])

    return run


def _score(book: Codes, tokens: int, vocabulary: int, ends: int, heavy_counts, heavy_weights):
    seen_share, weight_share = book.shares()

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        parts = {r[0]: r[1:] for r in rows}
        edges, heavy, (last, n_words, *place) = (unpack(b).astype(np.int64) for b in parts[-2])
        ids, counts = (unpack(b).astype(np.int64) for b in parts[-1][:2])
        docs = pa.ipc.open_stream(parts[-1][2]).read_all()
        keys, row = _Buffer.pairs(ids, counts)
        different, where = np.unique(keys, return_inverse=True)
        shard, order = _dealt(different, edges, heavy)
        code = np.empty(len(different), np.uint8)
        code[order] = np.concatenate([unpack(parts[s][0]) for s in sorted(k for k in parts if k >= 0)])
        times, weight = np.zeros(n_words, np.int64), np.full(n_words, _UNSEEN, np.uint8)
        at = 0
        for s in sorted(k for k in parts if k >= 0):
            context = different[order[at : at + int.from_bytes(parts[s][0][:8], "little")]] >> 32
            heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            times[context[heads]], weight[context[heads]] = unpack(parts[s][1]), unpack(parts[s][2])
            at += len(context)
        times[last] = ends
        if len(heavy):
            times[heavy], weight[heavy] = heavy_counts.value[place], heavy_weights.value[place]
        unigram = np.log10(times + 1.0)
        token = keys & 0xFFFFFFFF
        base = np.bincount(row, weights=unigram[token], minlength=len(counts)) - counts * np.log10(tokens + vocabulary + 1.0)
        context, token_of = different >> 32, different & 0xFFFFFFFF
        model = np.log10(seen_share[code] + weight_share[weight[context]] * ((times[token_of] + 1.0) / (tokens + vocabulary + 1.0)))[where]
        known = np.bincount(row, weights=times[token] > 0, minlength=len(counts)).astype(np.int64)
        score = np.bincount(row, weights=model, minlength=len(counts))
        columns = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), *(pa.array(x) for x in (counts, known, np.full(len(counts), tokens), base, score))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else c.chunk(0) for c in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, held = None, []
        for batch in batches:
            for name, *rest in zip(*(batch.column(c).to_pylist() for c in ("buffer", "shard", "a", "b", "c"))):
                if name != buffer and held:
                    yield solve(held)
                    held = []
                buffer = name
                held.append(tuple(rest))
        if held:
            yield solve(held)

    return run


def score_documents(documents: DataFrame, held_out: Column, heavy: int = HEAVY, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score of every document.

    Learns from the documents where `held_out` is not true. `heavy` = 0 splits no context.
    """
    spark = documents.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    start, end = (int(x.view(np.int64)) for x in (START, END))
    counted = docs.select("held_out", "text").mapInArrow(_counts, "word bigint, learnt bigint, all bigint")
    unigrams = written(counted.groupBy("word").agg(F.sum("learnt").alias("learnt"), F.sum("all").alias("all")), "unigrams")
    real = F.col("word") != start
    sums = unigrams.agg(
        F.sum(F.when(real, F.col("learnt"))).alias("tokens"), F.sum((real & (F.col("learnt") > 0)).cast("long")).alias("vocabulary"),
        F.sum(F.when(F.col("word") == end, F.col("learnt"))).alias("ends"), F.sum("all").alias("all"),
    ).first()
    limit = (sums["all"] or 0) / max(heavy * shards, 1)
    # At most heavy * shards words can each have more than 1 / (heavy * shards) of all tokens.
    split = unigrams.where((F.col("all") > limit) & (F.col("word") != end)).select("word", "learnt").collect() if heavy else []
    split = sorted((np.int64(r.word).view(np.uint64), r.learnt) for r in split)
    heavy_words = spark.sparkContext.broadcast(np.array([w for w, _ in split], np.uint64))
    heavy_counts = spark.sparkContext.broadcast(np.array([n for _, n in split], np.float64))
    book = Codes(sums["tokens"] or 0)
    requests = docs.select("row", "held_out", "text").mapInArrow(_requests(shards, heavy_words), _REQUEST)
    dealt = requests.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "buffer")
    answers = written(dealt.mapInArrow(_answers(book, heavy_words, heavy_counts), _ANSWER), "answers")
    spread = {}
    if split:
        # At most one row a split context.
        summed = answers.select(F.explode("spread").alias("s")).groupBy("s.word").agg(F.sum("s.successors").alias("successors"))
        spread = {np.int64(r.word).view(np.uint64): r.successors for r in summed.collect()}
    different = np.array([spread.get(w, 0) for w, _ in split], np.float64)
    learnt = heavy_counts.value > 0
    weights = np.full(len(split), _UNSEEN, np.uint8)
    weights[learnt] = book.weights(different[learnt], heavy_counts.value[learnt])
    heavy_weights = spark.sparkContext.broadcast(weights)
    texts = docs.mapInArrow(_texts(shards, heavy_words), _PART)
    both = texts.unionByName(answers.select("buffer", "shard", F.col("codes").alias("a"), F.col("times").alias("b"), F.col("weights").alias("c")))
    result = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return both.repartition(shards, "buffer").sortWithinPartitions("buffer", "shard").mapInArrow(_score(book, sums["tokens"] or 0, sums["vocabulary"] or 0, sums["ends"] or 0, heavy_counts, heavy_weights), result)
