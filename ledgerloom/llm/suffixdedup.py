"""Repeated passages by longest-previous-factor arrays over a corpus cut at content-defined anchors.

A byte goes if a string of `SPAN` bytes that covers it also starts earlier (smaller doc_id, or earlier in the document).
Every such string contains the same anchor wherever it stands: the `GRAM`-byte gram of least hash in it (the last, if
equal). Consecutive strings with the same anchor form a block of at most 61 strings.

1. Blocks are dealt by anchor. A block whose whole content stands earlier is repeated as a whole; that settles almost
   all of what copies share, with two numbers a block and each different block once a buffer.
2. What is left are the first blocks of contents that share an anchor and differ around it: the rims of shared passages.
   Their bytes meet by anchor; their strings are sorted as suffixes, and the longest-previous-factor array, taken from
   the previous and next smaller positions in suffix order, says which of them stand earlier in another block.
3. Each buffer of texts meets its answers and drops the covered bytes.

Anchors with over `CROWDED` different contents are split: their strings are dealt one by one, by their own hash, each
once a buffer. So no group grows with the corpus but by the number of buffers that share one string. Texts travel twice,
compressed, for steps 2 and 3. Blocks are equal if two 64-bit hashes are (anchor and content); strings within a group
are compared byte by byte.

Null texts count as empty; texts shorter than SPAN lose nothing. Rows that repeat a doc_id are in the order of the start,
then of the table. A null doc_id comes last. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.buffers import buffers, pack, unpack
from ledgerloom.llm.stages import written
from ledgerloom.llm.textbytes import RUN_BYTES, mix, prefix_sums, runs, span_hashes

SPAN = 100
GRAM = 40
CROWDED = 4096
BUFFER_BYTES = 16 << 20
_CHUNK = 200_000
_U = np.uint64
_BIAS = _U(1 << 63)
ALONE, REPEATED, RIM, CROWD = range(4)


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For every `width` consecutive grams the place of the least, the last one if equal."""
    value, place, span = grams, np.arange(len(grams), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        later = value[step:] <= value[: len(value) - step]
        value, place = np.where(later, value[step:], value[: len(value) - step]), np.where(later, place[step:], place[: len(place) - step])
        span += step
    return place


class Blocks:
    """The blocks of a buffer of texts, in the order of the table: anchor and content hash, place, number of strings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.data, self.offsets, self.ids = data, offsets, ids
        found = []
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
        for first, part, edges in runs(texts):
            if len(part) < SPAN:
                continue
            sums = prefix_sums(part)
            at = np.arange(len(part) - GRAM + 1)
            grams = span_hashes(sums, at, at + GRAM)
            anchor = _anchors(grams, SPAN - GRAM + 1)
            row = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
            whole = row[: len(anchor)] == row[SPAN - 1 :]
            starts = whole.copy()
            starts[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
            ends = whole.copy()
            ends[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1])
            low, high = np.flatnonzero(starts), np.flatnonzero(ends)
            found.append((grams[anchor[low]], span_hashes(sums, low, high + SPAN), low + offsets[first], (high - low + 1).astype(np.int64)))
        empty = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.anchor, self.content, self.start, self.strings = (np.concatenate(x) for x in zip(empty, *found))
        self.row, self.at = self.place(self.start)
        # Blocks by anchor, content and order in the corpus; the first of each content stands for it.
        self.order = np.lexsort((self.row, self.at, self.ids[self.row], self.content, self.anchor))
        a, c = self.anchor[self.order], self.content[self.order]
        self.first = self.order[np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))] if len(a) else self.order

    def place(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and offset within its text of byte positions."""
        row = np.searchsorted(self.offsets, start, "right") - 1
        return row, start - self.offsets[row]

    def dealt(self, keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """The members of each shard, in order."""
        shard = (mix(keys) % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            yield s, order[edges[s] : edges[s + 1]]

    def codes(self, answers: dict[int, bytes], shards: int) -> np.ndarray:
        out = np.zeros(len(self.first), np.int64)
        for s, part in self.dealt(self.anchor[self.first], shards):
            out[part] = unpack(answers[s])
        return out

    def rims(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """key, start, strings of all that step 2 has to look at, and the starts of strings that repeat in the buffer."""
        rim, crowd = self.first[codes == RIM], self.first[codes == CROWD]
        n = self.strings[crowd]
        single = np.repeat(self.start[crowd] - np.cumsum(n) + n, n) + np.arange(n.sum())
        again = single[:0]
        keys = np.zeros(0, np.uint64)
        if len(single):
            keys = np.array([int.from_bytes(hashlib.blake2b(self.data[s : s + SPAN].tobytes(), digest_size=8).digest(), "little") for s in single.tolist()], np.uint64)
            row, at = self.place(single)
            order = np.lexsort((row, at, self.ids[row], keys))
            head = np.append(True, keys[order][1:] != keys[order][:-1])
            again, single, keys = single[order[~head]], single[order[head]], keys[order[head]]
        return np.append(self.anchor[rim], keys), np.append(self.start[rim], single), np.append(self.strings[rim], np.ones(len(single), np.int64)), again


def longest_previous(group: np.ndarray, strings: np.ndarray, position: np.ndarray) -> np.ndarray:
    """For each string the longest prefix that a string of the same group and smaller position has too.

    `strings` is (n, SPAN) bytes. From the largest position down, a string's neighbours in suffix order are the nearest
    ones of smaller position on either side; after that it leaves the order.
    """
    n = len(group)
    # One byte more, so that strings that end in zero bytes keep their length.
    text = np.ascontiguousarray(np.hstack([strings, np.ones((n, 1), np.uint8)])).view(f"S{strings.shape[1] + 1}")[:, 0]
    order = np.argsort(position, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    differ = strings[order][1:] != strings[order][:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    common = np.where(group[order][1:] == group[order][:-1], common, 0)
    shared, before, after = [0, 0, *common.tolist(), 0], list(range(-1, n + 1)), list(range(1, n + 3))
    longest = [0] * (n + 2)
    for r in (np.argsort(position[order], kind="stable")[::-1] + 1).tolist():
        low, high = before[r], after[r]
        left, right = shared[r], shared[high]
        longest[r] = left if left > right else right
        shared[high] = left if left < right else right
        after[low], before[high] = high, low
    out = np.empty(n, np.int64)
    out[order] = longest[1 : n + 1]
    return out


_TEXTS = "buffer bigint, shard int, a binary, b binary, c binary"
_NAMES = ["buffer", "shard", "a", "b", "c"]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a buffer, under shard -1: bytes, offsets and doc_ids."""
    for table in buffers(batches, BUFFER_BYTES):
        column = table.column("text").combine_chunks()
        column = (column if isinstance(column, pa.Array) else column.chunk(0)).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
        sink = pa.BufferOutputStream()
        ids = table.select(["doc_id"]).combine_chunks()
        with pa.ipc.new_stream(sink, ids.schema) as stream:
            stream.write_table(ids)
        blobs = (len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True), pack((offsets - offsets[0]).astype(np.uint64)), sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array([table.column("row")[0].as_py()]), pa.array([-1], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], _NAMES)


def _open(a: bytes, b: bytes, c: bytes) -> tuple[Blocks, pa.Array]:
    data = np.frombuffer(pa.decompress(a[8:], decompressed_size=int.from_bytes(a[:8], "little"), codec="zstd", asbytes=True) if len(a) > 8 else b"", np.uint8)
    ids = pa.ipc.open_stream(c).read_all().column("doc_id").combine_chunks()
    ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
    known = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _BIAS
    return Blocks(data, unpack(b).astype(np.int64), known), ids


def _by(column: str, solve):
    """Runs `solve(key, rows)` for every run of rows with the same value in `column` of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row[column] != key and held:
                    yield from solve(key, held)
                    held = []
                key = row[column]
                held.append(row)
        if held:
            yield from solve(key, held)

    return run


def _requests(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in _texts(batches) for r in b.to_pylist()):
            blocks, _ = _open(row["a"], row["b"], row["c"])
            for s, part in blocks.dealt(blocks.anchor[blocks.first], shards):
                part = blocks.first[part]
                where = np.append(np.uint64(0), blocks.anchor[part])
                blobs = (pack(np.diff(where)), pack(blocks.content[part]), pack(blocks.ids[blocks.row[part]]), pack(blocks.at[part]))
                yield pa.RecordBatch.from_arrays([pa.array([row["buffer"]]), pa.array([s], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], ["buffer", "shard", "a", "b", "c", "d"])

    return run


def _judge(crowded: int):
    """Step 1: which contents stand earlier, which are alone under their anchor, and which need a closer look."""

    def solve(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        anchor = np.concatenate([np.cumsum(unpack(r["a"])) for r in rows])
        content, ids, at = (np.concatenate([unpack(r[c]) for r in rows]) for c in "bcd")
        sizes = [int.from_bytes(r["a"][:8], "little") for r in rows]
        order = np.lexsort((at, ids, content, anchor))
        a, c = anchor[order], content[order]
        new_anchor = np.append(True, a[1:] != a[:-1])
        new_content = new_anchor | np.append(True, c[1:] != c[:-1])
        group = np.cumsum(new_anchor) - 1
        contents = np.bincount(group, weights=new_content).astype(np.int64)[group]
        code = np.empty(len(order), np.uint64)
        code[order] = np.where(~new_content, REPEATED, np.where(contents == 1, ALONE, np.where(contents > crowded, CROWD, RIM)))
        for row, n, end in zip(rows, sizes, np.cumsum(sizes).tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([row["buffer"]]), pa.array([shard], pa.int32()), pa.array([pack(code[end - n : end])], pa.binary())], ["buffer", "shard", "codes"])

    return _by("shard", solve)


_RIMS = "buffer bigint, shard int, a binary, b binary, c binary, d binary, e binary"


def _rims(shards: int):
    """Step 2, first half: the bytes of the blocks that need a closer look."""

    def solve(buffer: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        text = next(r for r in rows if r["shard"] == -1)
        blocks, _ = _open(text["a"], text["b"], text["c"])
        keys, start, strings, _ = blocks.rims(blocks.codes({r["shard"]: r["a"] for r in rows if r["shard"] >= 0}, shards))
        for s, part in blocks.dealt(keys, shards):
            low, n = start[part], strings[part] + SPAN - 1
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            row, place = blocks.place(low)
            blobs = (pack(keys[part]), pack(strings[part]), pack(blocks.ids[row]), pack(place), pa.compress(blocks.data[at].tobytes(), codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array([buffer]), pa.array([s], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], ["buffer", "shard", "a", "b", "c", "d", "e"])

    return _by("buffer", solve)


def _compare(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Step 2, second half: longest-previous-factor arrays of the strings that share an anchor; one bit for each string."""
    keys, strings, ids, place = (np.concatenate([unpack(r[c]) for r in rows]) for c in "abcd")
    strings, place = strings.astype(np.int64), place.astype(np.int64)
    sizes = [int.from_bytes(r["a"][:8], "little") for r in rows]
    data = []
    for r, n, end in zip(rows, sizes, np.cumsum(sizes).tolist()):
        length = int(strings[end - n : end].sum()) + (SPAN - 1) * n
        data.append(np.frombuffer(pa.decompress(r["e"], decompressed_size=length, codec="zstd", asbytes=True), np.uint8))
    data = np.concatenate(data)
    width = strings + SPAN - 1
    head = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(keys)), strings)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = head[owner] + offset
    hashes = span_hashes(prefix_sums(data), at, at + SPAN)
    key = keys[owner]
    order = np.lexsort((hashes, key))
    same = (key[order][1:] == key[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    shared = order[np.append(False, same) | np.append(same, False)]
    repeated = np.zeros(len(owner), bool)
    if len(shared):
        rank = np.empty(len(shared), np.int64)
        rank[np.lexsort((shared, place[owner[shared]] + offset[shared], ids[owner[shared]]))] = np.arange(len(shared))
        edges = np.append(np.flatnonzero(np.append(True, key[shared][1:] != key[shared][:-1])), len(shared))
        low = 0
        while low < len(edges) - 1:
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + _CHUNK, "right")) - 1)
            part = slice(edges[low], edges[high])
            spots = shared[part]
            longest = longest_previous(key[spots], data[at[spots][:, None] + np.arange(SPAN)], rank[part])
            repeated[spots] = longest >= SPAN
            low = high
    for r, n, end in zip(rows, sizes, np.cumsum(sizes).tolist()):
        first, last = int(strings[: end - n].sum()), int(strings[:end].sum())
        yield pa.RecordBatch.from_arrays([pa.array([r["buffer"]]), pa.array([-2 - shard], pa.int32()), pa.array([pack(repeated[first:last].astype(np.uint64))], pa.binary())], ["buffer", "shard", "bits"])


def _drop(shards: int, texts: bool):
    """Step 3: covered bytes of every text of a buffer."""

    def solve(buffer: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        text = next(r for r in rows if r["shard"] == -1)
        blocks, ids = _open(text["a"], text["b"], text["c"])
        codes = blocks.codes({r["shard"]: r["a"] for r in rows if r["shard"] >= 0}, shards)
        keys, start, strings, again = blocks.rims(codes)
        bits = {-2 - r["shard"]: r["a"] for r in rows if r["shard"] < -1}
        gone = [again]
        for s, part in blocks.dealt(keys, shards):
            n = strings[part]
            spots = np.repeat(start[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            gone.append(spots[unpack(bits[s]).astype(bool)])
        whole = np.ones(len(blocks.anchor), bool)
        whole[blocks.first] = codes == REPEATED
        # A repeated content is repeated wherever it stands; other blocks of a content than its first are repeated too.
        low = np.concatenate([*gone, blocks.start[whole]]).astype(np.int64)
        high = np.concatenate([*(g + SPAN for g in gone), blocks.start[whole] + blocks.strings[whole] - 1 + SPAN]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
        digests, kept, removed, spans = [], [], [], []
        # Byte by byte over a few rows at a time: spans never leave their text.
        first, rows_, edges = 0, len(blocks.offsets) - 1, blocks.offsets
        while first < rows_:
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + RUN_BYTES, "right")) - 1)
            begin, end = int(edges[first]), int(edges[last])
            part = slice(*np.searchsorted(low, (begin, end)))
            depth = np.bincount(low[part] - begin, minlength=end - begin + 1) - np.bincount(high[part] - begin, minlength=end - begin + 1)
            covered = np.cumsum(depth)[: end - begin] > 0
            for x, y in zip((edges[first:last] - begin).tolist(), (edges[first + 1 : last + 1] - begin).tolist()):
                gone_here = covered[x:y]
                rest = blocks.data[begin + x : begin + y][~gone_here].tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                removed.append(y - x - len(rest))
                spans.append(int((gone_here[1:] & ~gone_here[:-1]).sum()) + int(gone_here[:1].any()))
                if texts:
                    kept.append(rest)
            first = last
        columns = [ids, pa.array(np.diff(edges)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        if texts:
            columns.append(pa.array(kept, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])

    return _by("buffer", solve)


def drop_repeats(documents: DataFrame, texts: bool = True, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `texts`, kept (the remaining bytes) of every document."""
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def dealt(rows: DataFrame, by: str, then: str) -> DataFrame:
        return rows.repartition(shards, by).sortWithinPartitions(by, then)

    asked = docs.mapInArrow(_requests(shards), "buffer bigint, shard int, a binary, b binary, c binary, d binary")
    codes = written(dealt(asked, "shard", "buffer").mapInArrow(_judge(crowded), "buffer bigint, shard int, codes binary"), "codes")
    empty = F.lit(None).cast("binary")
    answered = docs.mapInArrow(_texts, _TEXTS).unionByName(codes.select("buffer", "shard", F.col("codes").alias("a"), empty.alias("b"), empty.alias("c")))
    rims = dealt(answered, "buffer", "shard").mapInArrow(_rims(shards), _RIMS)
    bits = written(dealt(rims, "shard", "buffer").mapInArrow(_by("shard", _compare), "buffer bigint, shard int, bits binary"), "bits")
    answered = answered.unionByName(bits.select("buffer", "shard", F.col("bits").alias("a"), empty.alias("b"), empty.alias("c")))
    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts
    return dealt(answered, "buffer", "shard").mapInArrow(_drop(shards, texts), result)
