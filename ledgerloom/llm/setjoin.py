"""Documents whose sets of word shingles have a Jaccard similarity above a threshold, by a token-group matrix.

A document's set holds the 64-bit hashes of its distinct shingles (of its whole word sequence where there are fewer
words). Documents with equal sets are one class; a task folds its own copies first, so copies never meet in pairs.

Linked sets x and y share at least `percent` of the larger one, so of their rarest tokens, `n - share(n) + DEPTH` of each
in one global order, at least DEPTH are common. The order is that of a count sketch of fixed size over all sets (any order
is right; rare tokens first keeps passages that many documents share out). Only those tokens that stand in two sets at
least are kept; sets with fewer than DEPTH of them have no link.

Groups: sets with the same commonest kept token are similar and form a group, cut into parts of about `GROUP_SETS` sets
and `GROUP_TOKENS` tokens. The matrix holds for each token the groups in whose union it is. A set queries a group: the
number of its tokens in the group's union bounds its overlap with every member, and only groups with DEPTH or more are
opened, that is, the whole sets of query and members are compared exactly.

First the members of each group are compared with one another, and sets query the group of the set before them in a
token's list where it is another one, at most one query for each place in the lists. Then components are formed, and sets
query those groups that hold the token in a larger component than their own (by size, then name), which covers every pair
whose sides are still apart. From each opened group only a forest of its links leaves. So large groups of near copies cost
queries against groups, never rows for their pairs, and no link that joins two components is lost. Texts are fetched once,
for sets that share DEPTH kept tokens with a group, and sets are made from them where they are compared (texts compress, hashes do not).

Null and empty texts have no words, an empty set, and are linked with nothing. Repeated rows are copies. component_id is
the smallest doc_id reachable; null doc_ids count only where a component has no other. Very long texts are one set like
any other; a task holds one whole text, and for a group about GROUP_TOKENS tokens beside its longest member. Further
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textbytes
from ledgerloom.llm.simhash import components
from ledgerloom.llm.stages import fresh, tabled, written

DEPTH = 4
SKETCH_BITS = 18
SLICES = 16
GROUP_SETS = 256
GROUP_TOKENS = 1 << 20
WIDE = 64
_HELD = 20_000


def share(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with a linked one."""
    return -(-percent * n // 100)


def depth_of(percent: int) -> tuple[int, int]:
    """The size from which a set can have links to different sets, and the number of common rare tokens they have."""
    least = -(-percent // (100 - percent))
    return least, min(DEPTH, share(least, percent))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, nulls empty."""
    factors = textbytes.mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for _, data, offsets in textbytes.runs(column):
        data = textbytes.LOWER[data]
        starts, ends, first = textbytes.words(data, offsets, textbytes.NOT_SPACE)
        hashes = textbytes.span_hashes(textbytes.prefix_sums(data), starts, ends)
        whole = max(0, len(hashes) - words + 1)
        shingles = textbytes.mix(sum((hashes[j : j + whole] * factors[j] for j in range(words)), np.zeros(whole, np.uint64)) + np.uint64(words))
        for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
            n = high - low
            if n >= words:
                yield np.unique(shingles[low : high - words + 1])
            else:
                yield textbytes.mix((hashes[low:high] * factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))[: min(n, 1)]


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


_HOLDER = pa.struct([("row", pa.int64()), ("doc_id", pa.int64())])
_DIGESTS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("row", pa.int64()), ("least", pa.int64()), ("holders", pa.list_(_HOLDER)), ("slice", pa.int32()), ("counts", pa.binary())])


def _digest(words: int):
    """Sets to their keys with the rows that hold them (equal sets of a task once), and the task's part of the sketch."""

    def flush(held: dict[bytes, tuple[int, list]]) -> pa.RecordBatch:
        holders = [rows for _, rows in held.values()]
        none = pa.nulls(len(held), pa.int32()), pa.nulls(len(held), pa.binary())
        columns = [
            pa.array([k or None for k in held], pa.binary()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([min(r for r, _ in rows) for rows in holders], pa.int64()),
            pa.array([min((d for _, d in rows if d is not None), default=None) for rows in holders], pa.int64()), pa.array(holders, pa.list_(_HOLDER)), *none,
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, list]] = {}
        size = 0
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for row, doc_id, tokens in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), words)):
                key = blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else b""
                if key not in held:
                    held[key] = len(tokens), []
                    np.add.at(sketch, _cells(tokens), 1)
                held[key][1].append((row, doc_id))
                size += 1
                if size >= _HELD:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)
        counts = [x.astype("<i8").tobytes() for x in np.split(sketch, SLICES)]
        none = [pa.nulls(SLICES, f.type) for f in _DIGESTS][:5]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(counts, pa.binary())], schema=_DIGESTS)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the tasks' sketches to their sums."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            sums[at] = sums.get(at, 0) + np.frombuffer(counts, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])


def token_sketch(digests: DataFrame) -> np.ndarray:
    """How often each cell's tokens occur in sets: 2 ** SKETCH_BITS numbers, whatever the size of the table."""
    parts = digests.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary")
    found = parts.agg(F.array_sort(F.collect_list(F.struct("slice", "counts"))).alias("all")).first()["all"]
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for at, counts in found:
        sketch.reshape(SLICES, -1)[at] = np.frombuffer(counts, "<i8")
    return np.minimum(sketch, np.iinfo(np.uint32).max).astype(np.uint32)


def _rarest(words: int, percent: int, sketch: np.ndarray):
    """Rows to the rarest tokens of their sets, for sets that can have links; equal sets near each other once."""
    least, depth = depth_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows, rare = [], []
            for row, tokens in zip(batch.column("row").to_pylist(), shingle_sets(batch.column("text"), words)):
                n = len(tokens)
                if n < least:
                    continue
                key = blake2b(tokens.tobytes(), digest_size=16).digest()
                if key in seen:
                    continue
                seen.add(key)
                take = min(n, n - share(n, percent) + depth)
                rows.append(row)
                rare.append(tokens[np.lexsort((tokens, sketch[_cells(tokens)]))[:take]].view(np.int64))
            if len(seen) > _HELD:
                seen.clear()
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32)
            flat = np.concatenate(rare) if rare else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["row", "tokens"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, without tokens that stand in one row only."""
    held, passed = None, False
    for batch in batches:
        if not len(batch):
            continue
        token, cls = batch.column("token").to_numpy(), batch.column("cls").to_numpy()
        if held is not None:
            token, cls = np.append(held[0], token), np.append(held[1], cls)
        same = token[1:] == token[:-1]
        out = np.append(False, same) | np.append(same, False)
        # The last row waits for the next batch, unless the row before has its token; the one held may have gone already.
        held, gone = (token[-1:], cls[-1:]), bool(out[-1])
        if passed:
            out[0] = False
        passed = gone
        yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(cls[out])], ["token", "cls"])


def kept_tokens(documents: DataFrame, classes: DataFrame, words: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """token, cls: the rare tokens of each class that at least two classes have."""
    rare = documents.mapInArrow(_rarest(words, percent, sketch), "row bigint, tokens array<bigint>")
    rows = rare.join(classes.select("cls"), F.col("row") == F.col("cls"), "left_semi").select(F.explode("tokens").alias("token"), F.col("row").alias("cls"))
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(shards, "token").sortWithinPartitions("token")
    return written(dealt.mapInArrow(_shared, "token bigint, cls bigint"), "kept")


def matrix(kept: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """token, grp, cls, n: the kept tokens of every class that can have links, with the group it is in.

    A class stays if some group shares `depth` of its tokens; tokens in over WIDE groups count for every group, so that
    this costs at most WIDE rows a token of a class."""
    counts = kept.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    told = kept.join(counts, "token")
    active = told.groupBy("cls").agg(F.count(F.lit(1)).alias("held"), F.max(F.struct("sets", "token")).alias("top")).where(F.col("held") >= depth)
    active = written(active.join(classes.select("cls", "n"), "cls").select("cls", "n", F.col("top.token").alias("sig")), "active")
    sizes = active.groupBy("sig").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_SETS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts"))
    large = sizes.where("parts > 1")
    grouped = active.join(large, "sig", "left").select("cls", "n", F.xxhash64("sig", F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1)))).alias("grp"))
    table = written(kept.join(grouped, "cls").select("token", "grp", "cls", "n"), "matrix")
    unions = table.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("members"))
    wide = unions.groupBy("token").agg(F.count(F.lit(1)).alias("groups"))
    told = table.join(wide, "token").select("token", "cls", "grp", (F.col("groups") > WIDE).alias("wide"))
    met = told.where("not wide").join(unions.select("token", F.col("grp").alias("other"), "members"), "token").where("grp <> other or members > 1")
    met = met.groupBy("cls", "other").agg(F.count(F.lit(1)).alias("common")).groupBy("cls").agg(F.max("common").alias("common"))
    free = told.groupBy("cls").agg(F.count(F.when(F.col("wide"), 1)).alias("free"))
    live = free.join(met, "cls", "left").where(F.col("free") + F.coalesce("common", F.lit(0)) >= depth).select("cls")
    return written(table.join(live, "cls", "left_semi"), "matrix")


def _match(words: int, percent: int):
    """Members of one opened group, and its queries, to a forest of their links.

    Where the queries begin with a null, members are compared with one another too."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        names = members.column("cls").to_numpy()
        sets = list(shingle_sets(members.column("text").combine_chunks(), words)) if len(members) else []
        asked = queries.filter(pc.is_valid(queries.column("cls")))
        own = len(asked) < len(queries)
        edges: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        if sets:
            sizes = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            union, ends = flat[starts], np.append(starts[1:], len(flat))
            searches = list(zip(names.tolist(), sets)) if own else []
            if len(asked):
                searches += zip(asked.column("cls").to_pylist(), shingle_sets(asked.column("text").combine_chunks(), words))
            for cls, tokens in searches:
                at = np.searchsorted(union, tokens)
                at[at == len(union)] = 0
                at = at[union[at] == tokens]
                if len(at) < share(len(tokens), percent):
                    continue
                lengths = ends[at] - starts[at]
                places = np.repeat(starts[at] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
                common = np.bincount(owner[places], minlength=len(sets))
                linked = 100 * common >= percent * (len(tokens) + sizes - common)
                for other in names[linked].tolist():
                    a, b = find(cls), find(other)
                    if a != b:
                        root[a] = b
                        edges.append((cls, other))
        return pa.table([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    return run


def open_groups(asked: DataFrame, texts: DataFrame, words: int, percent: int, own: bool) -> DataFrame:
    """a, b: links between the queries of `asked` (cls, grp) and members of those groups, and if `own` is set among the
    members of every group. texts: cls, grp, n, text, a row for each class."""
    asked = asked.join(texts.select("cls", "n"), "cls")
    held = asked.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_SETS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts"))
    one = F.lit(1).cast("long")
    if own:
        several = texts.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        held = held.join(several, "grp", "full").select("grp", F.coalesce("parts", one).alias("parts"))
    held = written(held, "opened")
    at = lambda part: F.struct("grp", part.alias("part")).alias("at")
    queries = asked.select("cls", "grp").join(held, "grp").select("cls", at(F.pmod(F.xxhash64("cls"), "parts"))).join(texts.select("cls", "text"), "cls")
    if own:
        queries = queries.unionByName(held.select(F.lit(None).cast("long").alias("cls"), at(F.lit(0).cast("long")), F.lit(None).cast("string").alias("text")))
    members = texts.select("cls", "grp", "text").join(held, "grp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.select("cls", at(F.col("part")), "text")
    pairs = queries.groupBy("at").cogroup(members.groupBy("at")).applyInArrow(_match(words, percent), "a bigint, b bigint")
    return written(pairs, "links")


def ranked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` (with cls) and the rank of each class' component: its size, then its name."""
    roots = components(links)
    sizes = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    named = roots.join(sizes, "root")
    ends = named.select(F.col("node").alias("cls"), "root", "size").unionByName(sizes.select(F.col("root").alias("cls"), "root", "size"))
    one = F.lit(1).cast("long")
    return rows.join(ends, "cls", "left").select(*rows.columns, F.struct(F.coalesce("size", one).alias("size"), F.coalesce("root", F.col("cls")).alias("root")).alias("rank"))


def neighbours(rows: DataFrame, depth: int) -> DataFrame:
    """cls, grp: classes and the other group of the class before them in a token's list, if DEPTH tokens say so. A list may
    lie over several tasks; a place at the begin of a task has none before it, which the later queries make up for."""
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["token", "grp", "cls"]
    dealt = rows.select(*order).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_before, "cls bigint, grp bigint").groupBy("cls", "grp").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= depth).select("cls", "grp")


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        if not len(batch):
            continue
        token, grp, cls = (batch.column(c).to_numpy() for c in ("token", "grp", "cls"))
        if last is not None:
            token, grp, cls = np.append(last[0], token), np.append(last[1], grp), np.append(last[2], cls)
        other = (token[1:] == token[:-1]) & (grp[1:] != grp[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(cls[1:][other]), pa.array(grp[:-1][other])], ["cls", "grp"])
        last = token[-1:], grp[-1:], cls[-1:]


def apart(rows: DataFrame, depth: int) -> DataFrame:
    """cls, grp: the queries that are left. rows: token, grp, cls, rank."""
    top = rows.groupBy("token").agg(F.max("rank").alias("top"))
    low = rows.join(top, "token").where(F.col("rank") < F.col("top")).select("token", "cls", "rank")
    unions = rows.groupBy("token", "grp").agg(F.max("rank").alias("best"))
    common = low.join(unions, "token").where(F.col("rank") < F.col("best")).groupBy("cls", "grp").agg(F.count(F.lit(1)).alias("common"))
    return common.where(F.col("common") >= depth).select("cls", "grp")


def link_sets(documents: DataFrame, words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests (key, n, row, least, holders), classes (key, cls, n, least) and links (a, b) that connect all classes
    within the threshold, of `documents` with columns row, doc_id, text."""
    digests = written(documents.mapInArrow(_digest(words), "key binary, n bigint, row bigint, least bigint, holders array<struct<row:bigint,doc_id:bigint>>, slice int, counts binary"), "digests")
    rows = digests.where("slice is null").drop("slice", "counts")
    classes = written(rows.where("key is not null").groupBy("key").agg(F.min("row").alias("cls"), F.max("n").alias("n"), F.min("least").alias("least")), "classes")
    _, depth = depth_of(percent)
    kept = kept_tokens(documents.select("row", "text"), classes, words, percent, token_sketch(digests))
    table = matrix(kept, classes, depth)
    active = table.select("cls", "grp", "n").distinct()
    texts = written(documents.select("row", "text").join(active.hint("shuffle_hash"), F.col("row") == F.col("cls")).select("cls", "grp", "n", "text"), "members", "zstd")
    near = open_groups(neighbours(table, depth), texts, words, percent, own=True)
    far = open_groups(apart(written(ranked(table, near), "ranked"), depth), texts, words, percent, own=False)
    return rows, classes, near.unionByName(far)


def near_sets(documents: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """row, doc_id, n_shingles, component_id of every document, and keeper: the row of each component that stays
    (smallest doc_id, then row)."""
    docs = tabled(documents).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, classes, links = link_sets(docs, words, percent)
    roots = components(links)
    lowest = F.array_min(F.transform("holders", lambda h: F.struct(h["doc_id"].isNull().alias("none"), h["doc_id"].alias("doc_id"), h["row"].alias("row"))))
    first = rows.where("key is not null").groupBy("key").agg(F.min(lowest).alias("first"))
    named = classes.join(first, "key").join(roots, F.col("cls") == F.col("node"), "left").select("key", "least", "first", F.coalesce("root", "cls").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    told = named.select("key", "root").join(groups, "root").select("key", "component_id", F.col("first.row").alias("first_row"))
    linked = rows.join(told, "key").select("n", "component_id", "first_row", F.explode("holders").alias("h"))
    alone = rows.where("key is null").select("n", F.explode("holders").alias("h")).select("n", F.col("h.doc_id").alias("component_id"), F.col("h.row").alias("first_row"), "h")
    both = linked.unionByName(alone)
    return both.select("h.row", "h.doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("h.row") == F.col("first_row")).alias("keeper"))


def drop_near_sets(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`documents` with one row of each component, all columns as they were."""
    documents = tabled(documents)
    row, kept_row = fresh(documents, "row"), fresh(documents, "kept_row")
    kept = near_sets(documents, words, percent).where("keeper").select(F.col("row").alias(kept_row))
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(kept.hint("shuffle_hash"), F.col(row) == F.col(kept_row), "left_semi").drop(row)
