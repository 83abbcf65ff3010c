"""A Merkle manifest of a table, and proofs of every row by octopus multiproofs.

A row's leaf is the SHA-256 of its fields. The leaves of one group (a source) ascend by key; runs of `ARITY` consecutive
nodes become their parent until one is left, the group's subroot; subroots in order of the groups become the root alike.

Building: leaves are dealt by range of (group, key), so that a large group lies over many tasks. Places in groups come
from one summary row a partition, and each level is an aggregation of at most `ARITY` rows a node.

Proving: consecutive leaves are cut into leaf partitions of at most `PARTITION_LEAVES`. From the intervals of places that a
partition owns follow the coordinates (tree, level, place) of the nodes that its leaves cannot derive: the missing part of
a first and a last run at each level. These are fetched once, by one equality join for all partitions; each partition
derives the interior nodes that its leaves share and expands the proof of every leaf from them. Nodes that many
partitions ask for (levels from `SALTED_LEVEL`, and those of the subroots) are kept in `SALTS` copies.

A claim is another version of a row (such as a tampered text): its leaf is folded with the same siblings.

Null fields count as '-'. Null groups come first, null keys too; repeated rows are leaves of their own, rows with equal
group and key are ordered by leaf. Texts are hashed whole where they are read and never moved. Further columns of the
table do not matter. An empty table has no root and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.stages import written

ARITY = 16
PARTITION_LEAVES = 4096
SALTED_LEVEL = 3
SALTS = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1
_BITS = ARITY.bit_length() - 1
_PROVED = "doc_id bigint, tree bigint, pos bigint, size bigint, leaf binary, subroot binary, proof binary, derived binary, folded binary"


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 (binary) over the fields: byte count, ':' and value, or '-' for null."""
    said = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*said), 256))


def leaves(documents: DataFrame, fields=FIELDS, group: str = "source", claim: dict[str, Column] | None = None) -> DataFrame:
    """group, doc_id, leaf, and claimed: the leaf of the row with the columns of `claim` put in place of its own."""
    claim = claim or {}
    leaf = leaf_of([F.col(f) for f in fields])
    claimed = leaf_of([claim.get(f, F.col(f)) for f in fields]) if claim else leaf
    return documents.select(F.col(group).cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), claimed.alias("claimed"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition, place, and within the partition the number of their group and place in it."""
    pid, place, tree, pos, last = TaskContext.get().partitionId(), 0, -1, 0, None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        grp = batch.column("grp")
        none = grp.is_null().to_numpy(zero_copy_only=False)
        text = grp.fill_null("")
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])
        new[0] = last is None or last != (bool(none[0]), text[0].as_py())
        trees = tree + np.cumsum(new)
        starts = np.where(new, np.arange(n), -1)
        starts = np.maximum.accumulate(starts)
        places = np.where(starts >= 0, np.arange(n) - starts, np.arange(n) + pos)
        last, tree, pos = (bool(none[-1]), text[n - 1].as_py()), int(trees[-1]), int(places[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, pid, np.int64)), pa.array(place + np.arange(n)), pa.array(trees), pa.array(places), grp, batch.column("doc_id"), batch.column("leaf"), batch.column("claimed")],
            ["pid", "place", "tree", "pos", "grp", "doc_id", "leaf", "claimed"],
        )
        place += n


def placed(leaf_table: DataFrame) -> DataFrame:
    """pid, place, tree (the group's number), pos (the place in it), doc_id, leaf, claimed of every leaf."""
    numbered = leaf_table.withColumn("row", F.monotonically_increasing_id())
    shards = int(leaf_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", "doc_id", "leaf", "row"]
    dealt = numbered.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    local = written(dealt.mapInArrow(_number, "pid bigint, place bigint, tree bigint, pos bigint, grp string, doc_id bigint, leaf binary, claimed binary"), "leaves")
    # One row a partition from here: which group begins it, which ends it, and how far.
    ends = local.groupBy("pid").agg(F.min(F.struct("tree", "grp")).alias("a"), F.max(F.struct("tree", "pos", "grp")).alias("z"))
    ends = written(ends.select("pid", F.col("a.grp").alias("first"), F.col("z.grp").alias("last"), (F.col("z.pos") + 1).alias("held"), (F.col("z.tree") + 1).alias("trees")), "ends")
    both = ends.select("pid", F.col("last").alias("grp"), "held", F.lit(False).alias("asks")).unionByName(ends.select("pid", F.col("first").alias("grp"), F.lit(0).cast("long").alias("held"), F.lit(True).alias("asks")))
    before = Window.partitionBy("grp").orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)
    shift = both.withColumn("shift", F.coalesce(F.sum("held").over(before), F.lit(0))).where("asks").select("pid", "shift")
    line = Window.orderBy("pid")
    fresh_trees = F.col("trees") - F.when(F.col("first").eqNullSafe(F.lag("last").over(line)) & F.lag("pid").over(line).isNotNull(), 1).otherwise(0)
    trees = ends.withColumn("own", fresh_trees).withColumn("base", F.sum("own").over(line) - F.col("trees")).select("pid", "base")
    offsets = shift.join(trees, "pid")
    return local.join(F.broadcast(offsets), "pid").select(
        "pid", "place", (F.col("tree") + F.col("base")).alias("tree"),
        (F.col("pos") + F.when(F.col("tree") == 0, F.col("shift")).otherwise(0)).alias("pos"), "doc_id", "leaf", "claimed",
    )


def grow(level: DataFrame, widest: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Trees over (tree, pos, hash): the nodes of each level, and (tree, hash) of what remains of every tree."""
    levels, done = [level], None
    while True:
        runs = level.groupBy("tree", F.shiftright("pos", _BITS).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("run"))
        parent = F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["hash"]))), ""), 256))
        alone = (F.col("pos") == 0) & (F.size("run") == 1)
        up = written(runs.select("tree", "pos", F.when(alone, F.col("run")[0]["hash"]).otherwise(parent).alias("hash"), alone.alias("alone")), label)
        ended = up.where("alone").select("tree", "hash")
        done = ended if done is None else done.unionByName(ended)
        if widest <= 1:
            return levels, done
        level = up.where("not alone").select("tree", "pos", "hash")
        levels.append(level)
        widest = -(-widest // ARITY)


def _asked(spans: DataFrame, depth: int) -> DataFrame:
    """part, tree, level, pos: the nodes that (part, tree, lo, hi, size) needs and cannot derive."""
    at = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(depth - 1, 0)))))
    width = F.expr(f"shiftleft(1L, level * {_BITS})")
    at = at.select(
        "part", "tree", "level", F.floor(F.col("lo") / width).alias("lo"), F.ceil(F.col("hi") / width).alias("hi"), F.ceil(F.col("size") / width).alias("size"),
    ).where("size > 1")
    low, high = F.col("lo") - F.col("lo") % ARITY, F.least(F.ceil(F.col("hi") / ARITY) * ARITY, F.col("size"))
    none = F.array().cast("array<bigint>")
    left = F.when(low < F.col("lo"), F.sequence(low, F.col("lo") - 1)).otherwise(none)
    right = F.when(high > F.col("hi"), F.sequence(F.col("hi"), high - 1)).otherwise(none)
    return at.select("part", "tree", "level", F.explode(F.concat(left, right)).alias("pos"))


class _Tree:
    """The part of one tree that a leaf partition knows: at each level the digests of consecutive nodes."""

    def __init__(self, lo: int, digests: list[bytes], size: int, fetched: dict[tuple[int, int], bytes]):
        self.levels: list[tuple[int, list[bytes]]] = []
        self._above: dict[tuple[int, int], bytes] = {}
        level = 0
        while size > 1:
            while lo % ARITY:
                lo -= 1
                digests.insert(0, fetched[level, lo])
            while (lo + len(digests)) % ARITY and lo + len(digests) < size:
                digests.append(fetched[level, lo + len(digests)])
            runs = [b"".join(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
            lo, size, level = lo // ARITY, -(-size // ARITY), level + 1
            self.levels.append((lo, runs))
            digests = [parent(run) for run in runs]
        self.top = digests[0]

    def siblings(self, pos: int, level: int = 0) -> bytes:
        """The other digests of the run, then those of the runs above."""
        if level == len(self.levels):
            return b""
        lo, runs = self.levels[level]
        up, at = divmod(pos, ARITY)
        if (level, up) not in self._above:
            self._above[level, up] = self.siblings(up, level + 1)
        run = runs[up - lo]
        return run[: 32 * at] + run[32 * at + 32 :] + self._above[level, up]

    def fold(self, pos: int, digest: bytes) -> bytes:
        """The top if the leaf at `pos` were `digest`."""
        for lo, runs in self.levels:
            pos, at = divmod(pos, ARITY)
            run = runs[pos - lo]
            digest = parent(run[: 32 * at] + digest + run[32 * at + 32 :])
        return digest


def parent(run: bytes) -> bytes:
    """The node over the digests of a run, which are hashed as lowercase hexadecimal text."""
    return sha256(run.hex().encode()).digest()


def _prove(own: pa.Table, fetched: pa.Table) -> pa.Table:
    """The proofs of one leaf partition (at most PARTITION_LEAVES rows) and the few nodes fetched for it."""
    nodes: dict[int, dict[tuple[int, int], bytes]] = {}
    sizes: dict[int, int] = {}
    for tree, level, pos, digest in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "pos", "hash"))):
        if level < 0:
            sizes[tree] = pos
        else:
            nodes.setdefault(tree, {})[level, pos] = digest
    own = own.sort_by([("tree", "ascending"), ("pos", "ascending")])
    names = own.column("tree").to_numpy()
    places, leaf, claimed = (own.column(c).to_pylist() for c in ("pos", "leaf", "claimed"))
    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist()
    trees = []
    for low, high in zip(starts, [*starts[1:], len(names)]):
        tree = int(names[low])
        trees.append(_Tree(places[low], leaf[low:high], sizes[tree], nodes.get(tree, {})))
    first = int(names[0])
    top = _Tree(first, [t.top for t in trees], sizes[TOP], nodes.get(TOP, {}))
    size, subroot, proof, folded = [], [], [], []
    for k, (low, high) in enumerate(zip(starts, [*starts[1:], len(names)])):
        tree, above = trees[k], top.siblings(first + k)
        for i in range(low, high):
            size.append(sizes[first + k])
            subroot.append(tree.top)
            proof.append(tree.siblings(places[i]) + above)
            folded.append(top.top if claimed[i] == leaf[i] else top.fold(first + k, tree.fold(places[i], claimed[i])))
    n = len(names)
    return pa.table(
        [own.column("doc_id"), own.column("tree"), own.column("pos"), pa.array(size, pa.int64()), own.column("leaf"), pa.array(subroot, pa.binary()), pa.array(proof, pa.binary()), pa.array([top.top] * n, pa.binary()), pa.array(folded, pa.binary())],
        names=["doc_id", "tree", "pos", "size", "leaf", "subroot", "proof", "derived", "folded"],
    )


def prove(documents: DataFrame, fields=FIELDS, group: str = "source", claim: dict[str, Column] | None = None, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """One row a document: doc_id, tree and pos (its coordinates), size (leaves of its tree), leaf, subroot, proof (the
    digests of all siblings, from its run up to the root), derived (the root that its leaf partition derives), folded
    (the root that its claim gives) and root (that of the manifest). All digests are binary."""
    spark = documents.sparkSession
    leaf = placed(written(leaves(documents, fields, group, claim), "fields"))
    sizes = written(leaf.groupBy("tree").agg((F.max("pos") + 1).alias("size")), "sizes")
    widest, groups = sizes.agg(F.max("size"), F.count(F.lit(1))).first()
    if not groups:
        return spark.createDataFrame([], _PROVED + ", root binary")
    levels, subroots = grow(leaf.select("tree", "pos", F.col("leaf").alias("hash")), widest, "nodes")
    top_levels, top = grow(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash"), groups, "roots")
    root = top.first()["hash"]

    part = F.shiftleft(F.col("pid"), 32) + F.floor(F.col("place") / partition_leaves)
    parts = leaf.select(part.alias("part"), "tree", "pos", "doc_id", "leaf", "claimed")
    spans = parts.groupBy("part", "tree").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi")).join(sizes, "tree")
    spans = written(spans.select("part", "tree", "lo", "hi", "size"), "spans")
    tops = spans.groupBy("part").agg(F.min("tree").alias("lo"), (F.max("tree") + 1).alias("hi")).select("part", F.lit(TOP).cast("long").alias("tree"), "lo", "hi", F.lit(groups).cast("long").alias("size"))
    asked = _asked(spans, len(levels)).unionByName(_asked(tops, len(top_levels)))
    common = (F.col("tree") == TOP) | (F.col("level") >= SALTED_LEVEL)
    asked = asked.withColumn("salt", F.when(common, F.pmod("part", F.lit(SALTS))).otherwise(0).cast("int"))
    nodes = None
    for trees in (levels, top_levels):
        for k, level in enumerate(trees):
            level = level.select("tree", F.lit(k).alias("level"), "pos", "hash")
            nodes = level if nodes is None else nodes.unionByName(level)
    copies = F.when(common, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    fetched = asked.join(nodes.withColumn("salt", F.explode(copies)), ["tree", "level", "pos", "salt"]).select("part", "tree", "level", "pos", "hash")
    told = spans.unionByName(tops).select("part", "tree", F.lit(-1).alias("level"), F.col("size").alias("pos"), F.lit(None).cast("binary").alias("hash"))
    proved = parts.groupBy("part").cogroup(fetched.unionByName(told).groupBy("part")).applyInArrow(_prove, _PROVED)
    return proved.withColumn("root", F.lit(root))
