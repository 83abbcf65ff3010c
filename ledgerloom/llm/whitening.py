"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

An entry c becomes the integer x = floor(SCALE * c) + SHIFT, so that sums and centred vectors n * x - S are exact. The
components are the leading eigenvectors of the covariance V = XᵀX / n of the centred vectors. V is never formed: a pass
over the table (`covariance_times`) gives V Q for a block Q of a few more columns than components, each task summing its
own vectors' part, and all parts are added by matrix row.

One cycle applies a Chebyshev polynomial of V to the block. Its recurrence takes one pass a degree; it is bounded by one on
the unwanted spectrum, from a lower bound to the block's smallest Ritz value, and grows fast above, so that the unwanted
directions are damped. Then QR and Rayleigh-Ritz give the next block; its product with V, known from Rayleigh-Ritz, is the
first step of the next cycle. The lower bound comes from Lanczos steps that ride along as one more column of each pass. A
component is certified by its residual |V q - e q| <= TOLERANCE * e1; without that for all after `MOST_PASSES` it is an
error, never a result. Blocks, products and Ritz vectors are dimensions times about 1.5 * components numbers, whatever the
number of rows; only these reach the driver.

Dropped: null vectors, vectors with null or non-finite entries, and vectors whose length is not the commonest one (of
equally common lengths the largest stays). Entries whose x a double cannot hold exactly, and sums or deviations that a
long cannot hold, are errors. Repeated rows and repeated or null ids are rows like any other. Components whose eigenvalue
is under RANK_TOLERANCE of the largest do not exist: tables of equal vectors, and empty ones, give an empty result.
Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.stages import written

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
BLOCK_ENTRIES = 1 << 20
TOLERANCE = 2e-14
LOOSE_TOLERANCE = 1e-12
RANK_TOLERANCE = 1e-12
MOST_PASSES = 400
MOST_DEGREE = 12
MOST_RATIO = 1e7


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to blocks: ids and integer entries of vectors of one length."""
    for batch in batches:
        lists, ids = batch.column("vector"), batch.column("id")
        sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        row_of = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
        good = sizes >= 0
        good[row_of[~np.isfinite(entries)]] = False
        for size in np.unique(sizes[good]).tolist():
            rows = np.flatnonzero(good & (sizes == size))
            starts = (np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0))[rows]
            step = max(1, BLOCK_ENTRIES // max(size, 1))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                scaled = np.floor(SCALE * entries[starts[low : low + step, None] + np.arange(size)])
                if scaled.size and np.abs(scaled).max() >= 2.0**52:
                    raise ValueError("an embedding entry is too large to be held exactly")
                x = scaled.astype("<i8") + SHIFT
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([ids.take(pa.array(part)).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())],
                    ["size", "n", "ids", "x"],
                )


def blocks(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """size, n, ids, x: blocks of the vectors that stay, of the commonest length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    found = written(rows.mapInArrow(_blocks, "size int, n bigint, ids array<bigint>, x binary"), "vectors")
    common = found.groupBy("size").agg(F.sum("n").alias("rows")).agg(F.max(F.struct("rows", "size")).alias("top")).first()["top"]
    return found.where(F.col("size") == (common["size"] if common else -1))


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Scalar]]:
    for size, n, ids, x in zip(batch.column("size").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), batch.column("x")):
        yield np.frombuffer(x.as_buffer(), "<i8").reshape(n, size), ids


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, most = None, 0
    for batch in batches:
        for x, _ in _entries(batch):
            most += len(x) * int(np.abs(x).max(initial=0))
            if most >= 1 << 62:
                raise OverflowError("sums of embedding entries do not fit a long")
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "total"])


class Centred:
    """The vectors with their count n and exact sums S per dimension."""

    def __init__(self, found: DataFrame):
        self.blocks = found
        sums = found.mapInArrow(_sum_up, "i bigint, total bigint").groupBy("i").agg(F.sum("total").alias("total"))
        sums = sums.agg(F.array_sort(F.collect_list(F.struct("i", "total"))).alias("all")).first()["all"]
        self.sums = np.array([r["total"] for r in sums], np.int64)
        self.n = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """x to the exact integers n * x - S."""
        n, sums = self.n, self.sums
        top = int(np.abs(sums).max(initial=0))

        def run(x: np.ndarray) -> np.ndarray:
            if n * int(np.abs(x).max(initial=0)) + top < 1 << 62:
                return n * x - sums
            return n * x.astype(object) - sums.astype(object)

        return run

    def summed(self, task_part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over all blocks of task_part(centred vectors as doubles), a matrix of that shape."""
        centre, n, width = self.centre(), self.n, shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for x, _ in _entries(batch):
                    total += task_part(centre(x).astype(np.float64) / n)
            rows = pa.ListArray.from_arrays(np.arange(0, total.size + 1, width, dtype=np.int32), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), rows], ["i", "v"])

        parts = self.blocks.select("size", "n", "ids", "x").mapInArrow(run, "i bigint, v array<double>")
        rows = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
        found = rows.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("all")).first()["all"]
        return np.array([r["v"] for r in found]).reshape(shape)

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        """One pass: V q."""
        return self.summed(lambda y: y.T @ (y @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda y: np.array([[np.square(y).sum()]]), (1, 1))[0, 0]) / self.n


class _Lanczos:
    """Steps of one vector that ride along with the block, for a lower bound of the spectrum."""

    def __init__(self, start: np.ndarray):
        self.basis, self.diagonal, self.beside = [start / np.linalg.norm(start)], [], []

    def vector(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def step(self, product: np.ndarray) -> None:
        if len(self.diagonal) == len(self.basis):
            return
        self.diagonal.append(float(self.basis[-1] @ product))
        rest = product
        for _ in range(2):
            for v in self.basis:
                rest = rest - v * (v @ rest)
        size = float(np.linalg.norm(rest))
        self.beside.append(size)
        if len(self.basis) < len(rest) and size > 1e-14 * abs(self.diagonal[0]):
            self.basis.append(rest / size)

    def lowest(self) -> float:
        beside = self.beside[: len(self.diagonal) - 1]
        matrix = np.diag(self.diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
        return max(0.0, float(np.linalg.eigvalsh(matrix)[0]) - self.beside[-1])


def _degree(low: float, cut: float, wanted: float, largest: float) -> int:
    """How many steps until the largest eigenvalue outgrows the smallest wanted one by MOST_RATIO."""
    centre, half = (low + cut) / 2, (cut - low) / 2

    def growth(e: float) -> float:
        t = max(1.0, (e - centre) / half)
        return t + np.sqrt(t * t - 1)

    ratio = growth(largest) / growth(wanted)
    return MOST_DEGREE if ratio <= 1 else int(np.clip(np.log(MOST_RATIO) / np.log(ratio), 2, MOST_DEGREE))


def leading(times: Callable[[np.ndarray], np.ndarray], dimensions: int, components: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), eigenvectors (columns) and the number of passes; times(Q) is V Q."""
    width = min(dimensions, components + max(8, components // 2))
    rng = np.random.default_rng(0)
    lanczos = _Lanczos(rng.normal(size=dimensions))
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        both = times(np.hstack([q, lanczos.vector()]))
        lanczos.step(both[:, -1])
        return both[:, :-1]

    q = np.linalg.qr(rng.normal(size=(dimensions, width)))[0]
    best, waited = np.inf, 0
    while True:
        vq = product(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        largest = max(values[0], 0.0)
        wanted = min(components, int((values > RANK_TOLERANCE * largest).sum()))
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max(initial=0.0))
        if residual <= TOLERANCE * largest or width == dimensions:
            break
        # Rounding may keep the residual a little above; it is then as small as doubles make it.
        waited = waited + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if waited >= 2 and residual <= LOOSE_TOLERANCE * largest:
            break
        if passes > MOST_PASSES:
            raise RuntimeError(f"no certified components after {passes} passes: residual {residual:.3g} of {largest:.3g}")
        # The cut stays clear of the wanted values, also where the block's last ones equal them.
        low, smallest = lanczos.lowest(), float(values[wanted - 1])
        cut = max(min(float(values[-1]), smallest - 0.1 * (smallest - low)), RANK_TOLERANCE * largest)
        low = min(low, 0.999 * cut)
        centre, half = (low + cut) / 2, (cut - low) / 2
        sigma = first = half / (largest - centre) if largest > centre else 1.0
        before, now = q, (vq - centre * q) * (sigma / half)
        for _ in range(1, _degree(low, cut, float(values[wanted - 1]), largest)):
            then = 1 / (2 / first - sigma)
            before, now = now, (product(now) - centre * now) * (2 * then / half) - before * (sigma * then)
            sigma = then
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
    return values[:wanted], q[:, :wanted], passes


class Whitening:
    """The fitted whitening: n, eigenvalues, components (columns), trace, and the largest entry of cov(whitened) - 1."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding"):
        self.centred = Centred(blocks(vectors, id_column, vector_column))
        self.n, dimensions = self.centred.n, len(self.centred.sums)
        self.values, self.vectors, self.trace, self.identity_error, self.passes = np.zeros(0), np.zeros((dimensions, 0)), 0.0, 0.0, 0
        if self.n and dimensions:
            self.trace = self.centred.trace()
        if self.trace > 0:
            self.values, self.vectors, self.passes = leading(self.centred.covariance_times, dimensions, components)
            map_ = self.vectors / np.sqrt(self.values)
            k = len(self.values)
            self.identity_error = float(np.abs(self.centred.summed(lambda y: (y @ map_).T @ (y @ map_), (k, k)) / self.n - np.eye(k)).max())

    def transform(self) -> DataFrame:
        """vec_id, n, deviation, whitened (array of a number a component) of every vector."""
        centre, n, map_ = self.centred.centre(), self.n, self.vectors / np.sqrt(self.values)
        k = len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, ids in _entries(batch):
                    y = centre(x)
                    if y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) >= 2.0**62:
                        y = y.astype(object)
                    deviation = pa.array((y * y).sum(axis=1).tolist(), pa.int64())
                    white = (y.astype(np.float64) / n) @ map_
                    lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, k, dtype=np.int32), pa.array(white.ravel()))
                    yield pa.RecordBatch.from_arrays([ids.values, deviation, lists], ["vec_id", "deviation", "whitened"])

        schema = "vec_id bigint, deviation bigint, whitened array<double>"
        rows = self.centred.blocks.select("size", "n", "ids", "x").where(F.lit(k > 0)).mapInArrow(run, schema)
        return rows.select("vec_id", F.lit(int(n)).cast("long").alias("n"), "deviation", "whitened")
