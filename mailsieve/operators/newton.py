"""Penalised logistic regression by trust-region Newton steps whose linear systems are solved by conjugate gradients.

The rows are written once as packed sparse blocks. A pass is one scan of the blocks: each task multiplies its blocks by a vector in
numpy and returns one sum as long as the weights, and the sums are added up in a tree. The driver holds vectors as long as the weights and no rows.
One pass gives loss, gradient and the Hessian's diagonal at a point, the other kind the product of the Hessian with a direction. The
preconditioner is the diagonal, which evens out rare and frequent terms, corrected by every product so far as in L-BFGS: what earlier systems
told about the Hessian needs no more passes in later ones, nor in a second fit to the same rows with more features. Some 80 passes settle a fit.

With a unit penalty the Hessian's least eigenvalue is 1 for the weights, so they are no further from the optimum than the
gradient is long.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.operators.durable import discard, durable

#: Nonzero entries of a packed block, and partial sums that one task adds up.
BLOCK_ENTRIES, FAN_IN = 1 << 20, 64
MAX_ITERATIONS, TOLERANCE = 200, 1e-4
#: Bytes of products of the Hessian that the driver keeps for its preconditioner, the latest ones.
CURVATURE_BYTES = 1 << 26

PACKED = "label binary, ends binary, indices binary, values binary"


@dataclass(frozen=True)
class FitSummary:
    totalIterations: int  # noqa: N815 (named like the summaries of MLlib)
    passes: int
    gradient: float


@dataclass(frozen=True)
class Fit:
    weights: np.ndarray
    intercept: float
    summary: FitSummary
    #: For a fit that goes on from this one: the first gradient's length, and directions with the Hessian's products.
    steepest: float = 0.0
    curvature: tuple[tuple[np.ndarray, np.ndarray], ...] = ()


def _row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values`` that end at ``ends``."""
    out = np.zeros(len(ends))
    starts = ends - np.diff(ends, prepend=0)
    held = np.flatnonzero(ends > starts)
    if len(held):
        out[held] = np.add.reduceat(values, starts[held])
    return out


@dataclass(frozen=True)
class Block:
    label: np.ndarray
    ends: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    @functools.cached_property
    def places(self) -> np.ndarray:
        """``indices`` as numpy wants them, or each use would convert them."""
        return self.indices.astype(np.intp)

    def times(self, v: np.ndarray) -> np.ndarray:
        """Rows times ``v``, whose last entry belongs to the intercept."""
        return _row_sums(self.values * v.take(self.places), self.ends) + v[-1]

    def transposed(self, r: np.ndarray, size: int, square: bool = False) -> np.ndarray:
        """Sum of the rows (or of their squared entries) times ``r``."""
        each = np.repeat(r, np.diff(self.ends, prepend=0))
        values = self.values * self.values if square else self.values
        out = np.bincount(self.places, values * each, size)
        out[-1] = r.sum()
        return out


@dataclass(frozen=True)
class TermBlock(Block):
    """Unit-length TF-IDF vectors whose ``values`` are the terms' counts, and the columns ``beside`` behind their entries.

    An entry takes three bytes where a count and an index do, and a pass reads little else.
    """

    norms: np.ndarray
    idf: np.ndarray
    beside: np.ndarray

    def times(self, v: np.ndarray) -> np.ndarray:
        terms = len(self.idf)
        sums = _row_sums(self.values * (self.idf * v[:terms]).take(self.places), self.ends)
        return sums / self.norms + self.beside @ v[terms:-1] + v[-1]

    def transposed(self, r: np.ndarray, size: int, square: bool = False) -> np.ndarray:
        norms, values, idf, beside = self.norms, self.values, self.idf, self.beside
        if square:
            norms, values, idf, beside = norms * norms, values * values.astype(float), idf * idf, beside * beside
        terms = len(idf)
        out = np.empty(size)
        out[:terms] = np.bincount(self.places, values * np.repeat(r / norms, np.diff(self.ends, prepend=0)), terms) * idf
        out[terms:-1] = r @ beside
        out[-1] = r.sum()
        return out


def stretches(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, row behind the last) of blocks of about ``BLOCK_ENTRIES`` entries; ``ends`` are those of the rows' entries."""
    row = 0
    while row < len(ends):
        upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + BLOCK_ENTRIES, "right")))
        yield row, upto
        row = upto


def narrow(numbers: np.ndarray, *kinds: type) -> np.ndarray:
    """Whole numbers in the first of ``kinds`` that holds them."""
    return numbers.astype(next(k for k in kinds if numbers.max(initial=0) <= np.iinfo(k).max))


def widened(cell: pa.BinaryScalar, n: int, kinds: dict[int, type]) -> np.ndarray:
    """``n`` numbers of a packed cell, a view; ``kinds`` by their bytes."""
    raw = cell.as_buffer()
    return np.frombuffer(raw, kinds[raw.size // n if n else min(kinds)])


def pack(rows: DataFrame) -> DataFrame:
    """A written table of sparse blocks of ``label`` and the vector column ``features``."""

    def block(labels: list, ends: list, indices: list, values: list) -> pa.RecordBatch:
        # Two bytes an index where they do.
        places = narrow(np.concatenate(indices), np.uint16, np.int32)
        raw = [np.concatenate(labels).astype(float), np.concatenate(ends), places, np.concatenate(values)]
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in raw], names=["label", "ends", "indices", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, _, indices, values = batch.column(1).flatten()
            labels, kinds = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0), kinds))
            lengths = np.diff(values.offsets.to_numpy())
            held = values.flatten().to_numpy(zero_copy_only=False).astype(float)
            places = np.zeros(len(held), np.int64)
            sparse = np.repeat(kinds == 0, lengths)
            places[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            places[~sparse] = (np.arange(len(held)) - np.repeat(starts, lengths))[~sparse]
            for row, upto in stretches(starts + lengths):
                a, b = starts[row], starts[upto - 1] + lengths[upto - 1]
                yield block([labels[row:upto]], [starts[row:upto] + lengths[row:upto] - a], [places[a:b]], [held[a:b]])

    # In Arrow a vector is a plain struct of type, size, indices and values.
    return durable(rows.select(F.col("label").cast("double").alias("label"), "features").mapInArrow(run, PACKED), "blocks")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*batch.columns):
            # Views of the batch, no copies.
            label, ends, _, values = (cell.as_buffer() for cell in row)
            values = np.frombuffer(values, float)
            yield Block(np.frombuffer(label, float), np.frombuffer(ends, np.int64), widened(row[2], len(values), {2: np.uint16, 4: np.int32}), values)


Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[Block]]


def term_reader(idf: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> Reader:
    """Reads tables of ``termblocks.packed_counts``; its columns beside come less ``shift`` and divided by ``scale``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for label, ends, indices, counts, norms, *beside in zip(*batch.columns):
                label, ends, norms = (np.frombuffer(c.as_buffer(), kind) for c, kind in ((label, float), (ends, np.int64), (norms, float)))
                n = int(ends[-1])
                places, values = widened(indices, n, {2: np.uint16, 4: np.int32}), widened(counts, n, {1: np.uint8, 4: np.int32})
                raw = np.frombuffer(beside[0].as_buffer(), float).reshape(len(label), -1) if beside else np.zeros((len(label), 0))
                yield TermBlock(label, ends, places, values, norms, idf, (raw - shift) / scale)

    return read


def tree_sum(blocks: DataFrame, partial: Callable[[Block], np.ndarray], size: int, fan_in: int = FAN_IN, read: Reader = _blocks) -> np.ndarray:
    """The sum of ``partial`` over all blocks; no task and not the driver adds more than about ``fan_in`` or the root of the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for block in read(batches):
            total += partial(block)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        parts = sorted(zip(rows.column("part").to_pylist(), rows.column("total").to_pylist()))
        return pa.table({"part": pa.array([parts[0][0]], pa.int32()), "total": pa.array([sum(np.frombuffer(t) for _, t in parts).tobytes()], pa.binary())})

    sums = blocks.mapInArrow(run, "total binary").withColumn("part", F.spark_partition_id())
    # The table stays as it is for all passes, so its files are listed once.
    blocks.tasks = tasks = getattr(blocks, "tasks", None) or len(blocks.inputFiles())
    if tasks > fan_in:
        sums = sums.groupBy((F.col("part") % int(np.sqrt(tasks))).alias("slot")).applyInArrow(add, "part int, total binary")
    found = sorted((r.part, r.total) for r in sums.select("part", "total").collect())
    return sum((np.frombuffer(t) for _, t in found), np.zeros(size))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


def _at(w: np.ndarray) -> Callable[[Block], np.ndarray]:
    """Loss, gradient and diagonal of the Hessian of the unpenalised sum over a block."""

    def partial(block: Block) -> np.ndarray:
        z = block.times(w)
        p = _sigmoid(z)
        loss = np.sum(np.maximum(z, 0) - z * block.label + np.log1p(np.exp(-np.abs(z))))
        size = len(w)
        return np.concatenate([[loss], block.transposed(p - block.label, size), block.transposed(p * (1 - p), size, square=True)])

    return partial


def _bend(w: np.ndarray, v: np.ndarray) -> Callable[[Block], np.ndarray]:
    """The Hessian at ``w`` of the unpenalised sum over a block, times ``v``."""

    def partial(block: Block) -> np.ndarray:
        p = _sigmoid(block.times(w))
        return block.transposed(p * (1 - p) * block.times(v), len(w))

    return partial


def _preconditioner(curvature: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The inverse of a matrix near the Hessian: the diagonal ``scale``, corrected by directions and their products, the latest last."""
    weights = [1.0 / (d @ hd) for d, hd in curvature]

    def apply(r: np.ndarray) -> np.ndarray:
        z = r.copy()
        shares = []
        for (d, hd), weight in zip(reversed(curvature), reversed(weights)):
            shares.append(weight * (d @ z))
            z -= shares[-1] * hd
        z /= scale
        for (d, hd), weight, share in zip(curvature, weights, reversed(shares)):
            z += (share - weight * (hd @ z)) * d
        return z

    return apply


def _step(product: Callable, g: np.ndarray, precondition: Callable, radius: float, accuracy: float, most: int) -> tuple[np.ndarray, np.ndarray, float, list]:
    """(s, H s, length of s, directions and products): conjugate gradients on H s = -g, ended at the trust region's edge."""
    s, hs = np.zeros_like(g), np.zeros_like(g)
    r = -g
    z = precondition(r)
    d, rz = z.copy(), r @ z
    first = np.sqrt(rz)
    seen = []
    # The region is a ball in the preconditioner's norm: squares and product of d and s in it.
    dd, ds, ss = rz, 0.0, 0.0
    for _ in range(most):
        hd = product(d)
        curve = d @ hd
        if curve > 0:
            seen.append((d, hd))
        step = rz / curve if curve > 0 else np.inf
        edge = (-ds + np.sqrt(max(ds * ds - dd * (ss - radius * radius), 0.0))) / dd
        if step >= edge:
            return s + edge * d, hs + edge * hd, radius, seen
        s, hs, r = s + step * d, hs + step * hd, r - step * hd
        ss += 2 * step * ds + step * step * dd
        z = precondition(r)
        rz, before = r @ z, rz
        if not rz > (accuracy * first) ** 2:
            break
        turn = rz / before
        d = z + turn * d
        ds, dd = turn * (ds + step * dd), rz + turn * turn * dd
    return s, hs, np.sqrt(ss), seen


def fit_logistic(rows: DataFrame, size: int, penalty: float = 1.0, tolerance: float = TOLERANCE) -> Fit:
    """``fit_blocks`` on rows of ``label`` (0 or 1) and vectors ``features`` of ``size`` entries, which are packed first."""
    blocks = pack(rows)
    fit = fit_blocks(blocks, size, penalty, tolerance)
    discard(blocks)
    return fit


def fit_blocks(blocks: DataFrame, size: int, penalty: float = 1.0, tolerance: float = TOLERANCE, read: Reader = _blocks, after: Fit | None = None) -> Fit:
    """Weights and intercept that minimise the summed loss plus half the squared weights times ``penalty``; the intercept is free.

    Ends when the gradient is shorter than ``tolerance`` (or than what sums in doubles over so many rows resolve), and warns if it doesn't get there.
    ``after``: a fit to the same rows with the first of their features alone, from which this one goes on. The optimum is one, however it is come by.
    """
    n = size + 1
    ridge = np.full(n, penalty)
    ridge[-1] = 0.0
    passes = 0

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        nonlocal passes
        passes += 1
        total = tree_sum(blocks, _at(w), 2 * n + 1, read=read)
        return total[0] + 0.5 * (ridge * w) @ w, total[1 : n + 1] + ridge * w, total[n + 1 :] + ridge

    def product(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return tree_sum(blocks, _bend(w, v), n, read=read) + ridge * v

    def longer(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v[:-1], np.zeros(n - len(v)), v[-1:]])

    w = longer(np.append(after.weights, after.intercept)) if after else np.zeros(n)
    # At least a few products, or as many as fit.
    room = max(8, CURVATURE_BYTES // (16 * n))
    curvature = [(longer(d), longer(hd)) for d, hd in after.curvature][-room:] if after else []
    loss, g, scale = at(w)
    start = (after and after.steepest) or np.linalg.norm(g)
    # Rounding of the sums grows with the loss, which is n * log(2) at zero weights.
    limit = max(tolerance, 1e-14 * loss)
    radius = np.inf
    taken = 0
    while np.linalg.norm(g) > limit and taken < MAX_ITERATIONS:
        taken += 1
        # Later steps are solved more exactly, so the last ones converge faster than by a constant factor; no step needs to pass the limit by far.
        steep = np.linalg.norm(g)
        accuracy = max(min(0.1, np.sqrt(steep / start)), 0.1 * limit / steep)
        diagonal = np.maximum(scale, 1e-12)
        precondition = _preconditioner(curvature, diagonal)
        if not g @ precondition(g) > 0:  # lost to rounding
            curvature, precondition = [], _preconditioner([], diagonal)
        s, hs, length, seen = _step(functools.partial(product, w), g, precondition, radius, accuracy, 10 * n)
        curvature = (curvature + seen)[-room:]
        expected = -(g @ s + 0.5 * s @ hs)
        new = at(w + s)
        # Near the optimum both changes drown in rounding; the gradient decides there.
        gained, noise = loss - new[0], 1e-13 * abs(loss)
        good = gained >= 0.1 * expected - noise
        if gained < 0.25 * expected - noise:
            radius = 0.25 * length
        elif gained > 0.75 * expected:
            radius = max(radius, 2 * length)
        if good:
            w = w + s
            loss, g, scale = new
    left = float(np.linalg.norm(g))
    if left > limit:
        warnings.warn(f"the fit stopped after {taken} steps with a gradient of {left:.1e}", stacklevel=2)
    return Fit(w[:-1], float(w[-1]), FitSummary(taken, passes, left), float(start), tuple(curvature))
