"""Vector codes: every vector as four indexes into codebooks that are fitted with Drake-Hamerly adaptive bounds.

A vector becomes integers, floor(1024 * x), and is cut into four equal parts. The codebook of a part position starts as that part
of the 256 vectors with the least ids. Each round assigns every part to its nearest entry (ties to the lower index) and replaces
each entry by the floors of its parts' means; after the last round the parts are assigned once more.

An assignment doesn't measure all entries. The written state of a part holds its ``b`` closest entries in order, the nearest first, a lower
bound of the distance to each of the others, and one outer bound for all entries that aren't listed. When entries move, a
listed bound shrinks by its own entry's movement, the outer one by the greatest movement. The distance to the present entry is
measured in integers; only listed entries whose bound doesn't clear it are measured too, and only where the
outer bound doesn't clear the best of them are all entries. Bounds are rounded down and must be cleared by a margin; whatever is
not cleared is decided by integers, so the result is that of the full search. ``b`` starts at ``LISTED`` and shrinks to
what the last round used.

A round is a scan of one written table into the next, which replaces it, and one aggregation of sums that are combined in each task
(entries x components rows). Only codebooks, sums and a histogram of list lengths reach the driver; their size depends on the dimension alone.

Defined cases: rows whose vector is null or holds null or non-finite components are left out. Vectors shorter than the longest, and a length that
isn't a multiple of four, are filled up with zeros. A component beyond +-2**26 after scaling counts as that. With fewer than 256 rows the codebooks have
that many entries; null ids come last in their order and repeated ids are ordered by their vectors. Repeated rows each count. An empty table gives
no rows and empty codebooks. Only the id, the vector and the columns named in ``keep`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.operators.durable import discard, durable
from mailsieve.operators.joins import bounded_lookup

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 26
#: Listed entries of a part at first and at least; a list serves this share of the parts that need no full search.
LISTED, LEAST_LISTED, SERVED = 8, 2, 0.98
#: Rows worked on at a time.
BLOCK = 2048
EXACT = float(1 << 53)


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Floors of the scaled components; null where a vector is null or has a null or non-finite component."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    cut = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return F.when(~broken, cut)


@dataclass
class Codebooks:
    """``entries[part, index]`` is a list of integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry, as exact integers."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if x.shape[1] * (2.0 * most) ** 2 < EXACT:
        # Sums of integers below 2**53 are exact in doubles.
        a, e = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] + (e * e).sum(1) - 2 * (a @ e.T)).astype(np.int64)
    return np.stack([np.square(x - e).sum(1) for e in entries], 1)


def _apart(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x - entries
    return np.einsum("ij,ij->i", d, d)


def _full(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(the b closest entries, bounds of all but the first and of the rest) from all distances."""
    d = distances(x, entries)
    k = len(entries)
    take = min(b + 1, k)
    if d.max(initial=0) < 1 << 53 and k <= 256:
        # The index rides along below the distance, so one partition finds both and ties go to the lower index.
        packed = d * 256 + np.arange(k)
        nearest = np.sort(np.partition(packed, take - 1, axis=1)[:, :take], axis=1)
        ids, d = nearest & 255, nearest >> 8
    else:
        ids = np.argsort(d, axis=1, kind="stable")[:, :take]
        d = np.take_along_axis(d, ids, 1)
    low = np.full((len(x), b), np.inf)
    low[:, : take - 1] = np.sqrt(d[:, 1:])
    return ids[:, :b], low


def reassign(
    x: np.ndarray, entries: np.ndarray, moved: np.ndarray, near: np.ndarray, low: np.ndarray, b: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, low, squared distance, list places used) of parts whose state is from before the entries ``moved``.

    ``near`` has the closest entry first; ``low[:, j]`` bounds ``near[:, j + 1]`` and the last column all that aren't listed.
    A part that needs the full search has used one place more than the list has.
    """
    had = near.shape[1]
    low = low.astype(float)
    low[:, : had - 1] -= moved[near[:, 1:]]
    low[:, had - 1] -= moved.max(initial=0)
    exact = np.full(near.shape, np.iinfo(np.int64).max)
    exact[:, 0] = _apart(x, entries[near[:, 0]])
    clear = lambda d: np.sqrt(d) * (1 + 1e-9) + 1e-9
    row, place = np.nonzero(low[:, : had - 1] <= clear(exact[:, 0])[:, None])
    exact[row, place + 1] = _apart(x[row], entries[near[row, place + 1]])
    used = np.zeros(len(x), np.int64)
    np.maximum.at(used, row, place + 1)
    best = exact.min(axis=1)
    tied = np.where(exact == best[:, None], near, len(entries))
    first = tied.argmin(axis=1)
    bound = np.concatenate([np.full((len(x), 1), np.inf), low[:, : had - 1]], axis=1)
    measured = exact != np.iinfo(np.int64).max
    bound[measured] = np.sqrt(exact[measured])
    bound[np.arange(len(x)), first] = -np.inf
    order = np.argsort(bound, axis=1, kind="stable")
    near, bound = np.take_along_axis(near, order, 1), np.take_along_axis(bound, order, 1)
    outer = low[:, had - 1]
    if b < had:
        outer = np.minimum(outer, bound[:, b])
    out = np.concatenate([bound[:, 1:b], outer[:, None]], axis=1)
    near = near[:, :b].copy()
    lost = np.flatnonzero(low[:, had - 1] <= clear(best))
    if len(lost):
        near[lost], out[lost] = _full(x[lost], entries, b)
        used[lost] = had
        best[lost] = _apart(x[lost], entries[near[lost, 0]])
    return near, out, best, used


def _rounded_down(low: np.ndarray) -> np.ndarray:
    return np.where(np.isinf(low), low, np.nextafter(low.astype(np.float32), np.float32(-np.inf))).astype(np.float32)


def _matrix(column: pa.Array, n: int, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(dtype)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _state_step(books: np.ndarray, moved: np.ndarray | None, b: int, width: int, kept: list[str]):
    """Turns rows (kept, ints) or (kept, ints, near, low) into (kept, ints, near, low, error, used)."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        ints = batch.column(batch.schema.get_field_index("_ints"))
        x = _matrix(ints, n, np.int64).reshape(n, PARTS, width)
        if moved is not None:
            old = _matrix(batch.column(batch.schema.get_field_index("_near")), n, np.int64).reshape(n, PARTS, -1)
            bounds = _matrix(batch.column(batch.schema.get_field_index("_low")), n, np.float32).reshape(n, PARTS, -1)
        near, low = np.empty((n, PARTS, b), np.int64), np.empty((n, PARTS, b), np.float32)
        error, used = np.zeros(n, np.int64), np.zeros((n, PARTS), np.int64)
        for p in range(PARTS):
            part = np.ascontiguousarray(x[:, p])
            if moved is None:
                near[:, p], wide = _full(part, books[p], b)
                far = _apart(part, books[p][near[:, p, 0]])
            else:
                near[:, p], wide, far, used[:, p] = reassign(part, books[p], moved[p], old[:, p], bounds[:, p], b)
            low[:, p] = _rounded_down(wide)
            error += far
        carried = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        columns = [_lists(near.reshape(n, -1), pa.int16()), _lists(low.reshape(n, -1), pa.float32()), pa.array(error), _lists(used, pa.int16())]
        return pa.RecordBatch.from_arrays([*carried, ints, *columns], names=[*kept, "_ints", "_near", "_low", "_error", "_used"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(at, BLOCK))

    return run


def _sums(k: int, width: int, b: int):
    """One row per number of a task: (part, entry, place, total); place -1 counts, part -1 is the histogram of used places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((PARTS, k, width + 1), np.int64)
        places = np.zeros(b + 1, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(0), n, np.int64).reshape(n, PARTS, width)
            nearest = _matrix(batch.column(1), n, np.int64).reshape(n, PARTS, -1)[:, :, 0]
            for p in range(PARTS):
                np.add.at(totals[p, :, 1:], nearest[:, p], x[:, p])
                totals[p, :, 0] += np.bincount(nearest[:, p], minlength=k)
            places += np.bincount(_matrix(batch.column(2), n, np.int64).ravel(), minlength=b + 1)[: b + 1]
        part, entry, place = (v.ravel() for v in np.indices(totals.shape))
        numbers = [np.concatenate([a, v]) for a, v in ((part, np.full(b + 1, -1)), (entry, np.arange(b + 1)), (place - 1, np.full(b + 1, -1)), (totals.ravel(), places))]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in numbers], names=["part", "entry", "place", "total"])

    return run


def _moved(books: np.ndarray, state: DataFrame, b: int) -> tuple[np.ndarray, int]:
    """The entries' new places, and the list length that would have served ``SERVED`` of the parts."""
    _, k, width = books.shape
    found = state.select("_ints", "_near", "_used").mapInArrow(_sums(k, width, b), "part long, entry long, place long, total long")
    rows = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
    totals, places = np.zeros((PARTS, k, width + 1), np.int64), np.zeros(b + 1, np.int64)
    for r in rows:
        if r.part < 0:
            places[r.entry] = r.total
        else:
            totals[r.part, r.entry, r.place + 1] = r.total
    counts = totals[:, :, :1]
    new = np.where(counts > 0, totals[:, :, 1:] // np.maximum(counts, 1), books)
    listed = np.cumsum(places[:b])
    enough = int(np.searchsorted(listed, SERVED * listed[-1])) + 1
    return new, min(b, max(LEAST_LISTED, enough))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), entries: int = ENTRIES, rounds: int = ROUNDS, listed: int = LISTED
) -> tuple[DataFrame, Codebooks]:
    """(id, keep, codes array<int>, error) of every whole vector, and the codebooks.

    ``error`` is the squared distance of the integers to the entries of their codes.
    """
    carried = [F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep))]
    kept = ["_id", *(f"_keep{i}" for i in range(len(keep)))]
    whole = vectors.select(*carried, integers(F.col(vector)).alias("_ints")).where("_ints IS NOT NULL")
    longest = whole.agg(F.max(F.size("_ints"))).first()[0]
    width = -(-(longest or 0) // PARTS)
    filled = F.concat("_ints", F.array_repeat(F.lit(0), F.lit(width * PARTS) - F.size("_ints")))
    table = durable(whole.withColumn("_ints", filled), "vectors")
    first = [r._ints for r in table.select("_id", "_ints").orderBy(F.col("_id").asc_nulls_last(), "_ints").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    spark_types = {f.name: f.dataType for f in table.schema}
    schema = T.StructType(
        [T.StructField(c, spark_types[c]) for c in [*kept, "_ints"]]
        + [T.StructField("_near", T.ArrayType(T.ShortType())), T.StructField("_low", T.ArrayType(T.FloatType()))]
        + [T.StructField("_error", T.LongType()), T.StructField("_used", T.ArrayType(T.ShortType()))]
    )
    b = min(listed, len(first))
    state, moved = table, None
    if first and width:
        for step in range(rounds + 1):
            after = durable(state.mapInArrow(_state_step(books, moved, b, width, kept), schema), "codes")
            discard(state)
            state = after
            if step < rounds:
                new, shorter = _moved(books, state, b)
                # A list may only shrink once its use has been seen; the first round searched in full.
                b = shorter if step else b
                moved = np.sqrt(np.square(new - books).sum(axis=2)) * (1 + 1e-9) + 1e-9
                books = new
        codes = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.get("_near", p * b).cast("int"))
        out = state.withColumn("codes", codes)
    else:
        out = table.withColumns({"codes": F.array_repeat(F.lit(0), PARTS), "_error": F.lit(0).cast("long")})
    names = [F.col("_id").alias(id_col), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep))]
    return out.select(*names, "codes", F.col("_error").alias("error")), Codebooks(books)


def code_string(codes: Column | str = "codes") -> Column:
    """Two lowercase hex digits for each index, in the order of the parts."""
    return F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")


def digest(rows: DataFrame, books: Codebooks, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256); errors are summed per label, nulls together."""
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    keyed = rows.select(id_col, code_string().alias("code"), "error", key.alias("_label"))
    sums = durable(keyed.groupBy("_label").agg(F.sum("error").alias("label_error")), "label-errors")
    joined = bounded_lookup(keyed, sums, "_label", sums.count(), "left")
    return joined.select(id_col, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
