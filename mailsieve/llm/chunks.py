"""Counting keys over the whole corpus by asking for them in packed blocks.

Texts are packed into chunks of a few megabytes, one table row each. A chunk asks for its distinct keys: they
are sorted, cut at fixed limits of the key space, and every piece becomes one row (range, chunk, packed
numbers). A range gathers its pieces from all chunks, adds them up, and answers each piece with
one packed row of the same order. So a key costs a chunk one entry however often it occurs there, a key that
all chunks hold is spread over rows of equal size, and nobody ever holds all keys.

The number of ranges follows ``spark.sql.shuffle.partitions``: set that so that a range's share of the keys
fits a task, as for any other aggregation.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm import bytewords as bw
from mailsieve.operators.durable import durable

CHUNK_BYTES = 1 << 22
#: Rows go to Spark in batches of about so many bytes.
BATCH_BYTES = 1 << 20
#: Entries of an array that tell in which form it is compressed.
TRIED = 1 << 12
CHUNKS = "chunk long, doc_ids array<long>, flags array<boolean>, lengths array<long>, text binary"
ASKS = "range int, chunk long, ask binary"
REPLIES = "chunk long, range int, kind int, reply binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one byte string, each as planes of equal bytes, which the shuffle compresses well."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        parts.append(_planes(np.ascontiguousarray(a)).tobytes())
    return b"".join(parts)


def _planes(a: np.ndarray) -> np.ndarray:
    """Planes of equal bytes, copied plane by plane, which is faster than the transposed copy."""
    held = a.view(np.uint8).reshape(len(a), a.dtype.itemsize)
    out = np.empty(held.shape[::-1], np.uint8)
    for k in range(a.dtype.itemsize):
        out[k] = held[:, k]
    return out


def _of_planes(data: np.ndarray, dtype: np.dtype, n: int) -> np.ndarray:
    out = np.empty((n, dtype.itemsize), np.uint8)
    for k in range(dtype.itemsize):
        out[:, k] = data[k * n : (k + 1) * n]
    return out.view(dtype).reshape(-1)


def squeeze(*arrays: np.ndarray) -> bytes:
    """``pack`` with each array compressed, as planes or as it is, whichever is shorter for ``TRIED`` entries. No packed form starts like it."""
    parts, packer = [b"\x00" + struct.pack("<B", len(arrays))], zstandard.ZstdCompressor(level=1)
    for a in map(np.ascontiguousarray, arrays):
        part = a[(len(a) - TRIED) // 2 :][:TRIED] if len(a) > TRIED else a
        tried = [packer.compress(_planes(part)), packer.compress(part)]
        form = int(len(tried[1]) <= len(tried[0]))
        held = tried[form] if len(part) == len(a) else packer.compress(a if form else _planes(a))
        parts += [struct.pack("<2sQBQ", a.dtype.str[1:].encode(), len(a), form, len(held)), held]
    return b"".join(parts)


def _unsqueeze(packed: bytes) -> list[np.ndarray]:
    out, at, unpacker = [], 2, zstandard.ZstdDecompressor()
    for _ in range(packed[1]):
        kind, n, form, size = struct.unpack_from("<2sQBQ", packed, at)
        dtype = np.dtype("<" + kind.decode())
        data = np.frombuffer(unpacker.decompress(packed[at + 19 : at + 19 + size]), np.uint8)
        out.append(data.view(dtype) if form else _of_planes(data, dtype, n))
        at += 19 + size
    return out


def unpack(packed: bytes) -> list[np.ndarray]:
    if packed[0] == 0 and len(packed) > 1:
        return _unsqueeze(packed)
    out, at = [], 1
    for _ in range(packed[0]):
        kind, n = struct.unpack_from("<2sQ", packed, at)
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(packed, np.uint8, n * dtype.itemsize, at + 10)
        out.append(_of_planes(planes, dtype, n))
        at += 10 + n * dtype.itemsize
    return out


def pack_texts(chunk_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, task = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        for k, (rows, data, offsets) in enumerate(bw.text_blocks(batches, "text", chunk_bytes)):
            columns = [[(task << 32) | k], [rows.column(0)], [rows.column(1)], [np.diff(offsets)], [packer.compress(data.tobytes())]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array([v[0].to_pylist()] if isinstance(v[0], pa.Array) else v, t) for v, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "doc_ids", "flags", "lengths", "text"])

    return run


def write_chunks(docs: DataFrame, flag: F.Column | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A written table of packed texts with their ids and a flag each, whole texts only.

    A chunk's number is fixed by the table, so later passes and repeated tasks agree on it.
    """
    return durable(packed_chunks(docs, flag, chunk_bytes), "chunks")


def packed_chunks(docs: DataFrame, flag: F.Column | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``write_chunks`` before it is written, for callers that write something else made of it."""
    flag = F.lit(False) if flag is None else flag
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("flag"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(pack_texts(chunk_bytes), CHUNKS)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in batches of about ``BATCH_BYTES``, one row at least: Spark holds a whole one outside its heap."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


class Chunk:
    """One unpacked chunk: ids, flags, bytes and offsets; ``state`` is what a join has added to its row."""

    def __init__(self, row: dict):
        self.number, self.doc_ids, self.state = row["chunk"], row["doc_ids"], row.get("state")
        self.flags = np.array(row["flags"], bool)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))]).astype(np.int64)
        self.packed = row["text"]

    @functools.cached_property
    def data(self) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed), np.uint8)


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted keys pass from range to range (ranges + 1 places)."""
    limits = np.array([((r << 64) // ranges) for r in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]]).astype(np.int64)


def ask_batch(chunk: int, ranges: int, keys: np.ndarray, *values: np.ndarray, form: Callable = pack) -> pa.RecordBatch:
    """The pieces of one chunk, packed by ``form``; ``keys`` are sorted."""
    at = cuts(keys, ranges)
    full = np.flatnonzero(at[1:] > at[:-1])
    asks = [form(*(v[at[r] : at[r + 1]] for v in (keys, *values))) for r in full]
    arrays = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk)), pa.array(asks, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["range", "chunk", "ask"])


def reply_table(chunks: list[int | None], of_range: int, kind: int, packed: list[bytes]) -> pa.Table:
    """Rows of a range's replies, in batches as ``slices`` cuts them."""
    n = len(chunks)
    rows = pa.RecordBatch.from_pydict({
        "chunk": pa.array(chunks, pa.int64()), "range": pa.array([of_range] * n, pa.int32()),
        "kind": pa.array([kind] * n, pa.int32()), "reply": pa.array(packed, pa.binary()),
    })
    return pa.Table.from_batches(slices(rows), rows.schema)


def merge(asks: DataFrame, kind: int, answer: Callable[[list[np.ndarray]], tuple[np.ndarray, bytes | None]], form: Callable = pack) -> DataFrame:
    """A written table of replies. ``answer`` gets the joined arrays of a range, in order of chunks, and returns an
    array with an entry for each of theirs, and optionally a summary, kept in a row without a chunk."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # The order of the pieces is not the same in every run; that of the chunks is.
        pieces = sorted(zip(table.column("chunk").to_pylist(), table.column("ask").to_pylist()))
        arrays = [unpack(p[1]) for p in pieces]
        sizes = [len(a[0]) for a in arrays]
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        reply, summary = answer([*(np.concatenate(v) for v in zip(*arrays)), chunk])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        numbers = [p[0] for p in pieces]
        packed = [form(reply[a:b]) for a, b in zip(upto[:-1], upto[1:])]
        if summary is not None:
            numbers, packed = [*numbers, None], [*packed, summary]
        return reply_table(numbers, key[0].as_py(), kind, packed)

    return durable(asks.groupBy("range").applyInArrow(run, REPLIES), "replies", form is squeeze)


def replies_of(table: pa.Table) -> dict[int, np.ndarray]:
    """Answers by kind, in the order in which the chunk asked."""
    out: dict[int, list] = {}
    for row in sorted(table.select(["kind", "range", "reply"]).to_pylist(), key=lambda r: (r["kind"], r["range"])):
        out.setdefault(row["kind"], []).append(unpack(row["reply"])[0])
    return {k: np.concatenate(v) for k, v in out.items()}


def answered(replies: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``body(number of a chunk, replies by kind)`` gives a record batch for every chunk that has answers."""

    def run(key: tuple, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([body(key[0].as_py(), replies_of(answers))])

    return replies.where("chunk IS NOT NULL").groupBy("chunk").applyInArrow(run, schema)


def with_replies(chunks: DataFrame, replies: list[DataFrame], body: Callable, schema: str) -> DataFrame:
    """``body(chunk, replies by kind)`` gives record batches for every chunk together with its answers.

    Only answers are shuffled if the chunks lie in buckets of their numbers.
    """
    every = replies[0]
    for r in replies[1:]:
        every = every.unionByName(r)

    def run(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        found = replies_of(answers)
        out = [batch for row in own.to_pylist() for batch in body(Chunk(row), found)]
        return pa.Table.from_batches(out) if out else empty

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(T._parse_datatype_string(schema)).empty_table()
    answers = every.where("chunk IS NOT NULL")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def each_chunk(chunks: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``body(chunk)`` gives record batches for every chunk, without any answers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for found in body(Chunk(batch.slice(k, 1).to_pylist()[0])):
                    yield from slices(found)

    return chunks.mapInArrow(run, schema)
