"""Words and their hashes straight from Arrow text buffers, vectorised over a few megabytes at a time.

Texts are UTF-8 bytes. Both word rules used here are decided byte by byte (no byte above 0x7F is ever
a separator), so no text is decoded. A word's hash is a polynomial over its bytes modulo 2**64, finished
by a mixing step; equal words always agree, and two different ones agree with a chance of about 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))

# Separators are tab to carriage return and the blank; ASCII letters and digits beside
# all bytes above 0x7F make an alphanumeric word.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes hashed at a time.
STRETCH = 1 << 18

#: Whether this task has set aside what its worker loaded. The library travels with the tasks, so each of them has this list afresh.
_kept: list[bool] = []

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; kept while they stay small."""
    if len(_powers["up"]) < n:
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, INVERSE)]), dtype=np.uint64)
        if n > 1 << 23:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finish)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums) + 1)
    return (sums[end] - sums[start]) * down[start]


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 1 << 21
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with about ``max_bytes`` of text each; a longer single text stands alone.

    A null text counts as empty. Texts are never cut.
    """
    try:
        yield from _blocks(batches, column, max_bytes)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: idle workers stay alive beside the tasks that follow.

    What is loaded by a task's first call is set aside, so later calls don't search it again. What the task before
    set aside is searched first: its copy of the library would stay with all that it remembers.
    """
    first = not _kept and TaskContext.get() is not None
    if first:
        gc.unfreeze()
    gc.collect()
    if first:
        gc.freeze()
        _kept.append(True)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _blocks(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        if not len(texts):
            continue
        raw = texts.buffers()
        ends = np.frombuffer(raw[1], np.int64 if wide else np.int32)
        ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            upto = max(row + 1, int(np.searchsorted(ends, ends[row] + max_bytes, "right")) - 1)
            upto = min(upto, len(texts))
            yield batch.slice(row, upto - row), data[ends[row] : ends[upto]], ends[row : upto + 1] - ends[row]
            row = upto


def word_spans(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in order, and for each text the index of its first word (n + 1 entries).

    Words never reach over the end of a text.
    """
    inside = rule[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    ends[edges[1:] - 1] = inside[edges[1:] - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, never 0. ``start`` is ascending.

    Works on stretches of ``STRETCH`` bytes that begin and end with words, so the running sums stay small; only
    a longer single word makes one of its own length.
    """
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        base = start[first]
        last = max(first + 1, int(np.searchsorted(end, base + STRETCH, "right")))
        sums = prefix_sums(data[base : end[last - 1]])
        out[first:last] = range_hashes(sums, start[first:last] - base, end[first:last] - base)
        first = last
    out = mix(out)
    out[out == 0] = np.uint64(1)
    return out


def stable_order(values: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes, by one sort of plain numbers: leading bits with the place behind them."""
    mask = np.uint64((1 << max(len(values) - 1, 1).bit_length()) - 1)
    packed = values & ~mask
    packed |= np.arange(len(values), dtype=np.uint64)
    packed.sort()
    packed &= mask
    order = packed.view(np.int64)
    held = values[order]
    # Different hashes seldom have equal leading bits.
    return order if np.all(held[1:] >= held[:-1]) else np.argsort(values, kind="stable")


def distinct_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct 64-bit hashes in order, place of the first one of each, which of them each value is)."""
    order = stable_order(values)
    held = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return held[new], order[new], which


def distinct_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers in order, how often each one comes)."""
    held = np.sort(values)
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(held), 1), bool), held[1:] != held[:-1]]))
    return held[starts], np.diff(np.append(starts, len(held)))


def join_hashes(words: np.ndarray, count: int) -> np.ndarray:
    """Hash of ``count`` consecutive words at each place where that many follow (len - count + 1)."""
    n = len(words) - count + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(count):
        out *= BASE
        out += words[i : i + n]
    return mix(out)


def whole(first: np.ndarray, count: int, n: int) -> np.ndarray:
    """True where a window of ``count`` words that starts at word i stays inside its text (n flags)."""
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + count <= last


def take_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each range, joined."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def long_list(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)
