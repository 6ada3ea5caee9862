"""Removal of repeated byte strings by bucket refinement over sampled suffixes.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the corpus goes. The
suffixes of all texts are put into buckets that are refined until each is settled:

1. Initial buckets: the q-gram (50 bytes) at sampled offsets. Of the q-grams in each 200-byte window the one of
   least hash is taken, so equal windows choose the same offset. A window whose q-gram stands
   nowhere else is settled, which holds for nearly all of a corpus.
2. The other windows are refined by the bucket identifiers of longer strings around that offset. Runs of up
   to 19 neighbouring windows share their common core (182 bytes) and have a hull (all their bytes).
   A core that stands alone settles its windows as unique, a hull that stands twice as repeated.
3. Only windows between the two, at the ends of a repetition, are compared one by one, each hull of the same
   core once.

A bucket's identifier is a 64-bit name of its content, so identifiers made in different tasks agree and those
of an earlier step are used again. Buckets meet in ranges of identifiers (``chunks``), where
they are sorted and counted; the members of a bucket are never listed against each other.

Defined cases: null and empty texts have nothing removed; a text shorter than ``length`` is never
touched; equal texts of at least that length are removed whole, all copies; a null doc_id is reported as
null; repeated rows count as copies of each other; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailsieve.llm import bytewords as bw
from mailsieve.llm import chunks as ch

LENGTH = 200
GRAM = 50
GROUP = 19
#: Windows handled at a time; the hash keeps 64 - SEGMENT_BITS bits when the least q-gram is sought.
SEGMENT_BITS = 21
SEGMENT = 1 << 20


class Windows:
    """The windows of a chunk, each with the offset of its sampled q-gram."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.length, self.gram, self.offsets = length, gram, offsets
        self.sums = bw.prefix_sums(data)
        n = max(0, len(data) - length + 1)
        self.owner = np.zeros(n, np.int32 if len(data) < 1 << 31 else np.int64)
        reach = length - gram + 1
        low = np.uint64((1 << SEGMENT_BITS) - 1)
        for s in range(0, n, SEGMENT):
            size = min(SEGMENT, n - s)
            at = np.arange(s, s + size + reach - 1)
            key = (self.names(at, at + gram) & ~low) | (at - s).astype(np.uint64)
            width = 1
            while width * 2 <= reach:
                key = np.minimum(key[: len(key) - width], key[width:])
                width *= 2
            key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
            self.owner[s : s + size] = (key[:size] & low).astype(np.int64) + s
        # Windows that reach over the end of their text don't count.
        self.valid = np.ones(n, bool)
        for end in offsets[1:-1].tolist():
            self.valid[max(0, end - length + 1) : end] = False

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return bw.mix(bw.range_hashes(self.sums, start, end))

    def anchors(self) -> np.ndarray:
        """Distinct sampled offsets of the valid windows, in order."""
        own = self.owner[self.valid]
        return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own

    def units(self, able: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, name of the core, name of the hull) of each run of able windows
        with one sampled offset and one group of distances to it."""
        p = np.flatnonzero(able)
        a = self.owner[p].astype(np.int64)
        block = (a - p) // group
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (a[1:] != a[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(p)]]).astype(np.int64) - 1 if len(p) else first
        a, block, one, end = a[first], block[first], p[first], p[last]
        core_at = a - block * group
        salt = bw.mix(block.astype(np.uint64) + np.uint64(1))
        core = bw.mix(self.names(core_at, core_at - group + 1 + self.length) ^ salt)
        hull = bw.mix(self.names(one, end + self.length) + bw.mix(((a - end) * 4096 + (a - one)).astype(np.uint64)))
        return one, end, core, hull


def summed(keys: np.ndarray, tags: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct keys, how often each occurs (1 or 2 for more) and its tag, 0 where tags differ."""
    if tags is None:
        keys, counts = np.unique(keys, return_counts=True)
        return [keys, np.minimum(counts, 2).astype(np.uint8)]
    order = np.lexsort([tags, keys])
    keys, tags = keys[order], tags[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(keys)]]).astype(np.int64) - 1 if len(keys) else first
    tag = np.where(tags[first] == tags[last], tags[first], np.uint64(0))
    return [keys[first], np.minimum(last - first + 1, 2).astype(np.uint8), tag]


TWICE, MIXED, CHOSEN = 1, 2, 4


def count_answer(arrays: list[np.ndarray]) -> tuple[np.ndarray, None]:
    """For every entry: does its key stand twice, has it different tags, is this its first chunk?"""
    keys, counts, *tags, chunk = arrays
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(which, counts, len(distinct))
    reply = np.where(total[which] >= 2, TWICE, 0).astype(np.uint8)
    if tags:
        tag = tags[0]
        mixed = np.zeros(len(distinct), bool)
        mixed[which[(tag == 0) | (tag != tag[first][which])]] = True
        reply |= np.where(mixed[which], MIXED, 0).astype(np.uint8)
        chosen = np.zeros(len(keys), bool)
        chosen[first] = True
        reply |= np.where(chosen, CHOSEN, 0).astype(np.uint8)
    return reply, None


def told(asked: np.ndarray, reply: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """The answers for ``keys``, all of which are among the sorted distinct ``asked`` ones."""
    return reply[np.searchsorted(asked, keys)] if len(keys) else np.zeros(0, np.uint8)


class Search:
    """What a chunk knows after each round; later rounds repeat the earlier ones from their answers."""

    def __init__(self, length: int, gram: int, group: int, ranges: int):
        self.length, self.gram, self.group, self.ranges = length, gram, group, ranges

    def windows(self, chunk: ch.Chunk) -> Windows:
        return Windows(chunk.data, chunk.offsets, self.length, self.gram)

    def ask_grams(self, chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
        w = self.windows(chunk)
        at = w.anchors().astype(np.int64)
        yield ch.ask_batch(chunk.number, self.ranges, *summed(w.names(at, at + self.gram)))

    def open_units(self, w: Windows, replies: dict) -> tuple:
        """The runs of windows whose q-gram stands elsewhere, too."""
        at = w.anchors().astype(np.int64)
        names = w.names(at, at + self.gram)
        twice = told(np.unique(names), replies.get(1), names) & TWICE > 0
        repeated = np.zeros(len(w.sums), bool)
        repeated[at[twice]] = True
        return w.units(w.valid & repeated[w.owner], self.group)

    def ask_units(self, chunk: ch.Chunk, replies: dict) -> Iterator[pa.RecordBatch]:
        _, _, core, hull = self.open_units(self.windows(chunk), replies)
        yield ch.ask_batch(chunk.number, self.ranges, *summed(np.concatenate([core, hull]), np.concatenate([hull, hull])))

    def judge(self, w: Windows, replies: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last) of the units, those settled as repeated, and the windows to be looked up one by one."""
        one, end, core, hull = self.open_units(w, replies)
        asked = np.unique(np.concatenate([core, hull]))
        of_core, of_hull = told(asked, replies.get(2), core), told(asked, replies.get(2), hull)
        repeated = of_hull & TWICE > 0
        single = ~repeated & (of_core & TWICE > 0)
        # A repeated hull is shown once for the others that share its core.
        shown = np.zeros(len(hull), bool)
        shown[np.unique(hull, return_index=True)[1]] = True
        shown &= repeated & (of_hull & CHOSEN > 0) & (of_core & MIXED > 0)
        send = single | shown
        return one, end, repeated, bw.take_ranges(one[send], end[send] - one[send] + 1)

    def ask_windows(self, chunk: ch.Chunk, replies: dict) -> Iterator[pa.RecordBatch]:
        w = self.windows(chunk)
        at = self.judge(w, replies)[3]
        yield ch.ask_batch(chunk.number, self.ranges, *summed(w.names(at, at + self.length)))

    def covered(self, chunk: ch.Chunk, replies: dict) -> np.ndarray:
        """True for every byte that goes."""
        w = self.windows(chunk)
        one, end, repeated, at = self.judge(w, replies)
        names = w.names(at, at + self.length)
        at = at[told(np.unique(names), replies.get(3), names) & TWICE > 0]
        delta = np.zeros(len(chunk.data) + 1, np.int32)
        np.add.at(delta, one[repeated], 1)
        np.add.at(delta, end[repeated] + self.length, -1)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + self.length, -1)
        return np.cumsum(delta[:-1]) > 0

    def results(self, texts: bool):
        def run(chunk: ch.Chunk, replies: dict) -> Iterator[pa.RecordBatch]:
            gone = self.covered(chunk, replies)
            edge = np.zeros(len(gone) + 1, bool)
            edge[chunk.offsets] = True
            begins = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
            ends = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            doc = np.searchsorted(chunk.offsets, begins, "right") - 1
            n = len(chunk.offsets) - 1
            raw = chunk.data.tobytes()
            removed = np.bincount(doc, ends - begins, n).astype(np.int64)
            spans = np.bincount(doc, minlength=n)
            at = np.searchsorted(doc, np.arange(n + 1))
            kept = []
            for d in range(n):
                a, parts = int(chunk.offsets[d]), []
                for k in range(at[d], at[d + 1]):
                    parts.append(raw[a : begins[k]])
                    a = int(ends[k])
                kept.append(b"".join([*parts, raw[a : chunk.offsets[d + 1]]]))
            columns = {
                "doc_id": pa.array(chunk.doc_ids, pa.int64()), "n_bytes": np.diff(chunk.offsets), "n_removed": removed,
                "n_spans": spans.astype(np.int64), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            }
            if texts:
                columns["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

        return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs`` (doc_id, text).

    ``texts=True`` adds the remaining bytes as ``kept``. They may no longer be valid UTF-8: bytes are judged.
    """
    if not (0 < gram <= length and 0 < group <= length):
        raise ValueError("gram and group lie between 1 and length")
    spark = docs.sparkSession
    search = Search(length, gram, group, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = ch.write_chunks(docs)
    grams = ch.merge(ch.each_chunk(table, search.ask_grams, ch.ASKS), 1, count_answer)
    units = ch.merge(ch.with_replies(table, [grams], search.ask_units, ch.ASKS), 2, count_answer)
    windows = ch.merge(ch.with_replies(table, [grams, units], search.ask_windows, ch.ASKS), 3, count_answer)
    schema = RESULT + ", kept binary" if texts else RESULT
    return ch.with_replies(table, [grams, units, windows], search.results(texts), schema)
