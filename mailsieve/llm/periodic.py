"""Periodic runs of words, found with a suffix automaton and link-cut access, and texts with each run cut to its first period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least ``LEAST`` words and ``TIMES`` periods
that no neighbouring word extends. The suffix automaton of the words has a state for each class of strings that end at the same places; suffix
links make the states a tree, and the strings that end at word i are the path from the state of the first i words to the root. Appending word
i recolours that path with i. The path falls into segments of one colour each, the last place j where their strings ended before; a link-cut tree holds
the segments as splay trees, so one access visits each segment once and joins them into one, O(log n) of them per word over a whole text. A segment whose
longest string has L words says that the words before i and before j agree for exactly L words; if their distance q = i - j is at most
L, a square of period q ends at i, and q is its smallest period, because the last occurrence counts. Squares of one period that end at words in a row belong to one run, which
starts L words back from j.

Most texts need no automaton: inside a run each ``GRAM`` words occur twice or more, whatever its period, so only stretches in which every ``GRAM`` words
are repeated within the stretch can hold a run. Such stretches are cut with word hashes, again and again until
nothing changes; an accidental equality of hashes only leaves a stretch longer. The automaton compares the words themselves.

A text is worked on in one task, whole and alone; an automaton takes under a kilobyte for each word of its stretch. There is no shuffle.
Defined cases: null and empty texts have no words, no runs and an empty collapsed text; words are runs of bytes that aren't white space;
repeated rows and ids, null ids among them, each give a row; an empty table gives none. Only the id and the text are read, so other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.arrays import bind
from mailsieve.llm import bytewords as bw

LEAST, TIMES = 24, 3
#: A run of LEAST words and TIMES periods repeats each of its stretches of this many words; true up to (LEAST + TIMES) / TIMES words.
GRAM = 8
SPACE = r"[\x20\x09-\x0D]+"
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest string) of each state, 0 being the root, and the state of each prefix."""
    step: list[dict] = [{}]
    link, longest, prefix = [-1], [0], []
    last = 0
    for n, word in enumerate(words, 1):
        new = len(step)
        step.append({})
        longest.append(n)
        link.append(0)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            target = step[at][word]
            if longest[target] > longest[at] + 1:
                split = len(step)
                step.append(step[target].copy())
                longest.append(longest[at] + 1)
                link.append(link[target])
                link[target] = split
                while at >= 0 and step[at].get(word) == target:
                    step[at][word] = split
                    at = link[at]
                target = split
            link[new] = target
        last = new
        prefix.append(new)
    return link, longest, prefix


class Segments:
    """A link-cut tree over a fixed tree: each splay tree is a segment of a root path, ordered by depth, with one colour.

    ``up`` is the parent inside the splay tree, and at its root the parent of the segment's top. State 0, the
    empty string, stands for none.
    """

    def __init__(self, link: list[int]):
        self.up = [max(x, 0) for x in link]
        self.left, self.right = [0] * len(link), [0] * len(link)
        self.colour = [-1] * len(link)

    def splay(self, u: int) -> None:
        """Makes ``u`` the root of its splay tree, which keeps its colour."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = up[u]
            if not p or (left[p] != u and right[p] != u):
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == u):
                self._rotate(p)
                self._rotate(u)
            elif inner:
                self._rotate(u)
                self._rotate(u)
            else:
                self._rotate(u)
                colour[u] = colour[p]
                return
            top = g
            p = up[u]
            if not p or (left[p] != u and right[p] != u):
                colour[u] = colour[top]
                return

    def _rotate(self, u: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[u]
        g = up[p]
        if left[p] == u:
            b = left[p] = right[u]
            right[u] = p
        else:
            b = right[p] = left[u]
            left[u] = p
        if b:
            up[b] = p
        up[p], up[u] = u, g
        if left[g] == p:
            left[g] = u
        elif right[g] == p:
            right[g] = u

    def access(self, v: int, new: int) -> list[tuple[int, int]]:
        """Recolours the path from ``v`` to the root; gives (deepest state on the path, old colour) of each segment, deepest first."""
        up, right, colour = self.up, self.right, self.colour
        passed = []
        below, u = 0, v
        while u:
            self.splay(u)
            old = colour[u]
            if old >= 0:
                passed.append((u, old))
            # What lies deeper in this segment isn't on the path and keeps its colour.
            if right[u]:
                colour[right[u]] = old
            right[u] = below
            below, u = u, up[u]
        colour[below] = new
        return passed


def squares_to_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of two periods or more."""
    link, longest, prefix = automaton(words)
    segments = Segments(link)
    growing: dict[int, list[int]] = {}
    runs = []
    for i, state in enumerate(prefix):
        for deepest, j in segments.access(state, i):
            period, same = i - j, longest[deepest]
            if period <= same:
                run = growing.get(period)
                if run and run[1] == i - 1:
                    run[1] = i
                else:
                    if run:
                        runs.append((run[0], run[1] - run[0] + 1, period))
                    growing[period] = [j - same + 1, i]
    runs += [(first, last - first + 1, period) for period, (first, last) in growing.items()]
    return runs


def stretches(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the stretches that may hold runs; texts start at ``first`` (one entry more at the end).

    Stretches may share up to ``GRAM - 1`` words; a run's own stretches of ``GRAM`` words all lie in one.
    """
    start, size = first[:-1].astype(np.int64), np.diff(first).astype(np.int64)
    while True:
        long = size >= LEAST
        start, size = start[long], size[long]
        if not len(start):
            return start, size
        at = bw.take_ranges(start, size)
        owner = np.repeat(np.arange(len(start)), size)
        grams = bw.join_hashes(hashes[at], GRAM)
        # The last words of a stretch begin no whole gram.
        inside = owner[: len(grams)] == owner[GRAM - 1 :]
        keys = bw.mix(grams * bw.BASE + owner[: len(grams)].astype(np.uint64))
        keys, places = keys[inside], np.flatnonzero(inside)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        places = places[again]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (np.diff(places) > 1) | (np.diff(owner[places]) > 0)
        begin = np.flatnonzero(fresh)
        found = np.diff(np.append(begin, len(places))) + GRAM - 1
        if found.sum() == size.sum() and len(found) == len(size):
            return start, size
        start, size = at[places[begin]], found


def whole_runs(words: list, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs of ``LEAST`` words and ``TIMES`` periods or more within the stretches, by start and period."""
    found = []
    for at, size in places:
        runs = squares_to_runs(words[at : at + size])
        found += [(at + s, n, q) for s, n, q in runs if n >= max(LEAST, TIMES * q)]
    return sorted(found)


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in bw.text_blocks(batches, "_text"):
        start, end, first = bw.word_spans(data, offsets, bw.SPACED)
        at, size = stretches(bw.word_hashes(data, start, end), first)
        text_of = np.searchsorted(first, at, "right") - 1
        by_text: dict[int, list[tuple[int, int]]] = {}
        for t, a, n in zip(text_of.tolist(), (at - first[text_of]).tolist(), size.tolist()):
            by_text.setdefault(t, []).append((a, n))
        raw = data.tobytes()
        runs, texts = [], []
        for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            words = raw[a:b].split()
            found = whole_runs(words, by_text[t]) if t in by_text else []
            runs.append(found)
            texts.append(b" ".join(collapse(words, found) if found else words))
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
        listed = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)
        columns = [rows.column(0), pa.array(np.diff(first), pa.int64()), lists, pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of every whole text by start and period, and its kept words joined by single spaces."""
    body = F.col(text) if isinstance(text, str) else text
    rows = docs.select(F.col(id_col).alias("_id"), body.alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([rows.schema["_id"]]).add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "string")
    return rows.mapInArrow(_find, schema).withColumnRenamed("_id", id_col)


def planted_period(id_col: str = "doc_id", text: str = "text") -> Column:
    """The text, in one of ten documents with a periodic tail: its place, period and number of periods follow from the id's checksum."""
    check = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(check / 10).cast("long")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        cut = lambda c: F.transform(w, lambda x, i: F.when(i < c["a"], x).otherwise(F.get(w, c["a"] + (i - c["a"]) % c["p"])))
        return F.when(n > 0, F.array_join(bind(F.struct(a.alias("a"), p.alias("p")), cut), " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.col(text), SPACE), lambda w: w != "")
    return F.when(check % 10 == 0, bind(words, repeat)).otherwise(F.col(text))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the run of the greatest exponent, and checksums of all runs and of the collapsed text."""
    none = F.lit(None).cast(RUN)
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda b, r: F.when(more(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    thousand = 1000 * F.col("best.length")
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        ((thousand - thousand % F.col("best.period")) / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
