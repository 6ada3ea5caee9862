"""Words, adjacent pairs and their counts straight from Arrow text buffers, a few megabytes of text at a time.

Terms are told apart by 64-bit hashes inside a block or a vocabulary; what leaves a task are the terms themselves, so counts of
different tasks meet by their terms. Spark deals out the texts and adds the counts up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions import bytewords as bw
from mailsieve.operators.newton import narrow, stretches

#: Bytes of text that are counted at a time.
BLOCK_BYTES = 1 << 22
#: ASCII word characters, and those of the words of sequences.
WORD, SEQUENCE = np.zeros(256, bool), np.zeros(256, bool)
SEQUENCE[48:58] = SEQUENCE[97:123] = True
WORD[SEQUENCE] = WORD[65:91] = WORD[95] = True


class Terms:
    """The words of a block of texts in order, at least ``least`` characters long: hashes and the number of each one's text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: np.ndarray = WORD, least: int = 2):
        start, end, first = bw.word_spans(data, offsets, rule)
        kept = end - start >= least
        self.data, self.start, self.end, self.n = data, start[kept], end[kept], len(offsets) - 1
        self.first = np.concatenate([[0], np.cumsum(kept)])[first]
        self.text = np.repeat(np.arange(self.n), np.diff(self.first))
        self.words = bw.word_hashes(data, self.start, self.end)

    def pairs(self, able: np.ndarray | None = None) -> np.ndarray:
        """The words that another one of their text follows; both ``able`` where that is given."""
        follows = self.text[1:] == self.text[:-1]
        return np.flatnonzero(follows if able is None else follows & able[1:] & able[:-1])

    def pair_hashes(self, at: np.ndarray) -> np.ndarray:
        return bw.mix(self.words[at] * bw.BASE + self.words[at + 1])

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words ``at``."""
        length = self.end[at] - self.start[at]
        held = self.data[bw.take_ranges(self.start[at], length)]
        ends = np.concatenate([[0], np.cumsum(length)])
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(held)]).cast(pa.string())

    def pair_strings(self, at: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(self.strings(at), self.strings(at + 1), " ")

    def kinds(self, pairs: np.ndarray | bool) -> Iterator[tuple]:
        """(hashes, texts, places, how to spell the terms at places) of the words and of the pairs; ``pairs`` as in ``counts``."""
        if pairs is True or pairs is False:
            yield self.words, self.text, np.arange(len(self.words)), self.strings
        if pairs is not False:
            at = self.pairs(None if pairs is True else index_of(pairs, self.words) >= 0)
            yield self.pair_hashes(at), self.text[at], at, self.pair_strings


def blocks(batches, column: str) -> Iterator[tuple[pa.RecordBatch, Terms]]:
    for rows, data, offsets in bw.text_blocks(batches, column, BLOCK_BYTES):
        yield rows, Terms(data, offsets)


def index_of(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a table of distinct ones, -1 where it isn't there."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    return pc.index_in(pa.array(values), value_set=pa.array(table)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def term_hashes(terms: list[str]) -> np.ndarray:
    """Hashes of words and of pairs joined by a space; 0, which no word has, for what is neither."""
    out = np.zeros(len(terms), np.uint64)
    row = 0
    for rows, data, offsets in bw.text_blocks([pa.RecordBatch.from_arrays([pa.array(terms, pa.string())], names=["text"])], max_bytes=BLOCK_BYTES):
        t = Terms(data, offsets)
        words, length = np.diff(t.first), np.diff(offsets)
        one = np.flatnonzero(words == 1)
        one = one[(t.end - t.start)[t.first[one]] == length[one]]
        out[row + one] = t.words[t.first[one]]
        two = np.flatnonzero(words == 2)
        a = t.first[two]
        plain = (t.end[a] - t.start[a] + t.end[a + 1] - t.start[a + 1] + 1 == length[two]) & (t.start[a + 1] == t.end[a] + 1)
        plain[plain] = data[t.end[a[plain]]] == 32
        out[row + two[plain]] = t.pair_hashes(a[plain])
        row += rows.num_rows
    return out


def counts(df: DataFrame, clean: str, pairs: np.ndarray | bool) -> DataFrame:
    """(term, tf, df) of each block of texts, to be added up by term.

    ``pairs``: False counts words, True words and pairs, sorted hashes of words only the pairs made of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in blocks(batches, "clean"):
            for hashes, texts, places, spell in t.kinds(pairs):
                distinct, first, which = bw.distinct_hashes(hashes)
                place = places[first]
                held = bw.distinct_sorted(which * t.n + texts)[0] // t.n
                tf, n = (np.bincount(x, minlength=len(distinct)).astype(np.int64) for x in (which, held))
                yield pa.RecordBatch.from_arrays([spell(place), pa.array(tf), pa.array(n)], names=["term", "tf", "df"])

    return df.select(F.col(clean).alias("clean")).mapInArrow(run, "term string, tf long, df long")


def row_terms(df: DataFrame, id_col: str, clean: str) -> DataFrame:
    """(id, term, tf): the distinct words and pairs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in blocks(batches, "clean"):
            for hashes, texts, places, spell in t.kinds(True):
                distinct, first, which = bw.distinct_hashes(hashes)
                place = places[first]
                held, tf = bw.distinct_sorted(texts * len(distinct) + which)
                # What is spelled out at a time is bounded as well.
                for a in range(0, len(held), 1 << 16):
                    part = held[a : a + (1 << 16)]
                    ids = rows.column(0).take(pa.array(part // len(distinct)))
                    yield pa.RecordBatch.from_arrays([ids, spell(place[part % len(distinct)]), pa.array(tf[a : a + (1 << 16)].astype(np.int64))], names=names)

    names = [id_col, "term", "tf"]
    schema = T.StructType([df.schema[id_col], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return df.select(id_col, F.col(clean).alias("clean")).mapInArrow(run, schema)


class Vocabulary:
    """Numbers of terms, by their hashes, for counting texts inside the row. ``terms`` are distinct and bounded."""

    def __init__(self, terms: list[str]):
        hashes = term_hashes(terms)
        order = np.argsort(hashes, kind="stable")
        order = order[hashes[order] > 0]
        self.hashes, self.number, self.size = hashes[order], order.astype(np.int64), max(len(terms), 1)

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the term, occurrences), ordered by row and number."""
        found, row = [], 0
        for rows, t in blocks([pa.RecordBatch.from_arrays([texts], names=["clean"])], "clean"):
            at = t.pairs()
            keys = []
            for hashes, text in ((t.words, t.text), (t.pair_hashes(at), t.text[at])):
                place = index_of(self.hashes, hashes)
                known = place >= 0
                keys.append((row + text[known]) * self.size + self.number[place[known]])
            found.append(bw.distinct_sorted(np.concatenate(keys)))
            row += rows.num_rows
        key, n = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return key // self.size, key % self.size, n


def offsets_of(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))


def _unit(vocabulary: Vocabulary, idf: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, number, tf, tfidf) with unit length for every row."""
    row, number, n = vocabulary.hits(texts)
    x = n * idf[number]
    norm = np.sqrt(np.bincount(row, x * x, len(texts)))
    return row, number, n, x / norm[row]


def _added(df: DataFrame, clean: str, name: str, kind: T.DataType | str, fn: Callable[[pa.Array], pa.Array], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or of it the columns ``keep``) and a column ``name`` made of the texts. A step of its own, as Spark takes no Python function over an
    expression with lambdas."""
    df = df.drop(name)
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = fn(batch.column(batch.schema.get_field_index(clean)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), column], names=[*keep, name])

    return df.mapInArrow(run, schema)


def with_tfidf(df: DataFrame, clean: str, terms: list[str], idf: np.ndarray, name: str = "tfidf") -> DataFrame:
    """Adds the unit-length TF-IDF vector of a text, sparse; that of a null text is empty."""
    vocabulary, size = Vocabulary(terms), len(terms)

    def vectors(texts: pa.Array) -> pa.Array:
        row, number, _, x = _unit(vocabulary, idf, texts)
        at, n = offsets_of(row, len(texts)), len(texts)
        lists = [pa.ListArray.from_arrays(at, v) for v in (pa.array(number.astype(np.int32)), pa.array(x))]
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], names=["type", "size", "indices", "values"])

    return _added(df, clean, name, VectorUDT(), vectors)


def tfidf_rows(df: DataFrame, id_col: str, clean: str, terms: list[str], idf: np.ndarray) -> DataFrame:
    """(id, i, tf, tfidf): the vectors' entries as rows, terms by number."""
    vocabulary, names = Vocabulary(terms), [id_col, "i", "tf", "tfidf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                row, number, n, x = _unit(vocabulary, idf, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(x)], names=names)

    schema = T.StructType([df.schema[id_col], T.StructField("i", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("tfidf", T.DoubleType())])
    return df.select(id_col, F.col(clean).alias("clean")).mapInArrow(run, schema)


def with_sums(df: DataFrame, clean: str, terms: list[str], idf: np.ndarray, weight: np.ndarray, name: str = "sums", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct of a text's sum of tf x idf x weight (``dot``) and of squared tf x idf (``square``).

    Several rows of weights give a ``dot0``, ``dot1`` and so on from one count of the terms. ``keep``: the columns of ``df`` that stay.
    """
    vocabulary = Vocabulary(terms)
    weights = np.atleast_2d(weight)
    names = [*(["dot"] if np.ndim(weight) == 1 else [f"dot{k}" for k in range(len(weights))]), "square"]

    def sums(texts: pa.Array) -> pa.Array:
        row, number, n = vocabulary.hits(texts)
        x = n * idf[number]
        added = [np.bincount(row, v, len(texts)).astype(float) for v in (*(x * w[number] for w in weights), x * x)]
        return pa.StructArray.from_arrays([pa.array(v) for v in added], names=names)

    return _added(df, clean, name, f"struct<{','.join(f'{n}:double' for n in names)}>", sums, keep)


def packed_counts(df: DataFrame, clean: str, label: str, terms: list[str], idf: np.ndarray, beside: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of rows as ``newton.term_reader`` reads them: labels, counts of terms, lengths of the TF-IDF vectors and the columns ``beside``.

    They go from the texts into the blocks without a vector between.
    """
    vocabulary = Vocabulary(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            row, number, n = vocabulary.hits(batch.column(0))
            x = n * idf[number]
            norms = np.sqrt(np.bincount(row, x * x, rows))
            norms[norms == 0] = 1.0
            labels, *others = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])
            ends = np.cumsum(np.bincount(row, minlength=rows)).astype(np.int64)
            for a, b in stretches(ends):
                first, last = (ends[a - 1] if a else 0), ends[b - 1]
                held = [labels[a:b], ends[a:b] - first, narrow(number[first:last], np.uint16, np.int32), narrow(n[first:last], np.uint8, np.int32), norms[a:b]]
                if others:
                    held.append(np.column_stack([c[a:b] for c in others]))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in held], names=names)

    names = ["label", "ends", "indices", "counts", "norms", *(["beside"] if beside else [])]
    columns = [F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate((label, *beside))]
    return df.select(F.col(clean).alias("clean"), *columns).mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def with_word_ids(df: DataFrame, clean: str, words: list[str], ids: np.ndarray, unknown: int, max_len: int | None, name: str = "ids") -> DataFrame:
    """Adds the ids of a text's words in order, ``unknown`` for others, of at most ``max_len`` leading words; empty for null."""
    hashes = np.zeros(len(words), np.uint64)
    row = 0
    for rows, data, offsets in bw.text_blocks([pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["text"])], max_bytes=BLOCK_BYTES):
        t = Terms(data, offsets, SEQUENCE, 1)
        one = np.flatnonzero(np.diff(t.first) == 1)
        one = one[(t.end - t.start)[t.first[one]] == np.diff(offsets)[one]]
        hashes[row + one] = t.words[t.first[one]]
        row += rows.num_rows
    order = np.argsort(hashes, kind="stable")
    order = order[hashes[order] > 0]
    table, numbers = hashes[order], np.append(ids[order], unknown)

    def code(texts: pa.Array) -> pa.Array:
        parts, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, data, offsets in bw.text_blocks([pa.RecordBatch.from_arrays([texts], names=["clean"])], "clean", BLOCK_BYTES):
            t = Terms(data, offsets, SEQUENCE, 1)
            held, n = t.words, np.diff(t.first)
            if max_len is not None:
                held, n = held[np.arange(len(held)) - t.first[t.text] < max_len], np.minimum(n, max_len)
            parts.append(numbers[index_of(table, held)])
            lengths.append(n)
        at = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).astype(np.int32)))

    return _added(df, clean, name, "array<int>", code)
