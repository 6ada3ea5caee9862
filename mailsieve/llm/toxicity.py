"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct words, neighbouring pairs and pairs with one word between of a text, hashed into
2**bits coordinates. FTRL-proximal gives each coordinate its own learning rate and an L1 penalty that keeps
all but the telling coordinates at exactly zero. The few that remain travel to the tasks (bounded by
2**bits), and a score is one scan of the whole texts.

Learning uses a bounded sample of the labelled rows (about ``max_rows``, drawn by hash). Shards of about
``SHARD_ROWS`` rows learn side by side and their weights are averaged.

Defined cases: an empty or null text scores the intercept alone; a null doc_id is never learned from and
held out is false for it; null labels are ignored; repeated rows count as often as they occur; without any
labelled row every score is 0.5 and ``drop_toxic`` drops nothing. Extra columns pass through ``score_texts`` unless they are named like its
own (score, predicted).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.llm import bytewords as bw
from mailsieve.llm.columns import set_aside

BITS = 20
MAX_ROWS = 40_000
SHARD_ROWS = 10_000
EPOCHS = 4
#: FTRL-proximal: learning rate and its smoothing, L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0


def held_out(doc_id: Column | str, folds: int = 5, fold: int = 0) -> Column:
    """True where crc32 of the id's text leaves ``fold``; false for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of each occurrence of a word, a pair and a pair over one word."""
    data = bw.LOWER[data]
    start, end, first = bw.word_spans(data, offsets, bw.ALNUM)
    words = bw.word_hashes(data, start, end)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    docs, cells = [doc], [words]
    for gap, salt in ((1, np.uint64(0x51ED270B)), (2, np.uint64(0xA3C59AC3))):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            cells.append(bw.mix(words[:-gap] * bw.BASE + words[gap:] + salt)[same])
    return np.concatenate(docs), (np.concatenate(cells) >> np.uint64(64 - bits)).astype(np.int64)


def feature_rows(label: str, bits: int):
    """Rows of (label, distinct coordinates) for learning."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in bw.text_blocks(batches):
            doc, cell = features(data, offsets, bits)
            both = np.unique((doc.astype(np.int64) << bits) | cell)
            upto = np.searchsorted(both >> bits, np.arange(len(offsets)))
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array((both & ((1 << bits) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(label)), lists], names=["label", "cells"])

    return run


class Ftrl:
    """State of one learner: z and n per coordinate; the last coordinate is the intercept."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, cells: np.ndarray) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        l1 = np.where(cells == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, cells: np.ndarray, label: float) -> None:
        w = self.weights(cells)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[cells]
        more = n + gradient * gradient
        self.z[cells] += gradient - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[cells] = more


def learn_shard(bits: int, epochs: int):
    """One learner over the rows of a shard; gives its weights that aren't zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.array(c, np.int32), y) for b in batches for c, y in zip(b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_pylist())]
        if not rows:
            return
        # Neither the order of arrival nor that of the input counts.
        rows.sort(key=lambda r: (r[1], r[0].tobytes()))
        model, bias = Ftrl(1 << bits), np.array([1 << bits])
        # The order is shuffled alike in every run and retry.
        for order in (np.random.default_rng(e).permutation(len(rows)) for e in range(epochs)):
            for i in order:
                model.learn(np.concatenate([rows[i][0], bias]), rows[i][1])
        every = np.arange((1 << bits) + 1)
        w = model.weights(every)
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(w[kept])], names=["cell", "weight"])
        del rows, model, w, every
        bw.give_back()

    return run


class Model:
    """Sparse weights over hashed coordinates and an intercept."""

    def __init__(self, cells: np.ndarray, weights: np.ndarray, bits: int):
        self.bits, self.table, self.learned = bits, np.zeros((1 << bits) + 1), len(cells) > 0
        self.table[cells] = weights

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, cell = features(data, offsets, self.bits)
        told = np.flatnonzero(self.table[cell])
        both = np.unique((doc[told] << self.bits) | cell[told])
        total = np.bincount(both >> self.bits, self.table[both & ((1 << self.bits) - 1)], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.table[-1], -35, 35)))


def fit(labelled: DataFrame, label: str = "label", max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """A model from rows (doc_id, text, label in 0/1); about ``max_rows`` of them are learned from."""
    rows = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.col(label).cast("double").alias("label"))
    total = max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, max_rows / total) * (1 << 30)))
    cells = drawn.mapInArrow(feature_rows("label", bits), "label double, cells array<int>")
    shards = max(1, -(-min(total, max_rows) // SHARD_ROWS))
    found = cells.repartition(shards).mapInArrow(learn_shard(bits, epochs), "cell long, weight double")
    # At most 2**bits rows from each shard, a few thousand with the L1 penalty.
    weights = found.toArrow()
    cell, weight = weights.column(0).to_numpy(), weights.column(1).to_numpy()
    table = np.bincount(cell, weight, (1 << bits) + 1) / max(1, int(np.sum(cell == 1 << bits)))
    kept = np.flatnonzero(table)
    return Model(kept, table[kept], bits)


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from a score of 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in bw.text_blocks(batches, text):
            score = shared.value.scores(data, offsets)
            added = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that the model doesn't call toxic, columns as they came whatever their names; all of them if it learned from no row."""
    if not model.learned:
        return docs
    own, restore = set_aside(docs, text)
    return restore(score_texts(own, model, text).where("predicted = 0"))


def learn_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, **options) -> Model:
    """A model from the documents whose labels aren't held out; each label row counts."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold)).select("doc_id", F.col("toxic").alias("label"))
    return fit(docs.select("doc_id", "text").join(known, "doc_id"), **options)
