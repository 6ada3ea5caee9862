"""Tokens, vocabularies, TF-IDF, token sequences and scaled URL features.

Every ``fit_*`` reads training rows only and returns a small table; every transform takes that
table as an argument.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.arrays import bind, explode_rows, posexplode_rows
from mailsieve.functions.text import _as_col
from mailsieve.functions.urls import URL_FEATURES
from mailsieve.operators import termblocks as tb
from mailsieve.operators.durable import durable
from mailsieve.operators.joins import BROADCAST_ROWS, bounded_lookup

MAX_FEATURES = 5_000
NUM_WORDS = 20_000
MAX_LEN = 200
HYBRID_MAX_LEN = 100
OOV_ID = 1
# Bins per doubling of a count when the k-th largest one is sought.
COUNT_BINS = 32


def word_list(clean: Column | str) -> Column:
    """Words of at least two characters, in order (cleaned text is lower-case ASCII)."""
    return F.regexp_extract_all(_as_col(clean), F.lit(r"\w{2,}"), F.lit(0))


def sequence_words(clean: Column | str) -> Column:
    """Words of the sequence models: runs of letters and digits, single letters included."""
    return F.regexp_extract_all(_as_col(clean), F.lit("[a-z0-9]+"), F.lit(0))


def bigram_list(words: Column | str) -> Column:
    """Adjacent pairs joined by a space. Give a plain column, not an expression."""
    words = _as_col(words)
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def with_terms(df: DataFrame, clean: str = "clean") -> DataFrame:
    """Add ``terms``: the words and then the bigrams of every document."""
    words = df.withColumn("_words", word_list(clean))
    return words.withColumn("terms", F.concat("_words", bigram_list("_words"))).drop("_words")


def word_tokens(df: DataFrame, id_col: str = "doc_id", clean: str = "clean") -> DataFrame:
    """(id, pos, word), positions from 0."""
    return posexplode_rows(df, word_list(clean), "word", id_col)


def ngrams_1_2(df: DataFrame, id_col: str = "doc_id", clean: str = "clean", counted: bool = False) -> DataFrame:
    """(id, term): every word and every adjacent pair, built inside the row without a shuffle.

    ``counted`` gives (id, term, tf), each distinct one of an id once. They are counted inside the row, which is all that ids with one row need;
    only rows of ids that come again are added up by a shuffle, null ids as one. That reads ``df`` for its ids first, and then twice if some come again.
    """
    if counted:
        repeated = durable(df.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_id")), "repeated")
        if repeated.isEmpty():
            return tb.row_terms(df, id_col, clean)
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        once, again = (tb.row_terms(df.join(repeated, same, how), id_col, clean) for how in ("left_anti", "left_semi"))
        return once.unionByName(again.groupBy(id_col, "term").agg(F.sum("tf").alias("tf")))
    return explode_rows(with_terms(df.select(id_col, clean), clean), "terms", "term", id_col)


def _count_terms(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def term_counts(df: DataFrame, clean: str = "clean") -> DataFrame:
    """(term, tf, df) over all words and bigrams, combined before the one shuffle on the term."""
    return _count_terms(tb.counts(df, clean, True))


def largest(counts: DataFrame, n: str, k: int, *ties: Column | str) -> DataFrame:
    """The ``k`` rows with the largest ``n`` (1 or more), ties in the order of ``ties``.

    A histogram of the counts (at most 64 x ``COUNT_BINS`` rows) tells which bin holds the k-th row; only rows of that
    bin and above are ordered, so no task gathers k rows from every partition. Reads ``counts`` twice.
    """
    place = F.floor(F.log2(F.col(n).cast("double")) * COUNT_BINS)
    bins = counts.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    above = F.sum("rows").over(Window.orderBy(F.desc("bin"))) - F.col("rows")
    cut = bins.withColumn("above", above).where(F.col("above") < k).agg(F.min("bin")).scalar()
    return counts.where(place >= cut).orderBy(F.desc(n), *ties).limit(k)


def top_terms(counts: DataFrame, k: int) -> DataFrame:
    return largest(durable(counts, "counts"), "tf", k, "term")


def vocab_topk(df: DataFrame, k: int = MAX_FEATURES, clean: str = "clean") -> DataFrame:
    """(term, tf, df) of the ``k`` most frequent words and bigrams, ties by term.

    A pair is never more frequent than either of its words, so a pair among the top ``k`` is
    made of words at least as frequent as the ``k``-th word. Pairs with a rarer word are left out before
    the shuffle, which keeps the long tail of pairs off the network at the price of a second pass, without
    changing the result. With so many ties that the frequent words do not fit the lookup, all pairs are
    counted after all.
    """
    bound = 4 * k
    if bound > BROADCAST_ROWS:
        return top_terms(term_counts(df, clean), k)
    frequent = durable(top_terms(_count_terms(tb.counts(df, clean, False)), bound + 1), "words")
    # At most 4k + 1 rows from here on.
    ranked = frequent.select("tf", F.row_number().over(Window.orderBy(F.desc("tf"), "term")).alias("rn"))
    row = ranked.agg(
        F.max(F.when(F.col("rn") == k, F.col("tf"))).alias("kth"),
        F.max(F.when(F.col("rn") == bound + 1, F.col("tf"))).alias("last"),
    ).first()
    if row.kth is not None and row.last is not None and row.last >= row.kth:
        return top_terms(term_counts(df, clean), k)
    kept = frequent if row.kth is None else frequent.where(F.col("tf") >= row.kth)
    words = np.sort(tb.term_hashes([r.term for r in kept.select("term").collect()]))
    pairs = tb.counts(df, clean, words)
    return top_terms(kept.unionByName(_count_terms(pairs)), k)


def idf_value(df: Column, n_docs: int) -> Column:
    """Smoothed inverse document frequency plus one."""
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


@dataclass(frozen=True)
class TermWeights:
    """A fitted vocabulary: ``table`` (term, tf, df, idf) of at most ``size`` rows."""

    table: DataFrame
    size: int


def fit_idf(train: DataFrame, k: int = MAX_FEATURES, clean: str = "clean") -> TermWeights:
    """Vocabulary and idf of the training rows. Reads ``train`` three times: give a written table."""
    vocab = vocab_topk(train, k, clean).withColumn("idf", idf_value(F.col("df"), train.count()))
    return TermWeights(durable(vocab, "vocabulary"), k)


def document_terms(terms: Column | str) -> Column:
    """map term -> tf of one document: its sorted terms, cut where the term changes; linear but for the sort."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        lengths = bind(
            starts,
            lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - i).cast("long").alias("tf"))),
        )
        return F.when(F.size(t) > 0, lengths).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return bind(F.sort_array(terms), runs)


def term_frequencies(
    df: DataFrame, weights: TermWeights, id_col: str = "doc_id", clean: str = "clean"
) -> DataFrame:
    """(id, term, tf, idf and other columns of the table) for terms in the vocabulary.

    Terms are counted inside the row, so neither the text nor repeated terms move.
    """
    counted = with_terms(df.select(id_col, clean), clean).select(id_col, document_terms("terms").alias("counted"))
    rows = explode_rows(counted, "counted", "c", id_col).select(id_col, "c.term", "c.tf")
    extra = [c for c in weights.table.columns if c not in ("term", "tf", "df")]
    hits = bounded_lookup(rows, weights.table.select("term", *extra), "term", weights.size)
    return hits.select(id_col, "term", *extra, "tf")


def tfidf_vectors(weights: TermWeights, out: str = "tfidf") -> PipelineModel:
    """Transformer from ``terms`` to unit-length TF-IDF vectors, row by row. ``scoring`` reads its vocabulary and idf to do the same from texts.

    The vocabulary (at most ``weights.size`` terms) is the model and lives on the driver.
    """
    if weights.size > BROADCAST_ROWS:
        raise ValueError("vocabulary too large for a model")
    rows = weights.table.orderBy(F.desc("tf"), "term").collect()
    return PipelineModel(
        [
            CountVectorizerModel.from_vocabulary([r.term for r in rows], "terms", f"{out}_counts"),
            ElementwiseProduct(
                scalingVec=Vectors.dense([r.idf for r in rows]),
                inputCol=f"{out}_counts",
                outputCol=f"{out}_raw",
            ),
            Normalizer(p=2.0, inputCol=f"{out}_raw", outputCol=out),
        ]
    )


def tfidf(
    df: DataFrame, weights: TermWeights, id_col: str = "doc_id", clean: str = "clean"
) -> DataFrame:
    """(id, term, tf, tfidf): tf x idf with unit length per document.

    A vocabulary that fits a broadcast is looked up inside the row, where the norm is taken too, so only hits leave the
    row and nothing is shuffled for them. Beyond that terms are joined, and the hits of a document meet for the norm.
    """
    if weights.size > BROADCAST_ROWS:
        raw = term_frequencies(df, weights, id_col, clean).withColumn("x", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(id_col)))
        return raw.select(id_col, "term", "tf", (F.col("x") / norm).alias("tfidf"))
    if weights.table.isEmpty():
        return df.select(id_col, F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"), F.lit(0.0).alias("tfidf")).where("false")
    # At most BROADCAST_ROWS rows.
    rows = weights.table.select("term", "idf").collect()
    terms = [r.term for r in rows]
    named = df.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")
    hits = tb.tfidf_rows(df, id_col, clean, terms, np.array([r.idf for r in rows]))
    return hits.join(F.broadcast(named), "i").select(id_col, "term", "tf", "tfidf")


def seq_vocab(
    train: DataFrame, num_words: int = NUM_WORDS, id_col: str = "doc_id", clean: str = "clean"
) -> DataFrame:
    """(word, n, id): ids from 2 by frequency, ties by first appearance; only ids below
    ``num_words`` are kept because the others read as unknown."""
    tokens = posexplode_rows(train, sequence_words(clean), "word", id_col)
    counts = durable(
        tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(id_col, "pos")).alias("first")), "counts"
    )
    order = [F.desc("n"), F.asc("first")]
    top = largest(counts, "n", max(num_words - 2, 0), F.asc("first"))
    # At most num_words rows reach this window.
    rank = F.row_number().over(Window.orderBy(*order))
    return top.select("word", "n", (rank + OOV_ID).alias("id"))


def texts_to_sequences(
    df: DataFrame,
    vocab: DataFrame,
    num_words: int = NUM_WORDS,
    id_col: str = "doc_id",
    clean: str = "clean",
    max_len: int | None = None,
) -> DataFrame:
    """(id, ids): the document's words as ids, unknown words 1.

    With ``max_len`` only that many leading words are looked up, for callers that cut the
    sequence there anyway.
    """
    if num_words > BROADCAST_ROWS:
        return _joined_sequences(df, vocab, num_words, id_col, clean, max_len)
    known = vocab.select("word", "id").where("word IS NOT NULL AND id IS NOT NULL").collect()
    ids = np.array([r.id for r in known], np.int64)
    coded = tb.with_word_ids(df.select(id_col, clean), clean, [r.word for r in known], ids, OOV_ID, max_len)
    # Ids move instead of words, one list a row; rows with the same id are one sequence, by place and then by id.
    lists = coded.groupBy(id_col).agg(F.collect_list("ids").alias("lists"))
    places = F.transform("lists", lambda one: F.transform(one, lambda v, i: F.struct(i.alias("pos"), v.alias("id"))))
    merged = F.array_sort(F.flatten(places)).getField("id")
    return lists.select(id_col, F.when(F.size("lists") == 1, F.get("lists", F.lit(0))).otherwise(merged).alias("ids"))


def _joined_sequences(df: DataFrame, vocab: DataFrame, num_words: int, id_col: str, clean: str, max_len: int | None) -> DataFrame:
    """``texts_to_sequences`` with a vocabulary that is joined."""
    words = sequence_words(clean)
    if max_len is not None:
        words = F.slice(words, 1, max_len)
    # The outer form keeps documents without words, as one row without a word. Words are looked up where
    # they are; what moves to the document's row are ids, put together before they move.
    tokens = df.select(id_col, F.posexplode_outer(words).alias("pos", "word"))
    known = vocab.select("word", "id")
    coded = bounded_lookup(tokens, known, "word", num_words, "left")
    code = F.when(F.col("word").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(OOV_ID)).alias("id")))
    ordered = coded.groupBy(id_col).agg(F.array_sort(F.collect_list(code)).alias("coded"))
    return ordered.select(id_col, F.col("coded.id").alias("ids"))


def pad_ids(ids: Column | str, max_len: int = MAX_LEN) -> Column:
    """Zeros after the ids up to ``max_len``; ids beyond it cut."""
    return F.slice(F.concat(_as_col(ids), F.array_repeat(F.lit(0), max_len)), 1, max_len)


def pad_sequences(
    df: DataFrame,
    vocab: DataFrame,
    max_len: int = MAX_LEN,
    num_words: int = NUM_WORDS,
    id_col: str = "doc_id",
    clean: str = "clean",
) -> DataFrame:
    """(id, padded): fixed-length model input."""
    coded = texts_to_sequences(df, vocab, num_words, id_col, clean, max_len)
    return coded.select(id_col, pad_ids("ids", max_len).alias("padded"))


def scaler_fit(train: DataFrame, features: tuple[str, ...] = URL_FEATURES) -> DataFrame:
    """One row: mean and population deviation of every feature."""
    return train.agg(
        *[F.avg(f).alias(f"{f}_mean") for f in features],
        *[F.stddev_pop(f).alias(f"{f}_std") for f in features],
    )


def scaler_transform(
    df: DataFrame, stats: DataFrame, features: tuple[str, ...] = URL_FEATURES
) -> DataFrame:
    """(x - mean) / std per feature, a zero deviation counted as one.

    The one-row statistics enter as a scalar subquery, so nothing is joined.
    """
    return df.withColumns(scaled_columns(stats, features))


def scaled_columns(stats: DataFrame, features: tuple[str, ...] = URL_FEATURES) -> dict[str, Column]:
    row = stats.select(F.struct(*stats.columns).alias("s")).scalar()

    def scaled(f: str) -> Column:
        std = row.getField(f"{f}_std")
        return (F.col(f) - row.getField(f"{f}_mean")) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return {f"{f}_scaled": scaled(f) for f in features}
