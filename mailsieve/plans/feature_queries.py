"""Tokens, vocabularies and features; fitted on the training split, applied to all messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions.urls import URL_FEATURES
from mailsieve.operators import features as ft
from mailsieve.operators.scoring import assemble_features, tfidf_vectors, with_url_features
from mailsieve.plans import fixtures as fx
from mailsieve.plans import sql as S
from mailsieve.plans.registry import query
from mailsieve.plans.sql import with_views


@query("word_tokens", with_views("SELECT doc_id, pos, word FROM words"))
def word_tokens(spark, sf):
    return ft.word_tokens(fx.message_clean(spark, sf))


@query(
    "ngrams_1_2",
    with_views("SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term"),
)
def ngrams_1_2(spark, sf):
    return ft.ngrams_1_2(fx.message_clean(spark, sf), counted=True)


@query("vocab_topk", with_views("SELECT term, tf::BIGINT AS tf, df::BIGINT AS df FROM vocab"))
def vocab_topk(spark, sf):
    return ft.vocab_topk(fx.train_clean(spark, sf))


@query("idf", with_views("SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM vocab"))
def idf(spark, sf):
    return fx.fitted_terms(spark, sf).table.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf", with_views("SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf FROM tfidf"))
def tfidf(spark, sf):
    table = ft.tfidf(fx.message_clean(spark, sf), fx.fitted_terms(spark, sf))
    return table.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "top_terms_by_label",
    with_views(
        """SELECT label, term, weight, rank FROM (
            SELECT label, term, weight, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term)::INTEGER AS rank
            FROM (SELECT e.label, t.term, round(sum(t.tfidf), 6) AS weight
                  FROM tfidf t JOIN emails e USING (doc_id) GROUP BY e.label, t.term))
        WHERE rank <= 20"""
    ),
)
def top_terms_by_label(spark, sf):
    """The terms that weigh most in each class."""
    emails = fx.emails(spark, sf)
    clean = emails.select("doc_id", "label", fx.clean_text("text").alias("clean"))
    table = ft.tfidf(clean, fx.fitted_terms(spark, sf))
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    weights = table.join(labels, "doc_id").groupBy("label", "term").agg(F.round(F.sum("tfidf"), 6).alias("weight"))
    # At most one row per label and vocabulary term.
    rank = F.row_number().over(ft.Window.partitionBy("label").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("rank", rank).where("rank <= 20")


@query("seq_vocab", with_views("SELECT word, n, id FROM seq_vocab"))
def seq_vocab(spark, sf):
    return ft.seq_vocab(fx.train_clean(spark, sf))


_CODED = """
    SELECT c.doc_id, w.pos, coalesce(v.id, 1) AS id
    FROM message_clean c LEFT JOIN seq_words w USING (doc_id) LEFT JOIN seq_vocab v USING (word)"""


@query(
    "texts_to_sequences",
    with_views(
        f"""SELECT doc_id, coalesce(string_agg(id, ' ' ORDER BY pos) FILTER (pos IS NOT NULL), '') AS ids
        FROM ({_CODED}) GROUP BY doc_id"""
    ),
)
def texts_to_sequences(spark, sf):
    coded = ft.texts_to_sequences(fx.message_clean(spark, sf), ft.seq_vocab(fx.train_clean(spark, sf)))
    return coded.select("doc_id", F.array_join("ids", " ").alias("ids"))


def _padded_sql(n: int) -> str:
    return with_views(
        f"""SELECT doc_id, array_to_string(list_resize(coalesce(ids, []), {n}, 0), ' ') AS padded
        FROM (SELECT doc_id, list(id ORDER BY pos) FILTER (pos IS NOT NULL) AS ids FROM ({_CODED}) GROUP BY doc_id)"""
    )


@query("pad_sequences", _padded_sql(200))
def pad_sequences(spark, sf):
    padded = ft.pad_sequences(fx.message_clean(spark, sf), ft.seq_vocab(fx.train_clean(spark, sf)))
    return padded.select("doc_id", F.array_join("padded", " ").alias("padded"))


@query("pad_sequences_hybrid", _padded_sql(100))
def pad_sequences_hybrid(spark, sf):
    vocab = ft.seq_vocab(fx.train_clean(spark, sf))
    padded = ft.pad_sequences(fx.message_clean(spark, sf), vocab, ft.HYBRID_MAX_LEN)
    return padded.select("doc_id", F.array_join("padded", " ").alias("padded"))


def _train_urls(spark, sf):
    return with_url_features(fx.split_emails(spark, sf).where("split = 'train'").select("doc_id", "text"))


_STATS = f"""
    SELECT {', '.join(f'avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_std' for f in S.FEATURE_NAMES)}
    FROM message_url_features WHERE doc_id IN (SELECT doc_id FROM split_emails WHERE split = 'train')"""


@query(
    "scaler_fit",
    with_views(
        f"SELECT {', '.join(f'round({f}_{s}, 6) AS {f}_{s}' for f in S.FEATURE_NAMES for s in ('mean', 'std'))} FROM ({_STATS})"
    ),
)
def scaler_fit(spark, sf):
    stats = ft.scaler_fit(_train_urls(spark, sf))
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


@query(
    "scaler_transform",
    with_views(
        f"""SELECT doc_id, {', '.join(
            f'round(({f} - {f}_mean) / CASE WHEN {f}_std = 0 THEN 1 ELSE {f}_std END, 6) + 0.0 AS {f}_scaled'
            for f in S.FEATURE_NAMES)}
        FROM message_url_features CROSS JOIN ({_STATS})"""
    ),
)
def scaler_transform(spark, sf):
    rows = with_url_features(fx.messages(spark, sf).select("doc_id", "text"))
    scaled = ft.scaler_transform(rows, ft.scaler_fit(_train_urls(spark, sf)))
    return scaled.select(
        "doc_id", *[(F.round(f"{f}_scaled", 6) + F.lit(0.0)).alias(f"{f}_scaled") for f in URL_FEATURES]
    )


_SCALED = [f"({f} - {f}_mean) / CASE WHEN {f}_std = 0 THEN 1 ELSE {f}_std END" for f in S.FEATURE_NAMES]


@query(
    "assemble_features",
    with_views(
        f"""SELECT doc_id, ((SELECT count(*) FROM vocab) + {len(_SCALED)})::INTEGER AS n_features,
            (coalesce(t.n, 0) + u.n)::INTEGER AS n_nonzero, round(coalesce(t.total, 0) + u.total, 6) AS total
        FROM (SELECT doc_id, {' + '.join(f'({e} <> 0)::INT' for e in _SCALED)} AS n, {' + '.join(_SCALED)} AS total
              FROM message_url_features CROSS JOIN ({_STATS})) u
        LEFT JOIN (SELECT doc_id, count(*) AS n, sum(tfidf) AS total FROM tfidf GROUP BY doc_id) t USING (doc_id)"""
    ),
)
def assemble_features_query(spark, sf):
    weights = fx.fitted_terms(spark, sf)
    stats = ft.scaler_fit(_train_urls(spark, sf))
    rows = fx.messages(spark, sf).select("doc_id", "text", fx.clean_text("text").alias("clean"))
    assembled = assemble_features(rows, tfidf_vectors(weights), stats)
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array("features")
    return assembled.select(
        "doc_id",
        F.size(values).alias("n_features"),
        F.size(F.filter(values, lambda v: v != 0)).alias("n_nonzero"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
    )
