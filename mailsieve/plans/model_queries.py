"""Training, scoring and the column maths around probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mailsieve.functions import scores as sc
from mailsieve.functions.urls import URL_FEATURES
from mailsieve.operators import ensemble as en
from mailsieve.operators import metrics as M
from mailsieve.operators import scoring as md
from mailsieve.operators.durable import durable
from mailsieve.operators.features import TermWeights, fit_idf
from mailsieve.plans import fixtures as fx
from mailsieve.plans import sql as S
from mailsieve.plans.registry import query
from mailsieve.plans.sql import with_views
from mailsieve.sources.corpus import cast_types


def _clean_messages(spark, sf):
    return fx.messages(spark, sf).select("doc_id", "text", fx.clean_text("text").alias("clean"))


def _split_rows(spark, sf, split):
    """One split as a model takes it: text null as "nan", label as int, cleaned, with the URL features. Written, as fits read it often."""
    rows = cast_types(fx.split_emails(spark, sf).where(F.col("split") == split))
    cleaned = md.with_url_features(rows.select("doc_id", "label", "text", fx.clean_text("text").alias("clean")))
    return durable(cleaned.drop("text"), split)


def _train_rows(spark, sf):
    return _split_rows(spark, sf, "train")


@query("train_tfidf_lr")
def train_tfidf_lr(spark, sf):
    """The fitted model as a table."""
    table = md.train_tfidf_lr(_train_rows(spark, sf)).term_table()
    return table.select("term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("weight", 3).alias("weight"))


@query(
    "train_vocabulary",
    with_views("SELECT term, tf::BIGINT AS tf, df::BIGINT AS df, round(idf, 6) AS idf FROM vocab"),
)
def train_vocabulary(spark, sf):
    """The part of the trained model that SQL can rebuild: its terms, counts and idf."""
    table = fit_idf(_train_rows(spark, sf)).table
    return table.select("term", "tf", "df", F.round("idf", 6).alias("idf"))


@query("validation_report")
def validation_report(spark, sf):
    """Both classes, accuracy and averages of the trained classifier on the validation split."""
    model = md.train_tfidf_lr(_train_rows(spark, sf))
    scored = model(_split_rows(spark, sf, "validation")).withColumn("pred", sc.label_above("prob"))
    report = M.classification_report(M.confusion_counts(scored))
    return report.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("evaluate_trained")
def evaluate_trained(spark, sf):
    """(model, accuracy, roc_auc) on the test split: two trained members and three ways to combine them."""
    train = _train_rows(spark, sf)
    tfidf = md.train_tfidf_lr(train, beside=URL_FEATURES)
    scorers = {"tfidf": tfidf, "hybrid": md.train_hybrid(train, weights=tfidf.weights, after=tfidf)}
    test = _split_rows(spark, sf, "test")
    members = durable(md.predict_by_model(test, scorers, list(scorers)), "members")
    none = members.withColumns({"legitimacy": F.lit(0), "suspicion": F.lit(0)})
    combined = {
        "majority": en.majority_vote(members).select("doc_id", F.col("probability").alias("prob")),
        "weighted": en.weighted_average(members).select("doc_id", F.col("probability").alias("prob")),
        "adjusted": en.adjusted_weighted(none).select("doc_id", F.col("probability").alias("prob")),
    }
    every = members
    for name, rows in combined.items():
        every = every.unionByName(rows.withColumn("model", F.lit(name)))
    compared = M.model_comparison(every.join(test.select("doc_id", "label"), "doc_id"))
    best = M.best_model(compared, [*scorers, *combined]).select("model", F.lit(True).alias("best"))
    return compared.join(best, "model", "left").select(
        "model", F.round("accuracy", 6).alias("accuracy"), F.round("roc_auc", 6).alias("roc_auc"), F.coalesce("best", F.lit(False)).alias("best")
    )


@query("predict_proba")
def predict_proba(spark, sf):
    model = md.train_tfidf_lr(_train_rows(spark, sf))
    return model(_clean_messages(spark, sf).select("doc_id", "clean")).select("doc_id", F.round("prob", 4).alias("prob"))


@query("train_hybrid")
def train_hybrid(spark, sf):
    model = md.train_hybrid(_train_rows(spark, sf))
    return model(_clean_messages(spark, sf)).select("doc_id", F.round("prob", 4).alias("prob"))


@query("predict_by_model")
def predict_by_model(spark, sf):
    train = _train_rows(spark, sf)
    tfidf = md.train_tfidf_lr(train, beside=URL_FEATURES)
    scorers = {"tfidf": tfidf, "hybrid": md.train_hybrid(train, weights=tfidf.weights, after=tfidf)}
    return md.predict_by_model(_clean_messages(spark, sf), scorers, ["tfidf", "hybrid"]).withColumn(
        "prob", F.round("prob", 4)
    )


def hashed_model(spark, sf) -> TermWeights:
    """The training vocabulary with weights in [-1, 1] taken from hashes."""
    fitted = fx.fitted_terms(spark, sf)
    return TermWeights(fitted.table.withColumn("weight", fx.hashed_weight()), fitted.size)


@query(
    "linear_score",
    with_views(
        f"""SELECT c.doc_id, round(coalesce(s.score, 0) - 0.25, 6) AS score,
            round(1 / (1 + exp(-(coalesce(s.score, 0) - 0.25))), 6) AS prob
        FROM message_clean c LEFT JOIN (
            SELECT doc_id, sum(tfidf * ({S.md5_int('md5(term)', 1, 8)} / 2147483648.0::DOUBLE - 1)) AS score
            FROM tfidf GROUP BY doc_id) s USING (doc_id)"""
    ),
)
def linear_score(spark, sf):
    scored = md.linear_score(fx.message_clean(spark, sf), hashed_model(spark, sf), -0.25)
    return scored.select("doc_id", F.round("score", 6).alias("score"), F.round("prob", 6).alias("prob"))


def _length_scorer(texts: list[str]) -> np.ndarray:
    """Stands in for an outside model: depends on nothing but the text."""
    return np.array([(len(t) % 97) / 97 for t in texts])


@query(
    "batch_score",
    """SELECT doc_id, round(1 - length(text) % 97 / 97.0::DOUBLE, 6) AS p_legit,
        round(length(text) % 97 / 97.0::DOUBLE, 6) AS p_phish, false AS failed FROM documents""",
)
def batch_score(spark, sf):
    scored = md.batch_score(fx.table(spark, sf, "documents"), _length_scorer)
    return scored.select(
        "doc_id", F.round("p_legit", 6).alias("p_legit"), F.round("p_phish", 6).alias("p_phish"), "failed"
    )


@query(
    "two_class_probs",
    with_views("SELECT doc_id, model, round(1 - prob, 6) AS p_legit, round(prob, 6) AS p_phish FROM scores"),
)
def two_class_probs(spark, sf):
    rows = fx.score_table(spark, sf).select("doc_id", "model", sc.two_class_probs("prob").alias("p"))
    return rows.select(
        "doc_id", "model", F.round("p.p_legit", 6).alias("p_legit"), F.round("p.p_phish", 6).alias("p_phish")
    )


@query(
    "normalize_probs",
    with_views(
        """SELECT doc_id, round(a / CASE WHEN a + b = 0 THEN 1 ELSE a + b END, 6) AS p_legit,
            round(b / CASE WHEN a + b = 0 THEN 1 ELSE a + b END, 6) AS p_phish
        FROM (SELECT doc_id, greatest(l0, 0) AS a, greatest(l1, 0) AS b FROM logits)"""
    ),
)
def normalize_probs(spark, sf):
    # Negative logits become zero, so some rows sum to zero.
    raw = fx.logits(spark, sf).select(
        "doc_id", F.greatest("l0", F.lit(0.0)).alias("a"), F.greatest("l1", F.lit(0.0)).alias("b")
    )
    rows = raw.select("doc_id", sc.normalize_probs("a", "b").alias("p"))
    return rows.select("doc_id", F.round("p.p_legit", 6).alias("p_legit"), F.round("p.p_phish", 6).alias("p_phish"))


@query(
    "softmax_argmax",
    with_views(
        """SELECT doc_id, round(exp(l1) / (exp(l0) + exp(l1)), 6) AS p_phish, (l1 > l0)::INTEGER AS pred
        FROM logits"""
    ),
)
def softmax_argmax(spark, sf):
    return fx.logits(spark, sf).select(
        "doc_id", F.round(sc.softmax_phish("l0", "l1"), 6).alias("p_phish"), sc.argmax_label("l0", "l1").alias("pred")
    )


@query("sigmoid_logit", with_views("SELECT doc_id, round(1 / (1 + exp(-l1)), 6) AS prob FROM logits"))
def sigmoid_logit(spark, sf):
    return fx.logits(spark, sf).select("doc_id", F.round(sc.sigmoid("l1"), 6).alias("prob"))


@query(
    "threshold_label",
    with_views(
        """SELECT doc_id, model, (prob >= 0.5)::INTEGER AS at_least, (prob > 0.5)::INTEGER AS above,
            (prob > 1 - prob)::INTEGER AS argmax FROM scores"""
    ),
)
def threshold_label(spark, sf):
    return fx.score_table(spark, sf).select(
        "doc_id",
        "model",
        sc.label_at_least("prob").alias("at_least"),
        sc.label_above("prob").alias("above"),
        sc.argmax_label(1 - F.col("prob"), "prob").alias("argmax"),
    )


# Models without an entry read the default.
THRESHOLDS = {"tfidf": 0.45, "cnn": 0.55, "lstm": 0.6}
_THRESHOLD_SQL = "CASE model WHEN 'tfidf' THEN 0.45 WHEN 'cnn' THEN 0.55 WHEN 'lstm' THEN 0.6 ELSE 0.5 END::DOUBLE"


@query(
    "threshold_lookup",
    with_views(f"SELECT doc_id, model, prob, {_THRESHOLD_SQL} AS threshold FROM scores"),
)
def threshold_lookup(spark, sf):
    return md.threshold_lookup(fx.score_table(spark, sf), THRESHOLDS)


@query(
    "confidence",
    with_views(
        """SELECT doc_id, model, round(greatest(prob, 1 - prob), 6) AS of_likelier,
            round(CASE WHEN prob > 0.5 THEN prob ELSE 1 - prob END, 6) AS of_predicted, prob AS raw
        FROM scores"""
    ),
)
def confidence(spark, sf):
    return fx.score_table(spark, sf).select(
        "doc_id",
        "model",
        F.round(sc.confidence_max("prob"), 6).alias("of_likelier"),
        F.round(sc.confidence_of("prob", sc.label_above("prob")), 6).alias("of_predicted"),
        F.col("prob").alias("raw"),
    )
