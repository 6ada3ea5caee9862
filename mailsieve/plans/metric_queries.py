"""Evaluation aggregates over the labelled score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions.scores import label_above
from mailsieve.operators import metrics as M
from mailsieve.plans import fixtures as fx
from mailsieve.plans import sql as S
from mailsieve.plans.registry import query
from mailsieve.plans.sql import with_views

BY = ("model",)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _counts(spark, sf):
    scored = fx.labelled_scores(spark, sf).withColumn("pred", label_above("prob"))
    return M.confusion_counts(scored, BY)


@query(
    "confusion_matrix",
    with_views(
        """SELECT model, 0 AS label, 0 AS pred, tn AS n FROM score_counts
        UNION ALL SELECT model, 0, 1, fp FROM score_counts
        UNION ALL SELECT model, 1, 0, fn FROM score_counts
        UNION ALL SELECT model, 1, 1, tp FROM score_counts"""
    ),
)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_counts(spark, sf), BY)


@query("accuracy", with_views("SELECT model, round((tp + tn) / n, 6) AS accuracy FROM score_counts"))
def accuracy(spark, sf):
    return _rounded(M.accuracy(_counts(spark, sf), BY), "accuracy")


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0 ELSE ({num})::DOUBLE / ({den}) END"


_P1, _R1, _F1 = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn"), _ratio("2 * tp", "2 * tp + fp + fn")
_P0, _R0, _F0 = _ratio("tn", "tn + fn"), _ratio("tn", "tn + fp"), _ratio("2 * tn", "2 * tn + fp + fn")


@query(
    "precision_recall_f1",
    with_views(
        f"""SELECT model, round((tp + tn) / n, 6) AS accuracy, round({_P1}, 6) AS precision,
            round({_R1}, 6) AS recall, round({_F1}, 6) AS f1 FROM score_counts"""
    ),
)
def precision_recall_f1(spark, sf):
    return _rounded(M.precision_recall_f1(_counts(spark, sf), BY), "accuracy", "precision", "recall", "f1")


_AUC = S.auc("SELECT model, prob AS score, label FROM labelled_scores", "model")


@query("roc_auc", with_views(f"SELECT model, round(roc_auc, 6) AS roc_auc FROM ({_AUC})"))
def roc_auc(spark, sf):
    return _rounded(M.roc_auc(fx.labelled_scores(spark, sf), BY), "roc_auc")


@query(
    "classification_report",
    with_views(
        f"""SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
        FROM (
            SELECT model, '0' AS class, {_P0} AS precision, {_R0} AS recall, {_F0} AS f1, tn + fp AS support FROM score_counts
            UNION ALL SELECT model, '1', {_P1}, {_R1}, {_F1}, tp + fn FROM score_counts
            UNION ALL SELECT model, 'accuracy', NULL, NULL, (tp + tn) / n, n FROM score_counts
            UNION ALL SELECT model, 'macro avg', ({_P0} + {_P1}) / 2, ({_R0} + {_R1}) / 2, ({_F0} + {_F1}) / 2, n
                FROM score_counts
            UNION ALL SELECT model, 'weighted avg', ({_P0} * (tn + fp) + {_P1} * (tp + fn)) / n,
                ({_R0} * (tn + fp) + {_R1} * (tp + fn)) / n, ({_F0} * (tn + fp) + {_F1} * (tp + fn)) / n, n
                FROM score_counts)"""
    ),
)
def classification_report(spark, sf):
    return _rounded(M.classification_report(_counts(spark, sf), BY), "precision", "recall", "f1")


_COMPARISON = f"""
    SELECT model, (tp + tn) / n AS accuracy, roc_auc FROM score_counts JOIN ({_AUC}) USING (model)"""


@query(
    "model_comparison",
    with_views(f"SELECT model, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc FROM ({_COMPARISON})"),
)
def model_comparison(spark, sf):
    return _rounded(M.model_comparison(fx.labelled_scores(spark, sf)), "accuracy", "roc_auc")


@query(
    "best_model",
    with_views(
        f"""SELECT model, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc FROM ({_COMPARISON})
        ORDER BY accuracy DESC, list_position({list(fx.MODELS)}, model) LIMIT 1"""
    ),
)
def best_model(spark, sf):
    comparison = M.model_comparison(fx.labelled_scores(spark, sf))
    return _rounded(M.best_model(comparison, list(fx.MODELS)), "accuracy", "roc_auc")


@query(
    "evaluate_ensemble_sample",
    with_views(
        f"""SELECT tn, fp, fn, tp, round((tp + tn) / n, 6) AS accuracy, round({_P1}, 6) AS precision,
            round({_R1}, 6) AS recall, round({_F1}, 6) AS f1
        FROM (SELECT count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
                count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp,
                count(*) AS n
            FROM (SELECT doc_id, any_value(l.toxic) AS label, (sum((prob > 0.5)::INTEGER) >= count(*) // 2 + 1)::INTEGER AS pred
                FROM scores JOIN (SELECT * FROM labels ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100) l USING (doc_id)
                WHERE prob IS NOT NULL GROUP BY doc_id))"""
    ),
)
def evaluate_ensemble_sample(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return _rounded(
        M.evaluate_ensemble_sample(labels, fx.score_table(spark, sf)), "accuracy", "precision", "recall", "f1"
    )


@query(
    "validation_metrics",
    with_views(
        f"""SELECT round((tp + tn) / n, 6) AS accuracy, round({_P1}, 6) AS precision,
            round({_R1}, 6) AS recall, round({_F1}, 6) AS f1, round(roc_auc, 6) AS roc_auc
        FROM (SELECT count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
                count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp,
                count(*) AS n
            FROM (SELECT toxic AS label, (l1 > l0)::INTEGER AS pred FROM logits JOIN labels USING (doc_id))),
        ({S.auc("SELECT 1 / (1 + exp(-l1)) AS score, toxic AS label FROM logits JOIN labels USING (doc_id)")})"""
    ),
)
def validation_metrics(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = fx.logits(spark, sf).join(labels, "doc_id")
    return _rounded(M.validation_metrics(rows), "accuracy", "precision", "recall", "f1", "roc_auc")
