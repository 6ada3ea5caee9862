"""Evaluation as aggregations. ``by`` names grouping columns, usually the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.scores import argmax_label, label_above, sigmoid
from mailsieve.operators.ensemble import majority_vote
from mailsieve.operators.joins import BROADCAST_ROWS
from mailsieve.operators.split import seeded_sample

By = tuple[str, ...]


def confusion_counts(df: DataFrame, by: By = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """One row per group: tn, fp, fn, tp and n, from which every threshold metric follows."""

    def cell(true: int, predicted: int) -> Column:
        return F.count_if((F.col(label) == true) & (F.col(pred) == predicted))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(1, 1).alias("tp"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion_matrix(counts: DataFrame, by: By = ()) -> DataFrame:
    """(by, label, pred, n): all four cells, zeros included."""
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    rows = [
        F.struct(F.lit(t).alias("label"), F.lit(p).alias("pred"), F.col(c).alias("n")) for c, t, p in cells
    ]
    return counts.select(*by, F.inline(F.array(*rows)))


def ratio(num: Column, den: Column) -> Column:
    """num / den, zero when the denominator is."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _accuracy() -> Column:
    return (F.col("tp") + F.col("tn")) / F.col("n")


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def accuracy(counts: DataFrame, by: By = ()) -> DataFrame:
    return counts.select(*by, _accuracy().alias("accuracy"))


def precision_recall_f1(counts: DataFrame, by: By = ()) -> DataFrame:
    """Of class 1, zero where undefined."""
    p, r, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*by, _accuracy().alias("accuracy"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def classification_report(counts: DataFrame, by: By = ()) -> DataFrame:
    """(by, class, precision, recall, f1, support): both classes, accuracy and the two averages."""
    tn, fp, fn, tp, n = (F.col(c) for c in ("tn", "fp", "fn", "tp", "n"))
    zero, one = _prf(tn, fn, fp), _prf(tp, fp, fn)
    n0, n1 = tn + fp, fn + tp

    def row(name: str, prf, support: Column) -> Column:
        p, r, f = prf
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            support.alias("support"),
        )

    macro = tuple((a + b) / 2 for a, b in zip(zero, one))
    weighted = tuple((a * n0 + b * n1) / n for a, b in zip(zero, one))
    nothing = F.lit(None).cast("double")
    return counts.select(
        *by,
        F.inline(
            F.array(
                row("0", zero, n0),
                row("1", one, n1),
                row("accuracy", (nothing, nothing, _accuracy()), n),
                row("macro avg", macro, n),
                row("weighted avg", weighted, n),
            )
        ),
    )


def roc_auc(
    df: DataFrame, by: By = (), label: str = "label", score: str = "prob"
) -> DataFrame:
    """(by, roc_auc): share of (positive, negative) pairs ranked right, ties one half.

    Rows collapse to distinct scores first, which removes ties however common. The distinct
    scores are range-partitioned, so the partition number is a bucket in score order; pairs
    inside a bucket come from a running count there, pairs across buckets from bucket totals.
    """
    distinct = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranged = distinct.repartitionByRange(*by, score).withColumn("bucket", F.spark_partition_id())
    before_row = Window.partitionBy(*by, "bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before_row), F.lit(0))
    # Products of counts pass the range of a long from a few billion rows a class on.
    won = F.col("pos").cast("double") * (below + F.col("neg") / 2)
    buckets = (
        ranged.withColumn("won", won)
        .groupBy(*by, "bucket")
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # One row per bucket and group.
    before_bucket = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below_bucket = F.coalesce(F.sum("neg").over(before_bucket), F.lit(0))
    totals = (
        buckets.withColumn("won", F.col("won") + F.col("pos").cast("double") * below_bucket)
        .groupBy(*by)
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    pairs = F.col("pos").cast("double") * F.col("neg")
    return totals.select(
        *by, F.when(pairs == 0, F.lit(float("nan"))).otherwise(F.col("won") / pairs).alias("roc_auc")
    )


def model_comparison(df: DataFrame, by: By = ("model",), threshold: float = 0.5) -> DataFrame:
    """(model, accuracy, roc_auc) of every model from one long table."""
    counts = confusion_counts(df.withColumn("pred", label_above("prob", threshold)), by)
    # One row per model on both sides.
    return accuracy(counts, by).join(roc_auc(df, by), list(by))


def best_model(comparison: DataFrame, order: list[str]) -> DataFrame:
    """The most accurate model, the earlier one in ``order`` on ties."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return comparison.orderBy(F.desc("accuracy"), place).limit(1)


def evaluate_ensemble_sample(
    labelled: DataFrame,
    predictions: DataFrame,
    n: int = 100,
    thresholds: dict[str, float] | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row: confusion counts and metrics of the majority vote on a seeded sample."""
    sample = seeded_sample(labelled.select(id_col, "label"), n, id_col)
    if n <= BROADCAST_ROWS:
        sample = F.broadcast(sample)
    votes = majority_vote(predictions.join(sample, id_col), thresholds, (id_col, "label"))
    counts = confusion_counts(votes, pred="prediction")
    p, r, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(
        "tn", "fp", "fn", "tp",
        _accuracy().alias("accuracy"), p.alias("precision"), r.alias("recall"), f1.alias("f1"),
    )


def validation_metrics(df: DataFrame, label: str = "label") -> DataFrame:
    """One row from logits: arg-max predictions, AUC over the sigmoid of logit 1 alone."""
    scored = df.select(label, argmax_label("l0", "l1").alias("pred"), sigmoid("l1").alias("prob"))
    auc = roc_auc(scored, label=label).scalar()
    return precision_recall_f1(confusion_counts(scored, label=label)).withColumn("roc_auc", auc)
