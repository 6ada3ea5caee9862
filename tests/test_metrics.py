import math
import random

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import metrics as M


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def rows():
    """A third of all rows share one score."""
    rng = random.Random(7)
    return [(0.5 if rng.random() < 1 / 3 else round(rng.random(), 3), int(rng.random() < 0.3)) for _ in range(900)]


def test_auc_against_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "prob double, label int")
    assert M.roc_auc(df.repartition(7)).first().roc_auc == pytest.approx(brute_auc(rows), abs=1e-12)


def test_auc_depends_on_order_only(spark, rows):
    df = spark.createDataFrame(rows, "prob double, label int").withColumn("q", F.exp(F.col("prob") * 5))
    assert M.roc_auc(df, score="q").first()[0] == pytest.approx(M.roc_auc(df).first()[0], abs=1e-12)


def test_auc_of_one_class_is_nan(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "prob double, label int")
    assert math.isnan(M.roc_auc(df).first()[0])


def test_auc_equals_mllib(spark, rows):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.createDataFrame(rows, "prob double, label int").withColumn("label", F.col("label").cast("double"))
    theirs = BinaryClassificationEvaluator(rawPredictionCol="prob", numBins=0).evaluate(df)
    assert M.roc_auc(df).first()[0] == pytest.approx(theirs, abs=1e-12)


def test_zero_divisions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "label int, pred int")
    counts = M.confusion_counts(df)
    row = M.precision_recall_f1(counts).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)
    assert row.accuracy == pytest.approx(1 / 3)
    cells = {(r.label, r.pred): r.n for r in M.confusion_matrix(counts).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 2, (1, 1): 0}


def test_best_model_prefers_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "model string, accuracy double")
    assert M.best_model(df, ["c", "b", "a"]).first().model == "b"


def test_products_of_large_counts_do_not_overflow(spark):
    """The pair counts of the AUC are products of two longs that may each pass four thousand million."""
    import inspect

    df = spark.createDataFrame([(4_000_000_000, 4_000_000_000)], "pos long, below long")
    assert df.select(F.col("pos").cast("double") * F.col("below")).first()[0] == 1.6e19
    source = inspect.getsource(M.roc_auc)
    assert source.count('F.col("pos").cast("double") *') == 3
