import re

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailsieve.functions import scores as sc
from mailsieve.operators import ensemble as en
from mailsieve.operators import scoring as md
from mailsieve.operators.features import TermWeights
from mailsieve.plans import fixtures as fx
from mailsieve.plans.model_queries import _clean_messages, _train_rows
from mailsieve.streaming import arrivals


@pytest.fixture(scope="module")
def tfidf_lr(spark, sf):
    return md.train_tfidf_lr(_train_rows(spark, sf), 400)


@pytest.fixture(scope="module")
def hybrid(spark, sf):
    return md.train_hybrid(_train_rows(spark, sf), 400)


def test_relational_score_equals_model(spark, sf, tfidf_lr):
    docs = _clean_messages(spark, sf)
    table = TermWeights(tfidf_lr.term_table(), 400)
    relational = md.linear_score(docs, table, tfidf_lr.model.intercept).select("doc_id", "prob")
    both = relational.join(tfidf_lr(docs).select("doc_id", F.col("prob").alias("p")), "doc_id")
    assert both.count() == docs.count()
    assert both.where("abs(prob - p) > 1e-6").count() == 0


def test_document_without_features_gets_the_intercept(spark, tfidf_lr):
    docs = spark.createDataFrame([(1, "zzqq xxqq"), (2, "")], "doc_id bigint, clean string")
    table = TermWeights(tfidf_lr.term_table(), 400)
    scores = [r.score for r in md.linear_score(docs, table, -0.5).collect()]
    assert scores == [-0.5, -0.5]


def test_training_separates_its_own_rows(spark, sf):
    rows = [(i, "urgent verify account now" if i % 2 else "lunch meeting notes agenda", i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id bigint, clean string, label int")
    scored = md.train_tfidf_lr(train, 50)(train)
    assert scored.where("(prob > 0.5) <> (label = 1)").count() == 0


def optimum(x, y):
    """Weights and intercept of the penalised fit by Newton's method in as many unknowns as rows."""
    n, inner = len(y), x @ x.T
    a, b = np.zeros(n), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(inner @ a + b)))
        bend = p * (1 - p)
        system = np.block([[np.eye(n) + bend[:, None] * inner, bend[:, None]], [(bend @ inner)[None], np.array([[bend.sum()]])]])
        step = np.linalg.solve(system, np.append(a + p - y, (p - y).sum()))
        a, b = a - step[:-1], b - step[-1]
    return x.T @ a, b


def test_trained_weights_are_at_the_optimum(spark, sf):
    train = _train_rows(spark, sf)
    tfidf, both = md.train_tfidf_lr(train, 400), md.train_hybrid(train, 400)
    vectors = {
        "tfidf": (tfidf.model, md._add_tfidf(train, tfidf.vectors).select("label", vector_to_array("tfidf").alias("x"))),
        "hybrid": (both.model, md.assemble_features(train, both.vectors, both.stats).select("label", vector_to_array("features").alias("x"))),
    }
    for model, rows in vectors.values():
        rows = rows.collect()
        x, y = np.array([r.x for r in rows]), np.array([float(r.label) for r in rows])
        weights, intercept = optimum(x, y)
        assert np.abs(model.coefficients.toArray() - weights).max() < 1e-3
        assert abs(model.intercept - intercept) < 1e-3
        p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
        assert np.abs(x.T @ (p - y) + model.coefficients.toArray()).max() < 1e-3
        assert 0 < model.summary.totalIterations < md.MAX_ITERATIONS


def test_saved_models_score_the_same(spark, sf, tfidf_lr, hybrid, tmp_path):
    docs = _clean_messages(spark, sf)
    for name, model, kind in (("t", tfidf_lr, md.TfidfLR), ("h", hybrid, md.HybridLR)):
        model.save(f"{tmp_path}/{name}")
        again = kind.load(spark, f"{tmp_path}/{name}")
        both = model(docs).select("doc_id", "prob").join(again(docs).select("doc_id", F.col("prob").alias("p")), "doc_id")
        assert both.where("abs(prob - p) > 1e-12").count() == 0


def test_predict_by_model(spark, sf, tfidf_lr, hybrid):
    scorers = {"tfidf": tfidf_lr, "hybrid": hybrid}
    docs = _clean_messages(spark, sf)
    long = md.predict_by_model(docs, scorers, ["tfidf", "hybrid"])
    assert long.groupBy("model").count().where(f"count = {docs.count()}").count() == 2
    assert long.where("prob is null or prob < 0 or prob > 1").count() == 0
    with pytest.raises(ValueError, match="unknown model type: bert"):
        md.predict_by_model(docs, scorers, ["bert"])


def test_batch_score_isolates_failures(spark):
    def scorer(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return np.full(len(texts), 0.25)

    df = spark.createDataFrame([(i, "bad" if i == 5 else "ok") for i in range(10)], "doc_id bigint, text string")
    rows = {r.doc_id: tuple(r)[1:] for r in md.batch_score(df.coalesce(1), scorer, batch_size=4).collect()}
    assert [i for i, r in rows.items() if r[2]] == [4, 5, 6, 7]
    assert rows[5] == (0.5, 0.5, True) and rows[0] == (0.75, 0.25, False)


def test_batch_score_takes_two_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    two = md.batch_score(df, lambda t: np.tile([0.9, 0.1], (len(t), 1))).first()
    assert tuple(two) == (1, 0.9, 0.1, False)
    assert md.batch_score(df.where("false"), lambda t: np.zeros(len(t))).count() == 0


def test_column_maths(spark):
    row = spark.range(1).select(
        sc.label_at_least(F.lit(0.5)).alias("ge"),
        sc.label_above(F.lit(0.5)).alias("gt"),
        sc.argmax_label(F.lit(1.0), F.lit(1.0)).alias("tie"),
        sc.softmax_phish(F.lit(800.0), F.lit(801.0)).alias("big"),
        sc.normalize_probs(F.lit(0.0), F.lit(0.0)).alias("zero"),
        sc.adjusted_prob(F.lit(0.95), F.lit(0), F.lit(3)).alias("up"),
        sc.adjusted_prob(F.lit(0.05), F.lit(3), F.lit(0)).alias("down"),
        sc.adjusted_prob(F.lit(0.3), F.lit(3), F.lit(2)).alias("same"),
    ).first()
    assert (row.ge, row.gt, row.tie) == (1, 0, 0)
    assert row.big == pytest.approx(0.7310585786)
    assert tuple(row.zero) == (0.0, 0.0)
    assert (row.up, row.down, row.same) == (1.0, 0.0, 0.3)


def predictions(spark, *rows):
    return spark.createDataFrame(rows, "doc_id bigint, model string, prob double")


def test_majority_and_failures(spark):
    df = predictions(
        spark,
        (1, "tfidf", 0.9), (1, "cnn", 0.1),
        (2, "tfidf", 0.9), (2, "cnn", 0.1), (2, "lstm", 0.8),
        (3, "tfidf", None), (3, "cnn", 0.7),
        (4, "tfidf", None),
    )
    rows = {r.doc_id: r for r in en.majority_vote(df).collect()}
    assert {i: r.prediction for i, r in rows.items()} == {1: 0, 2: 1, 3: 1}
    assert tuple(rows[2].votes) == (2, 1)
    assert rows[1].confidence == pytest.approx(0.5) and rows[2].confidence == pytest.approx(0.6)
    assert [r.doc_id for r in en.failed_documents(df).collect()] == [4]
    strict = {r.doc_id: r.prediction for r in en.majority_vote(df, {"lstm": 0.8}).collect()}
    assert strict[2] == 0


def test_weighted_averages(spark):
    df = predictions(spark, (1, "bert", 0.8), (1, "cnn", 0.2), (2, "x", 0.4), (2, "y", 0.8), (3, "bert", None))
    rows = {r.doc_id: r for r in en.weighted_average(df).collect()}
    assert rows[1].probability == pytest.approx((0.8 * 0.25 + 0.2 * 0.2) / 0.45)
    assert rows[2].probability == pytest.approx(0.6)
    assert (rows[3].probability, rows[3].prediction) == (0.5, 1)
    flat = df.withColumns({"legitimacy": F.lit(3), "suspicion": F.lit(2)})
    adjusted = {r.doc_id: r for r in en.adjusted_weighted(flat).collect()}
    assert adjusted[2].prediction == 0 and 3 not in adjusted


def test_stream_scores_like_the_batch(spark, sf, tfidf_lr, tmp_path):
    docs = fx.messages(spark, sf).select("doc_id", "text")
    docs.write.json(f"{tmp_path}/in")
    stream = arrivals.score_arrivals(
        arrivals.read_arrivals(spark, f"{tmp_path}/in", docs.schema), {"tfidf": tfidf_lr}, ["tfidf"]
    )
    arrivals.write_predictions(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = tfidf_lr(_clean_messages(spark, sf)).select("doc_id", F.col("prob").alias("p"))
    both = got.join(batch, "doc_id")
    assert both.count() == docs.count()
    assert both.where("abs(prob - p) > 1e-12").count() == 0


def test_null_text_is_scored_like_an_empty_one(spark, tfidf_lr):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, clean string")
    a, b = (r.prob for r in tfidf_lr(docs).collect())
    assert a == b


def test_members_count_their_terms_once_and_start_no_job(spark, sf, capsys):
    """F1, F2: one step of Python for both models, with no text behind it; the hybrid's score is not assembled from vectors."""
    train = _train_rows(spark, sf)
    tfidf = md.train_tfidf_lr(train, 300, beside=md.URL_FEATURES)
    hybrid = md.train_hybrid(train, after=tfidf)
    docs = _clean_messages(spark, sf)
    spark.sparkContext.setJobGroup("applying", "applying")
    try:
        long = md.predict_by_model(docs, {"tfidf": tfidf, "hybrid": hybrid}, ["tfidf", "hybrid"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("applying")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    long.explain()
    plan = capsys.readouterr().out
    (step,) = [line for line in plan.splitlines() if "MapInArrow" in line]
    asked, given = re.fullmatch(r".* run\((.*)\)#\d+, \[(.*)\], \w+", step).groups()
    assert "text#" not in asked and "text#" not in given and "clean#" not in given
    # Each model alone, and the hybrid by MLlib over its assembled vectors, say the same.
    features = md.assemble_features(docs, hybrid.vectors, hybrid.stats)
    plain = hybrid.model.transform(features).select("doc_id", vector_to_array("probability")[1].alias("p"))
    alone = tfidf(docs).select("doc_id", F.lit("tfidf").alias("model"), F.col("prob").alias("p"))
    want = alone.unionByName(plain.withColumn("model", F.lit("hybrid")))
    both = long.join(want, ["doc_id", "model"])
    assert both.count() == 2 * docs.count() and both.where("abs(prob - p) > 1e-9").count() == 0


def test_scorers_of_several_vocabularies_and_kinds(spark, tfidf_lr, hybrid):
    docs = spark.createDataFrame([(1, "a b", "urgent verify"), (1, None, None), (None, "http://192.0.2.7/x", "lunch")], "doc_id long, text string, clean string")
    scorers = {"flat": lambda df, out: df.withColumn(out, F.length("text") / 100.0), "tfidf": tfidf_lr, "hybrid": hybrid}
    rows = md.predict_by_model(docs, scorers, ["hybrid", "flat", "tfidf", "flat"]).collect()
    assert [r.model for r in rows] == ["hybrid", "flat", "tfidf", "flat"] * 3
    got = {(r.doc_id, r.model, round(r.prob, 9)) for r in rows if r.model != "flat"}
    want = {(r.doc_id, m, round(r.prob, 9)) for m in ("tfidf", "hybrid") for r in scorers[m](docs).collect()}
    assert got == want and [r.prob for r in rows if r.model == "flat"] == [0.03, 0.03, None, None, 0.18, 0.18]


def test_hybrid_goes_on_from_the_fit_before(spark, sf):
    """the same optimum from the other fit's packed rows, in far fewer passes."""
    train = _train_rows(spark, sf)
    alone, first = md.train_hybrid(train, 400), md.train_tfidf_lr(train, 400, beside=md.URL_FEATURES)
    after = md.train_hybrid(train, after=first)
    assert np.abs(alone.model.coefficients.toArray() - after.model.coefficients.toArray()).max() < 1e-3
    assert abs(alone.model.intercept - after.model.intercept) < 1e-3
    assert after.model.summary.gradient <= 1e-4 and after.model.summary.passes < 0.8 * alone.model.summary.passes
    with pytest.raises(ValueError, match="no packed rows"):
        md.train_hybrid(train, after=md.train_tfidf_lr(train, 40))


@pytest.mark.parametrize("name", ["evaluate_trained", "predict_by_model"])
def test_both_members_are_fitted_to_rows_packed_once(spark, sf, name, monkeypatch):
    """each member wrote the training rows again and packed vectors of its own."""
    from mailsieve.plans import QUERIES

    packed, written = [], []
    pack, write = md.packed_counts, md.durable
    monkeypatch.setattr(md, "packed_counts", lambda *a: packed.append(a) or pack(*a))
    monkeypatch.setattr(md, "durable", lambda df, name: written.append(name) or write(df, name))
    rows = QUERIES[name](spark, sf)
    assert len(packed) == 1 and written == ["blocks", "url_stats"]
    assert {r.model for r in rows.select("model").distinct().collect()} >= {"tfidf", "hybrid"}
