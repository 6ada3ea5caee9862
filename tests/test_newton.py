import warnings

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from mailsieve.operators import newton as nt
from mailsieve.operators import scoring as md
from mailsieve.plans.model_queries import _train_rows

SCHEMA = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("features", VectorUDT())])


def frame(spark, x, y):
    """Every other row as a sparse vector."""
    vectors = [Vectors.dense(r) if i % 2 else Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)]) for i, r in enumerate(x)]
    return spark.createDataFrame([(int(a), v) for a, v in zip(y, vectors)], SCHEMA)


def gradient(x, y, w, b, penalty=1.0):
    p = 1 / (1 + np.exp(-(x @ w + b)))
    return np.append(x.T @ (p - y) + penalty * w, (p - y).sum())


def sample(seed, n=300, d=25):
    rng = np.random.default_rng(seed)
    # Columns of very different sizes are what makes a fit slow to settle.
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.4) * 10.0 ** rng.integers(-3, 3, d)
    y = (x @ (rng.normal(size=d) / np.abs(x).max(0)) + rng.normal(size=n) > 0.3).astype(int)
    return x, y


@pytest.mark.parametrize("seed", range(3))
def test_the_gradient_vanishes(spark, seed):
    x, y = sample(seed)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fit = nt.fit_logistic(frame(spark, x, y), x.shape[1])
    assert np.linalg.norm(gradient(x, y, fit.weights, fit.intercept)) < 2 * nt.TOLERANCE
    assert fit.summary.passes < 400 and fit.summary.gradient <= nt.TOLERANCE


def test_penalty_weighs_the_squares(spark):
    x, y = sample(9)
    fit = nt.fit_logistic(frame(spark, x, y), x.shape[1], penalty=30.0)
    assert np.linalg.norm(gradient(x, y, fit.weights, fit.intercept, 30.0)) < 2 * nt.TOLERANCE


def test_production_vocabulary_settles(spark, sf):
    train = _train_rows(spark, sf)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        model = md.train_tfidf_lr(train)
    rows = md._add_tfidf(train, model.vectors).select("label", vector_to_array("tfidf").alias("x")).collect()
    x, y = np.array([r.x for r in rows]), np.array([float(r.label) for r in rows])
    left = gradient(x, y, model.model.coefficients.toArray(), model.model.intercept)
    assert x.shape[1] > 1000 and np.abs(left).max() < 1e-3
    assert model.model.summary.passes < 100


def test_sums_do_not_depend_on_blocks_or_depth(spark, monkeypatch):
    x, y = sample(4)
    w = np.random.default_rng(1).normal(size=x.shape[1] + 1) * 1e-3
    whole = nt.tree_sum(nt.pack(frame(spark, x, y).coalesce(1)), nt._at(w), 2 * len(w) + 1)
    monkeypatch.setattr(nt, "BLOCK_ENTRIES", 40)
    blocks = nt.pack(frame(spark, x, y).repartition(12))
    assert blocks.count() > 50
    assert np.allclose(nt.tree_sum(blocks, nt._at(w), 2 * len(w) + 1, fan_in=2), whole, rtol=1e-10)
    direction = np.ones(len(w))
    z = x @ w[:-1] + w[-1]
    p = 1 / (1 + np.exp(-z))
    wide = np.hstack([x, np.ones((len(x), 1))])
    assert np.allclose(nt.tree_sum(blocks, nt._bend(w, direction), len(w)), wide.T @ (p * (1 - p) * (wide @ direction)))


def test_no_rows_rows_without_entries_and_one_class(spark):
    none = nt.fit_logistic(frame(spark, np.zeros((0, 3)), []), 3)
    assert none.weights.tolist() == [0, 0, 0] and none.intercept == 0 and none.summary.totalIterations == 0
    flat = nt.fit_logistic(frame(spark, np.zeros((8, 3)), [1, 1, 1, 1, 1, 1, 0, 0]), 3)
    assert flat.weights.tolist() == [0, 0, 0] and flat.intercept == pytest.approx(np.log(3), abs=1e-4)
    one = nt.fit_logistic(frame(spark, np.eye(4), [1] * 4), 4)
    assert one.intercept > 5 and one.summary.gradient <= nt.TOLERANCE


def test_blocks_are_packed_from_the_rows_in_one_write(spark, monkeypatch):
    """no table of vectors is written first, and an index takes two bytes where that does."""
    from pyspark.ml.linalg import Vectors

    from mailsieve.operators import newton as nt

    written = []
    monkeypatch.setattr(nt, "durable", lambda df, name: written.append(name) or df)
    vectors = [Vectors.sparse(70_000, [1, 5], [2.0, 3.0]), Vectors.dense([1.0, 0.0, 4.0])]
    for keep, width in ((vectors, 2), ([*vectors, Vectors.sparse(70_000, [69_999], [7.0])], 4)):
        rows = spark.createDataFrame([(k % 2, v) for k, v in enumerate(keep)], ["label", "features"]).coalesce(1)
        (raw,) = nt.pack(rows).toArrow().to_batches()
        (block,) = nt._blocks([raw])
        assert block.label.tolist() == [0.0, 1.0, 0.0][: len(keep)] and block.indices.itemsize == width
        assert block.ends.tolist() == [2, 5, 6][: len(keep)]
        assert block.indices.tolist() == [1, 5, 0, 1, 2, 69_999][: block.ends[-1]]
        assert block.values.tolist() == [2.0, 3.0, 1.0, 0.0, 4.0, 7.0][: block.ends[-1]]
    assert written == ["blocks", "blocks"]


def test_counts_of_terms_are_fitted_like_their_vectors(spark):
    """rows go from the texts into blocks of counts, without vectors between."""
    from mailsieve.operators import termblocks as tb

    rng = np.random.default_rng(3)
    terms, idf = ["aa", "bb", "cc", "aa bb", "dd"], np.array([1.0, 2.0, 1.5, 3.0, 1.2])
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "xx"], rng.integers(0, 9))) for _ in range(118)] + [None, "aa " * 300]
    rows = [(int(rng.random() < 0.2 + 0.6 * ("aa" in (t or ""))), t, int(rng.integers(0, 5))) for t in texts]
    df = spark.createDataFrame(rows, "label int, clean string, u int").repartition(3)
    blocks = tb.packed_counts(df, "clean", "label", terms, idf, ("u",))
    shift, scale = np.array([2.0]), np.array([1.5])
    fit = nt.fit_blocks(blocks, 6, read=nt.term_reader(idf, shift, scale))
    vectors = tb.with_tfidf(df, "clean", terms, idf).select("label", "u", vector_to_array("tfidf").alias("x")).collect()
    x = np.array([[*r.x, (r.u - 2.0) / 1.5] for r in vectors])
    assert np.linalg.norm(gradient(x, np.array([r.label for r in vectors]), fit.weights, fit.intercept)) < 2 * nt.TOLERANCE
    (one,) = tb.packed_counts(df.coalesce(1), "clean", "label", terms, idf).toArrow().to_batches()[:1]
    (block,) = nt.term_reader(idf, np.zeros(0), np.ones(0))(iter([one]))
    assert block.values.max() == 300 and block.values.itemsize == 4 and block.indices.itemsize == 2 and block.beside.shape == (120, 0)


def test_what_a_fit_learned_of_the_hessian_saves_passes(spark, sf):
    """every Newton step started its system from the diagonal alone."""
    train = _train_rows(spark, sf)
    model = md.train_tfidf_lr(train)
    assert model.model.summary.passes < 35
    x, y = sample(5)
    first = nt.fit_logistic(frame(spark, x[:, :20], y), 20)
    blocks = nt.pack(frame(spark, x, y))
    again, alone = nt.fit_blocks(blocks, 25, after=first), nt.fit_blocks(blocks, 25)
    assert np.linalg.norm(gradient(x, y, again.weights, again.intercept)) < 2 * nt.TOLERANCE
    assert np.abs(again.weights - alone.weights).max() < 1e-3


def test_little_room_for_products_changes_no_optimum(spark, monkeypatch):
    monkeypatch.setattr(nt, "CURVATURE_BYTES", 0)
    x, y = sample(6)
    fit = nt.fit_logistic(frame(spark, x, y), x.shape[1])
    assert len(fit.curvature) <= 8 and np.linalg.norm(gradient(x, y, fit.weights, fit.intercept)) < 2 * nt.TOLERANCE
