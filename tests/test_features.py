import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailsieve.operators import features as ft
from mailsieve.operators import scoring as md
from mailsieve.plans import fixtures as fx


@pytest.fixture(scope="module")
def train(spark, sf):
    return fx.train_clean(spark, sf)


def plain_terms(clean):
    import re

    words = re.findall(r"[a-z0-9_]{2,}", clean)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_terms_of_short_texts(spark):
    df = spark.createDataFrame([(0, "a bb cc_1 bb"), (1, "xx"), (2, ""), (3, "a b")], "doc_id int, clean string")
    got = {r.doc_id: r.terms for r in ft.with_terms(df).collect()}
    assert got == {0: ["bb", "cc_1", "bb", "bb cc_1", "cc_1 bb"], 1: ["xx"], 2: [], 3: []}


@pytest.mark.parametrize("k", [3, 50, 400, 5000])
def test_pruned_vocabulary_equals_unpruned(train, k):
    every = ft.term_counts(train).orderBy(F.desc("tf"), "term").limit(k).collect()
    assert [tuple(r) for r in ft.vocab_topk(train, k).collect()] == [tuple(r) for r in every]


def test_vocabulary_against_brute_force(train):
    tf, df = Counter(), Counter()
    for r in train.collect():
        terms = plain_terms(r.clean)
        tf.update(terms)
        df.update(set(terms))
    want = sorted(tf, key=lambda t: (-tf[t], t))[:300]
    got = ft.vocab_topk(train, 300).collect()
    assert [(r.term, r.tf, r.df) for r in got] == [(t, tf[t], df[t]) for t in want]


def test_pruning_gives_way_when_everything_ties(spark):
    df = spark.createDataFrame([(" ".join(f"w{i:03d}" for i in range(100)),)], "clean string")
    got = [r.term for r in ft.vocab_topk(df, 5).collect()]
    assert got == ["w000", "w000 w001", "w001", "w001 w002", "w002"]


def test_tfidf_rows_have_unit_length_and_match_vectors(spark, sf, train):
    weights = ft.fit_idf(train, 500)
    docs = fx.message_clean(spark, sf)
    table = ft.tfidf(docs, weights)
    norms = table.groupBy("doc_id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("n"))
    assert norms.where("abs(n - 1) > 1e-9").count() == 0
    vectors = md._add_tfidf(docs, md.tfidf_vectors(weights))
    total = F.aggregate(vector_to_array("tfidf"), F.lit(0.0), lambda a, v: a + v)
    sums = table.groupBy("doc_id").agg(F.sum("tfidf").alias("s"))
    both = vectors.select("doc_id", total.alias("t")).join(sums, "doc_id", "left").fillna(0.0)
    assert both.count() == docs.count()
    assert both.where("abs(t - s) > 1e-9").count() == 0


def test_tfidf_needs_no_shuffle(spark, sf, train, capsys):
    weights = ft.fit_idf(train, 500)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", fx.clean_text("text").alias("clean"))
    ft.tfidf(docs, weights).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 0
    assert "BroadcastHashJoin" in plan
    assert "size(regexp_extract_all" not in plan


def test_tfidf_by_rows_equals_tfidf_by_joins(spark, sf, train, monkeypatch):
    weights = ft.fit_idf(train, 500)
    docs = fx.message_clean(spark, sf)
    keys = ["doc_id", "term", "tf", F.round("tfidf", 9).alias("x")]
    inside = ft.tfidf(docs, weights).select(*keys)
    monkeypatch.setattr(ft, "BROADCAST_ROWS", 499)
    joined = ft.tfidf(docs, weights).select(*keys)
    assert inside.count() == joined.count() and inside.exceptAll(joined).isEmpty()


def test_tfidf_of_nothing(spark, sf, train):
    weights = ft.fit_idf(train, 50)
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "zzqq")], "doc_id long, clean string")
    assert ft.tfidf(docs, weights).count() == 0
    empty = ft.TermWeights(weights.table.where("false"), 50)
    assert ft.tfidf(fx.message_clean(spark, sf), empty).count() == 0


def test_idf_formula(train):
    n = train.count()
    for r in ft.fit_idf(train, 50).table.collect():
        assert r.idf == pytest.approx(math.log((1 + n) / (1 + r.df)) + 1)


def test_sequences_edge_cases(spark):
    train = spark.createDataFrame([(0, "b a a c"), (1, "c d")], "doc_id bigint, clean string")
    vocab = ft.seq_vocab(train)
    assert {r.word: r.id for r in vocab.collect()} == {"a": 2, "c": 3, "b": 4, "d": 5}
    small = ft.seq_vocab(train, num_words=4)
    assert {r.word: r.id for r in small.collect()} == {"a": 2, "c": 3}
    docs = spark.createDataFrame(
        [(0, "a <url> z_b"), (1, ""), (2, "a " * 201), (3, "d")], "doc_id bigint, clean string"
    )
    coded = {r.doc_id: r.ids for r in ft.texts_to_sequences(docs, vocab).collect()}
    assert coded == {0: [2, 1, 1, 4], 1: [], 2: [2] * 201, 3: [5]}
    padded = {r.doc_id: r.padded for r in ft.pad_sequences(docs, vocab).collect()}
    assert padded == {0: [2, 1, 1, 4] + [0] * 196, 1: [0] * 200, 2: [2] * 200, 3: [5] + [0] * 199}


def test_scaler_with_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = ft.scaler_fit(df, ("a", "b"))
    other = spark.createDataFrame([(3.0, 7.0)], "a double, b double")
    row = ft.scaler_transform(other, stats, ("a", "b")).first()
    assert (row.a_scaled, row.b_scaled) == (1.0, 2.0)


def test_scaler_plan_has_no_join(spark, sf, capsys):
    rows = md.with_url_features(fx.table(spark, sf, "documents").select("doc_id", "text"))
    ft.scaler_transform(rows, ft.scaler_fit(rows)).explain()
    assert "Join" not in capsys.readouterr().out
