import hashlib

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import split as sp


def key(i):
    return (hashlib.md5(f"{i}:42".encode()).hexdigest(), i)


def naive(ids, train=(4, 5), val=(9, 10)):
    ordered = sorted(ids, key=key)
    n = len(ordered)
    a, b = n * train[0] // train[1], n * val[0] // val[1]
    return {i: "train" if r < a else "validation" if r < b else "test" for r, i in enumerate(ordered)}


@pytest.fixture(scope="module")
def corpus(spark):
    label = F.when(F.col("id") % 9 == 0, 1).otherwise(0)
    return spark.range(20_011).select(F.col("id").alias("doc_id"), label.alias("label")).repartition(5)


def test_split_equals_naive_rank_and_covers_every_row(corpus):
    got = {r.doc_id: r.split for r in sp.stratified_split(corpus).collect()}
    ones = [i for i in range(20_011) if i % 9 == 0]
    zeros = [i for i in range(20_011) if i % 9]
    assert got == naive(ones) | naive(zeros)


def test_other_sizes_are_real_parameters(corpus):
    summary = sp.split_summary(sp.stratified_split(corpus, val_size=0.25, test_size=0.25))
    assert {r.split: r.n for r in summary.collect()} == {"train": 10005, "validation": 5003, "test": 5003}


def test_tiny_strata(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id bigint, label int")
    got = {r.doc_id: r.split for r in sp.stratified_split(df).collect()}
    assert got == naive([1]) | naive([2, 3])


def test_labels_are_checked(spark):
    df = spark.createDataFrame([(1, 0), (2, 7)], "doc_id bigint, label int")
    with pytest.raises(Exception, match="label must be 0 or 1, found 7"):
        sp.stratified_split(df).collect()


def test_shuffle_rank_and_order(corpus):
    want = sorted(range(20_011), key=key)
    ranks = {r.doc_id: r.shuffle_rank for r in sp.shuffle_rank(corpus).collect()}
    assert [ranks[i] for i in want] == list(range(1, 20_012))
    assert [r.doc_id for r in sp.seeded_shuffle(corpus).collect()] == want


@pytest.mark.parametrize("n", [1, 100, 12_345, 50_000])
def test_sample_by_top_k_and_by_cut(corpus, n):
    got = {r.doc_id for r in sp.seeded_sample(corpus, n).collect()}
    assert got == set(sorted(range(20_011), key=key)[:n])


def test_same_split_for_any_partitioning(corpus):
    one = sp.stratified_split(corpus.coalesce(1)).collect()
    many = sp.stratified_split(corpus.repartition(13)).collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in many}
