import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.operators import ensemble as en
from mailsieve.operators import scoring as md


class Counting:
    """Raises on calls that hold a bad text and counts its calls."""

    def __init__(self, bad):
        self.bad, self.calls = bad, 0

    def __call__(self, texts):
        self.calls += 1
        if self.bad & set(texts):
            raise RuntimeError("bad")
        return np.linspace(0.5, 0.5, len(texts))


@pytest.mark.parametrize("bad", [set(), {"0"}, {"31"}, {"3", "4", "17"}, {str(k) for k in range(32)}])
def test_only_texts_that_raise_fail(bad):
    texts = [str(k) for k in range(32)]
    scorer = Counting(bad)
    probs, errors = md.isolated_scores(scorer, texts)
    assert [t for t, p in zip(texts, probs) if p is None] == [t for t in texts if t in bad]
    assert [e for e in errors if e] == ["RuntimeError: bad"] * len(bad)
    assert scorer.calls <= 1 + 10 * len(bad)
    assert md.isolated_scores(scorer, []) == ([], [])


@pytest.mark.parametrize(
    "answer, error",
    [
        (lambda t: np.zeros(len(t) + 1), "ValueError: scorer returned shape (2,) for 1 texts"),
        (lambda t: np.full(len(t), np.nan), "ValueError: nan is no probability"),
        (lambda t: [1.5] * len(t), "ValueError: 1.5 is no probability"),
        (lambda t: [None] * len(t), "ValueError: nan is no probability"),
        (lambda t: 1 / 0, "ZeroDivisionError: division by zero"),
        (lambda t: {}.popitem() and [1], "KeyError: 'popitem(): dictionary is empty'"),
    ],
)
def test_answers_that_are_none(answer, error):
    assert md.isolated_scores(answer, ["a", "b"]) == ([None, None], [error, error])


@pytest.fixture
def picky():
    def score(texts):
        if "bad" in texts:
            raise ValueError("can't")
        return np.array([0.9 if t else 0.1 for t in texts])

    return md.TextScorer(score)


def test_members_and_votes(spark, picky):
    docs = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, "")], "doc_id long, clean string")
    members = {"picky": picky, "flat": lambda df, out: df.withColumn(out, F.lit(0.2)), "gone": lambda df, out: 1 / 0}
    scored = md.predict_members(docs, members).cache()
    got = {(r.doc_id, r.model): (r.prob, r.error) for r in scored.collect()}
    zero = (None, "ZeroDivisionError: division by zero")
    assert got == {
        (1, "picky"): (0.9, None), (2, "picky"): (None, "ValueError: can't"), (3, "picky"): (0.1, None), (4, "picky"): (0.1, None),
        **{(i, "flat"): (0.2, None) for i in range(1, 5)}, **{(i, "gone"): zero for i in range(1, 5)},
    }
    votes = {r.doc_id: len(r.members) for r in en.majority_vote(scored).collect()}
    assert votes == {1: 2, 2: 1, 3: 2, 4: 2}
    reasons = {r.doc_id: r.failures for r in en.failure_reasons(scored).collect()}
    assert reasons[2] == "gone=ZeroDivisionError: division by zero; picky=ValueError: can't" and len(reasons) == 4
    assert en.failed_documents(scored).count() == 0


def test_nobody_answers_no_members_no_rows(spark, picky):
    docs = spark.createDataFrame([(1, "ok")], "doc_id long, clean string")
    alone = md.predict_members(docs, {"gone": lambda df, out: 1 / 0})
    assert [r.doc_id for r in en.failed_documents(alone).collect()] == [1]
    assert md.predict_members(docs, {}).count() == 0
    assert md.predict_members(docs.where("false"), {"picky": picky}).count() == 0
