import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.functions.urls import URL_FEATURES
from mailsieve.operators import explain as ex
from mailsieve.plans import fixtures as fx

DOCS = [
    (1, "Dear Sir, verify account; VERIFY your account_1 now: http://a.b/login?x=1  (today)"),
    (2, "one"),
    (3, " été — naïve, 日本語 été "),
    (4, "..."),
    (5, ""),
]


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def variant(doc_id, text, sample):
    """Split into words and gaps, drop every occurrence of the removed words."""
    pieces = re.split(r"(\W+)", text)
    words = list(dict.fromkeys(p for i, p in enumerate(pieces) if i % 2 == 0 and p))
    if sample == 0 or not words:
        removed = set()
    else:
        n = 1 + int(md5(doc_id, sample)[:8], 16) % len(words)
        removed = set(sorted(words, key=lambda w: md5(doc_id, sample, w))[:n])
    text = "".join("" if i % 2 == 0 and p in removed else p for i, p in enumerate(pieces))
    return words, [w not in removed for w in words], text


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def test_variants_against_plain_python(docs):
    rows = ex.perturb_docs(docs, 40).collect()
    assert len(rows) == 40 * len(DOCS)
    texts = dict(DOCS)
    for r in rows:
        assert (r.words, r.keep, r.variant) == variant(r.doc_id, texts[r.doc_id], r.sample)


def test_sample_zero_is_the_document(docs):
    first = ex.perturb_docs(docs, 5).where("sample = 0").join(docs, "doc_id")
    assert first.where("variant <> text").count() == 0
    assert first.where(F.exists("keep", lambda k: ~k)).count() == 0


def test_kernel(spark):
    df = spark.createDataFrame([(0, 4), (1, 4), (4, 4)], "kept int, total int")
    distance = ex.kernel_distance(F.col("kept"), F.col("total"))
    got = [tuple(r) for r in df.select(distance, ex.kernel_weight(distance)).collect()]
    assert got[0] == (100.0, pytest.approx(math.exp(-8)))
    assert got[1] == (50.0, pytest.approx(math.exp(-2)))
    assert got[2] == (0.0, 1.0)


@pytest.mark.parametrize("shape", [(60, 9), (30, 80)])
def test_ridge_solves_the_weighted_normal_equations(shape):
    rng = np.random.default_rng(0)
    x = (rng.random(shape) < 0.6).astype(float)
    y, w, alpha = rng.random(shape[0]), rng.random(shape[0]) + 0.1, 0.7
    coef = ex._ridge(x, y, w, alpha)
    one = np.column_stack([np.ones(len(y)), x])
    penalty = alpha * np.eye(shape[1] + 1)
    penalty[0, 0] = 0.0
    want = np.linalg.solve(one.T @ (one * w[:, None]) + penalty, one.T @ (w * y))
    assert np.allclose(coef, want[1:])


def test_surrogate_finds_the_words_that_matter(docs):
    def scorer(df, out):
        return df.withColumn(
            out,
            0.1 + 0.6 * F.contains("clean", F.lit("verify")).cast("double")
            - 0.05 * F.contains("clean", F.lit("dear")).cast("double"),
        )

    top = ex.explain(docs.where("doc_id = 1"), scorer, num_features=3, num_samples=500).collect()
    assert len(top) == 3
    # Either spelling keeps the score up, so both share the weight.
    assert {r.token for r in top[:2]} == {"verify", "VERIFY"} and all(r.weight > 0.1 for r in top[:2])
    assert (top[2].token, top[2].weight < 0) == ("Dear", True)


def test_documents_without_words_have_no_explanation(docs):
    scorer = lambda df, out: df.withColumn(out, F.lit(0.3))
    got = {r.doc_id for r in ex.explain(docs, scorer, num_samples=20).collect()}
    assert got == {1, 2, 3}


def test_url_features_stay_those_of_the_original(docs):
    held = ex.perturb_docs(ex.hold_url_constant(docs), 30, carry=URL_FEATURES)
    per_doc = held.groupBy("doc_id").agg(*[F.countDistinct(f).alias(f) for f in URL_FEATURES])
    assert all(set(tuple(r)[1:]) == {1} for r in per_doc.collect())
    assert held.where("doc_id = 1 and url_keyword = 1").count() == 30


def test_explanations_do_not_depend_on_partitioning(docs):
    scorer = lambda df, out: df.withColumn(out, F.length("clean") / 100.0)
    runs = []
    for parts in (1, 8):
        rows = ex.explain(docs.repartition(parts), scorer, num_samples=60).collect()
        runs.append(sorted((r.doc_id, r.rank, r.token, round(r.weight, 9)) for r in rows))
    assert runs[0] == runs[1]


def test_record(spark, docs):
    top = spark.createDataFrame(
        [(1, r, f"t{r}", 1.0 / r) for r in range(1, 15)], "doc_id bigint, rank int, token string, weight double"
    )
    scored = docs.withColumn("prob", F.lit(0.3))
    rows = {r.doc_id: r for r in ex.explanation_record(scored, top, "m", "now", note="n").collect()}
    assert rows[1].label == "legitimate" and rows[1].probability == 0.7
    assert [t.token for t in rows[1].top_tokens] == [f"t{r}" for r in range(1, 11)]
    assert rows[2].top_tokens is None and rows[2].note == "n"


def test_whole_long_document_is_perturbed(spark, sf):
    longest = fx.table(spark, sf, "documents").orderBy(F.desc("n_chars")).limit(1).select("doc_id", "text")
    rows = ex.perturb_docs(longest, 3).select("sample", "variant", F.size("words").alias("n")).collect()
    text = longest.first().text
    assert {r.sample: r.variant for r in rows}[0] == text
    assert rows[0].n == len(set(re.findall(r"\w+", text)))
