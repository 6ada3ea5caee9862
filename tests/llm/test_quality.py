import random
from collections import Counter

import common as c
import numpy as np
import pytest

from mailsieve.llm import quality as q
from mailsieve.llm import queries


def counts(text):
    w = c.SPACED.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) for d in range(3) if seen[w[k], w[k + 1], w[k + 2]] > 1}
    lines = [x for x in (text or "").split("\n") if c.SPACED.search(x)]
    symbols = sum(x in "#*$%&|<>" for x in text or "")
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_and_verdicts(spark, sf):
    texts = {r.doc_id: r.text for r in c.documents(spark, sf).collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
        if quality.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept
        if quality.get(r.doc_id) == 0:
            assert not r.kept


def test_counts_of_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\t", "😀", "\r", "<"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = q.base_counts(c.frame(spark, texts)).collect()
    assert all(tuple(r[n] for n in NAMES) == counts(texts[r.doc_id]) for r in rows)


def test_only_dataframe_functions(spark, sf, capsys):
    q.judge(c.documents(spark, sf)).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "RDD"))


def test_chi_square_points():
    for p, d, x in ((0.95, 1, 3.841459), (0.975, 5, 12.832502), (0.99999, 5, 30.856190), (0.5, 7, 6.345811)):
        assert q.chi_square_point(p, d) == pytest.approx(x, abs=1e-5)


def test_junk_does_not_move_the_estimate(spark):
    """Forty per cent of a source is junk of one kind; it goes, and the rest stays."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    clean = [" ".join(word() for _ in range(rng.randrange(60, 200))) for _ in range(300)]
    junk = [" ".join(word().upper() + "!!" for _ in range(rng.randrange(60, 200))) for _ in range(200)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in q.judge(docs).where("kept").collect()}
    assert kept == set(range(300))


def test_small_groups_are_judged_by_their_language_or_by_all(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    clean = lambda: " ".join(word() for _ in range(rng.randrange(60, 200)))
    junk = lambda: " ".join(word().upper() + "!#" for _ in range(rng.randrange(60, 200)))
    rows = [(i, clean(), "en", "s") for i in range(200)]
    rows += [(1000, junk(), "en", "one"), (1001, junk(), "xx", "one"), (1002, junk(), None, "one")]
    rows += [(2000, clean(), "en", "two"), (2001, clean(), "yy", "one"), (2002, clean(), "xx", "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = q.judge(docs)
    assert judged.count() == len(rows)
    assert {r.doc_id for r in judged.where("kept").collect()} == {*range(200), 2000, 2001, 2002}


def test_transform_inverts_the_scatter(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, q.DIMS)) @ rng.normal(size=(q.DIMS, q.DIMS))
    names = [f"x{i}" for i in range(q.DIMS)]
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{n} double" for n in names))
    start = spark.createDataFrame([("g", *[0.0] * q.DIMS, *[float(i == j) for i, j in q.PAIRS])], "grp string, " + ", ".join(f"c{i} double" for i in range(q.DIMS)) + ", " + ", ".join(f"m{i}{j} double" for i, j in q.PAIRS))
    fitted = q._transform(q._total(q._moments(rows, start)), 1.0)
    scatter = np.cov(x.T, bias=True) + np.diag(np.square(q.FLOORS))
    want = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(scatter), x - x.mean(0))
    got = [r.d2 for r in rows.join(fitted, "grp").withColumn("d2", q.distance()).collect()]
    assert np.allclose(sorted(got), sorted(want))
    assert fitted.first().log_det == pytest.approx(np.linalg.slogdet(scatter)[1])


def test_edges(spark):
    docs = c.edge_docs(spark)
    judged = q.judge(docs)
    rows = judged.collect()
    assert len(rows) == len(c.EDGE)
    by = {r.doc_id: r for r in rows}
    for i, t, *_ in c.EDGE:
        assert tuple(by[i][n] for n in NAMES) == counts(t)
    assert by[5].kept and by[6].kept and not by[1].kept and by[1].distance == 0
    assert [x for x in docs.columns if x not in {"text", "n_words", "kept", "distance"} and x in judged.columns]
    assert q.judge(c.no_docs(spark)).count() == 0
