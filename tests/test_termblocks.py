import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.operators import features as ft
from mailsieve.operators import scoring as md
from mailsieve.operators import termblocks as tb
from mailsieve.plans import fixtures as fx

TEXTS = ["ab cd ab cd x ef", None, "", "a b c", "Ab_1 é ab-cd <url> @.", "zz " * 50, "abücd ab"]


def terms(text):
    words = re.findall(r"(?a)\w{2,}", text or "")
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, clean string")


def test_counted_terms_need_no_aggregation_but_for_repeated_ids(spark, docs, capsys):
    want = Counter((i, t) for i, text in enumerate(TEXTS) for t in terms(text))
    counted = ft.ngrams_1_2(docs, counted=True)
    assert {(r.doc_id, r.term): r.tf for r in counted.collect()} == want
    counted.explain()
    assert "HashAggregate" not in capsys.readouterr().out
    odd = docs.unionAll(docs.where("doc_id = 0")).unionAll(docs.select(F.lit(None).cast("long"), "clean").where("doc_id < 5"))
    want += Counter((0, t) for t in terms(TEXTS[0]))
    want += Counter((None, t) for text in TEXTS[:5] for t in terms(text))
    got = ft.ngrams_1_2(odd, counted=True).collect()
    assert len(got) == len(want) and {(r.doc_id, r.term): r.tf for r in got} == want


def test_counts_in_small_blocks_add_up(docs, monkeypatch):
    monkeypatch.setattr(tb, "BLOCK_BYTES", 8)
    tf, df = Counter(), Counter()
    for text in TEXTS:
        tf.update(terms(text))
        df.update(set(terms(text)))
    assert {r.term: (r.tf, r.df) for r in ft.term_counts(docs).collect()} == {t: (tf[t], df[t]) for t in tf}


def test_hashes_of_terms_that_no_text_has_are_none():
    held = tb.term_hashes(["ab", "ab cd", "ab  cd", "a", "ab cd ef", "", "ab-cd", " ab", "é"])
    assert [bool(h) for h in held] == [True, True] + [False] * 7


def test_vectors_are_made_without_exploding_terms_in_the_jvm(spark, sf, capsys):
    train = fx.train_clean(spark, sf)
    ft.fit_idf(train, 50)
    tb.counts(train, "clean", True).explain()
    assert "Generate" not in capsys.readouterr().out
    rows = md._add_tfidf(train, md.tfidf_vectors(ft.fit_idf(train, 50)))
    rows.explain()
    plan = capsys.readouterr().out
    assert "regexp_extract_all" not in plan and "Exchange" not in plan


def test_sequences_move_lists_of_ids_and_merge_repeated_ids(spark, capsys):
    vocab = spark.createDataFrame([("aa", 2), ("b", 3)], "word string, id int")
    rows = spark.createDataFrame([(1, "b aa x"), (1, "aa"), (2, None), (None, "b"), (3, "aa b_aa")], "doc_id long, clean string")
    coded = ft.texts_to_sequences(rows, vocab)
    assert {r.doc_id: r.ids for r in coded.collect()} == {1: [2, 3, 2, 1], 2: [], None: [3], 3: [2, 3, 2]}
    joined = ft._joined_sequences(rows, vocab, ft.NUM_WORDS, "doc_id", "clean", None)
    assert sorted(map(str, joined.collect())) == sorted(map(str, coded.collect()))
    coded.explain()
    assert "Generate" not in capsys.readouterr().out


def test_linear_scores_equal_the_joined_form(spark, sf, monkeypatch):
    train = fx.train_clean(spark, sf)
    fitted = ft.fit_idf(train, 200)
    weights = ft.TermWeights(fitted.table.withColumn("weight", fx.hashed_weight()), 200)
    rows = train.limit(50).unionByName(train.limit(3))
    inside = {r.doc_id: r.score for r in md.linear_score(rows, weights, 0.5).collect()}
    monkeypatch.setattr(md, "BROADCAST_ROWS", 199)
    joined = {r.doc_id: r.score for r in md.linear_score(rows, weights, 0.5).collect()}
    assert inside.keys() == joined.keys() and np.allclose([inside[k] for k in joined], list(joined.values()))


def test_models_share_a_vocabulary(spark, sf):
    rows = fx.split_emails(spark, sf).where("split = 'train'").select("text", "label", fx.clean_text("text").alias("clean")).limit(60)
    first = md.train_tfidf_lr(rows, 40)
    assert md.train_hybrid(rows, 40, weights=first.weights).weights is first.weights


def test_cleaned_texts_are_looked_up_though_nothing_else_asks_for_them(docs):
    cleaned = docs.select("doc_id", fx.clean_text("clean").alias("clean"))
    added = tb.with_sums(cleaned, "clean", ["ab"], np.ones(1), np.ones(1)).select("doc_id", "sums.dot")
    assert {r.doc_id: r.dot for r in added.collect()} == {i: Counter(terms((t or "").lower()))["ab"] for i, t in enumerate(TEXTS)}


def test_a_model_sums_up_inside_the_row():
    """no vector of a text leaves Python."""
    import inspect

    assert "with_sums" in inspect.getsource(md.TfidfLR.__call__)


def test_tasks_need_no_installed_copy(spark, tmp_path):
    """what fits and counts send to the tasks loads where the package isn't."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from mailsieve.operators import newton as nt

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, fn, schema):  # noqa: N802
            return fn

    w = np.zeros(4)
    sent = [tb.packed_counts(Frame(), "clean", "label", ["ab"], np.ones(1), ("u",)), nt.term_reader(np.ones(1), w[:1], w[:1] + 1), nt._blocks, nt._at(w), nt._bend(w, w)]
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(sent))
    load = f"import pickle; pickle.load(open({str(tmp_path / 'sent')!r}, 'rb')); import sys; assert not any(m.startswith('mailsieve') for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True)
    assert not done.returncode, done.stderr
