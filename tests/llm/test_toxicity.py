import random
import zlib

import common as c
import numpy as np
import pytest

from mailsieve.llm import queries, toxicity as tx

BIG = "/root/testdata/sf0.1"


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_sparsity(spark):
    docs, labels = c.documents(spark, BIG), spark.read.parquet(f"{BIG}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = queries.op4_toxicity(spark, BIG).collect()
    assert len(rows) == docs.count() and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert sum(a == 0 and b == 1 for a, b in test) <= 2
    model = tx.learn_toxicity(docs.select("doc_id", "text"), labels)
    assert np.count_nonzero(model.table) < 5_000


def test_held_out_labels_do_not_matter(spark, sf):
    docs, labels = c.documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out("doc_id"), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    a, b = tx.learn_toxicity(docs, labels), tx.learn_toxicity(docs.repartition(3), flipped.repartition(2))
    assert np.array_equal(a.table, b.table)


def test_learns_a_phrase_and_a_skip_gram():
    """Words that tell nothing alone do so as neighbours or over one word."""
    rng = random.Random(0)
    texts, labels = [], []
    for k in range(1200):
        fill = [f"f{rng.randrange(40)}" for _ in range(12)]
        label = k % 2
        pair = ["red", "car"] if label else ["car", "red"]
        if k % 4 < 2:
            pair.insert(1, f"f{rng.randrange(40)}")
        at = rng.randrange(10)
        texts.append(" ".join(fill[:at] + pair + fill[at:]))
        labels.append(float(label))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": texts, "label": labels})
    cells = list(tx.feature_rows("label", 20)([batch]))
    weights = next(tx.learn_shard(20, 4)(cells))
    model = tx.Model(weights.column(0).to_numpy(), weights.column(1).to_numpy(), 20)
    (_, data, offsets), = tx.bw.text_blocks([batch])
    assert ((model.scores(data, offsets) >= 0.5) == np.array(labels)).mean() > 0.99


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, None), (8, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    docs = c.edge_docs(spark)
    for known in (labels, labels.limit(0)):
        scored = tx.score_texts(docs, tx.learn_toxicity(docs, known))
        rows = scored.collect()
        assert len(rows) == len(c.EDGE) and all(0 <= r.score <= 1 for r in rows)
        assert scored.columns == [*(x for x in docs.columns if x not in ("score", "predicted")), "score", "predicted"]
    assert all(r.score == 0.5 for r in rows)
    assert tx.score_texts(c.no_docs(spark), tx.learn_toxicity(docs, labels)).count() == 0
    assert spark.createDataFrame([(None,)], "doc_id long").select(tx.held_out("doc_id")).first()[0] is False


@pytest.mark.parametrize("limit", [40, 10_000])
def test_sample_is_bounded(spark, sf, limit):
    docs, labels = c.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "label")
    model = tx.fit(docs.join(labels, "doc_id"), max_rows=limit)
    assert np.isfinite(model.table).all()
