import common as c
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
import test_decontaminate
import test_neardup
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The output of every stage over the smallest tables, each written and read again."""
    root = tmp_path_factory.mktemp("stages")
    out = [c.documents(spark, sf)]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "source_mixing", "token_files"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, sf, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, _ in rows(stages[1])}
    assert kept <= {i for i, _ in rows(stages[0])}
    assert sum(labels.get(i) == 0 for i, _ in rows(stages[0])) == sum(labels.get(i) == 0 for i in kept)


def test_one_document_of_each_group_stays(stages):
    groups = test_neardup.brute(rows(stages[1]))
    assert sorted(i for i, _ in rows(stages[2])) == sorted(set(groups.values()))


def test_contaminated_documents_go(spark, sf, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in test_decontaminate.brute(rows(stages[2]), items) if not r[5]}
    assert {i for i, _ in rows(stages[3])} == clean


def test_every_document_is_mixed_in(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) == set(before) and len(after) >= len(before)


def test_tokens_of_all_copies(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows(stages[4]))
    got = stages[5].orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == want
    assert [r.start for r in got] == [sum(n for _, n in want[:k]) for k in range(len(want))]


def test_run_gives_the_same_rows(spark, sf, stages):
    assert sorted(map(tuple, pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages[5].collect()))


OWN = [*c.CLASHING, "longest", "tokens", "held", "before", "budget", "cut", "left", "blocks", "row", "class", "_number", "_id"]


def test_columns_with_the_operators_own_names_keep_their_values(spark, sf):
    docs = c.documents(spark, sf).withColumns({x: F.concat(F.lit(f"{x} "), F.col("doc_id")) for x in dict.fromkeys(OWN)})
    want = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r == want[r.doc_id] for r in got), name
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == len(want)


def test_without_labels_nothing_is_dropped(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = c.documents(spark, sf)
    assert pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_edge_documents_go_through_every_stage(spark, sf):
    docs = c.edge_docs(spark)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
