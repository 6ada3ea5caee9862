import json

import pytest
from pyspark.sql import functions as F

from mailsieve.functions.text import clean_text
from mailsieve.operators import durable as du
from mailsieve.operators import split as sp
from mailsieve.sources import corpus as src
from mailsieve.sources import sinks

CSV = 'Email Text,Email Type\n"line one\nline ""two"", end",1\n,0\nplain,0\n'


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "mail.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_scan_clean_and_cast(spark, csv_path):
    df = src.cast_types(src.project_rename(src.scan_corpus(spark, csv_path), src.DEFAULT_TEXT, src.DEFAULT_LABEL))
    rows = [tuple(r) for r in df.select("text", "label", clean_text("text")).collect()]
    assert rows == [
        ('line one\nline "two", end', 1, "line one line two end"),
        ("nan", 0, "nan"),
        ("plain", 0, "plain"),
    ]


@pytest.mark.parametrize(
    "schema, found",
    [
        ("text string, label int", ("text", "label")),
        ("n int, email_text string, target int", ("email_text", "target")),
        ("id int, body string, subject string, is_phishing int, target int", ("body", "is_phishing")),
    ],
)
def test_column_discovery(spark, schema, found):
    assert src.resolve_columns(spark.createDataFrame([], schema)) == found


@pytest.mark.parametrize("schema", ["text string, kind int", "n int, label int"])
def test_column_discovery_fails_loudly(spark, schema):
    with pytest.raises(ValueError):
        src.resolve_columns(spark.createDataFrame([], schema))


def test_union_skips_missing_paths(spark, csv_path, tmp_path):
    merged = src.union_sources(spark, [csv_path, f"{tmp_path}/none.csv", csv_path])
    # A path listed twice is read twice.
    assert merged.count() == 6
    with pytest.raises(ValueError):
        src.union_sources(spark, [f"{tmp_path}/none.csv"])


def test_splits_written_and_pruned(spark, tmp_path, capsys):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    sinks.write_splits(sp.stratified_split(df), str(tmp_path / "s"))
    test = spark.read.parquet(f"{tmp_path}/s/corpus").where("split = 'test'")
    assert test.count() == 10
    test.explain()
    assert "PartitionFilters: [isnotnull(split" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/s/index").groupBy("split").count().count() == 3


def test_explanations_are_one_json_object_per_line(spark, tmp_path):
    df = spark.createDataFrame([("m", "a"), ("m", "b"), ("k", "c")], "model string, label string")
    sinks.write_explanations(df, str(tmp_path / "e"))
    lines = [json.loads(x) for f in (tmp_path / "e" / "model=m").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["label"] for x in lines) == ["a", "b"]


def test_intermediates_go_to_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert du.shared_dir(spark) == folder
    kept = du.durable(spark.range(3), "x")
    assert kept.count() == 3 and folder in kept.inputFiles()[0]


def test_spread_only_touches_scans_with_few_splits(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    df.coalesce(1).write.parquet(f"{tmp_path}/few")
    few = spark.read.parquet(f"{tmp_path}/few")
    assert src.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert src.spread(many) is many
