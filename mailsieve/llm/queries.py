"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import decontaminate, mixing, neardup, periodic, pii, quality, repeats, spotsigs, suffixtree, tokenfiles, toxicity, vectorcodes, warc
from mailsieve.operators.durable import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: one row each with the least doc_id of its group of near-duplicates."""
    classes = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query
def op2_bucket_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the byte strings that repeat."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back.

    Responses are read with their payloads (the reader checks each against its digest), revisits by
    their headers alone.
    """
    folder = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    columns = ["page_id", "payload_digest", "record_type", "refers_to"]
    full = warc.read_warc(spark, folder, [*columns, "payload"]).where("record_type = 'response'")
    heads = warc.read_warc(spark, folder, [*columns, "payload_bytes"]).where("record_type = 'revisit'")
    rows = full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload").unionByName(heads)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document from a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as token ids and found again in the files."""
    return tokenfiles.token_files(table(spark, sf_dir, "documents"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.match_benchmark(docs, table(spark, sf_dir, "benchmark")))


@query
def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree scores of every document."""
    return suffixtree.score_texts(table(spark, sf_dir, "documents"), toxicity.held_out("doc_id", 5, 1))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers over every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return quality.judge(docs).select("doc_id", *columns)


@query
def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a document that the mixture takes, and where it stands in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, max_repeats=mixing.MAX_REPEATS)
    return mixed.select("doc_id", "source", "n_tokens", "copy", "block", F.round("position", 9).alias("position"))


@query
def op13_drake_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, its error and the errors of its label."""
    rows, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    return vectorcodes.digest(rows, books)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one in ten given a periodic tail first."""
    found = periodic.find_runs(table(spark, sf_dir, "documents"), text=periodic.planted_period())
    return periodic.digest(found)


@query
def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and how alike it is to that of its edited text and of the next document."""
    return spotsigs.digest(spotsigs.compare_neighbours(table(spark, sf_dir, "documents")))
