"""Views over the given tables that stand in for e-mail corpora, scores and reputation data.

Each view exists twice, as a DataFrame and as SQL text with the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions.hashing import md5_int, md5_key
from mailsieve.functions.text import clean_text
from mailsieve.operators.durable import durable
from mailsieve.operators.features import TermWeights, fit_idf
from mailsieve.operators.split import stratified_split
from mailsieve.sources.corpus import spread

MODELS = ("tfidf", "cnn", "lstm", "bert", "hybrid")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """The id (first column) and text columns of a table, over all cores."""
    return spread(table(spark, sf, name).select(*columns))


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs with enough variety for every URL rule to fire."""
    pid = F.col("page_id")
    u = F.when(pid % 2 == 0, F.replace("url", F.lit("example"), F.lit("mail-verify"))).otherwise(F.col("url"))
    varied = (
        F.when(pid % 11 == 3, F.regexp_replace(u, "^https?://", "www."))
        .when(pid % 5 == 1, F.concat(F.lit("http://192.0.2.7/item/"), pid.cast("string"), F.lit("?a=1.2")))
        .when(pid % 7 == 2, F.concat(u, F.lit(").,")))
        .otherwise(u)
    )
    return table(spark, sf, "pages").select("page_id", varied.alias("url"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, text): the texts that are explained."""
    return texts(spark, sf, "benchmark", "item_id", "text")


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, text): the page source followed by its URL."""
    html = texts(spark, sf, "pages", "page_id", "html")
    return html.join(page_urls(spark, sf), "page_id").select(
        "page_id", F.concat_ws(" ", "html", "url").alias("text")
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, source): every document, with the URL of the page of the same number."""
    docs = texts(spark, sf, "documents", "doc_id", "text", "source")
    urls = page_urls(spark, sf).withColumnRenamed("page_id", "doc_id")
    text = F.concat("text", F.coalesce(F.concat(F.lit(" "), F.col("url")), F.lit("")))
    return docs.join(urls, "doc_id", "left").select("doc_id", text.alias("text"), "source")


def emails(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, label, source): the labelled messages."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return messages(spark, sf).join(labels, "doc_id").select("doc_id", "text", "label", "source")


def label_splits(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, label, split) without the texts; every labelled document exists."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return stratified_split(labels)


def split_emails(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, label, source, split): split on the narrow label table, then joined."""
    split = label_splits(spark, sf)
    return messages(spark, sf).join(split, "doc_id").select("doc_id", "text", "label", "source", "split")


def train_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned training rows, written once because fitting reads them several times."""
    rows = split_emails(spark, sf).where("split = 'train'")
    return durable(rows.select("doc_id", "label", clean_text("text").alias("clean")), "train")


def message_clean(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("doc_id", clean_text("text").alias("clean"))


def fitted_terms(spark: SparkSession, sf: str) -> TermWeights:
    return fit_idf(train_clean(spark, sf))


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, model, prob): hashed probabilities with ties, null for a member that failed."""
    docs = table(spark, sf, "documents").select("doc_id")
    models = F.explode(F.array(*[F.lit(m) for m in MODELS]))
    rows = docs.select("doc_id", models.alias("model"))
    key = md5_key("doc_id", "model")
    prob = F.round(md5_int(key, 4) / F.lit(65536.0), 2)
    failed = F.substring(key, 5, 1) == "0"
    return rows.select("doc_id", "model", F.when(~failed, prob).alias("prob"))


def labelled_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, model, prob, label) of the members that answered."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return score_table(spark, sf).where("prob is not null").join(labels, "doc_id")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, l0, l1): hashed logits in [-4, 4], coarse enough to tie now and then."""
    docs = table(spark, sf, "documents").select("doc_id")

    def logit(name: str):
        return (md5_int(md5_key("doc_id", F.lit(name)), 2) - 128) / F.lit(32.0)

    return docs.select("doc_id", logit("l0").alias("l0"), logit("l1").alias("l1"))


def hashed_weight(term: str = "term"):
    return md5_int(F.md5(term), 8) / F.lit(2147483648.0) - 1.0


def reputation(urls: DataFrame) -> DataFrame:
    """Vendor counts for most of the URLs in ``urls``."""
    key = F.md5("url")
    counts = {
        "malicious": F.greatest(md5_int(F.substring(key, 1, 1), 1) - 11, F.lit(0).cast("bigint")),
        "suspicious": F.greatest(md5_int(F.substring(key, 2, 1), 1) - 10, F.lit(0).cast("bigint")),
        "harmless": md5_int(F.substring(key, 3, 2), 2),
        "undetected": md5_int(F.substring(key, 5, 1), 1),
    }
    known = urls.select("url").distinct().where(md5_int(F.substring(key, 7, 2), 2) >= 26)
    return known.select("url", *[c.alias(n) for n, c in counts.items()])


def blocklist(urls: DataFrame) -> DataFrame:
    return urls.select("url").distinct().where(F.substring(F.md5("url"), 1, 1) == "0")
