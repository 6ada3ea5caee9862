"""Corpus assembly, splits and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.hashing import md5_key
from mailsieve.functions.scores import label_above
from mailsieve.operators import explain as ex
from mailsieve.operators import metrics as M
from mailsieve.operators import split as sp
from mailsieve.operators.durable import scratch_path
from mailsieve.plans import fixtures as fx
from mailsieve.plans import sql as S
from mailsieve.plans.registry import query
from mailsieve.plans.sql import with_views
from mailsieve.sources import corpus as src
from mailsieve.sources import sinks

_DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@query("scan_corpus", "SELECT doc_id, length(text)::INTEGER AS n_text, md5(text) AS text_md5 FROM documents")
def scan_corpus(spark, sf):
    docs = src.scan_corpus(spark, f"{sf}/documents.parquet", _DOC_SCHEMA, "parquet")
    return docs.select("doc_id", F.length("text").alias("n_text"), F.md5("text").alias("text_md5"))


@query(
    "resolve_columns",
    "SELECT d.doc_id, d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)",
)
def resolve_columns(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("is_phishing"))
    export = fx.table(spark, sf, "documents").withColumnRenamed("text", "email_text").join(labels, "doc_id")
    return src.standardize(export, keep=("doc_id",))


@query("project_rename", "SELECT d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)")
def project_rename(spark, sf):
    return src.project_rename(
        fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id"), "text", "toxic"
    )


@query(
    "cast_types",
    """SELECT d.doc_id, coalesce(d.text, 'nan') AS text, l.toxic::INTEGER AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def cast_types(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("label"))
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return src.cast_types(docs.join(labels, "doc_id", "left"))


@query("scan_csv", "SELECT doc_id, length(text)::INTEGER AS n_text, md5(text) AS text_md5 FROM documents")
def scan_csv(spark, sf):
    """Documents written as CSV (texts hold quotes and line breaks) and scanned from there."""
    path = scratch_path(spark, "csv")
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    docs.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    rows = src.scan_corpus(spark, path, _DOC_SCHEMA)
    return rows.select("doc_id", F.length("text").alias("n_text"), F.md5("text").alias("text_md5"))


_MERGED_SQL = """
    SELECT text, doc_id, lang, n_chars, NULL::BIGINT AS item_id, 'documents' AS source FROM documents
    UNION ALL SELECT text, NULL, NULL, NULL, item_id, 'benchmark' FROM benchmark
    UNION ALL SELECT text, doc_id, lang, n_chars, NULL, 'documents' FROM documents"""


@query("union_sources", _MERGED_SQL)
def union_sources(spark, sf):
    """Real paths: one is missing and one is listed twice."""
    names = ("documents", "missing", "benchmark", "documents")
    merged = src.union_sources(spark, [f"{sf}/{n}.parquet" for n in names], fmt="parquet")
    return merged.withColumn("source", F.regexp_extract("source", r"([^/]+)\.parquet$", 1))


_CONVERSED_SQL = """
    SELECT text, doc_id, lang, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, NULL::BIGINT AS item_id,
        'documents' AS source FROM documents
    UNION ALL SELECT text, NULL, NULL, conv_id, turn, NULL, 'conversations' FROM conversations
    UNION ALL SELECT text, NULL, NULL, NULL, NULL, item_id, 'benchmark' FROM benchmark"""


@query("union_frames", _CONVERSED_SQL)
def union_frames(spark, sf):
    return src.union_frames(
        [
            ("documents", fx.table(spark, sf, "documents").select("doc_id", "lang", "text")),
            ("conversations", fx.table(spark, sf, "conversations").select("conv_id", "turn", "text")),
            ("benchmark", fx.table(spark, sf, "benchmark").select("item_id", "text")),
        ]
    )


@query(
    "seeded_shuffle",
    "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS shuffle_rank FROM documents",
)
def seeded_shuffle(spark, sf):
    return sp.shuffle_rank(fx.table(spark, sf, "documents"))


@query(
    "seeded_sample",
    "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100",
)
def seeded_sample(spark, sf):
    # The key decides the sample; texts join the hundred rows afterwards.
    docs = fx.table(spark, sf, "documents")
    return sp.seeded_sample(docs.select("doc_id", F.md5("text").alias("text_md5")), 100)


@query(
    "corpus_profile",
    with_views(
        """SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share,
            (sum(n) OVER ())::BIGINT AS n_corpus
        FROM (SELECT split, label, count(*) AS n FROM split_emails GROUP BY split, label)"""
    ),
)
def corpus_profile(spark, sf):
    return sp.corpus_profile(fx.label_splits(spark, sf))


@query("stratified_split", with_views("SELECT doc_id, text, label, split FROM split_emails"))
def stratified_split(spark, sf):
    return sp.stratified_split(fx.emails(spark, sf)).select("doc_id", "text", "label", "split")


@query("split_index", with_views("SELECT doc_id, split FROM split_emails"))
def split_index(spark, sf):
    return sp.split_index(fx.label_splits(spark, sf))


@query(
    "split_summary",
    with_views(
        """SELECT split, n, round(100 * n / sum(n) OVER (), 6) AS pct
        FROM (SELECT split, count(*) AS n FROM split_emails GROUP BY split)"""
    ),
)
def split_summary(spark, sf):
    return sp.split_summary(fx.label_splits(spark, sf))


@query(
    "write_splits",
    with_views("SELECT split, label, doc_id, md5(text) AS text_md5 FROM split_emails"),
)
def write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    sinks.write_splits(fx.split_emails(spark, sf), path)
    corpus = spark.read.parquet(f"{path}/corpus").select("doc_id", "label", F.md5("text").alias("text_md5"))
    return corpus.join(spark.read.parquet(f"{path}/index"), "doc_id")


@query(
    "write_results",
    with_views("SELECT model, round((tp + tn) / n, 6) AS accuracy FROM score_counts"),
)
def write_results(spark, sf):
    path = scratch_path(spark, "results")
    scored = fx.labelled_scores(spark, sf).withColumn("pred", label_above("prob"))
    table = M.accuracy(M.confusion_counts(scored, ("model",)), ("model",))
    sinks.write_results(table.withColumn("accuracy", F.round("accuracy", 6)), path)
    return spark.read.schema("model string, accuracy double").option("header", True).csv(path)


# Hashed weights for the words of every benchmark text, the ten strongest of each.
_TOKENS_SQL = f"""
    SELECT item_id, string_agg(token, ' ' ORDER BY rank) AS tokens, round(sum(weight), 6) AS weight_sum
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY abs(weight) DESC, token) AS rank FROM (
        SELECT item_id, token, {S.md5_int("md5(token)", 1, 8)} / 2147483648.0::DOUBLE - 1 AS weight
        FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[a-z]+')) AS token FROM benchmark)))
    WHERE rank <= 10 GROUP BY item_id"""


@query(
    "write_explanations",
    f"""SELECT item_id, 'hashed' AS model, '2024-01-01T00:00:00' AS timestamp,
        CASE WHEN p > 1 - p THEN 'phishing' ELSE 'legitimate' END AS label,
        (p > 1 - p)::BIGINT AS prediction, round(greatest(p, 1 - p), 6) AS probability,
        CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS text_preview,
        length(text) AS text_length, tokens, weight_sum
    FROM (SELECT *, {S.md5_int("md5(item_id || ':p')", 1, 4)} / 65536.0::DOUBLE AS p FROM benchmark)
    LEFT JOIN ({_TOKENS_SQL}) USING (item_id)""",
)
def write_explanations(spark, sf):
    path = scratch_path(spark, "explanations")
    items = fx.table(spark, sf, "benchmark")
    prob = fx.md5_int(md5_key("item_id", F.lit("p")), 4) / F.lit(65536.0)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))
    tokens = items.select("item_id", F.explode(words).alias("token")).withColumn("weight", fx.hashed_weight("token"))
    records = ex.explanation_record(
        items.withColumn("prob", prob), ex.top_features(tokens, id_col="item_id"), "hashed", "2024-01-01T00:00:00", id_col="item_id"
    )
    sinks.write_explanations(records, path)
    schema = (
        "item_id bigint, timestamp string, label string, prediction bigint, probability double, text_preview string, "
        "text_length bigint, model string, top_tokens array<struct<token string, weight double>>"
    )
    rows = spark.read.schema(schema).json(path).withColumn("probability", F.round("probability", 6))
    total = F.aggregate("top_tokens", F.lit(0.0), lambda a, t: a + t.weight)
    return rows.withColumns(
        {"tokens": F.array_join("top_tokens.token", " "), "weight_sum": F.round(total, 6)}
    ).drop("top_tokens")
