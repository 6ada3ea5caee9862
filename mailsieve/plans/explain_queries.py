"""Local explanations of every benchmark text."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions.arrays import explode_rows
from mailsieve.functions.hashing import md5_int, md5_key
from mailsieve.functions.urls import URL_FEATURES
from mailsieve.operators import explain as ex
from mailsieve.operators import scoring as md
from mailsieve.plans import fixtures as fx
from mailsieve.plans import sql as S
from mailsieve.plans.model_queries import _train_rows, hashed_model
from mailsieve.plans.registry import query
from mailsieve.plans.sql import with_views

ID = "item_id"

def variants_sql(table: str, key: str, samples: int) -> str:
    """Distinct words in order of appearance, the number to remove per sample, and removal by hash rank."""
    return f"""
    WITH docs AS MATERIALIZED (
        SELECT {key}, list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS ws FROM {table}),
    samples AS MATERIALIZED (
        SELECT {key}, len(ws) AS total, ws, CASE WHEN sample = 0 OR len(ws) = 0 THEN 0 ELSE
            1 + {S.md5_int(f"md5({key} || ':' || sample)", 1, 8)} % len(ws) END AS removed, sample
        FROM docs, (SELECT unnest(range({samples}))::INTEGER AS sample)),
    ranked AS MATERIALIZED (
        SELECT {key}, sample, total, removed, word,
            row_number() OVER (PARTITION BY {key}, sample ORDER BY md5({key} || ':' || sample || ':' || word)) AS rn
        FROM (SELECT {key}, sample, total, removed, unnest(ws) AS word FROM samples)),
    variants AS MATERIALIZED (
        SELECT {key}, sample, any_value(total)::INTEGER AS total, any_value(removed)::INTEGER AS removed,
            coalesce(string_agg(word, ' ' ORDER BY word) FILTER (rn > removed), '') AS kept_words
        FROM ranked GROUP BY {key}, sample)"""


_VARIANTS = variants_sql("benchmark", "item_id", 500)


@query("perturb_docs", f"{_VARIANTS} SELECT item_id, sample, total, removed, kept_words FROM variants")
def perturb_docs(spark, sf):
    return _kept(ex.perturb_docs(fx.items(spark, sf), id_col=ID), ID)


def _kept(variants, key):
    """Words in all, words removed, and the kept ones in order of the alphabet."""
    kept = F.transform(F.filter(F.arrays_zip("words", "keep"), lambda z: z.keep), lambda z: z.words)
    return variants.select(
        key,
        "sample",
        F.size("words").alias("total"),
        (F.size("words") - ex.kept_words()).alias("removed"),
        F.array_join(F.array_sort(kept), " ").alias("kept_words"),
    )


DOC_SAMPLES = 3


@query(
    "perturb_documents",
    f"""{variants_sql("documents", "doc_id", DOC_SAMPLES)}
    SELECT doc_id, sample, total, removed, md5(kept_words) AS kept_md5 FROM variants""",
)
def perturb_documents(spark, sf):
    """Long texts, too: all documents, a few samples of each."""
    docs = fx.texts(spark, sf, "documents", "doc_id", "text")
    rows = _kept(ex.perturb_docs(docs, DOC_SAMPLES), "doc_id")
    return rows.withColumn("kept_md5", F.md5("kept_words")).drop("kept_words")


LINEAR_SAMPLES = 20
_PIECE = r"([\p{L}\p{N}_]+)([^\p{L}\p{N}_]*)"


@query(
    "score_perturbed_linear",
    with_views(
        f"""SELECT vid, round(coalesce(dot / norm, 0) - 0.25, 6) AS score FROM ({variants_sql("benchmark", "item_id", LINEAR_SAMPLES)},
        pieces AS (
            SELECT item_id, head, unnest(words) AS word, unnest(gaps) AS gap, generate_subscripts(words, 1) AS pos FROM (
                SELECT item_id, regexp_extract(text, '^[^\\p{{L}}\\p{{N}}_]*') AS head, regexp_extract_all(text, '{_PIECE}', 1) AS words,
                    regexp_extract_all(text, '{_PIECE}', 2) AS gaps FROM benchmark)),
        texts AS (
            SELECT item_id || ':' || sample AS vid, any_value(head)
                || string_agg(CASE WHEN rn > removed THEN word || gap ELSE gap END, '' ORDER BY pos) AS text
            FROM pieces JOIN ranked USING (item_id, word) GROUP BY item_id, sample),
        ws AS (SELECT vid, regexp_extract_all({S.clean_text('text')}, '[a-z0-9_]{{2,}}') AS ws FROM texts),
        each AS (
            SELECT vid, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM ws),
        known AS (SELECT vid, term, idf, count(*) AS tf FROM each JOIN vocab USING (term) GROUP BY vid, term, idf),
        sums AS (
            SELECT vid, sum(tf * idf * ({S.md5_int('md5(term)', 1, 8)} / 2147483648.0::DOUBLE - 1)) AS dot, sqrt(sum(tf * idf * tf * idf)) AS norm
            FROM known GROUP BY vid)
        SELECT vid, dot, norm FROM texts LEFT JOIN sums USING (vid))"""
    ),
)
def score_perturbed_linear(spark, sf):
    """The variants of every item under hashed weights."""
    variants = ex.perturb_docs(fx.items(spark, sf), LINEAR_SAMPLES, id_col=ID)
    vid = F.concat_ws(":", F.col(ID).cast("string"), F.col("sample").cast("string"))
    rows = variants.select(vid.alias("vid"), fx.clean_text("variant").alias("clean"))
    scored = md.linear_score(rows, hashed_model(spark, sf), -0.25, id_col="vid")
    return scored.select("vid", F.round("score", 6).alias("score"))


@query(
    "kernel_weights",
    f"""{_VARIANTS} SELECT item_id, sample, round(d, 6) AS distance, round(sqrt(exp(-(d * d) / 625.0::DOUBLE)), 6) AS kernel
    FROM (SELECT item_id, sample, 100 * (1 - sqrt((total - removed)::DOUBLE / total)) AS d FROM variants)""",
)
def kernel_weights(spark, sf):
    weighted = ex.kernel_weights(ex.perturb_docs(fx.items(spark, sf), id_col=ID))
    return weighted.select(
        ID, "sample", F.round("distance", 6).alias("distance"), F.round("kernel", 6).alias("kernel")
    )


def _items_with_urls(spark, sf):
    urls = fx.page_urls(spark, sf).withColumnRenamed("page_id", ID)
    items = fx.items(spark, sf).join(urls, ID, "left")
    return items.select(ID, F.concat_ws(" ", "text", "url").alias("text"))


@query(
    "hold_url_constant",
    with_views(
        f"""SELECT item_id, sample, {', '.join(S.FEATURE_NAMES)}
        FROM (SELECT item_id, {S.URL_FEATURES} FROM (
            SELECT b.item_id, regexp_extract(concat_ws(' ', b.text, v.url), 'https?://[!$-_a-z]+') AS u
            FROM benchmark b LEFT JOIN page_urls v ON v.page_id = b.item_id)),
            (SELECT unnest(range(500))::INTEGER AS sample)"""
    ),
)
def hold_url_constant(spark, sf):
    docs = ex.hold_url_constant(_items_with_urls(spark, sf))
    return ex.perturb_docs(docs, id_col=ID, carry=URL_FEATURES).select(ID, "sample", *URL_FEATURES)


@query("score_perturbed")
def score_perturbed(spark, sf):
    model = md.train_tfidf_lr(_train_rows(spark, sf))
    variants = ex.perturb_docs(fx.items(spark, sf), id_col=ID)
    return ex.score_perturbed(variants, model).select(ID, "sample", F.round("prob", 4).alias("prob"))


@query("local_surrogate")
def local_surrogate(spark, sf):
    model = md.train_tfidf_lr(_train_rows(spark, sf))
    explained = ex.explain(fx.items(spark, sf), model, id_col=ID)
    return explained.withColumn("weight", F.round("weight", 4))


@query("explain_hybrid")
def explain_hybrid(spark, sf):
    model = md.train_hybrid(_train_rows(spark, sf))
    explained = ex.explain(_items_with_urls(spark, sf), model, id_col=ID, url_constant=True)
    return explained.withColumn("weight", F.round("weight", 4))


_WORD_WEIGHTS = f"""
    SELECT item_id, token, {S.md5_int("md5(item_id || ':' || token)", 1, 8)} / 2147483648.0::DOUBLE - 1 AS weight
    FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS token FROM benchmark)"""
_TOP = f"""
    SELECT item_id, rank, token, weight FROM (SELECT *, row_number() OVER (
        PARTITION BY item_id ORDER BY abs(weight) DESC, token)::INTEGER AS rank FROM ({_WORD_WEIGHTS}))
    WHERE rank <= 10"""


def _word_weights(spark, sf):
    """A hashed weight for every word of every benchmark text."""
    words = ex._split_words(F.col("text"))[1]
    tokens = explode_rows(fx.items(spark, sf), F.array_distinct(words), "token", ID)
    weight = md5_int(md5_key(ID, "token"), 8) / F.lit(2147483648.0) - 1
    return tokens.withColumn("weight", weight)


@query("top_features", f"SELECT item_id, rank, token, round(weight, 6) AS weight FROM ({_TOP})")
def top_features(spark, sf):
    return ex.top_features(_word_weights(spark, sf), id_col=ID).withColumn("weight", F.round("weight", 6))


@query(
    "feature_direction",
    f"""SELECT item_id, token, CASE WHEN weight > 0 THEN 'Phishing' ELSE 'Legitimate' END AS direction
    FROM ({_WORD_WEIGHTS})""",
)
def feature_direction(spark, sf):
    return _word_weights(spark, sf).select(ID, "token", ex.feature_direction().alias("direction"))


@query(
    "predicted_class",
    with_views(
        """SELECT doc_id, model, (prob > 1 - prob)::INTEGER AS prediction,
            round(greatest(prob, 1 - prob), 6) AS probability FROM scores WHERE prob IS NOT NULL"""
    ),
)
def predicted_class(spark, sf):
    rows = fx.score_table(spark, sf).where("prob is not null")
    called = rows.select("doc_id", "model", ex.predicted_class().alias("c"))
    return called.select("doc_id", "model", "c.prediction", F.round("c.probability", 6).alias("probability"))


_PROB = f"{S.md5_int('md5(item_id::VARCHAR)', 1, 4)} / 65536.0::DOUBLE"


@query(
    "explanation_record",
    f"""SELECT item_id, 'baseline_tfidf_lr' AS model, '2024-01-01T00:00:00' AS timestamp,
        CASE WHEN p > 1 - p THEN 'phishing' ELSE 'legitimate' END AS label, (p > 1 - p)::INTEGER AS prediction,
        round(greatest(p, 1 - p), 6) AS probability,
        CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS text_preview,
        length(text)::INTEGER AS text_length, 10 AS num_features, 500 AS num_samples, top_tokens
    FROM (SELECT *, {_PROB} AS p FROM benchmark) LEFT JOIN (
        SELECT item_id, string_agg(token, ' ' ORDER BY rank) AS top_tokens FROM ({_TOP}) GROUP BY item_id) USING (item_id)""",
)
def explanation_record(spark, sf):
    items = fx.items(spark, sf).withColumn(
        "prob", md5_int(md5_key(ID), 4) / F.lit(65536.0)
    )
    records = ex.explanation_record(
        items,
        ex.top_features(_word_weights(spark, sf), id_col=ID),
        "baseline_tfidf_lr",
        "2024-01-01T00:00:00",
        id_col=ID,
    )
    return records.withColumns(
        {
            "probability": F.round("probability", 6),
            "top_tokens": F.array_join(F.transform("top_tokens", lambda t: t.token), " "),
        }
    )
