"""Local explanations of many documents in one job.

Every document is repeated with random words removed, all variants are scored together, and one
small weighted regression per document turns the scores into word weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.arrays import bind
from mailsieve.functions.hashing import md5_int
from mailsieve.functions.text import _as_col, clean_text, text_or_empty, text_preview
from mailsieve.operators.scoring import Scorer, with_url_features

NUM_SAMPLES = 500
NUM_FEATURES = 10
KERNEL_WIDTH = 25.0
METADATA_TOKENS = 10

# Letters, digits and underscore in any script.
_WORD = r"[\p{L}\p{N}_]"
_GAP = r"[^\p{L}\p{N}_]"


def _split_words(text: Column) -> tuple[Column, Column, Column]:
    """What precedes the first word, the words, and what follows each word."""
    pattern = F.lit(f"({_WORD}+)({_GAP}*)")
    return (
        F.regexp_extract(text, f"^{_GAP}*", 0),
        F.regexp_extract_all(text, pattern, F.lit(1)),
        F.regexp_extract_all(text, pattern, F.lit(2)),
    )


def perturb_docs(
    df: DataFrame,
    num_samples: int = NUM_SAMPLES,
    id_col: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, sample, words, keep, variant): sample 0 is the document itself, the others lose between
    one and all of their distinct words.

    How many words go and which is decided by hashes of document, sample and word, so a lost task
    rebuilds the same variants. All work is inside the row; ``words`` is the distinct words and
    ``keep`` a flag for each.
    """
    head, run, gaps = _split_words(text_or_empty(text))
    docs = df.select(id_col, *carry, head.alias("_head"), run.alias("_run"), gaps.alias("_gaps"))
    docs = docs.withColumn("words", F.array_distinct("_run"))
    samples = docs.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))
    seed = F.concat_ws(":", F.col(id_col).cast("string"), F.col("sample").cast("string"))
    seeded = samples.withColumn("_seed", seed)
    count = F.size("words")
    removed = F.when((F.col("sample") == 0) | (count == 0), F.lit(0)).otherwise(
        (1 + md5_int(F.md5("_seed"), 8) % F.greatest(count, F.lit(1))).cast("int")
    )
    hashed = seeded.withColumns(
        {
            "_n": removed,
            "_hashes": bind(
                "_seed",
                lambda seed: F.transform("words", lambda w: F.md5(F.concat(seed, F.lit(":"), w))),
            ),
        }
    )
    # The n-th smallest hash is the last one removed.
    cut = F.when(F.col("_n") > 0, F.element_at(F.sort_array("_hashes"), F.greatest("_n", F.lit(1)))).otherwise("")
    cutting = hashed.withColumn("_cut", cut)
    masked = cutting.withColumn("keep", bind("_cut", lambda c: F.transform("_hashes", lambda h: h > c)))
    # A word stays or goes wherever it stands, so each occurrence asks its own hash; looking its place
    # up among the distinct words would be quadratic in the length of the document.
    pieces = bind(
        F.struct(F.col("_seed").alias("seed"), F.col("_cut").alias("cut")),
        lambda b: F.zip_with(
            "_run", "_gaps", lambda w, g: F.when(F.md5(F.concat(b.seed, F.lit(":"), w)) > b.cut, F.concat(w, g)).otherwise(g)
        ),
    )
    return masked.select(
        id_col,
        *carry,
        "sample",
        "words",
        "keep",
        F.concat("_head", F.array_join(pieces, "")).alias("variant"),
    )


def kept_words(keep: Column | str = "keep") -> Column:
    return F.size(F.filter(_as_col(keep), lambda k: k))


def kernel_distance(kept: Column, total: Column) -> Column:
    """100 x cosine distance between a 0/1 mask and all ones; 100 when nothing is left."""
    cosine = F.when(total > 0, F.sqrt(kept / total)).otherwise(F.lit(0.0))
    return 100.0 * (1.0 - cosine)


def kernel_weight(distance: Column, width: float = KERNEL_WIDTH) -> Column:
    return F.sqrt(F.exp(-(distance * distance) / F.lit(width * width)))


def kernel_weights(variants: DataFrame) -> DataFrame:
    """Add ``distance`` and ``kernel`` to perturbed rows."""
    distance = kernel_distance(kept_words(), F.size("words"))
    return variants.withColumn("distance", distance).withColumn("kernel", kernel_weight(F.col("distance")))


def hold_url_constant(df: DataFrame, text: str = "text") -> DataFrame:
    """URL features of the original text as columns that every variant carries along."""
    return with_url_features(df, text)


def score_perturbed(variants: DataFrame, scorer: Scorer, out: str = "prob") -> DataFrame:
    """Clean and score every variant where it was made; nothing is shuffled."""
    cleaned = variants.withColumn("clean", clean_text("variant"))
    return scorer(cleaned, out).drop("clean")


def _ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Weighted ridge coefficients with a free intercept, in the smaller of the two systems."""
    total = w.sum()
    root = np.sqrt(w)[:, None]
    xc = (x - (w @ x) / total) * root
    yc = (y - (w @ y) / total) * root[:, 0]
    rows, cols = xc.shape
    if cols <= rows:
        return np.linalg.solve(xc.T @ xc + alpha * np.eye(cols), xc.T @ yc)
    return xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(rows), yc)


def local_surrogate(
    scored: DataFrame, num_features: int = NUM_FEATURES, id_col: str = "doc_id", score: str = "prob"
) -> DataFrame:
    """(id, token, weight): the strongest words of every document for class 1.

    All words are fitted once, the strongest are kept and fitted again. A group is the variants
    of one document; the word list travels with sample 0 only. Documents without words have none.
    """
    rows = kernel_weights(scored.where(F.size("words") > 0)).select(
        id_col,
        "sample",
        "keep",
        "kernel",
        F.col(score).alias("y"),
        F.when(F.col("sample") == 0, F.col("words")).alias("words"),
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sample")
        words = np.asarray(group["words"].iloc[0], dtype=object)
        x = np.vstack(group["keep"].to_numpy()).astype(float)
        y = group["y"].to_numpy(dtype=float)
        w = group["kernel"].to_numpy(dtype=float)
        first = _ridge(x, y, w, 0.01)
        used = np.lexsort((words, -np.abs(first)))[:num_features]
        coef = _ridge(x[:, used], y, w, 1.0)
        order = np.lexsort((words[used], -np.abs(coef)))
        return pd.DataFrame(
            {id_col: group[id_col].iloc[0], "token": words[used][order], "weight": coef[order]}
        )

    id_type = scored.schema[id_col].dataType.simpleString()
    return rows.groupBy(id_col).applyInPandas(fit, f"{id_col} {id_type}, token string, weight double")


def top_features(weights: DataFrame, n: int = NUM_FEATURES, id_col: str = "doc_id") -> DataFrame:
    """(id, rank, token, weight): the ``n`` strongest tokens of every document."""
    strongest = Window.partitionBy(id_col).orderBy(F.desc(F.abs("weight")), "token")
    ranked = weights.withColumn("rank", F.row_number().over(strongest))
    return ranked.where(F.col("rank") <= n).select(id_col, "rank", "token", "weight")


def feature_direction(weight: Column | str = "weight") -> Column:
    return F.when(_as_col(weight) > 0, "Phishing").otherwise("Legitimate")


def predicted_class(p: Column | str = "prob") -> Column:
    """struct of the likelier class (a tie is 0) and the probability of that class."""
    p = _as_col(p)
    return F.struct(
        (p > 1 - p).cast("int").alias("prediction"), F.greatest(p, 1 - p).alias("probability")
    )


def explanation_record(
    df: DataFrame,
    top: DataFrame,
    model: str,
    timestamp: str,
    num_features: int = NUM_FEATURES,
    num_samples: int = NUM_SAMPLES,
    id_col: str = "doc_id",
    text: str = "text",
    note: str | None = None,
) -> DataFrame:
    """One record per document of ``(id, text, prob)`` with its strongest tokens from ``top``."""
    tokens = (
        top.where(F.col("rank") <= METADATA_TOKENS)
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "token", "weight"))).alias("ranked"))
        .select(id_col, F.transform("ranked", lambda r: F.struct(r.token.alias("token"), r.weight.alias("weight"))).alias("top_tokens"))
    )
    called = df.withColumn("_class", predicted_class())
    prediction = F.col("_class.prediction")
    fields = [
        F.col(id_col),
        F.lit(model).alias("model"),
        F.lit(timestamp).alias("timestamp"),
        F.when(prediction == 1, "phishing").otherwise("legitimate").alias("label"),
        prediction.alias("prediction"),
        F.col("_class.probability").alias("probability"),
        text_preview(text).alias("text_preview"),
        F.length(text).alias("text_length"),
        F.lit(num_features).alias("num_features"),
        F.lit(num_samples).alias("num_samples"),
        "top_tokens",
    ]
    if note is not None:
        fields.append(F.lit(note).alias("note"))
    return called.join(tokens, id_col, "left").select(*fields)


def explain(
    df: DataFrame,
    scorer: Scorer,
    num_features: int = NUM_FEATURES,
    num_samples: int = NUM_SAMPLES,
    id_col: str = "doc_id",
    url_constant: bool = False,
) -> DataFrame:
    """(id, rank, token, weight) for every document of ``(id, text)``."""
    carry: tuple[str, ...] = ()
    if url_constant:
        before = df.columns
        df = hold_url_constant(df)
        carry = tuple(c for c in df.columns if c not in before)
    # Each document is about to become many rows, so moving it once to spread the work is cheap.
    cores = df.sparkSession.sparkContext.defaultParallelism
    variants = perturb_docs(df.repartition(cores, id_col), num_samples, id_col, carry=carry)
    return top_features(local_surrogate(score_perturbed(variants, scorer), num_features, id_col), num_features, id_col)
