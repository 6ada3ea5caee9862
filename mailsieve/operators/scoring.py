"""Training and applying classifiers, and the long table of predictions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.scores import sigmoid
from mailsieve.functions.text import _as_col
from mailsieve.functions.urls import URL_FEATURES, url_features
from mailsieve.operators.durable import discard, durable, is_written
from mailsieve.operators.features import (
    MAX_FEATURES,
    TermWeights,
    document_terms,
    fit_idf,
    scaled_columns,
    scaler_fit,
    scaler_transform,
    tfidf_vectors,
    with_terms,
)
from mailsieve.operators.joins import BROADCAST_ROWS, bounded_lookup
from mailsieve.operators.newton import MAX_ITERATIONS, Fit, FitSummary, fit_blocks, term_reader  # noqa: F401
from mailsieve.operators.termblocks import packed_counts, with_sums, with_tfidf

DEFAULT_THRESHOLD = 0.5
BATCH_SIZE = 32

# A scorer adds its probability column to a table that has ``text`` and ``clean``.
Scorer = Callable[[DataFrame, str], DataFrame]


def _add_tfidf(df: DataFrame, vectors: PipelineModel) -> DataFrame:
    """``tfidf``: the vector of ``clean``; a null text has no terms. Terms are counted in Arrow batches, by the vocabulary and idf of ``vectors``."""
    counter, scaling = vectors.stages[:2]
    return with_tfidf(df, "clean", list(counter.vocabulary), scaling.getScalingVec().toArray())


class FittedLR(LogisticRegressionModel):
    """A model of MLlib with weights that were fitted here; ``summary`` tells steps, passes and the gradient that is left."""

    def __init__(self, spark: SparkSession, fit: Fit):
        weights = _py2java(spark.sparkContext, Vectors.dense(fit.weights))
        package = spark._jvm.org.apache.spark.ml.classification
        super().__init__(package.LogisticRegressionModel(f"fitted_{uuid.uuid4().hex[:12]}", weights, fit.intercept))
        self.fit_summary = fit.summary

    @property
    def summary(self) -> FitSummary:
        return self.fit_summary


@dataclass(frozen=True)
class Fitted:
    """What a fit leaves to another one over the same rows: the rows as packed blocks, the columns beside the terms in them, and the fit."""

    blocks: DataFrame
    beside: tuple[str, ...]
    fit: Fit


def _packed(train: DataFrame, vectors: PipelineModel, beside: tuple[str, ...]) -> DataFrame:
    """A written table of the rows' blocks; each text is read once for it."""
    counter, scaling = vectors.stages[:2]
    return durable(packed_counts(train, "clean", "label", list(counter.vocabulary), scaling.getScalingVec().toArray(), beside), "blocks")


def _fit_lr(blocks: DataFrame, vectors: PipelineModel, shift: np.ndarray, scale: np.ndarray, after: Fit | None = None) -> Fit:
    """Ridge-penalised logistic regression with unit inverse strength on TF-IDF vectors and the columns beside them, less ``shift`` and divided by ``scale``."""
    idf = vectors.stages[1].getScalingVec().toArray()
    used = blocks if len(shift) else blocks.drop("beside")
    if used is not blocks:
        used.tasks = len(blocks.inputFiles())
    return fit_blocks(used, len(idf) + len(shift), read=term_reader(idf, shift, scale), after=after)


def _save(path: str, weights: TermWeights, vectors: PipelineModel, model: LogisticRegressionModel) -> None:
    weights.table.write.mode("overwrite").parquet(f"{path}/terms")
    vectors.write().overwrite().save(f"{path}/vectors")
    model.write().overwrite().save(f"{path}/model")


def _load(spark: SparkSession, path: str) -> tuple[TermWeights, PipelineModel, LogisticRegressionModel]:
    vectors = PipelineModel.load(f"{path}/vectors")
    weights = TermWeights(spark.read.parquet(f"{path}/terms"), len(vectors.stages[0].vocabulary))
    return weights, vectors, LogisticRegressionModel.load(f"{path}/model")


@dataclass(frozen=True)
class TfidfLR:
    """TF-IDF into logistic regression."""

    weights: TermWeights
    vectors: PipelineModel
    model: LogisticRegressionModel
    fitted: Fitted | None = None

    def __call__(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Adds ``out``. The vectors' products with the coefficients are summed up inside the row, so two numbers a text come back from Python."""
        return _score_with_sums(df, {out: self}, [c for c in df.columns if c != out])

    def save(self, path: str) -> None:
        _save(path, self.weights, self.vectors, self.model)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TfidfLR:
        return TfidfLR(*_load(spark, path))

    def term_table(self) -> DataFrame:
        """(term, tf, df, idf, weight): the fitted model as a table."""
        spark = self.weights.table.sparkSession
        vocabulary = self.vectors.stages[0].vocabulary
        pairs = list(zip(vocabulary, self.model.coefficients.toArray().tolist()))
        learned = spark.createDataFrame(pairs, "term string, weight double")
        return self.weights.table.join(F.broadcast(learned), "term")


def train_tfidf_lr(train: DataFrame, max_features: int = MAX_FEATURES, beside: tuple[str, ...] = ()) -> TfidfLR:
    """Fit vocabulary, idf and classifier on rows of ``(clean, label)``.

    ``beside``: columns of ``train`` that this fit doesn't use and another one over the same rows does. The packed rows keep them, and stay for it.
    """
    train = train if is_written(train) else durable(train.select("clean", "label", *beside), "train")
    weights = fit_idf(train, max_features)
    vectors = tfidf_vectors(weights)
    blocks = _packed(train, vectors, beside)
    fit = _fit_lr(blocks, vectors, np.zeros(0), np.ones(0))
    model = FittedLR(train.sparkSession, fit)
    if not beside:
        discard(blocks)
        return TfidfLR(weights, vectors, model)
    return TfidfLR(weights, vectors, model, Fitted(blocks, beside, fit))


def with_url_features(df: DataFrame, text: str = "text") -> DataFrame:
    """The six URL features of the raw text as columns."""
    return df.withColumn("_url", url_features(text)).select(
        "*", *[F.col(f"_url.{f}").alias(f) for f in URL_FEATURES]
    ).drop("_url")


def _with_urls(df: DataFrame) -> DataFrame:
    return df if set(URL_FEATURES) <= set(df.columns) else with_url_features(df)


def assemble_features(df: DataFrame, vectors: PipelineModel, stats: DataFrame) -> DataFrame:
    """``features``: the TF-IDF vector beside the scaled URL features.

    ``df`` has ``clean`` and either raw ``text`` or the URL features already as columns.
    """
    df = _with_urls(df)
    scaled_cols = [f"{f}_scaled" for f in URL_FEATURES]
    scaled = scaler_transform(_add_tfidf(df, vectors), stats)
    assembler = VectorAssembler(inputCols=["tfidf", *scaled_cols], outputCol="features")
    return assembler.transform(scaled).drop("tfidf", *scaled_cols)


@dataclass(frozen=True)
class HybridLR:
    """TF-IDF and scaled URL features into one logistic regression."""

    weights: TermWeights
    vectors: PipelineModel
    stats: DataFrame
    model: LogisticRegressionModel

    def save(self, path: str) -> None:
        _save(path, self.weights, self.vectors, self.model)
        self.stats.write.mode("overwrite").parquet(f"{path}/url_stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> HybridLR:
        weights, vectors, model = _load(spark, path)
        return HybridLR(weights, vectors, spark.read.parquet(f"{path}/url_stats"), model)

    def __call__(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Adds ``out``, by sums inside the row like ``TfidfLR``; the URL features' share is added up in the JVM."""
        return _score_with_sums(df, {out: self}, [c for c in df.columns if c != out])


def _score_with_sums(df: DataFrame, scorers: dict[str, TfidfLR | HybridLR], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and one of each scorer. The scorers have one vocabulary, whose terms are counted once for all of them."""
    models = list(scorers.values())
    counter, scaling = models[0].vectors.stages[:2]
    terms = list(counter.vocabulary)
    hybrids = [s for s in models if isinstance(s, HybridLR)]
    urls = URL_FEATURES if hybrids else ()
    df = _with_urls(df) if hybrids else df
    # Nothing else crosses to Python and back.
    held = list(dict.fromkeys([*keep, *urls]))
    weights = np.array([s.model.coefficients.toArray()[: len(terms)] for s in models])
    sums = with_sums(df.select(*dict.fromkeys([*held, "clean"])), "clean", terms, scaling.getScalingVec().toArray(), weights, "_sums", held)
    scores = {}
    for k, (out, scorer) in enumerate(scorers.items()):
        dot = F.when(F.col("_sums.square") > 0, F.col(f"_sums.dot{k}") / F.sqrt("_sums.square")).otherwise(0.0)
        scores[out] = dot + float(scorer.model.intercept)
        if isinstance(scorer, HybridLR):
            scaled = [F.lit(float(w)) * c for w, c in zip(scorer.model.coefficients.toArray()[len(terms) :], scaled_columns(scorer.stats).values())]
            scores[out] += sum(scaled[1:], scaled[0])
    return sums.select(*keep, *(sigmoid(score).alias(out) for out, score in scores.items()))


def train_hybrid(train: DataFrame, max_features: int = MAX_FEATURES, weights: TermWeights | None = None, after: TfidfLR | None = None) -> HybridLR:
    """Fit on rows of ``(text, clean, label)``; the URL features come from the raw text, or are columns already.

    ``weights`` is the vocabulary of the same rows where another model was fitted to them before; without it, it is fitted here. ``after`` is such a
    model whose packed rows have the URL features beside the terms: they are fitted to as they are, and from its weights on.
    """
    if not (set(URL_FEATURES) <= set(train.columns) and is_written(train)):
        train = durable(_with_urls(train).select("clean", "label", *URL_FEATURES), "train")
    if after:
        if after.fitted is None or after.fitted.beside != URL_FEATURES or weights not in (None, after.weights):
            raise ValueError("no packed rows of this vocabulary with URL features")
        weights = after.weights
    weights = weights or fit_idf(train, max_features)
    vectors = tfidf_vectors(weights)
    stats = durable(scaler_fit(train), "url_stats")
    row = stats.first()
    shift, scale = (np.array([row[f"{f}_{k}"] for f in URL_FEATURES], float) for k in ("mean", "std"))
    blocks = after.fitted.blocks if after else _packed(train, vectors, URL_FEATURES)
    fit = _fit_lr(blocks, vectors, shift, np.where(scale == 0, 1.0, scale), after and after.fitted.fit)
    if not after:
        discard(blocks)
    return HybridLR(weights, vectors, stats, FittedLR(train.sparkSession, fit))


def _joined_sums(df: DataFrame, weights: TermWeights, id_col: str, clean: str) -> DataFrame:
    """(id, dot, norm) of ``linear_score`` with a vocabulary that is joined."""
    counted = with_terms(df.select(id_col, clean), clean).select(id_col, document_terms("terms").alias("counted"))
    terms = counted.select(id_col, F.explode_outer("counted").alias("c")).select(id_col, "c.term", "c.tf")
    known = weights.table.select("term", "idf", "weight")
    looked_up = bounded_lookup(terms, known, "term", weights.size, "left")
    # One row per distinct term of a document, combined before it moves.
    x = F.when(F.col("idf").isNotNull(), F.col("tf") * F.col("idf"))
    return looked_up.groupBy(id_col).agg(
        F.sum(x * F.col("weight")).alias("dot"), F.sqrt(F.sum(x * x)).alias("norm")
    )


def linear_score(
    df: DataFrame,
    weights: TermWeights,
    intercept: float,
    id_col: str = "doc_id",
    clean: str = "clean",
) -> DataFrame:
    """(id, score, prob): dot product of unit-length TF-IDF and ``weight``, plus intercept.

    ``weights.table`` has ``term``, ``idf`` and ``weight``. Words outside the vocabulary stay in the sums as
    nulls, so documents without features stay and get the intercept. Rows with the same id are one document.
    """
    if weights.size > BROADCAST_ROWS:
        sums = _joined_sums(df, weights, id_col, clean)
    else:
        known = weights.table.select("term", "idf", F.coalesce("weight", F.lit(0.0)).alias("weight")).where("idf IS NOT NULL").collect()
        idf, weight = (np.array([r[k] for r in known], float) for k in (1, 2))
        added = with_sums(df.select(id_col, clean), clean, [r.term for r in known], idf, weight)
        # Two sums a row move.
        sums = added.groupBy(id_col).agg(F.sum("sums.dot").alias("dot"), F.sqrt(F.sum("sums.square")).alias("norm"))
        sums = sums.withColumn("norm", F.when(F.col("norm") > 0, F.col("norm")))
    score = F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)) + intercept
    return sums.select(id_col, score.alias("score")).withColumn("prob", sigmoid("score"))


def batch_score(
    df: DataFrame,
    fn: Callable[[list[str]], np.ndarray],
    id_col: str = "doc_id",
    text: str = "text",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """(id, p_legit, p_phish, failed) from any Python scorer over lists of texts.

    A batch whose scorer raises gets 0.5 / 0.5 and ``failed``. One-dimensional results are read
    as the probability of class 1.
    """

    def score(texts: list[str]) -> np.ndarray:
        probs = np.asarray(fn(texts), dtype=float)
        if probs.ndim == 1:
            probs = np.column_stack([1 - probs, probs])
        if probs.shape != (len(texts), 2):
            raise ValueError(f"scorer returned shape {probs.shape} for {len(texts)} texts")
        return probs

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                try:
                    probs, failed = score(part[text].tolist()), False
                except Exception:
                    probs, failed = np.full((len(part), 2), 0.5), True
                yield pd.DataFrame(
                    {id_col: part[id_col].to_numpy(), "p_legit": probs[:, 0], "p_phish": probs[:, 1], "failed": failed}
                )

    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("p_legit", T.DoubleType()),
            T.StructField("p_phish", T.DoubleType()),
            T.StructField("failed", T.BooleanType()),
        ]
    )
    return df.select(id_col, text).mapInPandas(run, schema)


def literal_lookup(key: Column | str, table: dict[str, float], default: float) -> Column:
    """A small constant table as an expression, with a default for unknown keys."""
    if not table:
        return F.lit(float(default))
    entries = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(entries, _as_col(key)), F.lit(float(default)))


def threshold_lookup(
    predictions: DataFrame, thresholds: dict[str, float], default: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Add each model's own ``threshold``."""
    return predictions.withColumn("threshold", literal_lookup("model", thresholds, default))


def predict_by_model(
    df: DataFrame, scorers: dict[str, Scorer], models: list[str], id_col: str = "doc_id"
) -> DataFrame:
    """(id, model, prob): every named scorer over the same cleaned rows in one pass.

    Fitted models with one vocabulary count its terms once, and only ids and numbers go on from there.
    """
    unknown = [m for m in models if m not in scorers]
    if unknown:
        raise ValueError(f"unknown model type: {', '.join(unknown)}")
    fitted: dict[int, dict[str, TfidfLR | HybridLR]] = {}
    for name in models:
        if isinstance(scorers[name], TfidfLR | HybridLR):
            fitted.setdefault(id(scorers[name].weights), {})[f"prob_{name}"] = scorers[name]
        else:
            df = scorers[name](df, f"prob_{name}")
    found = {f"prob_{name}" for name in models} - {out for group in fitted.values() for out in group}
    for k, group in enumerate(fitted.values(), 1):
        others = [c for c in df.columns if c not in group]
        df = _score_with_sums(df, group, others if k < len(fitted) else list(dict.fromkeys([id_col, *sorted(found)])))
        found |= set(group)
    members = [F.struct(F.lit(m).alias("model"), F.col(f"prob_{m}").alias("prob")) for m in models]
    return df.select(id_col, F.inline(F.array(*members)))


@dataclass(frozen=True)
class TextScorer:
    """A member that is a Python function from a list of texts to their probabilities of class 1.

    A text's result may not depend on the other texts of its call, because a call that raises is made again in parts.
    """

    fn: Callable[[list[str]], np.ndarray]


def _reason(error: Exception) -> str:
    """The first line of an error, after its type."""
    text = str(error).strip()
    return f"{type(error).__name__}: {text.splitlines()[0]}" if text else type(error).__name__


def isolated_scores(fn: Callable[[list[str]], np.ndarray], texts: list[str]) -> tuple[list[float | None], list[str | None]]:
    """(probabilities, errors), one of either null for every text.

    A call that raises is halved until the texts that raise stand alone, so a few of them cost a few calls more and the
    others keep their scores. A result of another shape is an error of the whole call, one outside 0 to 1 of its text.
    """
    probs: list[float | None] = [None] * len(texts)
    errors: list[str | None] = [None] * len(texts)
    parts = [(0, len(texts))] if texts else []
    while parts:
        a, b = parts.pop()
        try:
            found = np.asarray(fn(texts[a:b]), dtype=float)
            if found.ndim == 2 and found.shape == (b - a, 2):
                found = found[:, 1]
            if found.shape != (b - a,):
                raise ValueError(f"scorer returned shape {found.shape} for {b - a} texts")
        except Exception as error:
            if b - a > 1:
                middle = (a + b) // 2
                parts += [(middle, b), (a, middle)]
            else:
                errors[a] = _reason(error)
            continue
        for k, p in enumerate(found.tolist()):
            if 0.0 <= p <= 1.0:
                probs[a + k] = p
            else:
                errors[a + k] = f"ValueError: {p} is no probability"
    return probs, errors


def predict_members(
    df: DataFrame,
    members: dict[str, Scorer | TextScorer],
    id_col: str = "doc_id",
    text: str = "clean",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """(id, model, prob, error): every member over the same rows in one pass, none of them able to fail the others.

    A ``TextScorer`` that raises has a null ``prob`` and the reason in ``error`` for the rows it raises on; a scorer over
    DataFrames that can't be applied has both for all rows. Texts that are null reach a ``TextScorer`` as empty. Without
    members there are no rows. ``ensemble`` takes null probabilities as members that didn't answer.
    """
    python = {name: m.fn for name, m in members.items() if isinstance(m, TextScorer)}
    built: dict[str, str | None] = {}
    rows = df
    columns = {name: f"_member_{k}" for k, name in enumerate(members)}
    for name, member in members.items():
        if name in python:
            continue
        try:
            rows = member(rows, columns[name])
            built[name] = None
        except Exception as error:
            built[name] = _reason(error)
    none = F.lit(None)
    results = [
        F.struct(
            F.lit(name).alias("model"),
            (F.col(columns[name]) if error is None else none).cast("double").alias("prob"),
            (none if error is None else F.lit(error)).cast("string").alias("error"),
        )
        for name, error in built.items()
    ]
    kind = "array<struct<model:string,prob:double,error:string>>"
    ready = rows.select(id_col, F.coalesce(text, F.lit("")).alias("_text"), F.array(*results).cast(kind).alias("_done"))
    if not python:
        return ready.select(id_col, F.inline("_done"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = part.column(1).to_pylist()
                flat = [x for fn in python.values() for x in isolated_scores(fn, texts)]
                arrays = [pa.array(x, pa.string() if k % 2 else pa.float64()) for k, x in enumerate(flat)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *arrays], names=schema.fieldNames())

    schema = T.StructType([df.schema[id_col], T.StructField("_done", ready.schema["_done"].dataType)])
    for k in range(len(python)):
        schema = schema.add(f"_p{k}", "double").add(f"_e{k}", "string")
    scored = ready.mapInArrow(run, schema)
    late = [
        F.struct(F.lit(name).alias("model"), F.col(f"_p{k}").alias("prob"), F.col(f"_e{k}").alias("error"))
        for k, name in enumerate(python)
    ]
    return scored.select(id_col, F.inline(F.concat("_done", F.array(*late).cast(kind))))
