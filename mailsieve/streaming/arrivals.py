"""Scoring messages as their files arrive.

Cleaning, URL features and scorers are row-local, so the batch functions run on a stream as they
are and keep no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mailsieve.functions.text import clean_text, not_blank
from mailsieve.operators.ensemble import member_votes
from mailsieve.operators.scoring import Scorer, predict_by_model


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Messages ``(doc_id, text)`` from files that land in ``path``; blank ones are rejected."""
    return spark.readStream.schema(schema).format(fmt).load(path).where(not_blank("text"))


def score_arrivals(
    messages: DataFrame,
    scorers: dict[str, Scorer],
    models: list[str],
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """(doc_id, model, prob, pred) per message and model."""
    cleaned = messages.withColumn("clean", clean_text(F.col("text")))
    return member_votes(predict_by_model(cleaned, scorers, models), thresholds)


def write_predictions(predictions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append predictions to ``path`` until everything that has arrived is scored."""
    return (
        predictions.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
