"""Combining member probabilities. Input is long: (id, model, prob); a null prob is a failed member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.scores import adjusted_prob, confidence_max, confidence_of, label_above, label_at_least
from mailsieve.operators.scoring import DEFAULT_THRESHOLD, literal_lookup

# Member weights of the weighted averages.
AVERAGE_WEIGHTS = {"baseline": 0.15, "tfidf": 0.15, "cnn": 0.20, "lstm": 0.20, "bert": 0.25, "hybrid": 0.20}
AVERAGE_DEFAULT_WEIGHT = 0.2
ADJUSTED_WEIGHTS = {"lstm": 2.0, "tfidf": 1.0, "cnn": 1.0, "bert": 1.5, "hybrid": 1.0}
ADJUSTED_DEFAULT_WEIGHT = 1.0
ADJUSTED_THRESHOLD = 0.6


def skip_failed_members(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("prob").isNotNull())


def failed_documents(predictions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents for which no member answered."""
    return predictions.groupBy(id_col).agg(F.count("prob").alias("answered")).where("answered = 0").select(id_col)


def failure_reasons(predictions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, failures): ``model=error`` of the members that failed, by name, for documents with any."""
    named = F.concat_ws("=", "model", "error")
    failed = predictions.where(F.col("prob").isNull() & F.col("error").isNotNull())
    return failed.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(named)), "; ").alias("failures"))


def member_votes(
    predictions: DataFrame, thresholds: dict[str, float] | None = None, default: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Answered members with ``pred``: 1 above the member's own threshold."""
    threshold = literal_lookup("model", thresholds or {}, default)
    return skip_failed_members(predictions).withColumn("pred", label_above("prob", threshold))


def vote_breakdown(votes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Votes for either class per document."""
    return votes.groupBy(id_col).agg(
        F.sum("pred").alias("phishing_votes"), F.sum(1 - F.col("pred")).alias("legitimate_votes")
    )


def majority_vote(
    predictions: DataFrame,
    thresholds: dict[str, float] | None = None,
    id_cols: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Strict majority of the answered members, a tie counting as legitimate."""
    votes = member_votes(predictions, thresholds)
    combined = votes.groupBy(*id_cols).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.sum("pred").alias("phishing_votes"),
        F.avg("prob").alias("probability"),
        F.array_sort(F.collect_list(F.struct("model", "prob", "pred"))).alias("members"),
    )
    prediction = (F.col("phishing_votes") * 2 > F.col("n_models")).cast("int")
    return combined.withColumn("prediction", prediction).select(
        *id_cols,
        "prediction",
        "probability",
        confidence_of("probability", "prediction").alias("confidence"),
        F.struct(
            F.col("phishing_votes").alias("phishing"),
            (F.col("n_models") - F.col("phishing_votes")).alias("legitimate"),
        ).alias("votes"),
        "members",
    )


def _weighted_mean(prob: Column, weight: Column) -> Column:
    """Renormalised over the members that answered, one half if none did.

    Rounded to 12 places so that the order in which members arrive cannot tip a threshold.
    """
    answered = F.when(prob.isNotNull(), weight)
    return F.round(F.coalesce(F.sum(prob * weight) / F.sum(answered), F.lit(0.5)), 12)


def weighted_average(
    predictions: DataFrame,
    weights: dict[str, float] = AVERAGE_WEIGHTS,
    default_weight: float = AVERAGE_DEFAULT_WEIGHT,
    threshold: float = DEFAULT_THRESHOLD,
    id_col: str = "doc_id",
) -> DataFrame:
    """Weighted mean probability, positive from the threshold on."""
    weight = literal_lookup("model", weights, default_weight)
    combined = predictions.groupBy(id_col).agg(_weighted_mean(F.col("prob"), weight).alias("probability"))
    return combined.select(
        id_col,
        "probability",
        label_at_least("probability", threshold).alias("prediction"),
        confidence_max("probability").alias("confidence"),
    )


def adjusted_weighted(
    predictions: DataFrame,
    weights: dict[str, float] = ADJUSTED_WEIGHTS,
    default_weight: float = ADJUSTED_DEFAULT_WEIGHT,
    threshold: float = ADJUSTED_THRESHOLD,
    id_col: str = "doc_id",
) -> DataFrame:
    """Weighted mean of adjusted probabilities, positive only above the higher threshold.

    ``predictions`` has ``legitimacy`` and ``suspicion`` beside ``prob``.
    """
    adjusted = skip_failed_members(predictions).withColumn(
        "adjusted", adjusted_prob("prob", "legitimacy", "suspicion")
    )
    weight = literal_lookup("model", weights, default_weight)
    combined = adjusted.groupBy(id_col).agg(_weighted_mean(F.col("adjusted"), weight).alias("probability"))
    scored = combined.withColumn("prediction", label_above("probability", threshold))
    return scored.withColumn("confidence", confidence_of("probability", "prediction"))
