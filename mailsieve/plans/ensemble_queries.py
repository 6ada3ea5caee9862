"""Votes and weighted averages over the long score table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mailsieve.functions import scores as sc
from mailsieve.functions.hashing import md5_int, md5_key
from mailsieve.operators import ensemble as en
from mailsieve.operators.durable import durable
from mailsieve.operators.scoring import TextScorer, predict_members
from mailsieve.plans import fixtures as fx
from mailsieve.plans import sql as S
from mailsieve.plans.model_queries import _THRESHOLD_SQL, THRESHOLDS
from mailsieve.plans.registry import query
from mailsieve.plans.sql import with_views

_VOTES = f"SELECT doc_id, model, prob, (prob > {_THRESHOLD_SQL})::INTEGER AS pred FROM scores WHERE prob IS NOT NULL"


@query(
    "majority_vote",
    with_views(
        f"""SELECT doc_id, prediction, round(p, 6) AS probability,
            round(CASE WHEN prediction = 1 THEN p ELSE 1 - p END, 6) AS confidence, phishing, n - phishing AS legitimate,
            members
        FROM (SELECT doc_id, avg(prob) AS p, sum(pred)::BIGINT AS phishing, count(*) AS n,
                (sum(pred) >= count(*) // 2 + 1)::INTEGER AS prediction,
                string_agg(model || '=' || pred, ' ' ORDER BY model) AS members
              FROM ({_VOTES}) GROUP BY doc_id)"""
    ),
)
def majority_vote(spark, sf):
    voted = en.majority_vote(fx.score_table(spark, sf), THRESHOLDS)
    members = F.transform("members", lambda m: F.concat_ws("=", m.model, m.pred.cast("string")))
    return voted.select(
        "doc_id",
        "prediction",
        F.round("probability", 6).alias("probability"),
        F.round("confidence", 6).alias("confidence"),
        "votes.phishing",
        "votes.legitimate",
        F.array_join(members, " ").alias("members"),
    )


@query(
    "weighted_average",
    with_views(
        """SELECT doc_id, round(p, 6) AS probability, (p >= 0.5)::INTEGER AS prediction,
            round(greatest(p, 1 - p), 6) AS confidence
        FROM (SELECT doc_id, round(coalesce(sum(prob * w) / sum(CASE WHEN prob IS NOT NULL THEN w END), 0.5), 12) AS p
            FROM (SELECT *, CASE model WHEN 'tfidf' THEN 0.15 WHEN 'bert' THEN 0.25 ELSE 0.2 END::DOUBLE AS w FROM scores)
            GROUP BY doc_id)"""
    ),
)
def weighted_average(spark, sf):
    averaged = en.weighted_average(fx.score_table(spark, sf))
    return averaged.select(
        "doc_id",
        F.round("probability", 6).alias("probability"),
        "prediction",
        F.round("confidence", 6).alias("confidence"),
    )


def _with_scores(spark, sf):
    """Legitimacy and suspicion scores 0 to 7 per document, from hashes."""
    key = md5_key("doc_id", F.lit("s"))
    return fx.score_table(spark, sf).withColumns(
        {
            "legitimacy": md5_int(F.substring(key, 1, 1), 1) % 8,
            "suspicion": md5_int(F.substring(key, 2, 1), 1) % 8,
        }
    )


_ADJUSTED = f"""
    SELECT doc_id, model, prob, greatest(0, least(1, prob + CASE WHEN legitimacy > suspicion + 2 THEN -0.1
        WHEN suspicion > legitimacy + 2 THEN 0.1 ELSE 0 END::DOUBLE)) AS adjusted
    FROM (SELECT *, {S.md5_int("md5(doc_id || ':s')", 1, 1)} % 8 AS legitimacy,
        {S.md5_int("md5(doc_id || ':s')", 2, 1)} % 8 AS suspicion FROM scores) WHERE prob IS NOT NULL"""


@query(
    "adjusted_weighted",
    with_views(
        f"""SELECT doc_id, round(p, 6) AS probability, (p > 0.6)::INTEGER AS prediction,
            round(CASE WHEN p > 0.6 THEN p ELSE 1 - p END, 6) AS confidence
        FROM (SELECT doc_id, round(sum(adjusted * w) / sum(w), 12) AS p
            FROM (SELECT *, CASE model WHEN 'lstm' THEN 2 WHEN 'bert' THEN 1.5 ELSE 1 END::DOUBLE AS w FROM ({_ADJUSTED}))
            GROUP BY doc_id)"""
    ),
)
def adjusted_weighted(spark, sf):
    averaged = en.adjusted_weighted(_with_scores(spark, sf))
    return averaged.select(
        "doc_id",
        F.round("probability", 6).alias("probability"),
        "prediction",
        F.round("confidence", 6).alias("confidence"),
    )


@query(
    "score_adjustment",
    with_views(f"SELECT doc_id, model, round(adjusted, 6) AS adjusted FROM ({_ADJUSTED})"),
)
def score_adjustment(spark, sf):
    rows = en.skip_failed_members(_with_scores(spark, sf))
    return rows.select(
        "doc_id", "model", F.round(sc.adjusted_prob("prob", "legitimacy", "suspicion"), 6).alias("adjusted")
    )


@query(
    "vote_breakdown",
    with_views(
        f"""SELECT doc_id, sum(pred)::BIGINT AS phishing_votes, sum(1 - pred)::BIGINT AS legitimate_votes
        FROM ({_VOTES}) GROUP BY doc_id"""
    ),
)
def vote_breakdown(spark, sf):
    return en.vote_breakdown(en.member_votes(fx.score_table(spark, sf), THRESHOLDS))


@query(
    "skip_failed_members",
    with_views(
        """SELECT doc_id, count(prob) AS answered, count(*) - count(prob) AS failed,
            (count(prob) = 0)::INTEGER AS nothing FROM scores GROUP BY doc_id"""
    ),
)
def skip_failed_members(spark, sf):
    scores = fx.score_table(spark, sf)
    answered = en.skip_failed_members(scores).groupBy("doc_id").agg(F.count(F.lit(1)).alias("answered"))
    nobody = en.failed_documents(scores).select("doc_id", F.lit(1).alias("nothing"))
    asked = scores.groupBy("doc_id").agg(F.count(F.lit(1)).alias("asked"))
    rows = asked.join(answered, "doc_id", "left").join(nobody, "doc_id", "left")
    count = F.coalesce("answered", F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        count.alias("answered"),
        (F.col("asked") - count).alias("failed"),
        F.coalesce("nothing", F.lit(0)).alias("nothing"),
    )


def _by_length(texts: list[str]) -> np.ndarray:
    return np.array([len(t) % 97 / 97 for t in texts])


def _fussy(texts: list[str]) -> np.ndarray:
    """Raises on every call that holds a text of certain lengths."""
    if any(len(t) % 7 == 3 for t in texts):
        raise ValueError("unreadable text\nat some place")
    return np.array([[1 - len(t) % 89 / 89, len(t) % 89 / 89] for t in texts])


def _loose(texts: list[str]) -> np.ndarray:
    """Sometimes answers with something that is no probability."""
    return np.array([-1.0 if len(t) % 11 == 0 else len(t) % 11 / 11 for t in texts])


def _hashed(df, out):
    return df.withColumn(out, md5_int(F.md5(F.coalesce("text", F.lit(""))), 4) / F.lit(65536.0))


def _unloadable(df, out):
    raise FileNotFoundError("no weights")


_MEMBERS = {
    "hashed": _hashed, "length": TextScorer(_by_length), "fussy": TextScorer(_fussy),
    "loose": TextScorer(_loose), "unloadable": _unloadable,
}

_MEMBERS_SQL = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    answers AS (
        SELECT doc_id, 'hashed' AS model, {S.md5_int("md5(text)", 1, 4)} / 65536.0::DOUBLE AS prob, NULL AS error FROM t
        UNION ALL SELECT doc_id, 'length', n % 97 / 97.0::DOUBLE, NULL FROM t
        UNION ALL SELECT doc_id, 'fussy', CASE WHEN n % 7 <> 3 THEN n % 89 / 89.0::DOUBLE END,
            CASE WHEN n % 7 = 3 THEN 'ValueError: unreadable text' END FROM t
        UNION ALL SELECT doc_id, 'loose', CASE WHEN n % 11 <> 0 THEN n % 11 / 11.0::DOUBLE END,
            CASE WHEN n % 11 = 0 THEN 'ValueError: -1.0 is no probability' END FROM t
        UNION ALL SELECT doc_id, 'unloadable', NULL, 'FileNotFoundError: no weights' FROM t)"""


@query("predict_members", f"{_MEMBERS_SQL} SELECT doc_id, model, round(prob, 6) AS prob, error FROM answers")
def predict_members_query(spark, sf):
    """Five members over every document, three of which fail now and then or always."""
    scored = predict_members(fx.table(spark, sf, "documents"), _MEMBERS, text="text")
    return scored.select("doc_id", "model", F.round("prob", 6).alias("prob"), "error")


@query(
    "vote_despite_failures",
    f"""{_MEMBERS_SQL} SELECT v.doc_id, round(p, 6) AS probability, (2 * votes > n)::INTEGER AS prediction, n AS answered, failures
    FROM (SELECT doc_id, round(avg(prob), 9) AS p, sum((prob > 0.5)::BIGINT)::BIGINT AS votes, count(*) AS n
          FROM answers WHERE prob IS NOT NULL GROUP BY doc_id) v
    JOIN (SELECT doc_id, string_agg(model || '=' || error, '; ' ORDER BY model) AS failures
          FROM answers WHERE error IS NOT NULL GROUP BY doc_id) f USING (doc_id)""",
)
def vote_despite_failures(spark, sf):
    """The majority of the members that answered, and what the others failed on."""
    scored = durable(predict_members(fx.table(spark, sf, "documents"), _MEMBERS, text="text"), "members")
    voted = en.majority_vote(scored).select(
        "doc_id", F.round(F.round("probability", 9), 6).alias("probability"), "prediction", F.size("members").cast("long").alias("answered")
    )
    return voted.join(en.failure_reasons(scored), "doc_id")
