"""Lookup joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table known to hold no more rows than this may be broadcast.
BROADCAST_ROWS = 200_000
# Keys that own more than a shuffle partition's share of the rows travel apart (at least 1/HOT_SHARE counts as
# hot); there are fewer of them than partitions or HOT_SHARE.
HOT_SHARE = 1_000


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """Keys above the hot share, at most as many rows as shuffle partitions or ``HOT_SHARE``.

    Counts are combined before the shuffle, so a hot key costs one row per task.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    total = left.agg(F.count(key).alias("n"))
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = total.select(F.col("n") / max(HOT_SHARE, partitions)).scalar()
    return counts.where(F.col("count") > cut).select(key)


def skew_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` (unique per key) on ``key`` without a hot task.

    Rows with a hot key meet their few lookup rows by broadcast, bounded as above; every
    other key is small enough for an ordinary shuffle join. ``left`` is read for the key counts,
    the hot and the cold rows, so give a written table when it is costly to derive. ``how``: left,
    inner, left_semi or left_anti.
    """
    hot = F.broadcast(hot_keys(left, key))
    hot_right = F.broadcast(right.join(hot, key, "left_semi"))
    hot_rows = left.join(hot, key, "left_semi").join(hot_right, key, how)
    cold_rows = left.join(hot, key, "left_anti").join(right, key, how)
    return hot_rows.unionByName(cold_rows)


def bounded_lookup(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """Join to a lookup table of at most ``rows`` rows: broadcast when small, else by shuffle."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    return skew_lookup(left, right, key, how)
