"""URL tables: one row per URL, joined with reputation data and block lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.functions import urls as U
from mailsieve.functions.arrays import posexplode_rows
from mailsieve.operators.joins import skew_lookup

COUNTS = ("malicious", "suspicious", "harmless", "undetected")


def url_listing(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, position, url, display): one row per kept URL, positions from 1."""
    listed = posexplode_rows(df, U.extract_urls(text), "url", id_col)
    return listed.select(
        id_col, (F.col("pos") + 1).alias("position"), "url", U.url_display("url").alias("display")
    )


def reputation_join(urls: DataFrame, reputation: DataFrame, url: str = "url") -> DataFrame:
    """Attach vendor counts to every URL row; a URL without a report is ``report_pending``.

    ``reputation`` has one row per URL. A URL that fills a large share of the mail goes by
    broadcast, the others by shuffle.
    """
    known = reputation.select(url, *COUNTS, F.lit(True).alias("reported"))
    joined = skew_lookup(urls, known, url, "left")
    pending = F.col("reported").isNull()
    return joined.select(
        *urls.columns,
        *COUNTS,
        U.reputation_total().alias("total_engines"),
        pending.cast("int").alias("report_pending"),
        F.when(~pending, U.reputation_verdict()).alias("verdict"),
    )


def blocklist_hits(urls: DataFrame, blocklist: DataFrame, url: str = "url") -> DataFrame:
    """URL rows whose URL is listed."""
    return skew_lookup(urls, blocklist.select(url).distinct(), url, "left_semi")


def blocklist_misses(urls: DataFrame, blocklist: DataFrame, url: str = "url") -> DataFrame:
    """URL rows whose URL is not listed."""
    return skew_lookup(urls, blocklist.select(url).distinct(), url, "left_anti")


def blocklist_lookup(urls: DataFrame, blocklist: DataFrame, url: str = "url") -> DataFrame:
    """Every URL row with ``blocked`` 1 or 0."""
    listed = blocklist.select(url).distinct().withColumn("listed", F.lit(1))
    joined = skew_lookup(urls, listed, url, "left")
    return joined.select(*urls.columns, F.coalesce("listed", F.lit(0)).alias("blocked"))
