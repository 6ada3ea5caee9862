"""URL extraction, features and lookups over all pages and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions import urls as U
from mailsieve.functions.arrays import posexplode_rows
from mailsieve.operators import urls as ops
from mailsieve.operators.durable import durable
from mailsieve.plans import fixtures as fx
from mailsieve.plans import sql as S
from mailsieve.plans.registry import query
from mailsieve.plans.sql import with_views


def _sql_list(urls: str) -> str:
    return with_views(
        f"""SELECT page_id, unnest(us) AS url, (generate_subscripts(us, 1) - 1)::INTEGER AS pos
        FROM (SELECT page_id, {urls} AS us FROM page_texts)"""
    )


def _listed(spark, sf, urls):
    return posexplode_rows(fx.page_texts(spark, sf), urls, "url", "page_id")


@query("raw_urls", _sql_list(S.raw_urls("text")))
def raw_urls(spark, sf):
    return _listed(spark, sf, U.raw_urls("text"))


@query("normalize_urls", _sql_list(S.normalize_urls(S.raw_urls("text"))))
def normalize_urls(spark, sf):
    return _listed(spark, sf, U.normalize_urls(U.raw_urls("text")))


@query("drop_reserved_urls", _sql_list(S.drop_reserved(S.raw_urls("text"))))
def drop_reserved_urls(spark, sf):
    return _listed(spark, sf, U.drop_reserved_urls(U.raw_urls("text")))


@query("extract_urls", _sql_list(S.extract_urls("text")))
def extract_urls(spark, sf):
    return _listed(spark, sf, U.extract_urls("text"))


@query(
    "filtered_url_count",
    with_views(
        f"""SELECT page_id, (len({S.raw_urls('text')}) - len({S.extract_urls('text')}))::INTEGER AS filtered
        FROM page_texts"""
    ),
)
def filtered_url_count(spark, sf):
    return fx.page_texts(spark, sf).select("page_id", U.filtered_url_count("text").alias("filtered"))


@query(
    "url_listing",
    with_views(
        """SELECT page_id, position, url,
        CASE WHEN length(url) > 50 THEN substr(url, 1, 50) || '...' ELSE url END AS display FROM message_urls"""
    ),
)
def url_listing(spark, sf):
    return ops.url_listing(fx.page_texts(spark, sf), "page_id")


@query("first_feature_url", with_views(f"SELECT doc_id, {S.FEATURE_URL} AS url FROM messages"))
def first_feature_url(spark, sf):
    return fx.messages(spark, sf).select("doc_id", U.first_feature_url("text").alias("url"))


def _register_feature(name, builder):
    @query(name, with_views(f"SELECT doc_id, {name} FROM message_url_features"))
    def run(spark, sf):
        urls = fx.messages(spark, sf).select("doc_id", U.first_feature_url("text").alias("url"))
        return urls.select("doc_id", builder("url").alias(name))


for _name, _builder in (
    ("url_len", U.url_len),
    ("url_dots", U.url_dots),
    ("url_has_ip", U.url_has_ip),
    ("url_special", U.url_special),
    ("url_keyword", U.url_keyword),
    ("url_https", U.url_https),
):
    _register_feature(_name, _builder)


@query("url_features", with_views(f"SELECT doc_id, {', '.join(S.FEATURE_NAMES)} FROM message_url_features"))
def url_features(spark, sf):
    return fx.messages(spark, sf).select("doc_id", U.url_features("text").alias("f")).select("doc_id", "f.*")


@query(
    "url_lookup_key",
    with_views(
        """SELECT page_id, url, rtrim(replace(replace(base64(encode(url)), '+', '-'), '/', '_'), '=') AS lookup_key
        FROM page_urls"""
    ),
)
def url_lookup_key(spark, sf):
    return fx.page_urls(spark, sf).select("page_id", "url", U.url_lookup_key("url").alias("lookup_key"))


_JOINED = """
    SELECT u.page_id, u.position, u.url, r.malicious, r.suspicious, r.harmless, r.undetected,
        coalesce(r.malicious + r.suspicious + r.harmless + r.undetected, 0) AS total_engines,
        (r.url IS NULL)::INTEGER AS report_pending,
        CASE WHEN r.url IS NULL THEN NULL WHEN r.malicious > 0 THEN 'MALICIOUS'
             WHEN r.suspicious > 0 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict
    FROM message_urls u LEFT JOIN reputation r USING (url)"""


def _urls(spark, sf):
    """The URL table, written once: lookups and the fixtures below read it several times."""
    return durable(ops.url_listing(fx.page_texts(spark, sf), "page_id").drop("display"), "urls")


def _joined(spark, sf):
    urls = _urls(spark, sf)
    return ops.reputation_join(urls, fx.reputation(urls))


@query("reputation_join", with_views(_JOINED))
def reputation_join(spark, sf):
    return _joined(spark, sf)


@query("reputation_total", with_views(f"SELECT page_id, position, url, total_engines FROM ({_JOINED})"))
def reputation_total(spark, sf):
    return _joined(spark, sf).select("page_id", "position", "url", "total_engines")


@query(
    "reputation_verdict",
    with_views(
        f"""SELECT coalesce(verdict, 'PENDING') AS verdict, count(*) AS n, count(DISTINCT url) AS n_urls
        FROM ({_JOINED}) GROUP BY 1"""
    ),
)
def reputation_verdict(spark, sf):
    verdict = F.coalesce("verdict", F.lit("PENDING"))
    return (
        _joined(spark, sf)
        .groupBy(verdict.alias("verdict"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"))
    )


@query(
    "blocklist_lookup",
    with_views(
        """SELECT u.page_id, u.position, u.url, (b.url IS NOT NULL)::INTEGER AS blocked
        FROM message_urls u LEFT JOIN blocklist b USING (url)"""
    ),
)
def blocklist_lookup(spark, sf):
    urls = _urls(spark, sf)
    return ops.blocklist_lookup(urls, fx.blocklist(urls))


@query(
    "blocklist_hits",
    with_views("SELECT u.page_id, u.position, u.url FROM message_urls u JOIN blocklist b USING (url)"),
)
def blocklist_hits(spark, sf):
    urls = _urls(spark, sf)
    return ops.blocklist_hits(urls, fx.blocklist(urls))


@query(
    "blocklist_misses",
    with_views(
        """SELECT u.page_id, u.position, u.url FROM message_urls u
        WHERE NOT EXISTS (SELECT 1 FROM blocklist b WHERE b.url = u.url)"""
    ),
)
def blocklist_misses(spark, sf):
    urls = _urls(spark, sf)
    return ops.blocklist_misses(urls, fx.blocklist(urls))
