"""URL extraction and URL features as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.text import URL_PATTERN, _as_col, text_or_empty

# Substrings that mark a URL as reserved, wherever they occur in it.
RESERVED = (
    ".example", ".test", ".invalid", ".localhost",
    "example.com", "example.org", "example.net",
    "test.com", "localhost",
)
# Characters that end a sentence rather than a URL.
TRAILING_PUNCTUATION = ".,;:!?)'\""

# Words that make a URL suspicious.
SUSPICIOUS_KEYWORDS = ("login", "update", "verify", "bank", "secure", "account", "confirm")

# The narrower, case-sensitive pattern of the feature extractor, and its address pattern.
FEATURE_URL_PATTERN = r"https?://[!$-_a-z]+"
IP_PATTERN = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"

URL_FEATURES = ("url_len", "url_dots", "url_has_ip", "url_special", "url_keyword", "url_https")


def _contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needles])


def raw_urls(text: Column | str) -> Column:
    """Every URL-like run of the text, in order, duplicates kept."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(URL_PATTERN), F.lit(0))


def normalize_url(url: Column) -> Column:
    """Trailing punctuation off; ``http://`` in front of a bare ``www.`` name."""
    bare = F.rtrim(url, F.lit(TRAILING_PUNCTUATION))
    return F.when(F.startswith(F.lower(bare), F.lit("www.")), F.concat(F.lit("http://"), bare)).otherwise(bare)


def normalize_urls(urls: Column) -> Column:
    """Normalised URLs that have a scheme and a dot."""
    return F.filter(
        F.transform(urls, normalize_url),
        lambda u: F.contains(u, F.lit("://")) & F.contains(u, F.lit(".")),
    )


def is_reserved(url: Column | str) -> Column:
    return _contains_any(F.lower(_as_col(url)), RESERVED)


def drop_reserved_urls(urls: Column) -> Column:
    return F.filter(urls, lambda u: ~is_reserved(u))


def extract_urls(text: Column | str) -> Column:
    """The checkable URLs of a message, in order, duplicates kept."""
    return drop_reserved_urls(normalize_urls(raw_urls(text)))


def filtered_url_count(text: Column | str) -> Column:
    """How many URL-like runs the normaliser and the reserved list dropped."""
    return F.size(raw_urls(text)) - F.size(extract_urls(text))


def url_display(url: Column | str, max_len: int = 50) -> Column:
    url = _as_col(url)
    return F.when(
        F.length(url) > max_len, F.concat(F.substring(url, 1, max_len), F.lit("..."))
    ).otherwise(url)


def url_lookup_key(url: Column | str) -> Column:
    """URL-safe base64 without padding, the key reputation services use."""
    plain = F.base64(F.encode(_as_col(url), "UTF-8"))
    return F.rtrim(F.translate(F.regexp_replace(plain, r"[\r\n]", ""), "+/", "-_"), F.lit("="))


def first_feature_url(text: Column | str) -> Column:
    """First match of the feature pattern, or the empty string."""
    return F.regexp_extract(text_or_empty(text), FEATURE_URL_PATTERN, 0)


def url_len(url: Column | str) -> Column:
    return F.length(_as_col(url))


def url_dots(url: Column | str) -> Column:
    url = _as_col(url)
    return F.length(url) - F.length(F.replace(url, F.lit("."), F.lit("")))


def url_has_ip(url: Column | str) -> Column:
    return F.regexp_like(_as_col(url), F.lit(IP_PATTERN)).cast("int")


def url_special(url: Column | str) -> Column:
    url = _as_col(url)
    return F.length(url) - F.length(F.translate(url, "@-", ""))


def url_keyword(url: Column | str) -> Column:
    return _contains_any(F.lower(_as_col(url)), SUSPICIOUS_KEYWORDS).cast("int")


def url_https(url: Column | str) -> Column:
    return F.startswith(_as_col(url), F.lit("https")).cast("int")


def features_of_url(url: Column | str) -> Column:
    """struct of the six features; the empty URL gives six zeros."""
    builders = (url_len, url_dots, url_has_ip, url_special, url_keyword, url_https)
    return F.struct(*[f(url).alias(n) for n, f in zip(URL_FEATURES, builders)])


def url_features(text: Column | str) -> Column:
    """The six features of the first URL in the **raw** text."""
    return features_of_url(first_feature_url(text))


def reputation_total() -> Column:
    """Engines that reported at all."""
    counts = ("malicious", "suspicious", "harmless", "undetected")
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in counts]
    return sum(parts[1:], parts[0])


def reputation_verdict(malicious: Column | str = "malicious", suspicious: Column | str = "suspicious") -> Column:
    return (
        F.when(_as_col(malicious) > 0, "MALICIOUS")
        .when(_as_col(suspicious) > 0, "SUSPICIOUS")
        .otherwise("SAFE")
    )
