"""SQL text for the oracles: the views of ``fixtures`` and the expressions of ``functions``."""

from __future__ import annotations

import re

from mailsieve.functions.text import WS
from mailsieve.functions.urls import FEATURE_URL_PATTERN, IP_PATTERN, RESERVED, SUSPICIOUS_KEYWORDS, TRAILING_PUNCTUATION

MODELS = ("tfidf", "cnn", "lstm", "bert", "hybrid")

# The white-space class as DuckDB's trim() takes it.
SPACE = " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())
URL = rf"(?i)(?:https?://|www\.)[^{WS}]+"
MARKUP = (
    r"(?is)<!--.*?-->|<script\b.*?(?:</script[^>]*>|\z)|<style\b.*?(?:</style[^>]*>|\z)"
    r"|<template\b.*?(?:</template[^>]*>|\z)"
    r"""|<[a-z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[a-z/!?][^>]*>"""
)
ENTITIES = [
    ("&le;", "≤"), ("&alpha;", "α"), ("&hearts;", "♥"), ("&#146;", "’"), ("&#1234567890;", "\ufffd"),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


def unescape(e: str) -> str:
    for name, char in ENTITIES:
        e = f"replace({e}, '{name}', '{char}')"
    return e


def drop_markup(e: str, by: str) -> str:
    return unescape(f"regexp_replace({unescape(e)}, '{MARKUP}', {by}, 'g')")


def html_to_text(e: str) -> str:
    nodes = f"string_split({drop_markup(e, 'chr(1)')}, chr(1))"
    stripped = f"list_transform({nodes}, lambda n: trim(n, {SPACE}))"
    return f"array_to_string(list_filter({stripped}, lambda n: n <> ''), ' ')"


def mask_urls(e: str) -> str:
    return f"regexp_replace({e}, '{URL}', ' <URL> ', 'g')"


def filter_charset(e: str) -> str:
    return f"regexp_replace({e}, '[^A-Za-z0-9<>@._{WS}]', ' ', 'g')"


def squeeze_lower(e: str) -> str:
    return f"lower(trim(regexp_replace({e}, '[{WS}]+', ' ', 'g')))"


def clean_text(e: str) -> str:
    return squeeze_lower(filter_charset(mask_urls(html_to_text(e))))


def normalize_url(u: str) -> str:
    marks = TRAILING_PUNCTUATION.replace("'", "''")
    bare = f"rtrim({u}, '{marks}')"
    return f"CASE WHEN starts_with(lower({bare}), 'www.') THEN 'http://' || {bare} ELSE {bare} END"


RESERVED_PATTERN = "|".join(re.escape(r) for r in RESERVED)


def raw_urls(e: str) -> str:
    return f"regexp_extract_all({e}, '{URL}')"


def normalize_urls(urls: str) -> str:
    return (
        f"list_filter(list_transform({urls}, lambda u: {normalize_url('u')}),"
        " lambda u: contains(u, '://') AND contains(u, '.'))"
    )


def drop_reserved(urls: str) -> str:
    return f"list_filter({urls}, lambda u: NOT regexp_matches(lower(u), '{RESERVED_PATTERN}'))"


def extract_urls(e: str) -> str:
    return drop_reserved(normalize_urls(raw_urls(e)))


def md5_int(e: str, start: int, digits: int) -> str:
    return f"('0x' || substr({e}, {start}, {digits}))::BIGINT"


FEATURE_URL = f"regexp_extract(text, '{FEATURE_URL_PATTERN}')"
URL_FEATURES = rf"""
    length(u)::INTEGER AS url_len,
    (length(u) - length(replace(u, '.', '')))::INTEGER AS url_dots,
    regexp_matches(u, '{IP_PATTERN}')::INTEGER AS url_has_ip,
    (length(u) - length(replace(replace(u, '@', ''), '-', '')))::INTEGER AS url_special,
    regexp_matches(lower(u), '{'|'.join(SUSPICIOUS_KEYWORDS)}')::INTEGER AS url_keyword,
    starts_with(u, 'https')::INTEGER AS url_https"""
FEATURE_NAMES = ("url_len", "url_dots", "url_has_ip", "url_special", "url_keyword", "url_https")

# Views, in dependency order; with_views() adds the ones a query names and those they need.
VIEWS: dict[str, str] = {
    "page_urls": """
        SELECT page_id, CASE
            WHEN page_id % 11 = 3 THEN regexp_replace(u, '^https?://', 'www.')
            WHEN page_id % 5 = 1 THEN 'http://192.0.2.7/item/' || page_id || '?a=1.2'
            WHEN page_id % 7 = 2 THEN u || ').,' ELSE u END AS url
        FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, 'example', 'mail-verify')
              ELSE url END AS u FROM pages)""",
    "page_texts": "SELECT page_id, p.html || ' ' || v.url AS text FROM pages p JOIN page_urls v USING (page_id)",
    "messages": """
        SELECT d.doc_id, d.text || coalesce(' ' || v.url, '') AS text, d.source
        FROM documents d LEFT JOIN page_urls v ON v.page_id = d.doc_id""",
    "emails": """
        SELECT m.doc_id, m.text, l.toxic AS label, m.source
        FROM messages m JOIN labels l USING (doc_id)""",
    "ranked_emails": """
        SELECT doc_id, text, label, source,
            row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42'), doc_id) AS rn,
            count(*) OVER (PARTITION BY label) AS n
        FROM emails""",
    "split_emails": """
        SELECT doc_id, text, label, source, CASE WHEN rn * 10 <= n * 8 THEN 'train'
            WHEN rn * 10 <= n * 9 THEN 'validation' ELSE 'test' END AS split
        FROM ranked_emails""",
    "message_clean": f"SELECT doc_id, {clean_text('text')} AS clean FROM messages",
    "train_clean": """
        SELECT s.doc_id, s.label, c.clean FROM split_emails s JOIN message_clean c USING (doc_id)
        WHERE s.split = 'train'""",
    "word_lists": "SELECT doc_id, regexp_extract_all(clean, '[a-z0-9_]{2,}') AS words FROM message_clean",
    "words": """
        SELECT doc_id, (generate_subscripts(words, 1) - 1)::INTEGER AS pos, unnest(words) AS word
        FROM word_lists""",
    "terms": """
        SELECT doc_id, word AS term FROM words
        UNION ALL
        SELECT doc_id, word || ' ' || next AS term FROM (
            SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM words)
        WHERE next IS NOT NULL""",
    "train_counts": """
        SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df
        FROM terms WHERE doc_id IN (SELECT doc_id FROM train_clean) GROUP BY term""",
    "vocab": """
        SELECT term, tf, df,
            ln((1 + (SELECT count(*) FROM train_clean))::DOUBLE / (1 + df)) + 1 AS idf
        FROM train_counts ORDER BY tf DESC, term LIMIT 5000""",
    "term_tf": """
        SELECT doc_id, term, idf, count(*) AS tf FROM terms JOIN vocab USING (term)
        GROUP BY doc_id, term, idf""",
    "tfidf": """
        SELECT doc_id, term, tf,
            tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS tfidf
        FROM term_tf""",
    "seq_words": """
        SELECT doc_id, (generate_subscripts(ws, 1) - 1)::INTEGER AS pos, unnest(ws) AS word
        FROM (SELECT doc_id, regexp_extract_all(clean, '[a-z0-9]+') AS ws FROM message_clean)""",
    "seq_vocab": """
        SELECT word, n, (row_number() OVER (ORDER BY n DESC, first) + 1)::INTEGER AS id FROM (
            SELECT word, count(*) AS n, min({'doc_id': doc_id, 'pos': pos}) AS first
            FROM seq_words WHERE doc_id IN (SELECT doc_id FROM train_clean) GROUP BY word)
        QUALIFY row_number() OVER (ORDER BY n DESC, first) <= 19998""",
    "message_urls": f"""
        SELECT page_id, unnest({extract_urls('text')}) AS url,
            generate_subscripts({extract_urls('text')}, 1)::INTEGER AS position
        FROM page_texts""",
    "reputation": f"""
        SELECT url, greatest({md5_int('h', 1, 1)} - 11, 0) AS malicious,
            greatest({md5_int('h', 2, 1)} - 10, 0) AS suspicious,
            {md5_int('h', 3, 2)} AS harmless, {md5_int('h', 5, 1)} AS undetected
        FROM (SELECT DISTINCT url, md5(url) AS h FROM message_urls) WHERE {md5_int('h', 7, 2)} >= 26""",
    "blocklist": "SELECT DISTINCT url FROM message_urls WHERE md5(url)[1] = '0'",
    "message_url_features": f"""
        SELECT doc_id, {URL_FEATURES} FROM (SELECT doc_id, {FEATURE_URL} AS u FROM messages)""",
    "scores": f"""
        SELECT doc_id, model, CASE WHEN substr(h, 5, 1) <> '0'
            THEN round({md5_int('h', 1, 4)} / 65536.0::DOUBLE, 2) END AS prob
        FROM (SELECT doc_id, model, md5(doc_id || ':' || model) AS h FROM documents,
              (VALUES {', '.join(f"('{m}')" for m in MODELS)}) AS m(model))""",
    "labelled_scores": """
        SELECT s.doc_id, s.model, s.prob, l.toxic AS label FROM scores s JOIN labels l USING (doc_id)
        WHERE s.prob IS NOT NULL""",
    "score_counts": """
        SELECT model, count(*) FILTER (label = 0 AND pred = 0) AS tn,
            count(*) FILTER (label = 0 AND pred = 1) AS fp,
            count(*) FILTER (label = 1 AND pred = 0) AS fn,
            count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) AS n
        FROM (SELECT *, (prob > 0.5)::INTEGER AS pred FROM labelled_scores) GROUP BY model""",
    "logits": f"""
        SELECT doc_id, ({md5_int("md5(doc_id || ':l0')", 1, 2)} - 128) / 32.0::DOUBLE AS l0,
            ({md5_int("md5(doc_id || ':l1')", 1, 2)} - 128) / 32.0::DOUBLE AS l1
        FROM documents""",
}


def with_views(body: str) -> str:
    """``body`` behind the views it needs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in VIEWS.items():
            if name not in needed and _mentions(text, name):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed) + "\n" + body


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) is not None


def auc(source: str, by: str = "") -> str:
    """ROC AUC over ``source`` (score, label[, by]) by ranks, ties sharing their mean rank."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
        SELECT {lead}CASE WHEN sum(label) = 0 OR sum(1 - label) = 0 THEN 'nan'::DOUBLE ELSE
            (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0)
            / (sum(label)::DOUBLE * sum(1 - label)) END AS roc_auc
        FROM (SELECT {lead}label, rank() OVER ({part} ORDER BY score)
                + (count(*) OVER (PARTITION BY {lead}score) - 1) / 2.0::DOUBLE AS r
              FROM ({source})) {group}"""
