"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

# Words of a text: ASCII letters lower-cased, runs of letters, digits and characters above 0x7F.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# Vectors as integers cut into four parts, the first 256 ids' parts as entries, and one step of assignment and means.
_PARTS = """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, k, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k FROM p) WHERE k < 256)"""


def _assigned(r: int) -> str:
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"""a{r} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x, min({{'d': {apart}, 'k': k}}) AS near
  FROM p JOIN c{r} USING (part) GROUP BY vec_id, label, part)"""


def _means(r: int) -> str:
    return f"""c{r + 1} AS MATERIALIZED (SELECT part, k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
  SELECT part, k, list(mean ORDER BY i) AS m FROM (
    SELECT part, near.k AS k, i, floor(sum(x[i]) / count(*))::BIGINT AS mean FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i)
    GROUP BY ALL) GROUP BY part, k) USING (part, k))"""


_FITTED = ",\n".join([_PARTS, *(f"{_assigned(r)},\n{_means(r)}" for r in range(4)), _assigned(4)])

ORACLES: dict[str, str] = {
    "op1_dart_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
  list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS doc, doc_id AS top FROM documents UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.doc)
SELECT doc AS doc_id, min(top) AS class_id, doc = min(top) AS kept FROM r GROUP BY doc""",
    "op2_bucket_pointer": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400),
w AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i::INT + 1, 400)) AS k FROM p),
m AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
f AS (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -201) + 200)::INT AS fresh FROM m),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM f),
runs AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT d.r, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN runs ON runs.r = d.r GROUP BY d.r),
kept AS (SELECT r, string_agg(substr(h, 2 * a::INT + 1, 2 * (b - a)::INT), '' ORDER BY a) AS t FROM gaps JOIN d USING (r) GROUP BY r),
n AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM runs GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN n USING (r)""",
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS hex FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last_id FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM m""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE
  list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda i: w[i + 1 : i + 10]) END) AS win FROM b),
win AS (SELECT DISTINCT array_to_string(win, ' ') AS s, len(win) AS n, item_id FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN win v ON v.n = p.n AND v.s = array_to_string(w[i + 1 : i + p.n], ' ')),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_drake_hamerly": f"""
WITH {_FITTED},
codes AS (SELECT vec_id, label, string_agg(printf('%02x', near.k::INT), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a4 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS digest FROM c4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT digest FROM books) AS codebooks_sha256 FROM codes""",
}
