"""DuckDB SQL with the rows that the exact operators must give."""

from __future__ import annotations

import string

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keep FROM p
) SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM d"""

WINNOW = f"""WITH dw AS (SELECT doc_id, regexp_extract_all({_lowered('text')}, '{_ALNUM}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_lowered('text')}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS l, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(k) WHERE len(w) > 0
), lens AS (SELECT DISTINCT l FROM win),
own AS (SELECT doc_id, k, l, array_to_string(w[k : k + l - 1], ' ') AS win FROM dw, lens, unnest(range(1, len(w) - l + 2)) u(k)),
hits AS (SELECT doc_id, k, l, item FROM own JOIN win USING (l, win)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT DISTINCT doc_id, k, l FROM hits), unnest(range(k, k + l)) u(pos) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

FACTORS = f"""WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w FROM documents),
own AS (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS win FROM dw, unnest(range(1, len(w) - 18)) u(k)),
later AS (SELECT doc_id, k FROM own QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, pos FROM later, unnest(range(k, k + 20)) u(pos)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w[pos], ' ' ORDER BY pos) AS text FROM dw, unnest(range(1, len(w) + 1)) u(pos)
  WHERE (doc_id, pos) NOT IN (SELECT doc_id, pos FROM gone) GROUP BY 1
) SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM dw LEFT JOIN kept USING (doc_id)"""

SIMILAR = f"""WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_lowered('text')}, '{_PLAIN}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM dw, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(k) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, least(doc_id, min(b)) AS component_id
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id"""

# CRC-32 of the decimal doc_id, a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))))"""

# A pair of words q apart that begin equal five-word pieces is part of an island of such pairs; islands of enough words are runs.
RUNS = f"""WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w, {_CRC} AS h FROM documents),
pl AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM dw),
pp AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM pl),
tw AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)), lambda i: w[CAST(1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END AS INT)]) END AS w FROM pp),
gram AS (SELECT doc_id, i, array_to_string(w[CAST(i + 1 AS INT) : CAST(i + 5 AS INT)], ' ') AS g FROM tw, unnest(range(0, len(w) - 4)) u(i)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, pos FROM runs, unnest(range(start + period, start + length)) u(pos)),
kept AS (SELECT t.doc_id, string_agg(w[CAST(u.pos + 1 AS INT)], ' ' ORDER BY u.pos) AS text FROM tw t, unnest(range(0, len(w))) u(pos)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND g.pos = u.pos) GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM tw LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

NEAREST = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda s, x: s + x)) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM d QUALIFY rank <= 10"""

NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS own, CAST(list_sum(list_transform(list_zip(a.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
p AS (SELECT * FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10"""
