"""The corpus queries in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from ledgerloom.llm import divergence, lexical, license_scan, line_dedup, sharding
from ledgerloom.llm.common import LOWER, UPPER

_NEAR = """
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(n, m) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT r.n, e.b FROM reach r JOIN both_ e ON r.m = e.a),
labels AS (SELECT n, min(m) AS c FROM reach GROUP BY n)"""

#: Words of a text, A-Z lower-cased, without the separators of the class given.
_WORDS = "regexp_extract_all(translate({text}, '" + UPPER + "', '" + LOWER + "'), '{pattern}')"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="text", pattern="[^ " + chr(92) + "x09-" + chr(92) + "x0D]+")} AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS x FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id > q.doc_id GROUP BY p.doc_id, q.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),{_NEAR}
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN labels ON labels.n = doc_id
"""

CAPS = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT vec_id, v FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id > q.vec_id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= 0.9),{_NEAR},
counts AS (SELECT a, count(*) AS n FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM e LEFT JOIN labels ON labels.n = vec_id LEFT JOIN counts k ON k.a = vec_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (g * 5 + 1)::INTEGER, 5))::INTEGER >> s) & 31), 1)), '')), '') AS payload_digest,
  CASE WHEN newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM d
"""

_ALNUM = "[^" + "".join(chr(92) + x for x in ("x00-", "x2F", "x3A-", "x60", "x7B-", "x7F")) + "]+"
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(text="text", pattern=_ALNUM)}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(text="text", pattern=_ALNUM)} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, (len(w) - n + 2)::BIGINT), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS x FROM sized),
spots AS (SELECT doc_id, w, s.n, unnest(range(1, greatest(len(w) - s.n + 2, 1)::BIGINT)) AS k FROM d, (SELECT DISTINCT n FROM windows) s),
hits AS (SELECT doc_id, item_id, k, n FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS x FROM spots) JOIN windows USING (x, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, (k + n)::BIGINT)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op2_minhash": MINHASH,
    "op5_caps": CAPS,
    "op7_warc": WARC,
    "op8_decontaminate": DECONTAMINATE,
    "op10_license_scan": license_scan.oracle(),
    "op11_divergence": divergence.ORACLE_SQL,
    "op12_sharding": sharding.ORACLE_SQL,
    "op13_lexical_search": lexical.oracle(UPPER, LOWER),
}
