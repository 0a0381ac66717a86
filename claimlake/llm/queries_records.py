"""Queries of the prefix trie, ranked search and archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from claimlake.llm import ranking, trie, warc
from claimlake.llm.common import query, table
from claimlake.session import shared_dir

#: CRC-32 of a list of byte values b, bit by bit (reflected polynomial 0xEDB88320).
_CRC = "xor(4294967295, list_reduce([4294967295] || b, lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))))"

_TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM conversations WHERE conv_id IS NOT NULL)),
r AS (SELECT h.conv_id, 0 AS part, k, role, text FROM h JOIN t ON t.conv_id = h.base WHERE k <= h UNION ALL SELECT h.conv_id, 1, k, role, text FROM h JOIN t ON t.conv_id = h.conv_id WHERE k > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, list(md5(length(role) || ':' || role || text)) OVER w AS path, strlen(text) AS bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
m AS (SELECT * FROM p UNION ALL SELECT conv_id, 0, [], 0 FROM h),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM m GROUP BY path, depth),
c AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
s AS (SELECT m.path, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.bytes) AS BIGINT) AS saved_tokens FROM m JOIN f ON f.conv_id = m.conv_id AND f.depth >= m.depth GROUP BY m.path),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON f.depth > 0 AND u.path = f.path[:f.depth - 1]
"""


@query("op11_prefix_trie", _TRIE_SQL)
def trie_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


_RANK_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
a AS (SELECT q, term, count(*) AS k FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY q, term),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY r, term),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * docs) // terms AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT q, r, CAST(sum(k * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM a JOIN t USING (term) JOIN v USING (term) JOIN m USING (r) GROUP BY q, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN i USING (q) JOIN m USING (r) WHERE score > 0) WHERE rank <= 20
"""


@query("op12_ranked_search", _RANK_SQL)
def rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * CAST(i // 4 AS BIGINT) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)"

_WARC_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, strlen(html) AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: {_LETTER}), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM f
"""


@query("op13_warc", _WARC_SQL)
def warc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.archived(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)
