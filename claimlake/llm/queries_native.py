"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import chat, mixing, quality, sharding
from claimlake.llm.common import query, stash, table, text_or_empty

_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, regexp_replace(regexp_replace(replace(role || text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(body) + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op1_chat_format", _CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    back = chat.parse(chat.render(chat.fold_events(chat.turn_events(rows.unionByName(extra)))))
    loss = F.array_join(F.transform(F.filter("messages", lambda m: m["in_loss"]), lambda m: m["text"]), "")
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_sharding")
def shard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = stash(docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32")))
    dealt = sharding.shard_rows(rows, 16, F.col("doc_id"), F.col("size"), [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS FIRST) AS rank FROM s),
f AS (SELECT a.source, a.source_size, a.weight, a.rank,
        (SELECT sum(source_size) FROM r) - coalesce((SELECT sum(3 * source_size) FROM r b WHERE b.rank < a.rank), 0) AS rest,
        (SELECT sum(weight) FROM r b WHERE b.rank >= a.rank) AS rest_weight FROM r a),
o AS (SELECT rank, rest, rest_weight FROM f WHERE rest * weight <= 3 * source_size * rest_weight ORDER BY rank LIMIT 1),
g AS (SELECT f.source, source_size, CASE WHEN o.rank IS NULL OR f.rank < o.rank THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * CAST(o.rest AS DOUBLE) AS DOUBLE) / o.rest_weight END AS target
    FROM f LEFT JOIN o ON true),
c AS (SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * (rounds + CASE WHEN 2 * start_at + size <= 2 * (target - rounds * source_size) THEN 1 ELSE 0 END) AS taken FROM c
"""


@query("op3_mixing", _MIX_SQL)
def mix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document is counted in the mix itself, in training order."""
    rows = stash(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"), F.monotonically_increasing_id().alias("row")))
    mixed = stash(mixing.mix_sources(rows, F.col("size")))
    mix = stash(mixing.training_order(mixed, ["row", "doc_id", "size"], "position"))
    taken = mix.groupBy("row").agg(F.sum("size").alias("taken"))
    return mixed.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _quality_sql() -> str:
    """Features, exact binomial tails and cutoffs, said in SQL."""
    ratio = {"symbol_ratio": "n_symbols / word_chars", "capital_ratio": "n_capitals / word_chars", "dup_line_ratio": "n_dup_lines / n_lines", "repeat_ratio": "n_repeat_words / n_words"}
    ratios = ", ".join(f"coalesce({e.split(' / ')[0]} / nullif(CAST({e.split(' / ')[1]} AS DOUBLE), 0), 0.0) AS {r}" for r, e in ratio.items())
    tests = " UNION ALL ".join(f"SELECT lang, '{r}' AS rule, c, n, (SELECT count(*) FROM good g WHERE g.lang IS NOT DISTINCT FROM s.lang AND g.{r} > c) AS k FROM strata s, grid" for r in quality.RULES)
    verdict = " AND ".join(f"coalesce({r} <= (SELECT cut FROM cuts WHERE cuts.lang IS NOT DISTINCT FROM f.lang AND rule = '{r}'), true)" for r in quality.RULES)
    rate = quality.ALPHA / len(quality.RULES)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS row FROM documents),
g AS (SELECT row, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
p AS (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS next FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS n FROM g) WHERE n > 1),
r AS (SELECT row, sum(least(3, coalesce(next - i, 3))) AS n FROM p GROUP BY row),
m AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals,
    len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN r USING (row)),
f AS (SELECT *, {ratios}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
good AS (SELECT f.* FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) > 0)),
strata AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
grid AS (SELECT unnest({list(quality.GRID)}) AS c),
tests AS ({tests}),
tails AS (SELECT *, CASE WHEN k >= n * {rate} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln(1 - {rate}))) FROM range(0, k + 1) x(j)) END AS tail FROM tests),
cuts AS (SELECT lang, rule, min(c) AS cut FROM tails WHERE tail <= {quality.DELTA} / ((SELECT count(*) FROM strata) * {len(quality.RULES) * len(quality.GRID)}) GROUP BY lang, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept FROM f
"""


@query("op7_quality_rules", _quality_sql())
def judge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stash(quality.measured(table(spark, sf_dir, "documents"), ["doc_id", "lang"]))
    return quality.judge(features, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
