"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into `bins` equal arcs. A row's key decides its arc; the arc's clockwise next virtual node names its
home shard. A shard takes arcs until its load reaches (1 + slack) times the mean; arcs beyond that walk on clockwise to
the next virtual node whose shard has room. Arcs are placed largest first, so what is left for the last places is small
and loads end close to the bound. Only the loads of the arcs, `bins` rows at most, come to the driver.

Nulls: a null key hashes like any other key, a null size counts as 0. Ties and repeated rows share an arc and so a
shard, and each gets a slot of its own. An empty table gives an empty result. Columns of the input named like an
output column are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlake.llm.common import fresh, quoted

BINS = 8192
VNODES = 64
#: Pieces of a shard's rows along a column from 0 to 1 that are numbered each by itself.
STEPS = 4096
SLACK = 0.001


def ring_points(n_shards: int, vnodes: int = VNODES, bins: int = BINS) -> list[tuple[int, int]]:
    """(arc, shard) of every virtual node in clockwise order. A shard's points do not depend on the other shards."""
    def at(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}#{v}".encode()).digest()[:8], "big") % bins

    return sorted((at(s, v), s) for s in range(n_shards) for v in range(vnodes))


def place_arcs(loads: dict[int, int], n_shards: int, vnodes: int = VNODES, bins: int = BINS, slack: float = SLACK) -> dict[int, int]:
    """Shard of every loaded arc under bounded loads."""
    points = ring_points(n_shards, vnodes, bins)
    places = [p for p, _ in points]
    total = sum(loads.values())
    bound = -(-total // n_shards) * (1 + slack)
    held = [0] * n_shards
    out = {}
    for arc in sorted(loads, key=lambda a: (-loads[a], a)):
        first, tried = bisect_left(places, arc), set()
        for step in range(len(points)):
            shard = points[(first + step) % len(points)][1]
            if shard in tried:
                continue
            if held[shard] + loads[arc] <= bound:
                break
            tried.add(shard)
            if len(tried) == n_shards:  # larger than any room left: the emptiest shard
                shard = min(range(n_shards), key=lambda s: (held[s], s))
                break
        out[arc] = shard
        held[shard] += loads[arc]
    return out


def shard_rows(df: DataFrame, n_shards: int, key: Column, size: Column, order: list[Column], *, along: str | None = None, vnodes: int = VNODES, bins: int = BINS, slack: float = SLACK) -> DataFrame:
    """df with `shard` and a gapless `slot` per shard: by arc and order, or by the column `along` (0 to 1) and order.

    key decides the arc, size is the load, order makes slots repeatable (rows equal in it must be equal throughout).
    df is read twice: once for the loads of the arcs, once to deal its rows; with `along` once more, for the rows of each
    shard's steps (n_shards * STEPS numbers at most, which are broadcast).
    """
    arc, load, at, home, step, home_of, step_of, before = fresh(df, "arc", "load", "at", "home", "step", "home_of", "step_of", "before")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(*[quoted(c) for c in df.columns], F.pmod(F.xxhash64(key), F.lit(bins)).cast("int").alias(arc), F.coalesce(size, F.lit(0)).cast("long").alias(load))
    totals = rows.groupBy(arc).agg(F.sum(load).alias("b"), F.count("*").alias("n")).collect()
    shard_of = place_arcs({r[arc]: r["b"] for r in totals}, n_shards, vnodes, bins, slack)
    count = {r[arc]: r["n"] for r in totals}
    start, filled = {}, [0] * n_shards
    for a in sorted(count):
        start[a] = filled[shard_of[a]]
        filled[shard_of[a]] += count[a]

    def lookup(values: dict[int, int], kind: str) -> Column:
        return F.element_at(F.split(F.lit(",".join(str(values.get(a, 0)) for a in range(bins))), ",").cast(f"array<{kind}>"), F.col(arc) + 1)

    if along is not None:
        place = F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor(quoted(along) * STEPS)))
        dealt = rows.withColumn(home, lookup(shard_of, "int")).withColumn(step, place.cast("int"))
        counts = dealt.groupBy(F.col(home).alias(home_of), F.col(step).alias(step_of)).agg(F.count("*").alias("n"))
        starts = counts.select(home_of, step_of, (F.sum("n").over(W.partitionBy(home_of).orderBy(step_of)) - F.col("n")).alias(before))
        numbered = dealt.withColumn(at, F.row_number().over(W.partitionBy(home, step).orderBy(quoted(along), *order)))
        joined = numbered.join(F.broadcast(starts), (F.col(home) == F.col(home_of)) & (F.col(step) == F.col(step_of)))
        return joined.select(*[quoted(c) for c in kept], F.col(home).alias("shard"), (F.col(before) + F.col(at) - 1).alias("slot"))
    numbered = rows.withColumn(at, F.row_number().over(W.partitionBy(arc).orderBy(*order)))
    return numbered.select(
        *[quoted(c) for c in kept],
        lookup(shard_of, "int").alias("shard"),
        (lookup(start, "bigint") + F.col(at) - 1).alias("slot"),
    )


def shard_documents(df: DataFrame, n_shards: int = 16, **options) -> DataFrame:
    """Documents with `shard` and `slot`; the load is the UTF-8 bytes of the text plus 1, so near-equal shard sizes."""
    return shard_rows(df, n_shards, F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1, [F.col("doc_id"), F.xxhash64("text"), F.col("text")], **options)
