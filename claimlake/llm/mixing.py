"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, linear between knots. Its integral is the source's weight;
the weights share the words of all sources, a source gives at most `max_repeats` times its own words, and what is above
is shared anew by weight. Inside a source, documents stand in the order of the md5 of their id, and their running word
count is the demand at which they are needed. Inverting the integrated schedule at that demand gives the training
position, and the mix is range-sorted by position.

A document is taken as often as whole rounds of its source are needed, and once more if its middle word is below the
rest. Nulls: a null text has 0 words, a null source is a source (last in order), a null id hashes as the empty text.
Empty texts are taken 0 times. Equal rows are told apart by nothing and each is counted. An empty table gives an empty
mix. Clashing columns are replaced. There is one row for each source in one task; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlake.llm.common import WORD, fresh, quoted, stash

MAX_REPEATS = 3


def word_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def ramped_schedule(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating by source name; light sources fade out and heavy ones fade in, the integral stays."""
    weight = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    slope = (F.col("weight") - 2) * F.lit(0.5)
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), w.alias("w"))
    return sources.select("source", weight.cast("double").alias("weight")).select(
        "source", F.array(knot(0.0, F.col("weight") * (1 - slope)), knot(1.0, F.col("weight") * (1 + slope))).alias("knots")
    )


def targets(sources: DataFrame, schedule: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> weight (integral of the schedule), integral at each knot, target words."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("knots") - 2),
        lambda i: (F.col("knots")[i]["w"] + F.col("knots")[i + 1]["w"]) / 2 * (F.col("knots")[i + 1]["t"] - F.col("knots")[i]["t"]),
    )
    upto = F.transform(F.sequence(F.lit(0), F.size("pieces")), lambda i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    weighed = (
        sources.join(schedule.select(F.col("source").alias("s"), "knots"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "source_size", "knots", pieces.alias("pieces"))
        .select("source", "source_size", "knots", upto.alias("integral"))
        .withColumn("weight", F.element_at("integral", -1))
    )
    most = F.col("source_size") * max_repeats
    order = W.orderBy(F.col("fills_at"), F.col("source").asc_nulls_first())
    everyone = W.partitionBy()
    return (
        weighed.withColumn("fills_at", most / F.col("weight"))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(most).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("open", F.min(F.when(F.col("rest") * F.col("weight") <= most * F.col("rest_weight"), F.struct("rank", "rest", "rest_weight"))).over(everyone))
        .withColumn(
            "target",
            F.when(F.col("open").isNull() | (F.col("rank") < F.col("open.rank")), most.cast("double"))
            .otherwise(F.col("weight") * F.col("open.rest") / F.col("open.rest_weight")),
        )
        .select("source", "source_size", "weight", "knots", "integral", "target")
    )


def invert(demand: Column, knots: Column, integral: Column) -> Column:
    """The time at which the integrated schedule reaches demand."""
    at = F.greatest(F.lit(1), F.least(F.size(F.filter(integral, lambda x: x <= demand)), F.size(knots) - 1))
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    slope = (b["w"] - a["w"]) / (b["t"] - a["t"])
    more = demand - F.element_at(integral, at)
    root = F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + 2 * slope * more))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["t"] + F.try_divide(2 * more, a["w"] + root)))


def mix_sources(df: DataFrame, size: Column, schedule=ramped_schedule, *, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """df (doc_id, source, ...) with size, source_size, target and `positions`: one training position per use, maybe none.

    schedule: a function from the sources to (source, knots), knots an array of (t, w) from t 0 to 1, weights above 0.
    """
    outs = ("size", "source_size", "target", "positions")
    kept = [c for c in df.columns if c.lower() not in outs]
    order, part, start, before, s, full, rest = fresh(df, "md5_order", "part", "start", "before", "s", "full", "rest")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = df.select(*[quoted(c) for c in kept], size.cast("long").alias("size"), key.alias(order)).withColumn(part, F.substring(order, 1, 3))
    parts = stash(rows.groupBy("source", part).agg(F.sum("size").alias("part_size")))
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goals = stash(targets(sources, schedule(sources.select("source")), max_repeats)).select(F.col("source").alias(f"{s}2"), "source_size", "knots", "integral", "target")
    parts = parts.select(F.col("source").alias(s), F.col(part).alias(f"{part}2"), (F.sum("part_size").over(W.partitionBy("source").orderBy(part)) - F.col("part_size")).alias(before))
    blocks = parts.join(goals, F.col(s).eqNullSafe(F.col(f"{s}2"))).drop(f"{s}2")
    inside = W.partitionBy("source", part).orderBy(order, "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn(start, F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(blocks, F.col("source").eqNullSafe(F.col(s)) & (F.col(part) == F.col(f"{part}2")))
    begin = F.col(before) + F.col(start)
    rounds = (
        joined.withColumn(full, F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn(rest, F.col("target") - F.col(full) * F.col("source_size"))
        .withColumn(full, F.when(F.col("size") == 0, 0).otherwise(F.col(full) + (2 * begin + F.col("size") <= 2 * F.col(rest)).cast("int")))
    )
    whole_weight = F.element_at("integral", -1)
    position = lambda c: invert((c * F.col("source_size") + begin + F.col("size") / 2) / F.col("target") * whole_weight, F.col("knots"), F.col("integral"))
    uses = F.when(F.col(full) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(full).cast("long") - 1), position)).otherwise(F.array().cast("array<double>"))
    return rounds.select(*[quoted(c) for c in kept], "size", "source_size", "target", uses.alias("positions"))


def training_order(mixed: DataFrame, columns: list[str], position: str | None = None) -> DataFrame:
    """The mix itself: one row per use, range-sorted by training position, which stays as a last column if it is given a name."""
    used = position or fresh(mixed, "position")[0]
    rows = mixed.select(*[quoted(c) for c in columns], F.explode("positions").alias(used))
    return rows.repartitionByRange(F.col(used), F.col("doc_id")).sortWithinPartitions(used, "doc_id").select(*[quoted(c) for c in [*columns, *([position] if position else [])]])
