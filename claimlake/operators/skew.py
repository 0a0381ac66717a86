"""Skew-safe building blocks.

Any key may hold a third of all rows. Nothing here gathers one key in one task: joins split
hot keys over salted copies of the looked-up row, and positions or running values inside a
group are computed per block with block totals carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def hot_key_rows(df: DataFrame, keys: list[str], min_rows: int | None = None) -> DataFrame:
    """Keys with more rows than a partition has on average, or than min_rows. There are fewer of them than
    partitions, so a broadcast of the list is bounded; the others take the ordinary join path.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    if min_rows is not None:
        hot = counted.filter(F.col("__rows") >= min_rows)
    else:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot = counted.filter(F.col("__rows") * partitions > counted.agg(F.sum("__rows")).scalar())
    return hot.select(*keys, F.lit(True).alias("__hot"))


def lookup_join(
    left: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
    hot_rows: int | None = None, salts: int = SALTS,
) -> DataFrame:
    """Join rows to a lookup that has at most one row per key, splitting hot keys.

    Rows of a hot key get a salt drawn from their content; only hot lookup rows are copied
    per salt. All other rows keep salt 0, so the lookup is not enlarged.
    """
    hot = F.broadcast(hot_key_rows(left, keys, hot_rows))
    others = [c for c in left.columns if c not in keys]
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in (others or keys)]), F.lit(salts)).cast("int")
    salted_left = left.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), spread).otherwise(F.lit(0))
    ).drop("__hot")
    salted_lookup = lookup.join(hot, keys, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("__hot")
    return salted_left.join(salted_lookup, [*keys, "__salt"], how).drop("__salt")


def block_positions(df: DataFrame, keys: list[str], block: Column, order: list[str], out: str = "position") -> DataFrame:
    """0-based position inside each key group, ordered by (block, order), without a whole-group window.

    `block` must rise with `order` and bound the rows per (key, block). The block totals form a
    table of about rows / block size, and a prefix sum over it gives each block its offset.
    """
    rows = df.withColumn("__block", block)
    totals = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    return (
        rows.join(offsets, [*keys, "__block"])
        .withColumn(out, F.col("__offset") + F.row_number().over(inside) - 1)
        .drop("__block", "__offset")
    )


def running_max_before(
    df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, out: str
) -> DataFrame:
    """Largest earlier `value` inside each key group, block by block."""
    rows = df.withColumn("__block", block)
    totals = rows.groupBy(*keys, "__block").agg(F.max(value).alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__block", F.max("__m").over(before).alias("__carried"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(carried, [*keys, "__block"])
        .withColumn(out, F.greatest(F.col("__carried"), F.max(value).over(inside)))
        .drop("__block", "__carried")
    )


def previous_row(
    df: DataFrame, keys: list[str], block: Column, order: list[str], fields: list[str], out: str
) -> DataFrame:
    """The preceding row's fields as a struct, block by block; the last row of a block serves the next block."""
    rows = df.withColumn("__block", block).withColumn("__f", F.struct(*fields))
    last = rows.groupBy(*keys, "__block").agg(F.max_by("__f", F.struct(*order)).alias("__l"))
    carried = last.select(
        *keys, "__block", F.lag("__l").over(Window.partitionBy(*keys).orderBy("__block")).alias("__carried")
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    return (
        rows.join(carried, [*keys, "__block"])
        .withColumn(out, F.coalesce(F.lag("__f").over(inside), F.col("__carried")))
        .drop("__block", "__carried", "__f")
    )

