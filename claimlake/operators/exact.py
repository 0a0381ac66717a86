"""Sums of doubles that depend neither on the order of rows nor on partitions: integer sums per exponent bin, rounded once.

A finite double is an integer of 53 bits times a power of two. Cut at multiples of 2**32 it is at most three whole numbers, each of a bin;
the bins' sums are whole numbers too, so any order and any grouping give the same. A group has at most as many bins as doubles have
32-bit places, whatever its rows; their exact total is rounded to the nearest double once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST, _MOST = -34, 31
#: Doubles below 2**-800 are raised by 2**192, so that the powers they are cut at are doubles.
_RAISED = 6
_PLUS, _MINUS, _NAN = 1000, 1001, 1002


def _power(bin_: Column) -> Column:
    """2 ** (32 * bin), for bins from _LEAST + _RAISED on."""
    return F.element_at(F.array(*[F.lit(2.0 ** (32 * b)) for b in range(_LEAST + _RAISED, _MOST + 1)]), bin_ - (_LEAST + _RAISED) + 1)


def bins(value: Column) -> Column:
    """The bins of a double: array of (bin, part), parts below 2**32 in size; infinities and NaN have bins of their own."""
    size = F.abs(value)
    raised = F.when(size < 2.0**-800, value * 2.0 ** (32 * _RAISED)).otherwise(value)
    lower = F.when(size < 2.0**-800, _RAISED).otherwise(0)
    guess = F.floor(F.log2(F.abs(raised)) / 32).cast("int")

    def cut(state: Column, step: Column) -> Column:
        """Take the part of the next lower bin; what is left is exact."""
        bin_ = state["top"] - step
        part = F.when(state["left"] != 0.0, F.floor(F.abs(state["left"]) / _power(F.greatest(bin_, F.lit(_LEAST + _RAISED)))) * F.signum(state["left"])).otherwise(0.0)
        part = F.when(bin_ < _LEAST + _RAISED, 0.0).otherwise(part.cast("double"))
        return F.struct(
            state["top"].alias("top"), (state["left"] - part * _power(F.greatest(bin_, F.lit(_LEAST + _RAISED)))).alias("left"),
            F.concat(state["found"], F.array(F.struct((bin_ - lower).alias("bin"), part.cast("long").alias("part")))).alias("found"))

    # one bin above the guess is looked at as well, as the logarithm is rounded
    start = F.struct(F.least(guess + 1, F.lit(_MOST)).alias("top"), raised.alias("left"), F.array().cast("array<struct<bin:int,part:bigint>>").alias("found"))
    finite = F.aggregate(F.sequence(F.lit(0), F.lit(4)), start, cut, lambda s: F.filter(s["found"], lambda x: x["part"] != 0))
    special = lambda b: F.array(F.struct(F.lit(b).alias("bin"), F.lit(1).cast("long").alias("part")))
    return (
        F.when(value.isNull() | (value == 0.0), F.array().cast("array<struct<bin:int,part:bigint>>")).when(F.isnan(value), special(_NAN))
        .when(value == float("inf"), special(_PLUS)).when(value == float("-inf"), special(_MINUS)).otherwise(finite))


def rounded(bin_sums: list[tuple[int, int]]) -> float:
    """The double nearest to the exact total."""
    said = dict(bin_sums)
    if _NAN in said or (_PLUS in said and _MINUS in said):
        return float("nan")
    if _PLUS in said or _MINUS in said:
        return float("inf") if _PLUS in said else float("-inf")
    total = sum(n << (32 * (b - _LEAST)) for b, n in said.items())
    try:
        return total / (1 << (-32 * _LEAST))
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def exact_double_sum(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """(keys, out): the exact sum of value per key, rounded once; null where every value is null."""
    rows = df.select(*[F.col(k) for k in keys], value.cast("double").alias("exact_value")).filter("exact_value is not null")
    parts = rows.select(*[F.col(k) for k in keys], F.explode_outer(bins(F.col("exact_value"))).alias("x"))
    sums = parts.groupBy(*[F.col(k) for k in keys], F.coalesce("x.bin", F.lit(0)).alias("bin")).agg(F.sum(F.coalesce("x.part", F.lit(0)).cast("decimal(38,0)")).alias("part"))
    grouped = sums.groupBy(*[F.col(k) for k in keys]).agg(F.collect_list(F.struct("bin", F.col("part").cast("string").alias("part"))).alias("bins"))  # a row for each 32-bit place at most

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [rounded([(x["bin"], int(x["part"])) for x in b]) for b in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], [*batch.schema.names[:-1], out])

    return grouped.mapInArrow(finish, grouped.select(*[F.col(k) for k in keys], F.lit(0.0).alias(out)).schema)
