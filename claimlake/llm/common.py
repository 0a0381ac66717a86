"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.session import stored as stash  # noqa: F401  computed once, in the shared folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A word of the contracts that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where the result can be said in SQL."""
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Bits of the filter that keeps unwanted rows out of a shuffle: 1 MB, whatever the input.
FILTER_BITS = 1 << 23


def prefilter(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """df without most rows whose key is not in wanted: none that is goes. A join must follow."""
    row, bit, bucket, bits = fresh(df, "filter_key", "filter_bit", "filter_bucket", "filter_bits")
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS)) + 1
    held = wanted.select(place(wanted_key).alias("b")).groupBy(F.bitmap_bucket_number("b").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias(bits))
    rows = df.withColumn(row, place(key)).withColumn(bit, F.bitmap_bit_position(row)).withColumn(bucket, F.bitmap_bucket_number(row))
    byte = F.conv(F.hex(F.substring(bits, F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(held), bucket)  # FILTER_BITS / 32768 rows of 4 KB
    return joined.filter(F.getbit(byte.cast("long"), (F.col(bit) % 8).cast("int")) == 1).select(*[quoted(c) for c in df.columns])
