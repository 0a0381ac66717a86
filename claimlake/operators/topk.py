"""Bounded samples, pages and capped lists. Each limit here is the reported feature itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.session import stored

# Evidence rows per failed check, list page sizes, comparison highlights, corpus patterns, evidence per rule.
SAMPLE_ROWS = 3
PAGE_DEFAULT, PAGE_MAX = 100, 500
HIGHLIGHTS = 20
TOP_PATTERNS = 50
EVIDENCE_ROWS = 50


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], n: int, out: str = "place") -> DataFrame:
    """First n rows per key with their 1-based place. Spark keeps n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def sample_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The evidence rows of failed checks, in a total order."""
    return ranked(df, keys, order, SAMPLE_ROWS)


def page(df: DataFrame, order: list[Column | str], limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page of a sorted list; the caller shows `total` and `next_offset` beside it. The order must be total.

    Behind an offset, rows are dealt to ranges of the order and written once; the ranges are counted, and only those that the page
    lies in are read again and sorted, so no task sorts the rows before it.
    """
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {PAGE_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if offset == 0:
        return df.orderBy(*order).limit(limit)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, *order).withColumn("page_range", F.spark_partition_id()))
    counts = dict(dealt.groupBy("page_range").agg(F.count(F.lit(1))).collect())  # a row for each range
    before, wanted, first = 0, [], 0
    for k in sorted(counts):
        if before < offset + limit and before + counts[k] > offset:
            first = first if wanted else before
            wanted.append(k)
        before += counts[k]
    return dealt.filter(F.col("page_range").isin(wanted)).drop("page_range").orderBy(*order).offset(offset - first if wanted else 0).limit(limit)


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None = None, limit: int = PAGE_DEFAULT) -> DataFrame:
    """The page behind a row, by the values it has in `order`: (column, descending). Only rows behind it are sorted, however deep.

    The order must be total; nulls stand where Spark puts them, first ascending and last descending.
    """
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {PAGE_MAX}")
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, after, strict=True):
            c, v = F.col(name), F.lit(value)
            if value is None:
                later = F.lit(False) if descending else c.isNotNull()
            else:
                later = (c < v) | c.isNull() if descending else c > v
            behind = behind | (same & F.coalesce(later, F.lit(False)))
            same = same & c.eqNullSafe(v)
        df = df.filter(behind)
    return df.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, d in order]).limit(limit)


def page_info(df: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """total rows and the next offset, null on the last page."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    end = F.lit(offset + limit)
    return total.withColumn("next_offset", F.when(end < F.col("total"), end))
