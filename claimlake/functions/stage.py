"""Plan stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sealed(df: DataFrame) -> DataFrame:
    """End a stage: later filters read this stage's columns instead of repeating its expressions.

    The optimizer copies a computed column into every filter above it. For long JSON expressions that
    costs more than it saves; a one-row generator keeps the columns computed once.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
