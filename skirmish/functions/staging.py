"""Keeping long expression chains apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added (or replaced), each evaluated exactly once per row.

    Stacked projections are merged by the optimizer, and filters are pushed below
    them, which copies a shared CASE cascade into every place that uses it. A
    one-element generator is a border neither crosses; it stays on the JVM.
    """
    keep = [c for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))).alias("__staged")
    return df.select(*keep, one).select(*keep, *[F.col("__staged").getField(n).alias(n) for n in columns])
