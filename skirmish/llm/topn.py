"""Top N items of every group with bounded, mergeable heaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BROKEN = (T.FloatType, T.DoubleType, T.DecimalType)


def least_of(df: DataFrame, value: Column, n: int) -> Column:
    """Aggregate: the ``n`` least of ``value`` in order.

    Spark's own bounded priority queue, which has a partial step that keeps at most ``n`` values per
    group and a merge step; it has no Python name, so it is fetched from the JVM.
    """
    jvm = df.sparkSession._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    heap = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.CollectTopK(bridge.expression(value._jc), n, True)
    return Column(bridge.column(heap.toAggregateExpression()))


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, rank: str = "rank_no") -> DataFrame:
    """The ``n`` rows of highest ``score`` in each group, ranked from 1.

    Equal scores rank by ``ties`` (strings) in ascending byte order, null as the
    empty string; rows equal in all of these are interchangeable and each takes
    a rank. Rows with a null or NaN score are not ranked. Null group keys form a group. ``score`` is a number.

    Every task keeps one heap of at most ``n`` rows per group, and what
    reaches the shuffle is at most ``n`` rows per group and task, however large a
    group is. Heaps of a group are merged by the same rule after the shuffle; no Python is run.
    Result: ``groups``, ``score``, ``ties`` and ``rank``; other columns are dropped.
    """
    kind = df.schema[score].dataType
    if not isinstance(kind, _WHOLE + _BROKEN):
        raise TypeError(f"{score} is no number")
    whole = isinstance(kind, _WHOLE)

    def turned(c: Column) -> Column:
        """Descending order as ascending; its own inverse, without overflow."""
        return F.bitwise_not(c) if whole else -c

    src = df.where(F.col(score).isNotNull())
    if isinstance(kind, T.DoubleType | T.FloatType):
        src = src.where(~F.isnan(score))
    item = F.struct(
        turned(F.col(score)).alias("s"),
        *[F.coalesce(F.col(t), F.lit("")).alias(f"t{i}") for i, t in enumerate(ties)],
        *[F.col(t).isNull().alias(f"n{i}") for i, t in enumerate(ties)],
    )
    best = src.select(*groups, item.alias("__item")).groupBy(*groups).agg(least_of(df, F.col("__item"), n).alias("__best"))
    rows = best.select(*groups, F.posexplode("__best").alias("__at", "__item"))
    restored = [F.when(~F.col(f"__item.n{i}"), F.col(f"__item.t{i}")).alias(t) for i, t in enumerate(ties)]
    return rows.select(*groups, turned(F.col("__item.s")).cast(kind).alias(score), *restored, (F.col("__at") + 1).cast("int").alias(rank))
