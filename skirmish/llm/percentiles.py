"""Exact percentiles per group by bisection of value intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.session import cut_lineage

BITS_PER_PASS = 12
SALTS = 16


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """``grp, v, n``: the state that days, logs or partitions are combined by.

    Two states are combined by ``unionByName`` and another ``merge_counts``.
    """
    return df.select(F.col(group).alias("grp"), F.col(value).cast("bigint").alias("v")).where("v is not null").groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*states: DataFrame) -> DataFrame:
    """Combine states of separate days or logs."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("grp", "v").agg(F.sum("n").alias("n"))


def exact_percentiles(counts: DataFrame, pcts: list[int], least: int = 1) -> DataFrame:
    """``grp, pct, value``: the value at rank ceil(pct * n / 100) of each group.

    ``counts`` is a state as of :func:`value_counts`. Groups with fewer than
    ``least`` values are left out; a null group is a group. Values may be
    negative. An empty state gives no rows.

    Every (group, percentile) keeps an interval of values that holds its target
    rank. A pass cuts all intervals at 2**BITS_PER_PASS - 1 equidistant midpoints,
    counts the rows between them (combined before the shuffle), and keeps the
    piece in which the target rank falls; rows below it are subtracted from the
    rank. Passes end when an interval holds one value: at most
    ceil(64 / BITS_PER_PASS) of them, fewer when the range of values is narrow,
    as read once from the whole state. Only rows inside a kept interval enter the
    next pass; they meet their interval by an equi-join on (group, interval,
    salt), the salt taken from the value, so the rows of one hot group spread.
    Windows run over the pieces of one interval, at most 2**BITS_PER_PASS rows.
    """
    counts = cut_lineage(counts)
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    low, high = (low, high) if low is not None else (0, 0)
    bits = max(1, (high - low).bit_length())
    shift = -(-bits // BITS_PER_PASS) * BITS_PER_PASS - BITS_PER_PASS
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    # shifting floors, also below zero, so intervals need no common origin and no difference can overflow
    base = counts.select("grp", "v", "n")

    # first pass: one interval for all percentiles of a group
    piece = F.shiftright("v", shift)
    cut = base.groupBy("grp", piece.alias("piece")).agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("grp")
    upto = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.select("grp", "piece", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total")).where(F.col("total") >= least)
    targets = F.array(*[F.struct(F.lit(p).alias("pct"), F.ceil(F.lit(p) * F.col("total") / 100).cast("bigint").alias("rank")) for p in pcts])
    inside = F.filter(targets, lambda x: (x["rank"] <= F.col("upto")) & (x["rank"] > F.col("upto") - F.col("n")))

    def lowered(kept, below):
        return F.transform(kept, lambda x: F.struct(x["pct"].alias("pct"), (x["rank"] - below).alias("rank")))

    spans = ranked.select("grp", "piece", lowered(inside, F.col("upto") - F.col("n")).alias("want")).where(F.size("want") > 0)
    while shift > 0:
        next_shift = shift - BITS_PER_PASS
        salted = spans.select("grp", "piece", "want", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
        rows = base.select("grp", F.shiftright("v", shift).alias("piece"), salt.alias("salt"), F.shiftright("v", next_shift).alias("sub"), "n").groupBy("grp", "piece", "salt", "sub").agg(F.sum("n").alias("n"))
        same = [rows["grp"].eqNullSafe(salted["grp"]), rows["piece"] == salted["piece"], rows["salt"] == salted["salt"]]
        hit = rows.join(salted, same).select(rows["grp"], rows["piece"], "want", "sub", "n")
        sub = hit.groupBy("grp", "piece", "sub").agg(F.sum("n").alias("n"), F.first("want").alias("want"))
        upto = Window.partitionBy("grp", "piece").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
        ranked = sub.select("grp", "sub", "n", "want", F.sum("n").over(upto).alias("upto"))
        inside = F.filter("want", lambda x: (x["rank"] <= F.col("upto")) & (x["rank"] > F.col("upto") - F.col("n")))
        spans = ranked.select("grp", F.col("sub").alias("piece"), lowered(inside, F.col("upto") - F.col("n")).alias("want")).where(F.size("want") > 0)
        shift = next_shift
    return spans.select("grp", F.col("piece").alias("value"), F.explode("want").alias("w")).select("grp", F.col("w.pct").alias("pct"), "value")
