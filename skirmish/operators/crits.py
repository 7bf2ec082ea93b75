"""Critical markers joined to the hits they belong to."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.functions.times import wall_seconds
from skirmish.functions.arrow import grouped


class Marks:
    """Markers and hits waiting for each other, oldest first, per amount; what is older than ``window_s`` is gone."""

    def __init__(self, window_s: float) -> None:
        self.window_s = window_s
        self.waiting: dict = {}

    def _of(self, amount, now) -> tuple[deque, deque]:
        pair = self.waiting.setdefault(amount, (deque(), deque()))
        for queue in pair:
            while queue and now - queue[0][0] > self.window_s:
                queue.popleft()
        return pair

    @staticmethod
    def _fits(mark_spell, hit_spell, melee) -> bool:
        return (hit_spell or "").lower() == mark_spell.lower() if mark_spell else bool(melee)

    def mark(self, now, amount, spell):
        """The newest free hit that fits a marker, as it was handed in; None if the marker has to wait."""
        hits, marks = self._of(amount, now)
        for hit in reversed(hits):
            if self._fits(spell, hit[1], hit[2]):
                hits.remove(hit)
                return hit[3]
        marks.append((now, spell))
        return None

    def hit(self, now, amount, spell, melee, what) -> bool:
        """Whether a waiting marker takes a hit; else ``what`` waits for one."""
        hits, marks = self._of(amount, now)
        for mark in marks:
            if self._fits(mark[1], spell, melee):
                marks.remove(mark)
                return True
        hits.append((now, spell, melee, what))
        return False

    def forget(self, now) -> None:
        """Drop the amounts nothing waits for any more."""
        for amount in list(self.waiting):
            if not any(self._of(amount, now)):
                del self.waiting[amount]


def match_marks(rows: Iterable[tuple], window_s: float) -> list:
    """Line numbers of critical hits among ``(seconds, line_no, is_marker, spell, is_melee)`` in order.

    All rows share one amount. A marker takes the newest free hit of the last ``window_s``
    seconds, else waits; a hit is taken by the oldest waiting marker. A marker with a
    spell wants that spell (any case), one without wants a melee swing.
    """
    marks, taken = Marks(window_s), []
    for now, line, is_marker, spell, melee in rows:
        found = marks.mark(now, None, spell) if is_marker else line if marks.hit(now, None, spell, melee, line) else None
        if found is not None:
            taken.append(found)
    return taken


def critical_lines(outcomes: DataFrame, window_s: int = 2) -> DataFrame:
    """``log_id, line_no`` of the hits that a marker flags.

    Equal amounts are required, so (log, amount) groups are independent; a semi-join
    first drops the hits of amounts no marker names. Matching is greedy and sequential inside a
    group, in (ts, line) order; a group is cut at silences longer than the window, which no
    match crosses, so also the commonest amount of a huge log spreads over tasks.
    """
    marks = outcomes.where("outcome = 'crit'")
    hits = outcomes.where("outcome = 'event' and action = 'damage' and amount > 0").join(marks.select("log_id", "amount").distinct(), ["log_id", "amount"], "left_semi")
    sec = wall_seconds("ts")

    def side(df: DataFrame, marker: bool) -> DataFrame:
        return df.select("log_id", "amount", sec.alias("sec"), "line_no", F.lit(marker).alias("marker"), "spell", F.coalesce(F.col("mechanic").isin("melee", "melee_special"), F.lit(False)).alias("melee"))

    both = side(hits, False).unionByName(side(marks, True))
    day = F.expr("sec div 86400")
    order = Window.partitionBy("log_id", "amount", "day").orderBy("sec", "line_no")
    cut = (F.col("sec") - F.lag("sec").over(order) > window_s).cast("int")
    runs = both.withColumn("day", day).withColumn("cut", F.coalesce(cut, F.lit(0)))
    runs = runs.withColumn("run", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the first run of a day may go on from the day before: all first runs and last runs of touching days share a group
    ends = runs.groupBy("log_id", "amount", "day").agg(F.min("sec").alias("a"), F.max("sec").alias("b"), F.max("run").alias("last_run"))
    days = Window.partitionBy("log_id", "amount").orderBy("day")
    joined = ends.withColumn("new", F.coalesce((F.col("a") - F.lag("b").over(days) > window_s).cast("int"), F.lit(1)))
    offset = joined.select("log_id", "amount", "day", (F.sum(F.col("new") + F.col("last_run")).over(days.rowsBetween(Window.unboundedPreceding, 0)) - F.col("last_run")).alias("offset"))
    both = runs.join(offset, ["log_id", "amount", "day"]).withColumn("run", F.col("run") + F.col("offset"))
    out_type = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("line_no", T.IntegerType())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in grouped(batches, ["log_id", "amount", "run"]):
            cols = [t.column(c).to_pylist() for c in ("sec", "line_no", "marker", "spell", "melee")]
            logs = t.column("log_id")
            at, lines = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                found = match_marks(zip(*[c[s:e] for c in cols], strict=True), window_s)
                lines += found
                at += [s] * len(found)
            yield pa.RecordBatch.from_arrays([logs.take(pa.array(at, pa.int64())).combine_chunks(), pa.array(lines, pa.int32())], names=["log_id", "line_no"])

    return both.repartition("log_id", "amount", "run").sortWithinPartitions("log_id", "amount", "run", "sec", "line_no").mapInArrow(match, out_type)


def associate_crits(outcomes: DataFrame, window_s: int = 2) -> DataFrame:
    """Events with ``is_critical``; the other outcomes pass with false."""
    flagged = critical_lines(outcomes, window_s).withColumn("__crit", F.lit(True))
    return outcomes.join(flagged, ["log_id", "line_no"], "left").withColumn("is_critical", F.coalesce("__crit", F.lit(False))).drop("__crit")
