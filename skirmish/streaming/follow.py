"""Following logs with Structured Streaming."""

from __future__ import annotations

import json
import os
import pickle
from collections.abc import Iterator, MutableMapping
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skirmish.functions.times import from_wall_seconds, wall_seconds
from skirmish.operators.parse import line_shape, parse_lines, split_lines
from skirmish.operators.roster import Fact
from skirmish.schema import Options
from skirmish.sources.tail import register
from skirmish.streaming.live import LiveLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REVISION = (
    "log_id string, enc_id int, revision int, start_s bigint, end_s bigint, zone string, active boolean, end_reason string, title string, "
    "total_damage bigint, top_fighter string, kills int, player_deaths int, crits int, coverage double, fighters string"
)
_NEEDED = ["log_id", "generation", "line_no", "sec", "outcome", "action", "attacker", "target", "owner_hint", "amount", "mechanic", "verb", "spell", "zone", "pet_tag", "pet_tag_owner"]


class StoredFacts(MutableMapping):
    """Facts about names in a map state: read when first asked for, changes written at the end of a batch."""

    def __init__(self, state) -> None:
        self.state = state
        self.read: dict[str, Fact | None] = {}
        self.changed: set[str] = set()

    def get(self, name, default=None):
        if name not in self.read:
            self.read[name] = Fact(*self.state.getValue((name,))) if self.state.containsKey((name,)) else None
        found = self.read[name]
        return default if found is None else found

    def __getitem__(self, name):
        found = self.get(name)
        if found is None:
            raise KeyError(name)
        return found

    def __setitem__(self, name, fact) -> None:
        self.read[name] = fact
        self.changed.add(name)

    def __delitem__(self, name) -> None:
        raise TypeError("facts are never forgotten")

    def __iter__(self):
        return iter({*(k[0] for k in self.state.keys()), *self.changed})

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def flush(self) -> None:
        """Write what changed."""
        for name in self.changed:
            self.state.updateValue((name,), tuple(self.read[name]))
        self.changed.clear()


class LogFollower(StatefulProcessor):
    """A `LiveLog` per log in the state store, its names as a map state; emits revisions, and closes quiet fights by timer."""

    def __init__(self, options: Options, tick_ms: int, marks: dict[str, list[int]] | None = None) -> None:
        self.options, self.tick_ms, self.marks = options, tick_ms, marks or {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("live", "blob binary")
        self.names = handle.getMapState("names", "name string", "player boolean, led boolean, proven boolean, owner string")

    def _live(self, log_id: str) -> LiveLog:
        facts = StoredFacts(self.names)
        if self.state.exists():
            live = pickle.loads(bytes(self.state.get()[0]))
            live.roster.facts = facts
            return live
        live = LiveLog(log_id, self.options, facts=facts)
        for at in self.marks.get(log_id, ()):
            live.add_split(at)
        return live

    def _out(self, live: LiveLog) -> Iterator[pd.DataFrame]:
        rows = live.revisions()
        live.roster.facts.flush()
        live.roster.facts = None  # has a place of its own
        self.state.update((pickle.dumps(live),))
        if rows:
            yield pd.DataFrame(rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        live = self._live(key[0])
        batch = pd.concat(list(rows)).sort_values(["generation", "line_no"], kind="stable")
        clean = batch.astype(object).where(batch.notna(), None)
        for row in clean.to_dict("records"):
            for c in ("sec", "amount"):
                row[c] = int(row[c]) if row[c] is not None else 0
            if row["outcome"] == "split":
                live.add_split(row["sec"])
            else:
                live.feed(row)
        if self.tick_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick_ms)
        yield from self._out(live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        live = self._live(key[0])
        if live.last_event is not None:
            # wall time since the last line stands for event time that passed in silence
            live.tick(live.last_event + max(self.options.idle_s, self.options.recovery_s) + 1)
        yield from self._out(live)

    def close(self) -> None:
        pass


def parsed_stream(lines: DataFrame) -> DataFrame:
    """Outcomes of a stream of ``log_id, line_no, raw`` with event seconds."""
    if "generation" not in lines.columns:
        lines = lines.withColumn("generation", F.lit(0))
    out = parse_lines(split_lines(lines))
    return out.withColumn("sec", wall_seconds("ts")).select(*_NEEDED)


def follow(lines: DataFrame, options: Options | None = None, splits: DataFrame | None = None, tick_ms: int = 0, marks: dict[str, list[int]] | None = None) -> DataFrame:
    """Revisions of encounters of a stream of lines, in update mode keyed by (log_id, enc_id).

    ``splits`` is an optional control stream ``log_id, ts``, ``marks`` holds the seconds (of :func:`wall_seconds`) of splits
    saved before. Lines of a replaced file come after those of the old one. With ``tick_ms`` a fight is closed by wall
    clock when its log has been silent that long. State per log is its fights and a map of its names; restart from a
    checkpoint continues where it stopped.
    """
    opt = options or Options()
    rows = parsed_stream(lines)
    if splits is not None:
        cuts = splits.select("log_id", F.lit(-1).alias("generation"), F.lit(0).alias("line_no"), wall_seconds("ts").alias("sec"), F.lit("split").alias("outcome"))
        rows = rows.unionByName(cuts, allowMissingColumns=True)
    mode = "processingTime" if tick_ms else "none"
    revisions = rows.groupBy("log_id").transformWithStateInPandas(LogFollower(opt, tick_ms, marks), REVISION, "update", mode)
    start, end = [from_wall_seconds(c).alias(n) for c, n in (("start_s", "start_ts"), ("end_s", "end_ts"))]
    return revisions.select("log_id", "enc_id", "revision", start, end, *[c.split()[0] for c in REVISION.split(", ")[5:]])


def follow_path(spark: SparkSession, path: str, options: Options | None = None, latest: bool = False, tick_ms: int = 0, marks: dict[str, list[int]] | None = None) -> DataFrame:
    """Follow all files of a glob."""
    register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    lines = spark.readStream.format("log_tail").option("path", path).option("startingOffset", "latest" if latest else "earliest").load()
    return follow(lines, options, tick_ms=tick_ms, marks=marks)


def windowed_damage(lines: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Damage per log, attacker and tumbling window of a line stream, with a watermark for late lines."""
    ev = parse_lines(split_lines(lines)).where("outcome = 'event' and action = 'damage' and attacker is not null")
    return (
        ev.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
        .groupBy("log_id", F.window("at", window), F.lower("attacker").alias("attacker"))
        .agg(F.sum("amount").alias("damage"), F.count(F.lit(1)).alias("hits"))
    )


def unparsed_examples(lines: DataFrame) -> DataFrame:
    """First line of each shape that looks like damage and no rule reads; a stream keeps the shapes seen as state."""
    bad = parse_lines(split_lines(lines)).where("outcome = 'unparsed'")
    return bad.select(line_shape(F.col("message")).alias("shape"), "log_id", "line_no", "raw").dropDuplicates(["shape"])


class ClosedOnce:
    """Batch function that shows each closed encounter once, with its fighters, as text or JSON."""

    def __init__(self, json_lines: bool = False, top: int = 6, show=print) -> None:
        self.json_lines, self.top, self.show = json_lines, top, show
        self.shown: set[tuple[str, int]] = set()

    def __call__(self, batch: DataFrame, number: int) -> None:
        # as many rows as encounters closed during one batch
        for r in batch.where("not active and end_reason <> 'dropped'").orderBy("log_id", "enc_id", "revision").toLocalIterator():
            if (r.log_id, r.enc_id) in self.shown:
                continue
            self.shown.add((r.log_id, r.enc_id))
            who = json.loads(r.fighters)[: self.top]
            if self.json_lines:
                self.show(json.dumps(dict(log_id=r.log_id, enc_id=r.enc_id, title=r.title, start=str(r.start_ts), end=str(r.end_ts), zone=r.zone, end_reason=r.end_reason, total_damage=r.total_damage, kills=r.kills, fighters=who), ensure_ascii=False))
            else:
                self.show(f"#{r.enc_id} {r.title} ({(r.end_ts - r.start_ts).total_seconds():.0f} s, {r.end_reason}) {r.total_damage}")
                for f in who:
                    self.show(f"  {f['fighter']} {f['damage']} ({f['share']:.1%}), {f['crits']} critical")


class UnparsedFile:
    """Batch function that appends the first raw line of each new shape to a text file; a file that cannot be written is no error."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        # :func:`unparsed_examples` gives one row per new shape
        rows = [r.raw for r in batch.orderBy("log_id", "line_no").select("raw").toLocalIterator()]
        try:
            if rows:
                os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
                with open(self.path, "a", encoding="utf-8") as f:
                    f.writelines(r + "\n" for r in rows)
        except OSError:
            pass


class LiveQuery:
    """Follow logs in the background and look at the latest state.

    Revisions are appended to ``folder`` by each micro-batch (one file set per batch, overwritten if a
    batch is repeated after a restart), so a snapshot is the newest revision per encounter. Splits
    are files in a control folder that the query also follows.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str, options: Options | None = None, latest: bool = False, tick_ms: int = 0) -> None:
        self.spark, self.path, self.folder = spark, path, folder.rstrip("/")
        self.options, self.latest, self.tick_ms = options or Options(), latest, tick_ms
        self.query = None

    def start(self, trigger: str = "500 milliseconds") -> LiveQuery:
        """Start or resume from the checkpoint in the folder."""
        register(self.spark)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        os.makedirs(f"{self.folder}/splits", exist_ok=True)
        lines = self.spark.readStream.format("log_tail").option("path", self.path).option("startingOffset", "latest" if self.latest else "earliest").load()
        splits = self.spark.readStream.schema("log_id string, ts timestamp_ntz").json(f"{self.folder}/splits")

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/revisions/batch={number}")

        writer = follow(lines, self.options, splits, self.tick_ms).writeStream.outputMode("update").foreachBatch(keep)
        self.query = writer.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime=trigger).start()
        return self

    def stop(self) -> None:
        """Stop; a later start continues."""
        if self.query is not None:
            self.query.stop()

    def force_split(self, log_id: str, at: datetime) -> None:
        """Cut the log's fight at a time; what follows is a new encounter."""
        name = f"{self.folder}/splits/{log_id}-{at:%Y%m%d%H%M%S}.json"
        with open(name + ".part", "w", encoding="utf-8") as f:
            f.write(json.dumps({"log_id": log_id, "ts": f"{at:%Y-%m-%d %H:%M:%S}"}))
        os.replace(name + ".part", name)

    def snapshot(self) -> DataFrame:
        """Newest revision of every encounter that was not dropped, newest encounter first."""
        if not os.path.isdir(f"{self.folder}/revisions"):
            return self.spark.createDataFrame([], "log_id string, enc_id int")
        rows = self.spark.read.parquet(f"{self.folder}/revisions")
        cols = [c for c in rows.columns if c not in ("log_id", "enc_id")]
        newest = rows.groupBy("log_id", "enc_id").agg(F.max(F.struct("batch", "revision", *[c for c in cols if c not in ("batch", "revision")])).alias("r"))
        return newest.select("log_id", "enc_id", "r.*").where("end_reason <> 'dropped'").drop("batch").orderBy(F.desc("start_ts"), F.desc("enc_id"))
