"""``python -m skirmish LOG [--table | --json | --csv DIR | --unparsed] [--idle S | --rest S] [--top N] [--markers PATH | --no-markers] [--follow]``.

Without ``--markers`` the saved markers of the log's character are applied.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 no arguments, 2 log not found."""
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        print(__doc__)
        return 1
    p = argparse.ArgumentParser(prog="skirmish")
    p.add_argument("log")
    for flag in ("--table", "--json", "--unparsed", "--follow", "--no-markers"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--csv")
    p.add_argument("--markers")
    p.add_argument("--idle", type=int)
    p.add_argument("--rest", type=int)
    p.add_argument("--top", type=int, default=6)
    a = p.parse_args(argv)
    if not os.path.exists(a.log):
        print(f"not found: {a.log}", file=sys.stderr)
        return 2
    from skirmish.operators.parse import parser_metrics, unparsed_shapes
    from skirmish.plans.pipeline import analyze
    from skirmish.schema import Options
    from skirmish.sources import export
    from skirmish.sources.logs import read_logs
    from skirmish.sources.markers import default_path, load_markers
    from skirmish.sources.tail import identity_of

    options = Options.from_rest_period(a.rest) if a.rest is not None else Options()
    if a.idle is not None and a.rest is None:
        options = options.with_idle(a.idle)
    spark = SparkSession.builder.appName("skirmish").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    saved = a.markers or default_path(identity_of(a.log))
    splits = None if a.no_markers or not (a.markers or os.path.exists(saved)) else load_markers(spark, saved).where("kind = 0")
    if a.follow:
        from skirmish.functions.times import wall_seconds
        from skirmish.streaming.follow import ClosedOnce, follow_path

        marks: dict[str, list[int]] = {}
        # a marker file is as small as its user's patience
        for r in splits.select("log_id", wall_seconds("ts").alias("at")).collect() if splits is not None else []:
            marks.setdefault(r.log_id, []).append(r["at"])
        closed = follow_path(spark, a.log, options, tick_ms=1000, marks=marks)
        closed.writeStream.outputMode("update").foreachBatch(ClosedOnce(a.json, a.top)).trigger(processingTime="1 second").start().awaitTermination()
        return 0
    lines = read_logs(spark, a.log)
    battle = analyze(lines, options, splits)
    events = battle.events.where("enc_id is not null")
    if a.unparsed:
        unparsed_shapes(battle.outcomes.withColumn("message", F.regexp_replace("raw", r"^\[[^\]]*\] ", ""))).orderBy(F.desc("n")).show(40, False)
    elif a.json:
        for r in parser_metrics(lines, battle.outcomes).toJSON().toLocalIterator():
            print(r)
        for r in export.report_json(events).orderBy("log_id", "enc_id").toLocalIterator():
            print(r.document)
    elif a.csv:
        for name, section in (("sources", export.damage_csv), ("defenses", export.defense_csv), ("mobs", export.mob_csv)):
            export.write_csv(section(events), os.path.join(a.csv, name))
    else:
        parser_metrics(lines, battle.outcomes).show(truncate=False)
        for r in export.encounter_table(battle.encounters, events, a.top).orderBy("log_id", "enc_id", "part", "rank_no").toLocalIterator():
            print("  " * min(r.part, 2) + r.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
