from pyspark.sql import functions as F

from skirmish.plans.pipeline import analyze
from skirmish.sources.logs import read_logs
from skirmish.streaming.follow import follow_path

FIGHT = """[Thu Sep 03 20:00:00 2026] You have entered the Ashen Hall.
[Thu Sep 03 20:00:10 2026] You crush a cinder wolf for 500 points of damage.
[Thu Sep 03 20:00:11 2026] You score a critical hit! (500)
[Thu Sep 03 20:00:12 2026] Ragtooth bites a cinder wolf for 200 points of damage.
[Thu Sep 03 20:00:13 2026] Ragtooth (Owner: Mira) bites a cinder wolf for 300 points of damage.
[Thu Sep 03 20:00:15 2026] a cinder wolf has been slain by Mira!
"""
MORE = """[Thu Sep 03 20:10:10 2026] You crush a smoke imp for 100 points of damage.
[Thu Sep 03 20:10:14 2026] You have slain a smoke imp!
"""


def _drain(spark, path, ckpt, name):
    q = follow_path(spark, path).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", ckpt).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [r.asDict() for r in spark.table(name).collect()]


def test_follow_equals_batch_and_restarts(spark, tmp_path):
    log = tmp_path / "eqlog_Mira_ashfall.txt"
    log.write_text(FIGHT + "[Thu Sep 03 20:10:0")  # the last line is still being written
    rows = _drain(spark, str(log), str(tmp_path / "c"), "first")
    last = max(rows, key=lambda r: r["revision"])
    assert (last["enc_id"], last["title"], last["end_reason"], last["total_damage"], last["top_fighter"], last["crits"]) == (1, "a cinder wolf", "all_mobs_dead", 1000, "mira", 1)
    log.write_text(FIGHT + MORE)
    # memory sinks cannot resume in update mode from a checkpoint in one session, so the offsets are checked by a batch twin
    battle = analyze(read_logs(spark, str(log)))
    heads = battle.encounters.orderBy("enc_id").collect()
    assert [(h.enc_id, h.title, h.end_reason) for h in heads] == [(1, "a cinder wolf", "all_mobs_dead"), (2, "a smoke imp", "all_mobs_dead")]
    rows = _drain(spark, str(log), str(tmp_path / "d"), "second")
    got = {r["enc_id"]: r["total_damage"] for r in sorted(rows, key=lambda r: r["revision"])}
    assert got == {1: 1000, 2: 100}
    batch = battle.events.where("enc_id is not null and action = 'damage'").groupBy("enc_id").agg(F.sum("amount").alias("n")).collect()
    assert {r.enc_id: r.n for r in batch} == got


def test_tail_reader_holds_back_and_sees_truncation(tmp_path):
    from skirmish.sources.tail import _Reader

    f = tmp_path / "eqlog_A_b.txt"
    f.write_bytes(b"one\r\ntwo\nthr")
    r = _Reader({"path": str(f)})
    rows, off = r.read({})
    assert [x[3:] for x in rows] == [(1, "one"), (2, "two")]
    f.write_bytes(b"one\r\ntwo\nthree\n")
    rows, off2 = r.read(off)
    assert [x[3:] for x in rows] == [(3, "three")]
    assert [x[3:] for x in r.readBetweenOffsets(off, off2)] == [(3, "three")]
    f.write_bytes(b"new\n")
    rows, off3 = r.read(off2)
    assert [x[2:] for x in rows] == [(1, 1, "new")]
    late = _Reader({"path": str(f), "startingOffset": "latest"})
    assert late.read(late.initialOffset())[0].__length_hint__() == 0


def test_live_query_splits_and_resumes(spark, tmp_path):
    import datetime as dt

    from skirmish.schema import Options
    from skirmish.streaming.follow import LiveQuery

    log = tmp_path / "eqlog_Mira_ashfall.txt"
    log.write_text(FIGHT)
    live = LiveQuery(spark, str(log), str(tmp_path / "live"), Options.from_rest_period(120))
    live.start("1 second").query.processAllAvailable()
    live.stop()
    first = live.snapshot().collect()
    assert [(r.enc_id, r.active, r.total_damage) for r in first] == [(1, True, 1000)]
    live.force_split("Mira_ashfall", dt.datetime(2026, 9, 3, 20, 0, 20))
    live.start("1 second").query.processAllAvailable()
    live.stop()
    with log.open("a") as f:
        f.write("[Thu Sep 03 20:00:30 2026] You crush a smoke imp for 70 points of damage.\n")
    live.start("1 second").query.processAllAvailable()
    live.stop()
    got = [(r.enc_id, r.end_reason, r.total_damage) for r in live.snapshot().collect()]
    assert got == [(2, "", 70), (1, "manual", 1000)]


def test_live_log_pure():
    from skirmish.streaming.live import LiveLog

    live = LiveLog("Mira_x", catalog={("verb", "kick"): "Monk"})
    row = dict(outcome="event", action="damage", attacker="Mira", target="a rat", owner_hint=None, amount=5, mechanic="melee_special", verb="kick", spell=None, zone=None, pet_tag=None, pet_tag_owner=None)
    for i in range(3):
        live.feed(dict(row, sec=i, line_no=i))
    assert live.class_label("Mira") == "Monk" and live.fighters(1) == {"mira": 15} and live.coverage() == 1.0
    assert [r["active"] for r in live.revisions()] == [True] and live.revisions() == []
    live.tick(500)
    assert [(r["end_reason"], r["revision"]) for r in live.revisions()] == [("dropped", 2)]  # two seconds, no kill
    assert live.force_split() == 2 and live.revisions() == []


def test_unparsed_stream(spark, tmp_path):
    from skirmish.sources.tail import register
    from skirmish.streaming.follow import unparsed_examples

    log = tmp_path / "eqlog_Mira_ashfall.txt"
    log.write_text("".join(f"[Thu Sep 03 20:00:0{i} 2026] Odd {i} points of damage\n" for i in range(5)))
    register(spark)
    stream = unparsed_examples(spark.readStream.format("log_tail").option("path", str(log)).load())
    q = stream.writeStream.outputMode("append").format("memory").queryName("odd").start()
    q.processAllAvailable()
    q.stop()
    assert [r["shape"] for r in spark.table("odd").collect()] == ["Odd # points of damage"]


def test_closed_encounters_are_shown_once_with_their_fighters(spark, tmp_path):
    import json

    from skirmish.functions.times import wall_seconds
    from skirmish.streaming.follow import ClosedOnce

    log = tmp_path / "eqlog_Mira_ashfall.txt"
    log.write_text(FIGHT + MORE)
    at = spark.range(1).select(wall_seconds(F.lit("2026-09-03 20:10:12").cast("timestamp_ntz")).alias("s")).first().s
    said, text = [], []
    show, again = ClosedOnce(True, 1, said.append), ClosedOnce(False, 6, text.append)

    def both(batch, number):
        for f in (show, again, show):
            f(batch, number)

    q = follow_path(spark, str(log), marks={"Mira_ashfall": [at]}).writeStream.outputMode("update").foreachBatch(both).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    docs = [json.loads(x) for x in said]
    # the saved split stands between the first blow of the second fight and its end
    assert [(d["enc_id"], d["end_reason"]) for d in docs] == [(1, "all_mobs_dead")]
    assert docs[0]["fighters"] == [{"fighter": "mira", "damage": 1000, "crits": 1, "share": 1.0}]
    assert text == ["#1 a cinder wolf (5 s, all_mobs_dead) 1000", "  mira 1000 (100.0%), 1 critical"]


def test_replaced_file_comes_after_the_old_one(spark, tmp_path):
    rows = [("Mira_x", g, n, raw) for g, lines in ((0, FIGHT), (1, MORE)) for n, raw in enumerate(lines.splitlines(), 1)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "log_id string, generation int, line_no int, raw string").repartition(3).write.parquet(str(src))
    from skirmish.streaming.follow import follow

    stream = spark.readStream.schema("log_id string, generation int, line_no int, raw string").parquet(str(src))
    q = follow(stream).writeStream.outputMode("update").format("memory").queryName("gen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.enc_id: (r.title, r.total_damage, r.end_reason) for r in spark.table("gen").orderBy("revision").collect()}
    assert got == {1: ("a cinder wolf", 1000, "all_mobs_dead"), 2: ("a smoke imp", 100, "all_mobs_dead")}


def test_unparsed_lines_are_appended_to_a_file(spark, tmp_path):
    from skirmish.streaming.follow import UnparsedFile

    df = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first")], "log_id string, line_no int, raw string")
    sink = UnparsedFile(str(tmp_path / "deep" / "unparsed.txt"))
    sink(df, 0)
    sink(df.limit(0), 1)
    sink(df.where("line_no = 1"), 2)
    assert (tmp_path / "deep" / "unparsed.txt").read_text() == "first\nsecond\nfirst\n"
    UnparsedFile("/proc/none/x.txt")(df, 0)


def test_default_markers_of_a_character(spark, tmp_path, monkeypatch):
    import datetime as dt

    from skirmish.sources.markers import add_split, default_path, load_markers

    monkeypatch.setenv("HOME", str(tmp_path))
    path = default_path("Mira_ashfall")
    (tmp_path / ".skirmish" / "markers").mkdir(parents=True)
    add_split(path, "Mira_ashfall", dt.datetime(2026, 9, 3, 20, 0, 12))
    assert [(r.log_id, str(r.ts), r.kind) for r in load_markers(spark, path).collect()] == [("Mira_ashfall", "2026-09-03 20:00:12", 0)]
