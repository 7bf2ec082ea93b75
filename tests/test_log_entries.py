from skirmish.operators import log_entries as le
from skirmish.operators.log_entries import clean_line, log_entries

GAME = ["stray", "[Mon Mar 04 01:00:00 2019] You hit a rat.", "", "  indented", "[Mon Mar 05 01:00:00 2019] wrong weekday", "[Sat Feb 30 01:00:00 2019] no such day", "[Mon Mar 04 01:00:02 2019] done\r"]
APP = [
    "﻿2019-03-04 01:00:00,123 WARN  [main] disk - low",
    "Kiln.Fault: boom",
    "   at Kiln.Run()",
    "> 2019-03-04 01:00:05,000 INFO [x] disk - quoted",
    "\x1b[31m2019-03-04 01:00:09,500 FATAL [pool-1] net.sync - gone\x1b[0m",
    "time=2019-03-04T01:00:10Z component=zone level=warning msg=\"x\"",
    "2019-03-04 25:00:09,500 INFO [pool-1] net.sync - bad hour",
    "Mar  4 01:00:11 host patcher[12]: not written by this file's programs",
]
SYS = ["Mar  4 01:00:11 host patcher[12]: started", "Mar  4 01:00:12 host patcher[12]: "]


def _lines(spark, files):
    rows = [(f"log{i}", path, n, text) for i, (path, texts) in enumerate(files.items()) for n, text in enumerate(texts, 1)]
    return rows, "log_id string, file_path string, line_no int, raw string"


def test_layouts_fallbacks_and_messages(spark, monkeypatch):
    monkeypatch.setattr(le, "LINES_PER_CHUNK", 3)
    many = APP + ["2019-03-04 01:01:00,000 INFO [main] disk - fine", "time=2019-03-04T01:02:10Z level=info component=zone msg=\"\""] * 60
    rows, schema = _lines(spark, {"/logs/game/eqlog_A_b.txt": GAME, "/logs/h/2019/app.log": many, "/logs/h/2018/sys.log": SYS})
    df = spark.createDataFrame(rows + rows[:5], schema).repartition(4)
    got = {(r.log_id, r.first_line): (r.last_line, str(r.entry_ts), r.log_level, r.component, r.message) for r in log_entries(df).collect()}
    assert got["log0", 2] == (6, "2019-03-04 01:00:00", "", "", "\n".join(GAME[1:6]))
    assert got["log0", 7] == (7, "2019-03-04 01:00:02", "", "", GAME[6].rstrip("\r"))
    assert got["log1", 1][:4] == (4, "2019-03-04 01:00:00", "warn", "disk")
    assert got["log1", 5][:4] == (5, "2019-03-04 01:00:09", "fatal", "net.sync")
    assert got["log1", 6][:4] == (8, "2019-03-04 01:00:10", "warn", "zone")
    assert got["log2", 1][:4] == (1, "2018-03-04 01:00:11", "", "patcher")
    assert len(got) == 2 + 3 + 120 + 2
    assert {(r.log_id, r.first_line, r.last_line) for r in log_entries(df, with_message=False).collect()} == {(k[0], k[1], v[0]) for k, v in got.items()}


def test_position_counts_of_a_file(spark):
    rows, schema = _lines(spark, {"/logs/h/2019/a.log": APP})
    got = {(r.form, r.pattern or r.key): (r.n, r.stamps, r.levels, r.names) for r in le.position_counts(le.read_heads(spark.createDataFrame(rows, schema))).collect()}
    assert got == {
        ("plain", f"{le.STAMP} L [ T ] W - W"): (1, 0, 0, 0), ("plain", f"{le.STAMP} L [ T ] X - W"): (1, 0, 0, 0), ("plain", f"{le.STAMP} W W [ N ] : W W"): (1, 0, 0, 0),
        ("pairs", "time"): (1, 1, 0, 0), ("pairs", "component"): (1, 0, 0, 1), ("pairs", "level"): (1, 0, 1, 0), ("pairs", "msg"): (1, 0, 0, 1),
    }


def test_templates_follow_agreement():
    S = le.STAMP
    many = {f"{S} W W [ N ] : W W": 70, f"{S} W W : L W": 25, f"{S} W W [ N ] : W W :": 5}
    assert le.templates(many) == {f"{S} W W [ N ] : W W": (7, None, 2), f"{S} W W : L W": (5, 4, 2), f"{S} W W [ N ] : W W :": (7, None, 2)}
    odd = {f"{S} [ L ] < W > W": 95, f"{S} [ W ] < W > W W": 1, f"{S} W W": 1}
    assert le.templates(odd) == {f"{S} [ L ] < W > W": (7, 2, 5), f"{S} [ W ] < W > W W": (7, 2, 5), f"{S} W W": (1, None, None)}
    assert le.templates({f"L : X : {S} : W W": 9}) == {f"L : X : {S} : W W": (6, 0, 2)}
    assert le.templates({f"{S} L X W": 9, f"{S} L X X": 5}) == {f"{S} L X W": (3, 1, 2), f"{S} L X X": (3, 1, 2)}
    assert le.templates({f"{S} W : L W W": 9, f"{S} X : L": 5}) == {f"{S} W : L W W": (4, 3, 1), f"{S} X : L": (4, 3, 1)}
    assert le.templates({f"{S} L W W": 9, f"{S} L": 5}) == {f"{S} L W W": (2, 1, None), f"{S} L": (2, 1, None)}


def test_edges(spark):
    schema = "log_id string, file_path string, line_no int, raw string, chunk int"
    assert log_entries(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, "p", 1, "x", 1), ("a", None, None, "x", 1), ("a", None, 1, None, 1), ("a", None, 2, "y" * 100_000, 1)], schema)
    assert log_entries(odd).count() == 0
    one = spark.createDataFrame([("a", "p", 1, "1552268662365 D/Pets(  12): hello")], "log_id string, file_path string, line_no int, raw string")
    r = log_entries(one).first()
    assert (str(r.entry_ts), r.log_level, r.component) == ("2019-03-11 01:44:22", "debug", "Pets")
    assert one.select(clean_line(one.raw)).first()[0].endswith("hello")


def test_every_line_of_a_layout_in_use_opens_an_entry(spark):
    long_entries = [x for i in range(30) for x in [f"2019-03-04 01:00:{i:02d},000 INFO [main] disk - x", *["  at y"] * 150]]
    rare = ["2019-03-04 01:00:00,000 INFO [main] disk - x"] * 3000 + ["time=2019-03-04T01:00:10Z component=zone level=info msg=x"] * 25
    days = [f"Mar  9 01:00:{i % 60:02d} host patcher[12]: x" for i in range(300)] + ["Mar 10 01:00:00 host patcher[12]: x"] * 2
    months = ["INFO:disk:28-Feb-2019 01:00:00: x"] * 300 + ["INFO:disk:01-Mar-2019 01:00:00: x"] * 2
    rows, schema = _lines(spark, {"/logs/h/2019/a.log": long_entries, "/logs/h/2019/b.log": rare, "/logs/h/2019/c.log": days, "/logs/h/2019/d.log": months})
    out = log_entries(spark.createDataFrame(rows, schema), with_message=False)
    assert {r.log_id: r["count"] for r in out.groupBy("log_id").count().collect()} == {"log0": 30, "log1": 3025, "log2": 302, "log3": 302}


def test_json_heads_with_a_late_time_key(spark):
    context = " ".join(f"word{i}" for i in range(60))
    late = ['{"message":"%s %d","level":"warn","logger":"net","ts":"2019-03-04T01:00:%02dZ"}' % (context, i, i) for i in range(12)]
    mixed = ['{"id":%d,"code":"%d","level":"info","logger":"net","ts":"2019-03-04T01:00:%02dZ"}' % (10**i, i, i) for i in range(10)] + ["  at y"] * 2000
    rows, schema = _lines(spark, {"/logs/h/2019/a.log": late, "/logs/h/2019/b.log": mixed})
    got = log_entries(spark.createDataFrame(rows, schema), with_message=False).collect()
    assert sorted((r.log_id, r.first_line) for r in got) == [("log0", i + 1) for i in range(12)] + [("log1", i + 1) for i in range(10)]
    assert {(r.log_level, r.component) for r in got if r.log_id == "log0"} == {("warn", "net")}


def test_layouts_outside_the_notations_are_mined(spark):
    slashes = [x for i in range(30) for x in (f"2019/03/04 01:00:{i:02d} {['INFO', 'WARN'][i % 2]} disk: low {i}", "  at y")]
    web = [f"[04/Mar/2019:01:00:{i:02d} +0000] [web{i % 3}] error GET /x {i}" for i in range(30)]
    rows, schema = _lines(spark, {"/logs/h/2019/a.log": slashes, "/logs/h/2019/b.log": web, "/logs/h/2019/c.log": APP[:3] + [APP[5]]})
    got = {(r.log_id, r.first_line): (str(r.entry_ts), r.log_level, r.component, r.message) for r in log_entries(spark.createDataFrame(rows, schema), cut_head=True).collect()}
    assert len(got) == 30 + 30 + 2
    assert got["log0", 3] == ("2019-03-04 01:00:01", "warn", "disk", "low 1\n  at y")
    assert got["log1", 5] == ("2019-03-04 01:00:04", "error", "web1", "GET /x 4")
    assert got["log2", 1] == ("2019-03-04 01:00:00", "warn", "disk", "low\nKiln.Fault: boom\n   at Kiln.Run()")
    assert got["log2", 4][3] == "x"


def test_messages_of_key_value_lines_lose_nothing(spark):
    line = '{"ts":"2019-03-04T01:00:00Z","level":"info","logger":"net","message":"say \\"a\\""%s}'
    head = "time=2019-03-04T01:00:10Z component=zone level=info "
    rows, schema = _lines(spark, {"/logs/h/2019/a.log": [line % "", line % ',"took":3', head + 'msg="say \\"a\\""', head + 'msg="x" took=3']})
    got = [r.message for r in log_entries(spark.createDataFrame(rows, schema), cut_head=True).orderBy("first_line").collect()]
    assert got == ['say "a"', line % ',"took":3', 'say "a"', 'msg="x" took=3']


def test_probes_of_layouts(spark):
    """Padded days over midnight, long entries, digits in components, long first fields, layouts seen nowhere else."""
    padded = [f"[Sat Mar  9 23:59:{i:02d} 2019] x" for i in range(5)] + [f"[Sun Mar 10 00:{i // 60:02d}:{i % 60:02d} 2019] x" for i in range(1000)]
    longs = [x for i in range(20) for x in [f"[Sat Mar 09 23:59:{i:02d} 2019] x", *["  at y"] * 150]]
    digits = [f"INFO:disk{i}:09-Mar-2019 01:{i // 60:02d}:{i % 60:02d}: x" for i in range(1000)]
    first = ['{"message":"%s","level":"warn","logger":"net","ts":"2019-03-04T01:00:%02dZ"}' % ("long " * 50, i % 60) for i in range(100)]
    slash = [f"2024/02/09 23:59:{i % 60:02d} {['INFO', 'WARN'][i % 2]} db.pool took {i} ms" for i in range(100)]
    access = [f'10.0.0.{i} - - [04/Mar/2019:01:00:{i % 60:02d} +0000] "GET / HTTP/1.1" 200 {i}' for i in range(50)]
    spark_style = [f"19/03/04 01:00:{i % 60:02d} {['INFO', 'WARN'][i % 2]} DAGScheduler: job {i}" for i in range(50)]
    rows, schema = _lines(spark, {f"/logs/h/2019/{i}.log": t for i, t in enumerate((padded, longs, digits, first, slash, access, spark_style))})
    got = log_entries(spark.createDataFrame(rows, schema), with_message=False).collect()
    counts = {}
    for r in got:
        counts[r.log_id] = counts.get(r.log_id, 0) + 1
    assert counts == {"log0": 1005, "log1": 20, "log2": 1000, "log3": 100, "log4": 100, "log5": 50, "log6": 50}
    fields = {(r.log_id, r.first_line): (r.log_level, r.component) for r in got}
    assert fields["log2", 8] == ("info", "disk7") and fields["log3", 1] == ("warn", "net") and fields["log4", 2] == ("warn", "db.pool")
    assert fields["log5", 1] == ("", "") or fields["log5", 1][0] == ""
    assert fields["log6", 2] == ("warn", "DAGScheduler")


def test_control_characters_cost_no_line(spark):
    odd = ["2019-03-04 01:00:00,000 INFO [main] disk - a\x01b\x02c", "2019-03-04 01:00:01,000 INFO [main] disk - plain"]
    rows, schema = _lines(spark, {"/logs/h/2019/a.log": odd})
    got = log_entries(spark.createDataFrame(rows, schema), cut_head=True).orderBy("first_line").collect()
    assert [(r.component, r.message) for r in got] == [("disk", "a\x01b\x02c"), ("disk", "plain")]
