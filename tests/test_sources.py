import datetime as dt

from pyspark.sql import functions as F

from skirmish.__main__ import main
from skirmish.operators.parse import split_lines
from skirmish.plans.pipeline import analyze
from skirmish.sources.archive import archive_log
from skirmish.sources.export import damage_csv, encounter_table, report_json
from skirmish.sources.logs import discover_logs, log_identity, read_logs, retro_window, server_of
from skirmish.sources.markers import add_split, load_markers, remove_split

LINES = ["[Thu Sep 03 20:00:00 2026] You crush a rat for 5 points of damage.", "[Thu Sep 03 20:00:04 2026] You have slain a rat!", "[Thu Sep 03 21:00:00 2026] late", "[Thu Sep 03 19:00:00 2026] older"]


def test_line_numbers_survive_many_splits(spark, tmp_path):
    f = tmp_path / "eqlog_Mira_ash.fall.txt"
    f.write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_logs(spark, str(tmp_path)).cache()
        assert df.rdd.getNumPartitions() >= 1 and df.where(F.col("raw") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
        assert df.count() == 2000 and df.first().log_id == "Mira_ash.fall"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_identity_and_discovery(spark, tmp_path):
    names = ["eqlog_Mira_ashfall.txt", "/x/eqlog_Mira_ash_fall.20260903-200000-1.txt", "eqlog_Mira_x.20260903-200000.txt", "notes.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(log_identity(F.col("n")), server_of(log_identity(F.col("n")))).collect()]
    assert got == [("Mira_ashfall", "ashfall"), ("Mira_ash_fall", "ash_fall"), ("Mira_x", "x"), ("notes", None)]
    for n in ("eqlog_A_b.txt", "eqlog_A_b_backup.txt", "other.txt"):
        (tmp_path / n).write_text("x")
    assert [(r.character, r.bytes) for r in discover_logs(spark, str(tmp_path)).collect()] == [("A", 1)]


def test_retro_window_is_a_prefix_skip(spark):
    df = split_lines(spark.createDataFrame([("A_b", i, r) for i, r in enumerate(LINES)], "log_id string, line_no int, raw string"))
    now = F.lit("2026-09-03 21:10:00").cast("timestamp_ntz")
    assert sorted(r.line_no for r in retro_window(df, 30, now).collect()) == [2, 3]
    assert retro_window(df, -1, now).count() == 4 and retro_window(df, 0, now).count() == 0


def test_markers(spark, tmp_path):
    f = str(tmp_path / "m.json")
    at = dt.datetime(2026, 9, 3, 20, 0, 0)
    for t in (at, at, at - dt.timedelta(seconds=9)):
        add_split(f, "Mira_x", t)
    got = [(r.log_id, str(r.ts), r.kind) for r in load_markers(spark, f).orderBy("ts").collect()]
    assert got == [("Mira_x", "2026-09-03 19:59:51", 0), ("Mira_x", "2026-09-03 20:00:00", 0)]
    assert remove_split(f, "Mira_x", at + dt.timedelta(milliseconds=400)) and not remove_split(f, "Mira_x", at)
    (tmp_path / "broken.json").write_text("{")
    assert load_markers(spark, str(tmp_path / "broken.json")).count() == 0 and load_markers(spark, str(tmp_path / "none.json")).count() == 0


def test_archive(tmp_path):
    f = tmp_path / "eqlog_A_b.txt"
    f.write_text("x" * 10)
    assert archive_log(str(f), 11) == (None, None)
    new, err = archive_log(str(f), 10, dt.datetime(2026, 9, 3, 20, 0, 0))
    assert err is None and new.endswith("eqlog_A_b.20260903-200000.txt")
    assert archive_log(str(f), 1)[0] is None and archive_log(str(f), 1)[1]


def test_exports(spark):
    b = analyze(spark.createDataFrame([("A_b", i, r) for i, r in enumerate(LINES, 1)], "log_id string, line_no int, raw string"))
    ev = b.events.where("enc_id is not null")
    doc = report_json(ev).first().document
    assert '"fighter":"A"' in doc and '"mob":"a rat"' in doc
    rows = [(r.metric, r.category, r.source, r.total, r.average) for r in damage_csv(ev).orderBy(F.desc("category")).collect()]
    assert rows == [("damage_done", "TOTAL", "", 5, ""), ("damage_done", "Melee", "crush", 5, "5")]
    assert any("a rat" in r.line for r in encounter_table(b.encounters, ev).collect())


def test_command_line_exit_codes(capsys):
    assert main([]) == 1 and main(["/no/such/log"]) == 2
