"""Log files as tables: batch scan, identity, discovery, retro window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed format: eqlog_<Character>_<server>[.yyyymmdd-hhmmss[-n]].txt
_ARCHIVED = r"\.\d{8}-\d{6}(?:-\d+)?$"


def log_identity(file_name: Column) -> Column:
    """``Character_server`` of a log file name without path; an archive stamp does not count.

    A name that is not of the usual form gives its stem.
    """
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*[/\\]", ""), r"(?i)\.txt$", "")
    plain = F.regexp_replace(stem, _ARCHIVED, "")
    return F.when(plain.rlike(r"(?i)^eqlog_[^_]+"), F.regexp_replace(plain, r"(?i)^eqlog_", "")).otherwise(plain)


def character_of(identity: Column) -> Column:
    """The part before the first underscore."""
    return F.split(identity, "_").getItem(0)


def server_of(identity: Column) -> Column:
    """The part behind the first underscore, null without one."""
    return F.nullif(F.regexp_replace(identity, "^[^_]*_?", ""), F.lit(""))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``log_id, file_path, line_no, raw`` of all log files under ``path`` (glob or folder).

    Line numbers are exact and 1-based per file. A large file is read in many
    splits; lines are numbered inside their split and moved by the line counts of the
    splits before it, so no task sees a whole file.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    )
    inside = Window.partitionBy("file_path", "block").orderBy("at")
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = text.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("file_path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = text.withColumn("i", F.row_number().over(inside)).join(offsets, ["file_path", "block"])
    return numbered.select(log_identity(F.col("name")).alias("log_id"), "file_path", (F.col("offset") + F.col("i")).cast("int").alias("line_no"), "raw")


def discover_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``path, log_id, character, server, modified, bytes`` of the log files in a folder, newest first.

    File contents are not read; files with ``backup`` in the name are skipped.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "eqlog_*.txt").load(folder).select("path", "modificationTime", "length")
    name = F.regexp_replace("path", r"^.*/", "")
    return (
        files.where(~F.lower(name).contains("backup"))
        .select("path", log_identity(name).alias("log_id"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
        .withColumns({"character": character_of(F.col("log_id")), "server": server_of(F.col("log_id"))})
        .orderBy(F.desc("modified"))
    )


def retro_window(lines: DataFrame, minutes: int, now: Column) -> DataFrame:
    """Lines from the first one stamped within the last ``minutes`` on.

    Later lines stay even if their stamps are older. ``minutes`` below 0 keeps everything, 0 nothing.
    ``lines`` has ``log_id, line_no, ts``; ``now`` is a TIMESTAMP_NTZ expression without columns.
    """
    if minutes < 0:
        return lines
    if minutes == 0:
        return lines.limit(0)
    recent = lines.where(F.col("ts") >= now - F.expr(f"interval {minutes} minutes"))
    first = recent.groupBy("log_id").agg(F.min("line_no").alias("first_line"))
    return lines.join(first, "log_id").where("line_no >= first_line").drop("first_line")
