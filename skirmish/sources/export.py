"""Reports as JSON, CSV and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.plans import report


def _nested(buckets: DataFrame, keys: list[str], name: str, fields: list[str]) -> DataFrame:
    """Buckets of a key as one array, largest total first."""
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("_o"), *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return buckets.groupBy(*keys).agg(order.alias(name))


def report_json(events: DataFrame, by: list[str] = report.ENCOUNTER) -> DataFrame:
    """``by, document``: one nested JSON document per report (fighters with sources, defenses, monsters)."""
    given = report.credits(events, by)
    who = report.fighters(given, by)
    fields = ["metric", "category", "source", "pet", "total", "hits", "crits", "min_hit", "max_hit", "average"]
    src = _nested(report.sources(given, by), [*by, "fighter_key"], "sources", fields)
    shown = ["fighter", "damage_done", "damage_taken", "healing_done", "deaths", "swing_hits", "swing_misses", "crit_hits", "accuracy", "crit_rate", "pets"]
    people = who.join(src, [*by, "fighter_key"], "left").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("damage_done")).alias("order"), *shown, "sources"))).alias("fighters"))
    d = report.defenses(events, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("swings")).alias("order"), "defender", "attack_type", "category", "swings", "hits", "misses", "parries", "dodges", "blocks", "ripostes", "absorbs", "invulnerables", "damage", "crits", "min_hit", "max_hit", "average"))).alias("defenses"))
    m = report.mobs(events, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("damage_taken")).alias("order"), "mob", "damage_taken", "deaths", "last_killer", "ttk_s"))).alias("mobs"))
    doc = people.join(d, by, "full").join(m, by, "full")
    return doc.select(*by, F.to_json(F.struct("fighters", "defenses", "mobs")).alias("document"))


def damage_csv(events: DataFrame, by: list[str] = report.ENCOUNTER) -> DataFrame:
    """Section 1 of the CSV export: a TOTAL row of each fighter and metric, then its sources, as grouping sets."""
    rows = report.credits(events, by).where(F.col("metric").isin("done", "taken", "heal"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in (("done", "damage_done"), ("taken", "damage_taken"), ("heal", "healing")) for x in kv]), F.col("metric"))
    cut = rows.select(*by, label.alias("metric"), F.lower("fighter").alias("fighter"), "category", "source", F.coalesce(F.lower("pet"), F.lit("")).alias("pet"), "amount", "critical", "swing")
    keys = [F.col(c) for c in (*by, "metric", "fighter")]
    out = cut.groupingSets([keys, [*keys, F.col("category"), F.col("source"), F.col("pet")]], *keys, "category", "source", "pet").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("hits"), F.count_if("critical").alias("crits"), F.max("amount").alias("max"), F.grouping("source").alias("is_total"),
    )
    total = F.col("is_total") == 1
    average = F.when(total, "").otherwise(F.regexp_replace(F.format_string("%.2f", F.col("total") / F.col("hits")), r"\.?0+$", ""))
    return out.select(
        *by, "metric", "fighter", F.when(total, "TOTAL").otherwise(F.col("category")).alias("category"), F.when(total, "").otherwise(F.col("source")).alias("source"),
        F.when(total, "").otherwise(F.col("pet")).alias("pet"), "total", "hits", "crits", F.when(total, "").otherwise(F.col("max").cast("string")).alias("max"), average.alias("average"),
    )


def defense_csv(events: DataFrame, by: list[str] = report.ENCOUNTER) -> DataFrame:
    """Section 2 of the CSV export: one row per defender and kind of attack."""
    d = report.defenses(events, by)
    average = F.regexp_replace(F.format_string("%.2f", "average"), r"\.?0+$", "")
    return d.select(*by, "defender", "attack_type", "category", "swings", "hits", "damage", F.col("min_hit").alias("min"), F.col("max_hit").alias("max"), average.alias("average"), "crits", F.col("misses").alias("miss"), F.col("parries").alias("parry"), F.col("dodges").alias("dodge"), F.col("blocks").alias("block"), F.col("ripostes").alias("riposte"), F.col("absorbs").alias("rune"))


def mob_csv(events: DataFrame, by: list[str] = report.ENCOUNTER) -> DataFrame:
    """Section 3 of the CSV export: one row per monster."""
    return report.mobs(events, by).select(*by, "mob", "damage_taken", "deaths", F.coalesce("last_killer", F.lit("")).alias("last_killer"), F.col("ttk_s").alias("time_to_kill_seconds"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes only where a value needs them."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per line."""
    df.select("document").write.mode("overwrite").text(path)


def encounter_table(headers: DataFrame, events: DataFrame, top: int = 6) -> DataFrame:
    """``log_id, enc_id, part, rank_no, line``: the text report, bounded by per-group ranks (sources ``top``, defenders 8, monsters 12)."""
    by = report.ENCOUNTER
    given = report.credits(events, by)
    title = headers.select(*by, F.lit(0).alias("part"), F.lit(0).alias("rank_no"), F.format_string("#%d %s (%.0f s, %s)", "enc_id", "title", "duration_s", "end_reason").alias("line"))
    who = report.ranked(report.fighters(given, by), by, "damage_done", [F.asc("first_seq"), F.asc("fighter_key")])
    people = who.select(*by, F.lit(1).alias("part"), "rank_no", F.format_string("%s %d", "fighter", "damage_done").alias("line"))
    src = report.ranked(report.sources(given, by).where("metric = 'done'"), [*by, "fighter_key"], "total", [F.asc("category"), F.asc("source"), F.asc_nulls_first("pet")], top)
    sources = src.select(*by, F.lit(2).alias("part"), "rank_no", F.format_string("%s: %s %d", "fighter", "source", "total").alias("line"))
    d = report.ranked(report.defense_rollup(report.defenses(events, by), report.fighters(given, by), by), by, "swings", [F.desc("damage"), F.asc("defender_key")], 8)
    guard = d.select(*by, F.lit(3).alias("part"), "rank_no", F.format_string("%s %d swings, %.1f%% avoided", "defender", "swings", F.col("avoid_rate") * 100).alias("line"))
    m = report.ranked(report.mobs(events, by), by, "damage_taken", [F.asc("first_seq")], 12)
    foes = m.select(*by, F.lit(4).alias("part"), "rank_no", F.format_string("%s %d in %d s", "mob", "damage_taken", "ttk_s").alias("line"))
    return title.unionByName(people).unionByName(sources).unionByName(guard).unionByName(foes)
