"""Queries of the sources and sinks: log files written and read back, CSV sections, documents, the text report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.plans import queries as q
from skirmish.session import ensure_checkpoint_dir, load
from skirmish.sources import export
from skirmish.sources.logs import read_logs


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def x_read_logs(spark, sf_dir):
    """Game logs written as text files and read back with exact line numbers."""
    lines = load(spark, sf_dir, "raw_lines").where("file_path like '/logs/game/%'").groupBy("log_id", "line_no").agg(F.min("raw").alias("raw"))
    folder = _folder(spark, "logs")
    lines.repartition("log_id").sortWithinPartitions("log_id", "line_no").select("log_id", "raw").write.partitionBy("log_id").text(folder)
    back = read_logs(spark, f"{folder}/*/*.txt")
    return back.select(F.regexp_extract("file_path", "log_id=([^/]+)/", 1).alias("log_id"), "line_no", "raw")


def x_damage_csv(spark, sf_dir):
    """Totals of each fighter and their sources, written as CSV and read back."""
    rows = export.damage_csv(q.fought(spark, sf_dir, q.SOURCE))
    folder = _folder(spark, "csv")
    export.write_csv(rows, folder)
    back = spark.read.option("header", True).option("escape", '"').schema(rows.schema).csv(folder)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in back.dtypes])


def x_defense_csv(spark, sf_dir):
    """The section of defenses."""
    return export.defense_csv(q.fought(spark, sf_dir)).drop("category")


def x_mob_csv(spark, sf_dir):
    """The section of monsters."""
    return export.mob_csv(q.fought(spark, sf_dir, q.CORE))


_DOCUMENT = "fighters array<struct<fighter:string,damage_done:bigint,healing_done:bigint,sources:array<struct<metric:string,source:string,total:bigint>>>>"


def x_json(spark, sf_dir):
    """Documents of the encounters, taken apart again: fighters with the number of their buckets and the largest one."""
    docs = export.report_json(q.fought(spark, sf_dir))
    read = docs.select("log_id", "enc_id", F.from_json("document", _DOCUMENT).alias("d"))
    who = read.select("log_id", "enc_id", F.explode("d.fighters").alias("f"))
    sources = F.coalesce("f.sources", F.array().cast("array<struct<metric:string,source:string,total:bigint>>"))
    return who.select("log_id", "enc_id", "f.fighter", "f.damage_done", "f.healing_done", F.size(sources).alias("n_sources"), F.coalesce(F.get(sources, F.lit(0))["total"], F.lit(0)).alias("largest"))


def x_table(spark, sf_dir):
    """The text report of the encounters, its sources, defenders and monsters ranked and cut as printed."""
    heads = q._headers(spark, sf_dir).withColumn("duration_s", F.greatest(F.lit(1.0), (F.unix_timestamp(F.col("end_ts").cast("string")) - F.unix_timestamp(F.col("start_ts").cast("string"))).cast("double")))
    return export.encounter_table(heads, q.fought(spark, sf_dir))


QUERIES = {f.__name__: f for f in (x_read_logs, x_damage_csv, x_defense_csv, x_mob_csv, x_json, x_table)}

_AVG = "regexp_replace(printf('%.2f', {0}), '\\.?0+$', '')"
ORACLES = {
    "x_read_logs": "select log_id, line_no, regexp_replace(min(raw), '\\r$', '') as raw from raw_lines where file_path like '/logs/game/%' group by 1, 2",
    "x_damage_csv": f"""with {q._GIVEN}, r as (select log_id, enc_id, case metric when 'done' then 'damage_done' when 'taken' then 'damage_taken' else 'healing' end as metric, fighter, category, source, coalesce(pet, '') as pet, amount, critical
 from given where metric in ('done', 'taken', 'heal') and fighter is not null)
select log_id, enc_id, metric, fighter, 'TOTAL' as category, '' as source, '' as pet, cast(sum(amount) as bigint) as total, count(*) as hits, count(*) filter (critical) as crits, '' as max, '' as average from r group by all
union all select log_id, enc_id, metric, fighter, category, source, pet, cast(sum(amount) as bigint), count(*), count(*) filter (critical), max(amount)::varchar, {_AVG.format('round(sum(amount) / count(*), 2)')} from r group by log_id, enc_id, metric, fighter, category, source, pet""",
    "x_defense_csv": f"""with {q._GIVEN}, {q._DEF} select log_id, enc_id, defender, attack_type, swings, hits, damage, min_hit as min, max_hit as max, {_AVG.format('round(case when hits > 0 then damage / hits else 0 end, 2)')} as average, crits,
 misses as miss, parries as parry, dodges as dodge, blocks as block, ripostes as riposte, absorbs as rune from def""",
    "x_mob_csv": f"with {q._GIVEN}, {q._MOBS} select log_id, enc_id, mob, damage_taken, deaths, coalesce(last_killer, '') as last_killer, cast(epoch(last_hit) - epoch(first_hit) as bigint) as time_to_kill_seconds from mob",
    "x_json": f"""with {q._GIVEN}, {q._WHO}, {q._SOURCES}, b as (select log_id, enc_id, fighter, count(*) as n_sources, max(total) as largest from buckets group by all)
select w.log_id, w.enc_id, w.fighter, damage_done, healing_done, coalesce(n_sources, 0) as n_sources, coalesce(largest, 0) as largest from who w left join b on b.log_id = w.log_id and b.enc_id = w.enc_id and b.fighter = w.fighter""",
    "x_table": f"""with {q._GIVEN}, {q._WHO}, {q._SOURCES}, {q._DEF}, {q._MOBS}, {q._HEADS},
d as (select log_id, enc_id, defender, cast(sum(swings) as bigint) as swings, cast(sum(damage) as bigint) as damage, sum(swings) filter (category in ('Melee', 'Melee Special')) as ms, sum(hits) filter (category in ('Melee', 'Melee Special')) as mh from def group by 1, 2, 3)
select log_id, enc_id, 0 as part, 0 as rank_no, '#' || enc_id || ' ' || coalesce(title, 'null') || ' (' || cast(greatest(1, epoch(end_ts) - epoch(start_ts)) as bigint) || ' s, ' || coalesce(end_reason, 'null') || ')' as line from heads
union all select log_id, enc_id, 1, {q._RANK}, fighter || ' ' || damage_done from who where damage_done > 0
union all select log_id, enc_id, 2, rank_no, fighter || ': ' || source || ' ' || total from (select *, row_number() over (partition by log_id, enc_id, fighter order by total desc, category, source, pet nulls first) as rank_no from buckets where metric = 'done' and total > 0 and fighter is not null) where rank_no <= 6
union all select log_id, enc_id, 3, rank_no, defender || ' ' || swings || ' swings, ' || printf('%.1f', round(coalesce((ms - mh) / ms, 0) * 100, 1)) || '% avoided' from (select *, row_number() over (partition by log_id, enc_id order by swings desc, damage desc, defender) as rank_no from d where swings > 0) where rank_no <= 8
union all select log_id, enc_id, 4, rank_no, mob || ' ' || damage_taken || ' in ' || cast(epoch(last_hit) - epoch(first_hit) as bigint) || ' s' from (select *, row_number() over (partition by log_id, enc_id order by damage_taken desc, first_seq) as rank_no from mob) where rank_no <= 12""",
}
