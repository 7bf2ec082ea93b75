"""Queries over the event and raw-line tables (general data preparation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.times import stamp_text
from skirmish.functions.names import name_key, term_key
from skirmish.operators.delivery import once_per_key
from skirmish.operators.features import entity_features
from skirmish.operators.log_entries import log_entries
from skirmish.operators.gap_tree import gap_tree, sessions_at
from skirmish.plans.sqlnames import sql_key, sql_term
from skirmish.session import load

SESSION_GAP_S = 45


def _events(spark: SparkSession, sf_dir: str, columns: dict) -> DataFrame:
    return once_per_key(load(spark, sf_dir, "combat_events"), ["log_id", "line_no"], "arrived_at", columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of activity on each target of a log, cut at 45 s."""
    ev = _events(spark, sf_dir, {"ts": F.col("ts"), "target": name_key(F.col("target"))}).where("target is not null and ts is not null")
    tree = gap_tree(ev, ["log_id", "target"], "ts", only_gaps=[SESSION_GAP_S])
    s = sessions_at(tree, SESSION_GAP_S)
    return s.select(
        "log_id", "target", stamp_text("start_ts").alias("start_ts"), stamp_text("end_ts").alias("end_ts"), "duration_s", "n_events"
    )


def p1_gap_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of sessions and covered seconds for several gap settings, read from one tree."""
    ev = _events(spark, sf_dir, {"ts": F.col("ts"), "target": name_key(F.col("target"))}).where("target is not null and ts is not null")
    settings = [6, 15, 45, 120, 300]
    tree = gap_tree(ev, ["log_id", "target"], "ts", only_gaps=settings)
    hit = [
        F.when((F.col("gap_us") <= g * 1_000_000) & (F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > g * 1_000_000)), F.lit(g))
        for g in settings
    ]
    return (
        tree.select(F.explode(F.array_compact(F.array(*hit))).alias("gap_s"), "span_us", "n_events")
        .groupBy("gap_s")
        .agg(F.count(F.lit(1)).alias("n_sessions"), F.sum(F.expr("span_us div 1000000")).alias("covered_s"), F.sum("n_events").alias("n_events"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, totals and last use of every event type per fighter of a log."""
    name = F.coalesce(term_key(F.col("spell")), term_key(F.col("verb")), F.lit("none"))
    ev = _events(
        spark,
        sf_dir,
        {
            "attacker": name_key(F.col("attacker")),
            "attacker_owner": name_key(F.col("attacker_owner")),
            "event_type": F.concat_ws(":", F.col("action"), F.coalesce(F.col("mechanic"), F.lit("none")), name),
            "amount": F.coalesce(F.col("amount"), F.lit(0)),
            "ts": F.col("ts"),
        },
    ).where("attacker is not null")
    folded = entity_features(
        ev.withColumn("n", F.lit(1).cast("bigint")), ["log_id", "attacker", "attacker_owner"], "event_type", "n", "amount", "ts", whole_entities=False
    )
    owners = (
        load(spark, sf_dir, "pet_tags")
        .select("log_id", name_key(F.col("pet")).alias("attacker"), F.struct("line_no", name_key(F.col("owner")).alias("owner")).alias("tag"))
        .groupBy("log_id", "attacker")
        .agg(F.max("tag").getField("owner").alias("tag_owner"))
    )
    entity = F.coalesce("attacker_owner", "tag_owner", "attacker").alias("entity")
    partial = folded.join(owners, ["log_id", "attacker"], "left").select("log_id", entity, "event_type", "n", "amount", "ts")
    out = entity_features(partial, ["log_id", "entity"], "event_type", "n", "amount", "ts", whole_entities=True)
    return out.select(
        "log_id",
        "entity",
        "event_type",
        F.col("n").alias("n_events"),
        F.col("amount").alias("total_amount"),
        F.coalesce(stamp_text("ts"), F.lit("")).alias("last_seen"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all logs with stamp, level and component."""
    out = log_entries(load(spark, sf_dir, "raw_lines"), with_message=False)
    return out.withColumn("entry_ts", stamp_text("entry_ts"))


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries with their whole message text, heads cut off."""
    return log_entries(load(spark, sf_dir, "raw_lines"), cut_head=True).withColumn("entry_ts", stamp_text("entry_ts"))


_ONCE = "(select * from combat_events qualify row_number() over (partition by log_id, line_no order by arrived_at) = 1)"

_P1_RUNS = f"""
with e as (select log_id, {sql_key('target')} as target, ts, line_no from {_ONCE} where ts is not null and target is not null),
g as (select *, case when epoch(ts) - epoch(lag(ts) over w) <= GAP_S then 0 else 1 end as is_new from e window w as (partition by log_id, target order by ts, line_no)),
s as (select *, sum(is_new) over (partition by log_id, target order by ts, line_no rows unbounded preceding) as sid from g),
r as (select log_id, target, min(ts) as a, max(ts) as b, count(*) as n from s group by log_id, target, sid)
"""

ORACLES = {
    "p1_found": _P1_RUNS.replace('GAP_S', str(SESSION_GAP_S))
    + """select log_id, target, strftime(a, '%Y-%m-%d %H:%M:%S') as start_ts, strftime(b, '%Y-%m-%d %H:%M:%S') as end_ts,
cast(epoch(b) - epoch(a) as bigint) as duration_s, n as n_events from r""",
    "p1_gap_settings": " union all ".join(
        f"select * from ({_P1_RUNS.replace('GAP_S', str(g))} select {g} as gap_s, count(*) as n_sessions, cast(sum(epoch(b) - epoch(a)) as bigint) as covered_s, cast(sum(n) as bigint) as n_events from r)"
        for g in [6, 15, 45, 120, 300]
    ),
    "p3_found": f"""
with o as (select log_id, {sql_key('pet')} as pet, max(struct_pack(l := line_no, o := {sql_key('owner')})).o as owner from pet_tags group by 1, 2),
e as (select log_id, {sql_key('attacker')} as attacker, {sql_key('attacker_owner')} as own,
  action || ':' || coalesce(mechanic, 'none') || ':' || coalesce({sql_term('spell')}, {sql_term('verb')}, 'none') as event_type, coalesce(amount, 0) as amount, ts
  from {_ONCE} where attacker is not null)
select e.log_id, coalesce(e.own, o.owner, e.attacker) as entity, event_type, count(*) as n_events, cast(sum(amount) as bigint) as total_amount,
  coalesce(strftime(max(ts), '%Y-%m-%d %H:%M:%S'), '') as last_seen
from e left join o on o.log_id = e.log_id and o.pet = e.attacker group by 1, 2, 3""",
}

QUERIES = {"p1_found": p1_found, "p1_gap_settings": p1_gap_settings, "p2_found": p2_found, "p2_entries": p2_entries, "p3_found": p3_found}
