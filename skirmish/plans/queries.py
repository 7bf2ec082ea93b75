"""Report, ownership and join queries over the enriched event tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.functions.names import name_key, term_key
from skirmish.operators.delivery import once_per_key
from skirmish.operators.encounters import build_encounters
from skirmish.operators.gap_tree import sessionize
from skirmish.operators.owners import asof_last, final_owners
from skirmish.plans import report
from skirmish.plans.fold_twin import FOLD, HEADERS
from skirmish.plans.sqlnames import sql_key, sql_term
from skirmish.session import cut_lineage, load

BY = report.ENCOUNTER


# Columns a report reads; the one-row-per-line shuffle carries no others.
CORE = ["ts", "enc_id", "action", "amount", "attacker", "target", "attacker_kind", "target_kind"]
FIGHTER = [*CORE, "attacker_owner", "target_owner", "mechanic", "is_critical"]
SOURCE = [*FIGHTER, "verb", "spell"]
DEFENSE = [*SOURCE, "miss_reason"]
CLASS = ["ts", "attacker", "attacker_kind", "verb", "spell"]
FOLD_IN = ["ts", "action", "amount", "attacker", "target", "attacker_kind", "target_kind", "mechanic"]


def clean_events(spark: SparkSession, sf_dir: str, need: list[str] = DEFENSE) -> DataFrame:
    """Each delivered line once, names in comparison form, only rows with a stamp; of the columns those in ``need``."""
    names = {c: name_key(F.col(c)) for c in ("attacker", "target", "attacker_owner", "target_owner")}
    terms = {c: term_key(F.col(c)) for c in ("spell", "verb")}
    rest = {c: F.col(c) for c in ("ts", "action", "mechanic", "miss_reason", "is_critical", "attacker_kind", "target_kind", "enc_id")}
    columns = {c: e for c, e in {**names, **terms, **rest, "amount": F.coalesce("amount", F.lit(0))}.items() if c in need}
    return once_per_key(load(spark, sf_dir, "combat_events"), ["log_id", "line_no"], "arrived_at", columns).where("ts is not null")


def fought(spark: SparkSession, sf_dir: str, need: list[str] = DEFENSE) -> DataFrame:
    """Clean events inside encounters."""
    return clean_events(spark, sf_dir, need).where("enc_id is not null")


def _given(spark: SparkSession, sf_dir: str, by: list[str] = BY, need: list[str] = FIGHTER) -> DataFrame:
    return report.credits(fought(spark, sf_dir, need), by)


def r_fighters(spark, sf_dir):
    """Totals, swings, rates, deaths and pets of every fighter of every encounter."""
    out = report.fighters(_given(spark, sf_dir)).drop("fighter_key", "first_seq")
    return out.withColumn("pets", F.array_join("pets", ","))


def r_sources(spark, sf_dir):
    """Source buckets of damage done, damage taken and healing."""
    return report.sources(_given(spark, sf_dir, need=SOURCE)).drop("fighter_key", "pet_key")


def r_top_sources(spark, sf_dir):
    """K2, K5: the six largest buckets of each fighter and metric, with their share of the fighter's total."""
    s = report.sources(_given(spark, sf_dir, need=SOURCE))
    grp = [*BY, "metric", "fighter"]
    share = report.ratio(F.col("total"), F.sum("total").over(Window.partitionBy(*grp)))
    ties = [F.asc("category"), F.asc("source"), F.asc_nulls_first("pet")]
    top = report.ranked(s.withColumn("share", share), grp, "total", ties, 6)
    return top.select(*grp, "category", "source", "pet", "total", "share", "rank_no")


def r_ranking(spark, sf_dir):
    """K1: fighters with damage in falling order; ties by first appearance; share and damage per second."""
    who = report.ranked(report.fighters(_given(spark, sf_dir)), BY, "damage_done", [F.asc("first_seq"), F.asc("fighter_key")])
    share = report.ratio(F.col("damage_done"), F.sum("damage_done").over(Window.partitionBy(*BY)))
    return who.select(*BY, "fighter", "damage_done", share.alias("share"), "rank_no")


def r_totals(spark, sf_dir):
    """A10: total damage and healing of each encounter."""
    return report.totals(_given(spark, sf_dir, need=CORE))


def r_merged_logs(spark, sf_dir):
    """A1 over all encounters of a log as one report."""
    return report.fighters(_given(spark, sf_dir, ["log_id"]), ["log_id"]).select("log_id", "fighter", "damage_done", "damage_taken", "healing_done", "deaths")


def r_damage_plus_healing(spark, sf_dir):
    """Damage and healing of a fighter added up."""
    who = report.fighters(_given(spark, sf_dir))
    both = who.select(*BY, "fighter", F.col("damage_done").alias("v")).unionByName(who.select(*BY, "fighter", F.col("healing_done").alias("v")))
    return both.groupBy(*BY, "fighter").agg(F.sum("v").alias("combined")).where("combined > 0")


def r_mobs(spark, sf_dir):
    """Monsters with damage, deaths, last killer and time to kill."""
    return report.mobs(fought(spark, sf_dir, CORE)).drop("mob_key", "first_seq")


def r_mob_sources(spark, sf_dir):
    """Monster x fighter x source."""
    return report.mob_sources(fought(spark, sf_dir, SOURCE)).drop("mob_key", "fighter_key", "pet_key")


def r_defenses(spark, sf_dir):
    """Outcomes of every kind of attack on every defender."""
    return report.defenses(fought(spark, sf_dir)).drop("defender_key", "type_key", "category")


def r_defense_rollup(spark, sf_dir):
    """Defenses rolled up per defender, with deaths."""
    ev = fought(spark, sf_dir)
    return report.defense_rollup(report.defenses(ev), report.fighters(report.credits(ev))).drop("defender_key")


def r_source_tree(spark, sf_dir):
    """Damage tree fighter > group > leaf with shares, as grouping sets."""
    return report.source_tree(_given(spark, sf_dir, need=SOURCE), "done")


def r_branch(spark, sf_dir):
    """One fighter's (the top of each encounter) sources, pets in front, with their share."""
    given = _given(spark, sf_dir, need=SOURCE)
    top = report.ranked(report.fighters(given), BY, "damage_done", [F.asc("first_seq"), F.asc("fighter_key")], 1).select(*BY, "fighter_key")
    rows = report.sources(given).where("metric = 'done'").join(top, [*BY, "fighter_key"], "left_semi")
    label = F.concat(F.coalesce(F.concat("pet", F.lit(": ")), F.lit("")), "source")
    out = rows.groupBy(*BY, "fighter", label.alias("label")).agg(F.sum("total").alias("total"))
    return out.withColumn("share", report.ratio(F.col("total"), F.sum("total").over(Window.partitionBy(*BY))))


def r_class_evidence(spark, sf_dir):
    """Class evidence of players over all events of a log."""
    ev = report.class_evidence(clean_events(spark, sf_dir, CLASS), load(spark, sf_dir, "class_catalog"))
    return ev.select("log_id", "player", "class_name", "uses")


def r_class_labels(spark, sf_dir):
    """The three best-supported classes of a player as a label."""
    return report.class_labels(report.class_evidence(clean_events(spark, sf_dir, CLASS), load(spark, sf_dir, "class_catalog"))).select("log_id", "player", "label")


def _headers(spark, sf_dir):
    """Each encounter once: the row with the latest activity, complete before open."""
    rows = load(spark, sf_dir, "encounters").where("start_ts is not null and end_ts is not null")
    return rows.groupBy(*BY).agg(F.max(F.struct("end_ts", "start_ts", "title", "end_reason")).alias("h")).select(*BY, "h.*")


def r_summaries(spark, sf_dir):
    """List view of the encounters."""
    return report.summaries(_headers(spark, sf_dir), report.fighters(_given(spark, sf_dir)))


def r_time_range(spark, sf_dir):
    """Merged time range of a log: span, summed durations, totals."""
    return report.time_range(_headers(spark, sf_dir), _given(spark, sf_dir, need=CORE))


def r_titles(spark, sf_dir):
    """The hardest-hit monster of an encounter and how many others."""
    m = report.mobs(fought(spark, sf_dir, CORE))
    out = m.groupBy(*BY).agg(F.min(F.struct((-F.col("damage_taken")).alias("d"), "first_seq", "mob")).getField("mob").alias("mob"), (F.count(F.lit(1)) - 1).alias("others"))
    title = F.when(F.col("others") > 0, F.concat("mob", F.lit(" +"), F.col("others").cast("string"))).otherwise(F.col("mob"))
    return out.select(*BY, title.alias("title"))


def r_chat_line(spark, sf_dir):
    """K8, K9: ranking as one chat line within 480 characters, numbers made compact."""
    who = report.ranked(report.fighters(_given(spark, sf_dir)), BY, "damage_done", [F.asc("first_seq"), F.asc("fighter_key")])
    text = F.concat("fighter", F.lit(" "), report.compact_number(F.col("damage_done")))
    return report.chat_line(who.withColumn("text", text), BY, "text")


def r_selected(spark, sf_dir):
    """Totals of the encounters that ended with a kill (semi join)."""
    chosen = _headers(spark, sf_dir).where("end_reason = 'all_mobs_dead'").select(*BY)
    return report.totals(report.credits(fought(spark, sf_dir, CORE).join(chosen, BY, "left_semi")))


def r_unlisted(spark, sf_dir):
    """Encounters that have events but no header (anti join)."""
    return fought(spark, sf_dir, ["ts", "enc_id"]).groupBy(*BY).agg(F.count(F.lit(1)).alias("n_events")).join(_headers(spark, sf_dir), BY, "left_anti")


def l_other_logs(spark, sf_dir):
    """Logs with lines but without any event (anti join), with their number of lines."""
    lines = load(spark, sf_dir, "raw_lines").select("log_id", "line_no").distinct().groupBy("log_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return lines.join(load(spark, sf_dir, "combat_events").select("log_id"), "log_id", "left_anti")


def o_final_owner(spark, sf_dir):
    """The last owner stated for each pet of a log."""
    tags = load(spark, sf_dir, "pet_tags").select("log_id", "line_no", name_key(F.col("pet")).alias("pet"), name_key(F.col("owner")).alias("owner"))
    return final_owners(tags).withColumnRenamed("pet_key", "pet")


def o_owner_asof(spark, sf_dir):
    """The owner stated last at or before each event's line."""
    ev = clean_events(spark, sf_dir, ["ts", "attacker"]).where("attacker is not null").select("log_id", "line_no", F.col("attacker").alias("pet"), F.lit(None).cast("string").alias("owner"), F.lit(True).alias("is_event"))
    tags = load(spark, sf_dir, "pet_tags").select("log_id", "line_no", name_key(F.col("pet")).alias("pet"), name_key(F.col("owner")).alias("owner"))
    tags = tags.groupBy("log_id", "line_no", "pet").agg(F.max("owner").alias("owner")).withColumn("is_event", F.lit(False))
    both = tags.unionByName(ev).groupBy("log_id", "line_no", "pet").agg(F.max("owner").alias("owner"), F.max("is_event").alias("is_event"))
    out = asof_last(cut_lineage(both), ["log_id", "pet"], "line_no", "owner", "owner_asof")
    return out.where("is_event and owner_asof is not null").select("log_id", "line_no", "pet", "owner_asof")


def s_sessions_of_users(spark, sf_dir):
    """General sessionizing of another table: activity of users with a six-hour gap."""
    return sessionize(load(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, chunk_hours=24 * 7).select("user_id", "start_ts", "end_ts", "n_events")


def as_text(headers: DataFrame) -> DataFrame:
    """Headers with their map as JSON and their lists joined by bars."""
    return headers.withColumns({"npc_damage": F.to_json("npc_damage"), **{c: F.array_join(c, "|") for c in ("npcs_killed", "player_deaths")}})


def s_encounter_fold(spark, sf_dir):
    """E1-E17 over the classified events and the split markers: encounter headers."""
    ev = clean_events(spark, sf_dir, FOLD_IN)
    marks = load(spark, sf_dir, "split_markers").where("kind = 0").select("log_id", "ts").distinct()
    return as_text(build_encounters(ev, None, marks)[0])


QUERIES = {
    f.__name__: f
    for f in (
        r_fighters, r_sources, r_top_sources, r_ranking, r_totals, r_merged_logs, r_damage_plus_healing, r_mobs, r_mob_sources, r_defenses,
        r_defense_rollup, r_source_tree, r_branch, r_class_evidence, r_class_labels, r_summaries, r_time_range, r_titles, r_chat_line, r_selected, r_unlisted,
        o_final_owner, l_other_logs, o_owner_asof, s_sessions_of_users, s_encounter_fold,
    )
}


# ---- SQL twins --------------------------------------------------------------------------------

_k, _t = sql_key, sql_term
_CLEAN = f"""clean as (select log_id, line_no, ts, action, {_k('attacker')} as attacker, {_k('target')} as target, {_k('attacker_owner')} as attacker_owner,
 {_k('target_owner')} as target_owner, coalesce(amount, 0) as amount, mechanic, {_t('verb')} as verb, {_t('spell')} as spell, miss_reason, is_critical, attacker_kind, target_kind, enc_id
 from (select * from combat_events qualify row_number() over (partition by log_id, line_no order by arrived_at) = 1) where ts is not null)"""
_CAT = "case mechanic when 'melee' then 'Melee' when 'melee_special' then 'Melee Special' when 'non_melee' then 'Non-melee' when 'damage_shield' then 'Damage Shield' else 'Other' end"
_SRC = "coalesce(spell, verb, case mechanic when 'melee' then 'melee' when 'melee_special' then 'meleespecial' when 'non_melee' then 'nonmelee' when 'damage_shield' then 'damageshield' else 'unknown' end)"
_AF, _TF = "attacker_kind in ('player', 'pet') and attacker is not null", "target_kind in ('player', 'pet') and target is not null"
_TN = "target_kind = 'npc' and target is not null"
_APET = "attacker_kind = 'pet' and attacker_owner is not null and attacker_owner <> attacker"
_TPET = "target_kind = 'pet' and target_owner is not null and target_owner <> target"
_GIVEN = f"""{_CLEAN},
ev as (select * from clean where enc_id is not null),
given as (
 select log_id, enc_id, ts, line_no, 'done' as metric, case when {_APET} then attacker_owner else attacker end as fighter, case when {_APET} then attacker end as pet, {_CAT} as category, {_SRC} as source, amount, mechanic in ('melee', 'melee_special') as swing, is_critical as critical
  from ev where action = 'damage' and {_AF} and {_TN}
 union all select log_id, enc_id, ts, line_no, 'taken', case when {_TPET} then target_owner else target end, case when {_TPET} then target end, {_CAT}, coalesce(attacker, case when mechanic = 'damage_shield' then 'damage shield' else 'unknown' end), amount, mechanic in ('melee', 'melee_special'), is_critical
  from ev where action = 'damage' and {_TF} and (attacker_kind = 'npc' or attacker is null)
 union all select log_id, enc_id, ts, line_no, 'miss', case when {_APET} then attacker_owner else attacker end, null, null, null, amount, null, false from ev where action = 'miss' and {_AF} and {_TN}
 union all select log_id, enc_id, ts, line_no, 'heal', case when {_APET} then attacker_owner else attacker end, case when {_APET} then attacker end, 'Heal', coalesce(spell, 'heal'), amount, null, false from ev where action = 'heal' and {_AF}
 union all select log_id, enc_id, ts, line_no, 'healed', target, null, null, null, amount, null, false from ev where action = 'heal' and {_TF}
 union all select log_id, enc_id, ts, line_no, 'death', target, null, null, null, amount, null, false from ev where action = 'death' and target_kind = 'player'
)"""


def _fighters(by: str) -> str:
    return f"""who as (select {by}, fighter, min(struct_pack(t := ts, l := line_no)) as first_seq,
 cast(coalesce(sum(amount) filter (metric = 'done'), 0) as bigint) as damage_done, cast(coalesce(sum(amount) filter (metric = 'taken'), 0) as bigint) as damage_taken,
 cast(coalesce(sum(amount) filter (metric = 'heal'), 0) as bigint) as healing_done, cast(coalesce(sum(amount) filter (metric = 'healed'), 0) as bigint) as healing_received,
 count(*) filter (metric = 'death') as deaths, count(*) filter (metric = 'done' and swing) as swing_hits, count(*) filter (metric = 'miss') as swing_misses,
 count(*) filter (metric = 'done' and swing and critical) as crit_hits, coalesce(string_agg(distinct pet, ',' order by pet), '') as pets
 from given where fighter is not null group by {by}, fighter)"""


_SOURCES = """buckets as (select log_id, enc_id, metric, fighter, category, source, pet, cast(sum(amount) as bigint) as total, count(*) as hits, count(*) filter (critical) as crits,
 min(amount) as min_hit, max(amount) as max_hit, sum(amount) / count(*) as average from given where metric in ('done', 'taken', 'heal') group by all)"""
_WHO = _fighters("log_id, enc_id")
_MOBS = f"""mob as (select log_id, enc_id, target as mob, cast(sum(amount) filter (action = 'damage') as bigint) as damage_taken, count(*) filter (action = 'death') as deaths,
 arg_max(attacker, struct_pack(t := ts, l := line_no)) filter (action = 'death' and attacker is not null and attacker_kind is distinct from 'npc') as last_killer,
 min(ts) as first_hit, max(ts) as last_hit, min(struct_pack(t := ts, l := line_no)) as first_seq
 from ev where {_TN} and (action = 'death' or (action = 'damage' and amount > 0)) group by all having sum(amount) filter (action = 'damage') > 0)"""
_DEF = f"""hits as (select log_id, enc_id, case when {_TPET} then target_owner else target end as defender,
  case when mechanic = 'non_melee' then 'non-melee' || coalesce(': ' || spell, '') else coalesce(verb, 'hit') end as attack_type, {_CAT} as category, line_no, action, amount, is_critical,
  case when miss_reason in ('miss', 'parry', 'dodge', 'block', 'riposte', 'invulnerable', 'rune') then miss_reason else 'miss' end as reason
  from ev where action in ('damage', 'miss') and {_TF} and coalesce(attacker_kind not in ('player', 'pet'), true) and coalesce(mechanic, '') <> 'damage_shield'),
def as (select log_id, enc_id, defender, attack_type, min(category) as category, count(*) filter (action = 'damage' and amount > 0) as hits,
  count(*) filter (action = 'miss' and reason = 'miss') as misses, count(*) filter (action = 'miss' and reason = 'parry') as parries, count(*) filter (action = 'miss' and reason = 'dodge') as dodges,
  count(*) filter (action = 'miss' and reason = 'block') as blocks, count(*) filter (action = 'miss' and reason = 'riposte') as ripostes, count(*) filter (action = 'miss' and reason = 'rune') as absorbs,
  count(*) filter (action = 'miss' and reason = 'invulnerable') as invulnerables, cast(coalesce(sum(amount) filter (action = 'damage' and amount > 0), 0) as bigint) as damage,
  count(*) filter (action = 'damage' and amount > 0 and is_critical) as crits, coalesce(min(amount) filter (action = 'damage' and amount > 0), 0) as min_hit, coalesce(max(amount) filter (action = 'damage' and amount > 0), 0) as max_hit,
  count(*) filter (action = 'miss' or amount > 0) as swings from hits group by all having count(*) filter (action = 'miss' or amount > 0) > 0)"""
_CLASSES = f"""{_CLEAN}, uses as (select log_id, attacker as player, 'spell' as kind, spell as sig from clean where attacker_kind = 'player' and attacker is not null and spell is not null
 union all select log_id, attacker, 'verb', verb from clean where attacker_kind = 'player' and attacker is not null and verb is not null),
evid as (select log_id, player, class_name, count(*) as uses from uses join (select distinct kind, lower(signature) as sig, class_name from class_catalog) c using (kind, sig) group by all having count(*) >= 2)"""
_HEADS = """heads as (select log_id, enc_id, unnest(max(struct_pack(end_ts := end_ts, start_ts := start_ts, title := title, end_reason := end_reason))) from encounters where start_ts is not null and end_ts is not null group by 1, 2)"""
_SECONDS = "greatest(1.0, cast(epoch(end_ts) - epoch(start_ts) as double))"
_COMPACT = """case when damage_done >= 1000000 then ((damage_done + 5000) // 10000 // 100) || '.' || lpad(((damage_done + 5000) // 10000 % 100)::varchar, 2, '0') || 'M'
 when damage_done >= 1000 then ((damage_done + 50) // 100 // 10) || '.' || ((damage_done + 50) // 100 % 10) || 'K' else damage_done::varchar end"""
_RANK = "row_number() over (partition by log_id, enc_id order by damage_done desc, first_seq, fighter)"

ORACLES = {
    "s_encounter_fold": f"with recursive {_CLEAN}, {FOLD} {HEADERS}",
    "r_fighters": f"""with {_GIVEN}, {_WHO} select * exclude (first_seq), case when swing_hits + swing_misses > 0 then swing_hits / (swing_hits + swing_misses) else 0 end as accuracy,
 case when swing_hits > 0 then crit_hits / swing_hits else 0 end as crit_rate from who""",
    "r_sources": f"with {_GIVEN}, {_SOURCES} select * from buckets where fighter is not null",
    "r_top_sources": f"""with {_GIVEN}, {_SOURCES}, s as (select *, case when sum(total) over w > 0 then total / sum(total) over w else 0 end as share from buckets where fighter is not null window w as (partition by log_id, enc_id, metric, fighter)),
r as (select *, row_number() over (partition by log_id, enc_id, metric, fighter order by total desc, category, source, pet nulls first) as rank_no from s where total > 0)
select log_id, enc_id, metric, fighter, category, source, pet, total, share, rank_no from r where rank_no <= 6""",
    "r_ranking": f"with {_GIVEN}, {_WHO} select log_id, enc_id, fighter, damage_done, damage_done / sum(damage_done) over (partition by log_id, enc_id) as share, {_RANK} as rank_no from who where damage_done > 0",
    "r_totals": f"with {_GIVEN} select log_id, enc_id, cast(coalesce(sum(amount) filter (metric = 'done'), 0) as bigint) as total_damage, cast(coalesce(sum(amount) filter (metric = 'heal'), 0) as bigint) as total_healing from given group by 1, 2",
    "r_merged_logs": f"with {_GIVEN}, {_fighters('log_id')} select log_id, fighter, damage_done, damage_taken, healing_done, deaths from who",
    "r_damage_plus_healing": f"with {_GIVEN}, {_WHO} select log_id, enc_id, fighter, damage_done + healing_done as combined from who where damage_done + healing_done > 0",
    "r_mobs": f"with {_GIVEN}, {_MOBS} select * exclude (first_seq), cast(epoch(last_hit) - epoch(first_hit) as bigint) as ttk_s from mob",
    "r_mob_sources": f"""with {_GIVEN} select log_id, enc_id, target as mob, case when {_APET} then attacker_owner else attacker end as fighter, case when {_APET} then attacker end as pet, {_CAT} as category, {_SRC} as source,
 cast(sum(amount) as bigint) as total, count(*) as hits, count(*) filter (is_critical) as crits, min(amount) as min_hit, max(amount) as max_hit from ev where action = 'damage' and amount > 0 and {_AF} and {_TN} group by all""",
    "r_defenses": f"with {_GIVEN}, {_DEF} select * exclude (category), case when hits > 0 then damage / hits else 0 end as average from def",
    "r_defense_rollup": f"""with {_GIVEN}, {_DEF}, {_WHO}, d as (select log_id, enc_id, defender, cast(sum(swings) as bigint) as swings, cast(sum(hits) as bigint) as hits, cast(sum(damage) as bigint) as damage, max(max_hit) as max_hit,
 cast(coalesce(sum(swings) filter (category in ('Melee', 'Melee Special')), 0) as bigint) as melee_swings, cast(coalesce(sum(hits) filter (category in ('Melee', 'Melee Special')), 0) as bigint) as melee_hits from def group by 1, 2, 3)
select d.*, coalesce(w.deaths, 0) as deaths, case when melee_swings > 0 then (melee_swings - melee_hits) / melee_swings else 0 end as avoid_rate, case when melee_swings > 0 then melee_hits / melee_swings else 0 end as hit_rate
from d left join who w on w.log_id = d.log_id and w.enc_id = d.enc_id and w.fighter = d.defender""",
    "r_source_tree": f"""with {_GIVEN}, g as (select log_id, enc_id, fighter, case when pet is not null then pet when category = 'Melee' then 'Melee' else source end as grp, source as leaf, amount from given where metric = 'done'),
t as (select log_id, enc_id, fighter, grp, leaf, cast(sum(amount) as bigint) as total, count(*) as hits, grouping(grp) + grouping(leaf) as gg from g group by grouping sets ((log_id, enc_id, fighter), (log_id, enc_id, fighter, grp), (log_id, enc_id, fighter, grp, leaf))),
d as (select *, 3 - gg as depth from t)
select log_id, enc_id, fighter, grp, leaf, total, hits, depth, case when sum(total) over w > 0 then total / sum(total) over w else 0 end as share from d
window w as (partition by log_id, enc_id, depth, case when depth = 1 then '' when depth = 2 then fighter else fighter || chr(1) || grp end)""",
    "r_branch": f"""with {_GIVEN}, {_WHO}, {_SOURCES}, top as (select log_id, enc_id, fighter from who where damage_done > 0 qualify {_RANK} = 1),
b as (select log_id, enc_id, fighter, coalesce(pet || ': ', '') || source as label, cast(sum(total) as bigint) as total from buckets semi join top using (log_id, enc_id, fighter) where metric = 'done' group by all)
select *, case when sum(total) over (partition by log_id, enc_id) > 0 then total / sum(total) over (partition by log_id, enc_id) else 0 end as share from b""",
    "r_class_evidence": f"with {_CLASSES} select * from evid",
    "r_class_labels": f"with {_CLASSES}, r as (select *, row_number() over (partition by log_id, player order by uses desc, class_name) as n from evid) select log_id, player, string_agg(class_name, ' / ' order by n) as label from r where n <= 3 group by 1, 2",
    "r_summaries": f"""with {_GIVEN}, {_WHO}, {_HEADS}, s as (select log_id, enc_id, cast(sum(damage_done) as bigint) as total_damage, cast(sum(deaths) as bigint) as deaths from who group by 1, 2),
t as (select * from who where damage_done > 0 qualify {_RANK} = 1)
select h.log_id, h.enc_id, h.start_ts, {_SECONDS.replace('end_ts', 'h.end_ts').replace('start_ts', 'h.start_ts')} as duration_s, h.title, h.end_reason, t.fighter as top_fighter, coalesce(t.damage_done, 0) / {_SECONDS.replace('end_ts', 'h.end_ts').replace('start_ts', 'h.start_ts')} as top_dps,
 coalesce(s.total_damage, 0) as total_damage, coalesce(s.deaths, 0) as deaths from heads h left join s using (log_id, enc_id) left join t using (log_id, enc_id)""",
    "r_time_range": f"""with {_GIVEN}, {_HEADS}, x as (select log_id, cast(coalesce(sum(amount) filter (metric = 'done'), 0) as bigint) as total_damage, cast(coalesce(sum(amount) filter (metric = 'heal'), 0) as bigint) as total_healing from given group by 1),
h as (select log_id, count(*) as n_encounters, min(start_ts) as start_ts, max(end_ts) as end_ts, sum({_SECONDS}) as duration_s from heads group by 1)
select h.*, coalesce(total_damage, 0) as total_damage, coalesce(total_healing, 0) as total_healing from h left join x using (log_id)""",
    "r_titles": f"with {_GIVEN}, {_MOBS}, r as (select *, count(*) over (partition by log_id, enc_id) - 1 as others from mob qualify row_number() over (partition by log_id, enc_id order by damage_taken desc, first_seq, mob) = 1) select log_id, enc_id, mob || case when others > 0 then ' +' || others else '' end as title from r",
    "r_chat_line": f"""with {_GIVEN}, {_WHO}, r as (select log_id, enc_id, fighter || ' ' || {_COMPACT} as t, {_RANK} as n from who where damage_done > 0),
c as (select *, sum(length(t) + 3) over (partition by log_id, enc_id order by n) - 3 as used from r)
select log_id, enc_id, string_agg(t, ' | ' order by n) filter (used <= 480) || case when count(*) filter (used > 480) > 0 then ' (+' || count(*) filter (used > 480) || ' more)' else '' end as line from c group by 1, 2""",
    "r_selected": f"with {_GIVEN}, {_HEADS} select log_id, enc_id, cast(coalesce(sum(amount) filter (metric = 'done'), 0) as bigint) as total_damage, cast(coalesce(sum(amount) filter (metric = 'heal'), 0) as bigint) as total_healing from given semi join (select * from heads where end_reason = 'all_mobs_dead') h using (log_id, enc_id) group by 1, 2",
    "r_unlisted": f"with {_CLEAN}, {_HEADS} select log_id, enc_id, count(*) as n_events from clean anti join heads using (log_id, enc_id) where enc_id is not null group by 1, 2",
    "l_other_logs": "select log_id, count(distinct line_no) as n_lines from raw_lines where log_id not in (select log_id from combat_events where log_id is not null) and log_id is not null group by 1",
    "o_final_owner": f"select log_id, {_k('pet')} as pet, max(struct_pack(l := line_no, o := {_k('owner')})).o as owner from pet_tags group by 1, 2",
    "o_owner_asof": f"""with {_CLEAN}, tags as (select log_id, line_no, {_k('pet')} as pet, max({_k('owner')}) as owner from pet_tags group by 1, 2, 3)
select c.log_id, c.line_no, c.attacker as pet, t.owner as owner_asof from clean c asof join tags t on c.log_id = t.log_id and c.attacker = t.pet and c.line_no >= t.line_no""",
    "s_sessions_of_users": """with g as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over w) <= 21600000000 then 0 else 1 end as f from events window w as (partition by user_id order by ts)),
s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
select user_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as n_events from s group by user_id, sid""",
}
