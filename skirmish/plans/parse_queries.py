"""Queries over raw log lines, and tables rendered as log lines and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators.crits import associate_crits
from skirmish.operators.owners import ownership_tags
from skirmish.operators.parse import line_shape, parse_lines, parser_metrics, split_lines, unparsed_shapes
from skirmish.plans import report
from skirmish.plans.pipeline import Battle, analyze
from skirmish.plans.queries import as_text
from skirmish.session import cut_lineage, load, spread
from skirmish.sources.logs import character_of, log_identity, retro_window, server_of

STAMP = "EEE MMM dd HH:mm:ss yyyy"


def game_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game log lines, each once."""
    rows = load(spark, sf_dir, "raw_lines").where("file_path like '/logs/game/%'")
    return rows.groupBy("log_id", "line_no").agg(F.min("raw").alias("raw"))


def l_rule_counts(spark, sf_dir):
    """Lines per outcome and rule."""
    return parse_lines(split_lines(game_lines(spark, sf_dir))).groupBy("outcome", F.coalesce("rule_id", F.lit("")).alias("rule_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def l_metrics(spark, sf_dir):
    """Parser metrics and coverage per log."""
    lines = game_lines(spark, sf_dir)
    return parser_metrics(lines, parse_lines(split_lines(lines)))


def l_unparsed_shapes(spark, sf_dir):
    """Shapes of damage-like lines that no rule reads."""
    return unparsed_shapes(parse_lines(split_lines(game_lines(spark, sf_dir)))).drop("example")


def l_line_shapes(spark, sf_dir):
    """shapes of the lines no rule is about, with their counts."""
    rows = parse_lines(split_lines(game_lines(spark, sf_dir))).where("outcome = 'none'")
    return rows.groupBy(line_shape(F.col("message")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def l_pet_tags(spark, sf_dir):
    """L2, O1: ownership stated on lines."""
    return ownership_tags(parse_lines(split_lines(game_lines(spark, sf_dir))))


def l_log_identity(spark, sf_dir):
    """Identity, character and server from file names."""
    paths = load(spark, sf_dir, "raw_lines").where("file_path like '/logs/game/%'").select("file_path").distinct()
    ident = log_identity(F.col("file_path"))
    return paths.select("file_path", ident.alias("identity"), character_of(ident).alias("character"), server_of(ident).alias("server"))


def l_retro_window(spark, sf_dir):
    """Lines from the first one of the last days before a fixed time on."""
    lines = split_lines(game_lines(spark, sf_dir))
    out = retro_window(lines, 14 * 24 * 60, F.lit("2019-03-29 20:00:00").cast("timestamp_ntz"))
    return out.groupBy("log_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


def _stamped(ts: Column, message: Column) -> Column:
    """A log line; the stamp is formatted without a time zone's influence (UTC in, UTC out)."""
    return F.concat(F.lit("["), F.date_format(ts, STAMP), F.lit("] "), message)


def rendered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log lines of one log per user group: swings, misses, heals and spells."""
    e = spread(load(spark, sf_dir, "events"))
    who = F.concat(F.lit("U"), F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij"))
    n = (F.floor("value") + 1).cast("bigint").cast("string")
    reasons = ["miss", "a warrior parries", "a warrior dodges", "a warrior blocks with shield", "a warrior ripostes", "a warrior is INVULNERABLE", "a warrior's magical skin absorbs the blow"]
    reason = F.element_at(F.array(*[F.lit(r) for r in reasons]), (F.col("event_id") % 7 + 1).cast("int"))
    msg = (
        F.when(F.col("event_type") == "error", F.concat(who, F.lit(" tries to crush a warrior, but "), reason, F.lit("!")))
        .when(F.col("event_type") == "purchase", F.concat(who, F.lit(" has healed Mira for "), n, F.lit(" points of damage. (Mending Rain)")))
        .when(F.col("event_type") == "signup", F.concat(who, F.lit(" hit a warrior for "), n, F.lit(" points of non-melee damage. (Ember Lance)")))
        .otherwise(F.concat(who, F.lit(" crushes a "), F.col("event_type"), F.lit(" for "), n, F.lit(" points of damage.")))
    )
    return e.select(F.lit("Mira_test").alias("log_id"), F.col("event_id").cast("int").alias("line_no"), _stamped(F.col("ts"), msg).alias("raw"))


def t_events_roundtrip(spark, sf_dir):
    """L1-L3: rendered events read back, summed by action, target, spell and reason."""
    out = parse_lines(split_lines(rendered_events(spark, sf_dir)))
    return out.groupBy("action", "target", F.coalesce("spell", F.lit("")).alias("spell"), F.coalesce("miss_reason", F.lit("")).alias("miss_reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def t_damage_by_attacker(spark, sf_dir):
    """A1 on rendered events: damage and hits of every attacker on every target."""
    out = parse_lines(split_lines(rendered_events(spark, sf_dir))).where("action = 'damage'")
    return out.groupBy("attacker", "target").agg(F.sum("amount").alias("damage"), F.count(F.lit(1)).alias("hits"), F.max("amount").alias("max_hit"))


def t_lineitem_parse(spark, sf_dir):
    """Parse throughput: every line item as a melee line, read back and summed by supplier, verb and target."""
    li, part = spread(load(spark, sf_dir, "lineitem")), load(spark, sf_dir, "part")
    verb = F.when(F.col("l_returnflag") == "A", "slashes").when(F.col("l_returnflag") == "N", "crushes").otherwise("kicks")
    who = F.concat(F.lit("S"), F.translate(F.col("l_suppkey").cast("string"), "0123456789", "abcdefghij"))
    msg = F.concat(who, F.lit(" "), verb, F.lit(" a "), F.col("p_name"), F.lit(" for "), F.floor("l_quantity").cast("string"), F.lit(" points of damage."))
    lines = li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.concat(F.lit("Log"), F.col("l_suppkey").cast("string"), F.lit("_x")).alias("log_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("line_no"), _stamped(F.col("l_shipdate"), msg).alias("raw")
    )
    out = parse_lines(split_lines(lines)).where("outcome = 'event'")
    return out.groupBy("attacker", "verb", "mechanic", "target").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("hits"))


def t_crits(spark, sf_dir):
    """Every seventh swing is followed by a marker of its amount one second later; flagged hits and damage."""
    e = load(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "ts", (F.floor("value") + 1).cast("bigint").alias("n"))
    hit = e.select(F.lit("Mira_test").alias("log_id"), (F.col("event_id") * 2).cast("int").alias("line_no"), _stamped(F.col("ts"), F.concat(F.lit("You crush a warrior for "), F.col("n").cast("string"), F.lit(" points of damage."))).alias("raw"))
    mark = e.where("event_id % 7 = 0").select(F.lit("Mira_test").alias("log_id"), (F.col("event_id") * 2 + 1).cast("int").alias("line_no"), _stamped(F.col("ts") + F.expr("interval 1 second"), F.concat(F.lit("You score a critical hit! ("), F.col("n").cast("string"), F.lit(")"))).alias("raw"))
    parsed = cut_lineage(parse_lines(split_lines(hit.unionByName(mark))))
    out = associate_crits(parsed).where("outcome = 'event'")
    return out.groupBy("is_critical").agg(F.count(F.lit(1)).alias("hits"), F.sum("amount").alias("damage"))


def _battle(spark: SparkSession, sf_dir: str) -> Battle:
    """The whole batch pipeline on the raw game logs and the split markers."""
    marks = load(spark, sf_dir, "split_markers").where("kind = 0").select("log_id", "ts").distinct()
    return analyze(game_lines(spark, sf_dir), splits=marks)


def b_battle_encounters(spark, sf_dir):
    """The whole batch pipeline on the raw game logs: encounter headers."""
    return as_text(_battle(spark, sf_dir).encounters)


def b_battle_fighters(spark, sf_dir):
    """The whole batch pipeline on the raw game logs: fighters of every encounter."""
    ev = _battle(spark, sf_dir).events.where("enc_id is not null")
    return report.fighters(report.credits(ev)).drop("first_seq", "fighter_key").withColumn("pets", F.array_join("pets", ","))


QUERIES = {
    f.__name__: f
    for f in (
        l_rule_counts, l_metrics, l_unparsed_shapes, l_line_shapes, l_pet_tags, l_log_identity, l_retro_window, t_events_roundtrip, t_damage_by_attacker, t_lineitem_parse, t_crits,
        b_battle_encounters, b_battle_fighters,
    )
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# The twins read lines by patterns of their own, in the order of the rules; the amount is the pattern's group n, if any.
_VERB = "hits|crushes|slashes|pierces|bites|claws|gores|stings|mauls|smashes|slams|rends|burns|freezes|slices|kicks|punches|bashes|backstabs|strikes|frenzies on"
_FOR = r"for (?P<n>\d+) points? of damage\."
_MAGIC = r"for (?P<n>\d+) points? of non-melee damage\."
_AFTER = r"( \(.+\))?$"
_READ = [
    ("R1", r"^You have entered .+\.$", "zone"),
    ("R2", r"^.+ has been slain by .+!$", "event"),
    ("R3", r"^You have slain .+!$", "event"),
    ("R4", r"^You have been slain by .+!$", "event"),
    ("R5", r"^.+ (score a critical hit|scores a critical hit|land a Crippling Blow|lands a Crippling Blow|deliver a critical blast|delivers a critical blast)! \((?P<n>\d+)\)" + _AFTER, "crit"),
    ("R6", r"\b(has|have) shielded .+ from \d+ points? of damage\.", "ignored"),
    ("R7", r"^The Spellshield absorbed \d+ of \d+ points? of damage$", "ignored"),
    ("R8", r"\babsorbs? \d+ (of \d+ )?points? of damage", "ignored"),
    ("R9", r"^You have taken (?P<n>\d+) points? of damage\.$", "event"),
    ("R10", "^You have been healed " + _FOR + _AFTER, "event"),
    ("R11", "^.+ (has|have) healed .+ " + _FOR + _AFTER, "event"),
    ("R12", "^(has|have) healed .+ " + _FOR + _AFTER, "event"),
    ("R13", "^You heal .+ " + _FOR + _AFTER, "event"),
    ("R14", r"^.+ has taken (?P<n>\d+) damage from .+ by .+\.$", "event"),
    ("R15", r"^.+ has taken (?P<n>\d+) damage from your .+\.$", "event"),
    ("R16", rf"^[A-Z][A-Za-z`'-]+`s [A-Z][A-Za-z '-]+ (hit|{_VERB}) .+ for (?P<n>\d+) points? of (non-melee )?damage\." + _AFTER, "event"),
    ("R17", r"^[A-Z][A-Za-z`'-]+`s [A-Z][A-Za-z '-]+ tries to [a-z]+ .+, but [^!]+!$", "event"),
    ("R18", r"^.+ was hit by non-melee for (?P<n>\d+) points? of damage\.$", "event"),
    ("R19", "^.+ hit .+ " + _MAGIC + _AFTER, "event"),
    ("R20", "^hit .+ " + _MAGIC + _AFTER, "event"),
    ("R21", "^You [a-z]+ .+ " + _FOR + _AFTER, "event"),
    ("R22", r"^You try to [a-z]+ .+, but [^!]+!$", "event"),
    ("R23", "^.+ [a-z]+ YOU " + _FOR + _AFTER, "event"),
    ("R24", f"^.+ ({_VERB}) .+ " + _FOR + _AFTER, "event"),
    ("R25", f"^({_VERB}) .+ " + _FOR + _AFTER, "event"),
    ("R26", r"^.+ tries to [a-z]+ .+, but [^!]+!$", "event"),
]
_PET = r"^([A-Z][A-Za-z`'-]+) \(Owner: ([A-Z][A-Za-z`'-]+)\) (.+)$"
_SWARM = r"^([A-Z][A-Za-z`'-]+?)`s ([A-Z][A-Za-z '-]+?) (?:tries to |(?:hit|" + _VERB + ") )"
_RULE = "case " + " ".join(f"when {'tagged and ' if i == 'R12' else ''}regexp_matches(msg, {_q(p)}) then '{i}'" for i, p, _ in _READ) + " end"
_AMOUNT = "coalesce(try_cast(case rule " + " ".join(f"when '{i}' then regexp_extract(msg, {_q('(?:for|taken) (\\d+) (?:points?|damage)' if i != 'R5' else '! \\((\\d+)\\)')}, 1)" for i, p, _ in _READ if "?P<n>" in p) + " end as bigint), 0)"
_OUTCOME = "case when rule = 'R1' and lower(msg) = 'you have entered an instanced version of the zone.' then 'ignored' " + " ".join(
    f"when rule in ({', '.join(_q(i) for i, _, o in _READ if o == kind)}) then '{kind}'" for kind in ("event", "crit", "zone", "ignored")
) + " when regexp_matches(msg, '(?i)points? of (non-melee )?damage|has taken \\d+ damage') then 'unparsed' else 'none' end"
_PARSED = f"""lines as (select log_id, line_no, min(raw) as raw from raw_lines where file_path like '/logs/game/%' group by 1, 2),
cut as (select log_id, line_no, regexp_extract(regexp_replace(replace(raw, chr(65279), ''), '\\r$', ''), '^\\[([A-Z][a-z]{{2}}) ([A-Z][a-z]{{2}} \\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}} \\d{{4}})\\] (.*)$', ['wd', 'at', 'message']) as p from lines),
stamped as (select log_id, line_no, try_strptime(p.at, '%b %d %H:%M:%S %Y') as ts, p.message as message from cut where p.at <> '' and try_strptime(p.at, '%b %d %H:%M:%S %Y') is not null and strftime(try_strptime(p.at, '%b %d %H:%M:%S %Y'), '%a') = p.wd),
tagged as (select *, regexp_matches(message, {_q(_PET)}) as tagged, case when regexp_matches(message, {_q(_PET)}) then regexp_extract(message, {_q(_PET)}, 3) else message end as msg from stamped),
ruled as (select *, {_RULE} as rule from tagged),
parsed as (select *, {_OUTCOME} as outcome, {_AMOUNT} as amount from ruled)"""
_WHO = "'U' || translate(user_id::varchar, '0123456789', 'abcdefghij')"
_N = "cast(floor(value) as bigint) + 1"

ORACLES = {
    "l_rule_counts": f"with {_PARSED} select outcome, coalesce(rule, '') as rule_id, count(*) as n, cast(sum(case when outcome in ('event', 'crit') then amount end) as bigint) as amount from parsed group by 1, 2",
    "l_metrics": f"""with {_PARSED}, t as (select log_id, count(*) as total_lines from lines group by 1),
b as (select log_id, count(*) as timestamped_lines, count(*) filter (outcome = 'event') as events, count(*) filter (outcome = 'crit') as crit_markers, count(*) filter (outcome = 'zone') as zone_changes, count(*) filter (outcome = 'unparsed') as unparsed from parsed group by 1)
select t.log_id, total_lines, coalesce(timestamped_lines, 0) as timestamped_lines, coalesce(events, 0) as events, coalesce(crit_markers, 0) as crit_markers, coalesce(zone_changes, 0) as zone_changes, coalesce(unparsed, 0) as unparsed,
 case when timestamped_lines > 0 then 1 - unparsed / timestamped_lines else 1.0 end as coverage from t left join b using (log_id)""",
    "l_unparsed_shapes": f"with {_PARSED} select regexp_replace(message, '\\d+', '#', 'g') as shape, count(*) as n from parsed where outcome = 'unparsed' group by 1",
    "l_line_shapes": f"with {_PARSED} select regexp_replace(message, '\\d+', '#', 'g') as shape, count(*) as n from parsed where outcome = 'none' group by 1",
    "l_pet_tags": f"""with {_PARSED} select log_id, line_no, case when rule in ('R16', 'R17') then regexp_extract(msg, {_q(_SWARM)}, 1) || '`s ' || regexp_extract(msg, {_q(_SWARM)}, 2) else regexp_extract(message, {_q(_PET)}, 1) end as pet,
 case when rule in ('R16', 'R17') then regexp_extract(msg, {_q(_SWARM)}, 1) else regexp_extract(message, {_q(_PET)}, 2) end as owner from parsed where tagged or rule in ('R16', 'R17')""",
    "l_log_identity": "with p as (select distinct file_path, regexp_replace(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\\.txt$', ''), '\\.\\d{8}-\\d{6}(-\\d+)?$', '') as stem from raw_lines where file_path like '/logs/game/%'), i as (select file_path, regexp_replace(stem, '^eqlog_', '') as identity from p) select file_path, identity, split_part(identity, '_', 1) as character, nullif(regexp_replace(identity, '^[^_]*_?', ''), '') as server from i",
    "l_retro_window": f"with {_PARSED}, f as (select log_id, min(line_no) as first_line from stamped where ts >= timestamp '2019-03-29 20:00:00' - interval 14 days group by 1) select s.log_id, count(*) as n_lines, min(line_no) as first_line from stamped s join f using (log_id) where line_no >= f.first_line group by 1",
    "t_events_roundtrip": f"""select case event_type when 'error' then 'miss' when 'purchase' then 'heal' else 'damage' end as action,
 case when event_type in ('error', 'signup') then 'a warrior' when event_type = 'purchase' then 'Mira' else 'a ' || event_type end as target,
 case event_type when 'purchase' then 'Mending Rain' when 'signup' then 'Ember Lance' else '' end as spell,
 case when event_type = 'error' then ['miss', 'parry', 'dodge', 'block', 'riposte', 'invulnerable', 'rune'][event_id % 7 + 1] else '' end as miss_reason,
 count(*) as n, cast(sum(case when event_type = 'error' then 0 else {_N} end) as bigint) as amount from events group by all""",
    "t_damage_by_attacker": f"select {_WHO} as attacker, case when event_type = 'signup' then 'a warrior' else 'a ' || event_type end as target, cast(sum({_N}) as bigint) as damage, count(*) as hits, max({_N}) as max_hit from events where event_type not in ('error', 'purchase') group by all",
    "t_lineitem_parse": """select 'S' || translate(l_suppkey::varchar, '0123456789', 'abcdefghij') as attacker, case l_returnflag when 'A' then 'slash' when 'N' then 'crush' else 'kick' end as verb,
 case when l_returnflag in ('A', 'N') then 'melee' else 'melee_special' end as mechanic, 'a ' || p_name as target, cast(sum(cast(floor(l_quantity) as bigint)) as bigint) as total, count(*) as hits
 from lineitem join part on l_partkey = p_partkey group by all""",
    "t_crits": f"select event_id % 7 = 0 as is_critical, count(*) as hits, cast(sum({_N}) as bigint) as damage from events where event_type = 'click' group by 1",
}
