"""Queries over lines rendered from other tables whose results are known by construction, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.times import stamp_text
from skirmish.operators.log_entries import log_entries
from skirmish.operators.parse import parse_lines, split_lines, unparsed_shapes
from skirmish.plans import report
from skirmish.plans.pipeline import Battle, analyze
from skirmish.session import cut_lineage, load

START = "2026-09-03 20:00:00"
GAME_STAMP = "EEE MMM dd HH:mm:ss yyyy"
A, B = "a cinder wolf", "a smoke imp"

# One line for each way a rule is met; {n} is the amount. Then what it must be read as:
# outcome, rule, action, attacker, target, mechanic, verb, spell, miss reason, owner, zone, and whether it has the amount.
LINES = [
    ("You have entered the Ashen Hall.", "zone", "R1", "", "", "", "", "", "", "", "", "the Ashen Hall", False),
    ("You have entered an instanced version of the zone.", "ignored", "R1", "", "", "", "", "", "", "", "", "", False),
    ("a cinder wolf has been slain by Bron!", "event", "R2", "death", "Bron", A, "", "", "", "", "", "", False),
    ("You have slain a smoke imp!", "event", "R3", "death", "Mira", B, "", "", "", "", "", "", False),
    ("You have been slain by a smoke imp!", "event", "R4", "death", B, "Mira", "", "", "", "", "", "", False),
    ("Bron scores a critical hit! ({n})", "crit", "R5", "", "", "", "", "", "", "", "", "", True),
    ("You deliver a critical blast! ({n}) (Ember Lance)", "crit", "R5", "", "", "", "", "", "Ember Lance", "", "", "", True),
    ("Bron has shielded Mira from {n} points of damage.", "ignored", "R6", "", "", "", "", "", "", "", "", "", False),
    ("The Spellshield absorbed {n} of {n} points of damage", "ignored", "R7", "", "", "", "", "", "", "", "", "", False),
    ("Your rune absorbs {n} points of damage.", "ignored", "R8", "", "", "", "", "", "", "", "", "", False),
    ("You have taken {n} points of damage.", "event", "R9", "damage", "", "Mira", "non_melee", "", "", "", "", "", True),
    ("You have been healed for {n} points of damage. (Mending Rain)", "event", "R10", "heal", "", "Mira", "", "", "Mending Rain", "", "", "", True),
    ("Bron has healed Vexa for {n} points of damage. (Mending Rain)", "event", "R11", "heal", "Bron", "Vexa", "", "", "Mending Rain", "", "", "", True),
    ("Bron has healed himself for {n} points of damage.", "event", "R11", "heal", "Bron", "Bron", "", "", "", "", "", "", True),
    ("Grub (Owner: Bron) has healed Vexa for {n} points of damage. (Mending Rain)", "event", "R12", "heal", "Grub", "Vexa", "", "", "Mending Rain", "", "Bron", "", True),
    ("You heal Vexa for {n} points of damage. (Light)", "event", "R13", "heal", "Mira", "Vexa", "", "", "Light", "", "", "", True),
    ("a smoke imp has taken {n} damage from Venom by Bron.", "event", "R14", "damage", "Bron", B, "non_melee", "", "Venom", "", "", "", True),
    ("a smoke imp has taken {n} damage from your Venom.", "event", "R15", "damage", "Mira", B, "non_melee", "", "Venom", "", "", "", True),
    ("Bron`s Doppelganger hits a smoke imp for {n} points of damage.", "event", "R16", "damage", "Bron`s Doppelganger", B, "melee", "hit", "", "", "Bron", "", True),
    ("Bron`s Ember Sprite hit a smoke imp for {n} points of non-melee damage. (Ember Lance)", "event", "R16", "damage", "Bron`s Ember Sprite", B, "non_melee", "", "Ember Lance", "", "Bron", "", True),
    ("Bron`s Doppelganger tries to bash a smoke imp, but a smoke imp dodges!", "event", "R17", "miss", "Bron`s Doppelganger", B, "melee_special", "bash", "", "dodge", "", "", False),
    ("a smoke imp was hit by non-melee for {n} points of damage.", "event", "R18", "damage", "", B, "damage_shield", "", "", "", "", "", True),
    ("Bron hit a smoke imp for {n} points of non-melee damage. (Ember Lance)", "event", "R19", "damage", "Bron", B, "non_melee", "", "Ember Lance", "", "", "", True),
    ("Grub (Owner: Bron) hit a smoke imp for {n} points of non-melee damage. (Ember Lance)", "event", "R20", "damage", "Grub", B, "non_melee", "", "Ember Lance", "", "Bron", "", True),
    ("You crush a smoke imp for {n} points of damage.", "event", "R21", "damage", "Mira", B, "melee", "crush", "", "", "", "", True),
    ("You kick a smoke imp for {n} points of damage.", "event", "R21", "damage", "Mira", B, "melee_special", "kick", "", "", "", "", True),
    ("You try to crush a smoke imp, but miss!", "event", "R22", "miss", "Mira", B, "melee", "crush", "", "miss", "", "", False),
    ("You try to crush a smoke imp, but a smoke imp parries!", "event", "R22", "miss", "Mira", B, "melee", "crush", "", "parry", "", "", False),
    ("A smoke imp bites YOU for {n} points of damage.", "event", "R23", "damage", B, "Mira", "melee", "bite", "", "", "", "", True),
    ("Bron slashes a smoke imp for {n} points of damage.", "event", "R24", "damage", "Bron", B, "melee", "slash", "", "", "", "", True),
    ("Bron frenzies on a smoke imp for {n} points of damage.", "event", "R24", "damage", "Bron", B, "melee_special", "frenzy", "", "", "", "", True),
    ("Grub (Owner: Bron) bites a smoke imp for {n} points of damage. (Venom Bite)", "event", "R25", "damage", "Grub", B, "melee", "bite", "", "", "Bron", "", True),
    ("a smoke imp tries to bite Bron, but Bron blocks with his shield!", "event", "R26", "miss", B, "Bron", "melee", "bite", "", "block", "", "", False),
    ("a smoke imp tries to bite Bron, but Bron is INVULNERABLE!", "event", "R26", "miss", B, "Bron", "melee", "bite", "", "invulnerable", "", "", False),
    ("a smoke imp tries to bite Bron, but Bron's magical skin absorbs the blow!", "event", "R26", "miss", B, "Bron", "melee", "bite", "", "rune", "", "", False),
    ("Odd forces deal {n} points of damage to nobody", "unparsed", "", "", "", "", "", "", "", "", "", "", False),
    ("Strange light has taken {n} damage away", "unparsed", "", "", "", "", "", "", "", "", "", "", False),
    ("You feel hungry.", "none", "", "", "", "", "", "", "", "", "", "", False),
]
FIELDS = ["outcome", "rule_id", "action", "attacker", "target", "mechanic", "verb", "spell", "miss_reason", "owner", "zone"]

# Fights of one hero Mira, one per log: (seconds, message); {n} is the damage of a blow.
_HIT_A, _HIT_B = f"You crush {A} for {{n}} points of damage.", f"You crush {B} for {{n}} points of damage."
_KILL_A, _KILL_B = f"You have slain {A}!", f"You have slain {B}!"
FIGHTS = [
    [(0, _HIT_A), (2, _HIT_A), (3, _KILL_A)],
    [(0, _HIT_A), (5, _HIT_A), (120, _HIT_B), (125, _HIT_B)],
    [(0, _HIT_A), (3, _HIT_A), (48, _HIT_A), (51, _HIT_A)],
    [(0, _HIT_A), (3, _HIT_A), (49, _HIT_A), (52, _HIT_A)],
    [(0, _HIT_A), (100, _HIT_B), (104, _HIT_B)],
    [(0, _HIT_A), (3, _KILL_A), (10, _HIT_B), (13, _KILL_B)],
    [(0, _HIT_A), (3, _HIT_A), (6, _HIT_A), (8, "You have entered Elsewhere."), (20, _HIT_B), (24, _HIT_B)],
    [(0, _HIT_A), (5, "A cinder wolf hits YOU for 5 points of damage."), (6, f"You have been slain by {A}!"), (10, "You have entered Home."), (30, "You have entered Ashen Hall."), (45, _HIT_A), (80, _KILL_A)],
    [(s, _HIT_A) for s in range(0, 641, 40)],
    [(0, _HIT_A), (5, _HIT_A), (10, _HIT_A), (12, _KILL_A)],
    [(0, f"Grub bites {A} for 7 points of damage."), (1, f"Grub (Owner: Mira) bites {A} for 9 points of damage."), (2, f"Bron`s Doppelganger hits {A} for 4 points of damage."), (2, "Bron has healed Mira for 30 points of damage. (Light)"), (3, f"{A} has been slain by Bron!")],
    [(0, _HIT_A), (1, "You score a critical hit! ({n})"), (4, _KILL_A)],
]
SPLIT_FIGHT, SPLIT_AT = 9, 8
# fight, enc_id, start, end, reason, title, zone, killed, fallen, blows of n, other damage
HEADERS = [
    (0, 1, 0, 3, "all_mobs_dead", A, "", A, "", 2, 0),
    (1, 1, 0, 5, "idle", A, "", "", "", 2, 0),
    (1, 2, 120, 125, "log_end", B, "", "", "", 2, 0),
    (2, 1, 0, 51, "log_end", A, "", "", "", 4, 0),
    (3, 1, 0, 3, "idle", A, "", "", "", 2, 0),
    (3, 2, 49, 52, "log_end", A, "", "", "", 2, 0),
    (4, 2, 100, 104, "log_end", B, "", "", "", 2, 0),
    (5, 1, 0, 13, "all_mobs_dead", A + " +1", "", f"{A}|{B}", "", 2, 0),
    (6, 1, 0, 6, "zone_change", A, "", "", "", 3, 0),
    (6, 2, 20, 24, "log_end", B, "Elsewhere", "", "", 2, 0),
    (7, 1, 0, 80, "all_mobs_dead", A, "", A, "Mira", 2, 0),
    (8, 1, 0, 600, "time_cap", A, "", "", "", 15, 0),
    (8, 2, 600, 640, "log_end", A, "", "", "", 2, 0),
    (9, 1, 0, 8, "manual", A, "", "", "", 2, 0),
    (9, 2, 10, 12, "all_mobs_dead", A, "", A, "", 1, 0),
    (10, 1, 0, 3, "all_mobs_dead", A, "", A, "", 0, 20),
    (11, 1, 0, 4, "all_mobs_dead", A, "", A, "", 1, 0),
]
# fight, enc_id, fighter, blows of n, other damage, damage taken, deaths, critical hits, pets, healing
FIGHTERS = [
    *[(f, e, "Mira", blows, 0, 5 if f == 7 else 0, int(f == 7), int(f == 11), "", 0) for f, e, *_, blows, other in HEADERS if not other],
    (10, 1, "Mira", 0, 16, 0, 0, 0, "Grub", 0),
    (10, 1, "Bron", 0, 4, 0, 0, 0, "Bron`s Doppelganger", 30),
]


def _at(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit(START).cast("timestamp_ntz"))


def _stamped(ts: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, GAME_STAMP), F.lit("] "), message)


def planted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as one of LINES in one log."""
    told = spark.createDataFrame([(i, line[0]) for i, line in enumerate(LINES)], "k int, message string")
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("line_no"), (F.col("p_partkey") % len(LINES)).cast("int").alias("k"))
    n = (F.col("line_no") % 997 + 1).cast("string")
    raw = _stamped(_at(F.col("line_no")), F.replace("message", F.lit("{n}"), n))
    return parts.join(told, "k").select(F.lit("Mira_test").alias("log_id"), "line_no", raw.alias("raw"))


def t_planted_rules(spark, sf_dir):
    """Lines of every rule with all their fields."""
    out = parse_lines(split_lines(planted_lines(spark, sf_dir))).withColumnRenamed("owner_hint", "owner")
    return out.groupBy(*[F.coalesce(c, F.lit("")).alias(c) for c in FIELDS]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("amount", F.lit(0))).alias("amount"))


def t_planted_unparsed(spark, sf_dir):
    """Shapes of damage-like lines that no rule reads."""
    return unparsed_shapes(parse_lines(split_lines(planted_lines(spark, sf_dir)))).drop("example")


def planted_battle(spark: SparkSession, sf_dir: str) -> Battle:
    """Every customer as a log with one of FIGHTS, through the whole batch pipeline."""
    told = spark.createDataFrame([(k, i, s, m) for k, fight in enumerate(FIGHTS) for i, (s, m) in enumerate(fight, 1)], "k int, line_no int, s int, message string")
    logs = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("c"), (F.col("c_custkey") % len(FIGHTS)).cast("int").alias("k"))
    log_id = F.concat(F.lit("Mira_"), F.col("c").cast("string")).alias("log_id")
    n = (F.col("c") % 89 + 11).cast("string")
    lines = logs.join(told, "k").select(log_id, "line_no", _stamped(_at(F.col("c") + F.col("s")), F.replace("message", F.lit("{n}"), n)).alias("raw"))
    splits = logs.where(F.col("k") == SPLIT_FIGHT).select(log_id, _at(F.col("c") + SPLIT_AT).alias("ts"))
    return analyze(lines, splits=splits)


def t_planted_fights(spark, sf_dir):
    """Headers of fights that end in every way, one log each."""
    heads = planted_battle(spark, sf_dir).encounters
    damage = F.aggregate(F.map_values("npc_damage"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    joined = {c: F.array_join(c, "|") for c in ("npcs_killed", "player_deaths")}
    return heads.select("log_id", "enc_id", "start_ts", "end_ts", "end_reason", "title", F.coalesce("zone", F.lit("")).alias("zone"), *[e.alias(c) for c, e in joined.items()], damage.alias("damage"))


def t_planted_fighters(spark, sf_dir):
    """Fighters of the same fights, pets with their owners, damage and healing per second."""
    battle = planted_battle(spark, sf_dir)
    who = report.fighters(report.credits(battle.events.where("enc_id is not null")))
    rates = report.per_second(who, battle.encounters)
    return rates.select("log_id", "enc_id", "fighter", "damage_done", "damage_taken", "deaths", "crit_hits", F.array_join("pets", ",").alias("pets"), "dps", "hps")


LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]
COMPONENTS = ["disk", "net.sync", "Zone9", "audio-cue"]


def p2_planted(spark, sf_dir):
    """Every order as an entry of one or three lines, in eight layouts no list knows."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("k") % 6 + 1).cast("int"))
    comp = F.element_at(F.array(*[F.lit(x) for x in COMPONENTS]), (F.col("k") % 4 + 1).cast("int"))
    ts, big, msg = _at(F.col("k")), F.upper(level), F.concat(F.lit("took "), F.col("k").cast("string"), F.lit(" ms on shelf 7"))

    def day(pattern: str) -> Column:
        return F.date_format(ts, pattern)

    layouts = [
        F.concat(day("yyyy/MM/dd HH:mm:ss"), F.lit(" "), big, F.lit(" "), comp, F.lit(": "), msg),
        F.concat(big, F.lit("|"), comp, F.lit("|"), day("yyyy-MM-dd HH:mm:ss"), F.lit("| "), msg),
        F.concat(day("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" <"), big, F.lit("> ("), comp, F.lit(") "), msg),
        F.concat(day("dd.MM.yyyy HH:mm:ss"), F.lit(" - "), comp, F.lit(" ["), big, F.lit("] "), msg),
        F.concat(day("MMM d HH:mm:ss"), F.lit(" host "), comp, F.lit("[77]: "), msg),
        F.concat(F.lit('{"msg":"'), msg, F.lit('","severity":"'), big, F.lit('","module":"'), comp, F.lit('","time":"'), day("yyyy-MM-dd HH:mm:ss"), F.lit('"}')),
        F.concat(F.unix_timestamp(ts.cast("string")).cast("string"), F.lit(" "), big, F.lit(" "), comp, F.lit(" - "), msg),
        F.concat(F.lit("lvl="), level, F.lit(" logger="), comp, F.lit(" ts="), day("yyyy-MM-dd'T'HH:mm:ss"), F.lit(' msg="'), msg, F.lit('"')),
    ]
    layout = (F.col("k") % 7 + F.floor(F.col("k") / 7) % 2).cast("int")
    texts = F.element_at(F.array(*layouts), layout + 1)
    more = F.when(F.col("k") % 5 == 0, F.array(texts, F.lit("  at shelf 7"), F.concat(F.lit("> "), day("HH:mm:ss"), F.lit(" quoted")))).otherwise(F.array(texts))
    rows = o.select("k", layout.alias("layout"), F.posexplode(more).alias("part", "raw"))
    # written once: line numbers come from a window over each file
    log_id = F.concat(F.lit("file"), F.col("layout").cast("string"), F.lit("_"), F.floor(F.col("k") / 20_000).cast("string"))
    placed = cut_lineage(rows.select(log_id.alias("log_id"), F.lit("/logs/plant/2026/x.log").alias("file_path"), "k", "part", "raw"))
    lines = placed.select("log_id", "file_path", F.expr("row_number() over (partition by log_id order by k, part)").alias("line_no"), "raw")
    return log_entries(lines, with_message=False).withColumn("entry_ts", stamp_text("entry_ts"))


QUERIES = {f.__name__: f for f in (t_planted_rules, t_planted_unparsed, t_planted_fights, t_planted_fighters, p2_planted)}


def _values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_N = "(c_custkey % 89 + 11)"
_LOG = f"(select c_custkey, 'Mira_' || c_custkey as log_id, timestamp '{START}' + to_seconds(c_custkey) as t0, {_N} as n, c_custkey % {len(FIGHTS)} as k from customer)"
_LEVEL = "case k % 6 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(LEVELS)) + " end"
_COMP = "case k % 4 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(COMPONENTS)) + " end"

ORACLES = {
    "t_planted_rules": f"""select {', '.join(FIELDS)}, count(*) as n, cast(sum(case when counts then p_partkey % 997 + 1 else 0 end) as bigint) as amount
 from part join (values {_values([(i, *line[1:]) for i, line in enumerate(LINES)])}) v(k, {', '.join(FIELDS)}, counts) on p_partkey % {len(LINES)} = v.k group by all""",
    "t_planted_unparsed": f"""select shape, count(*) as n from part join (values {_values([(i, line[0].replace('{n}', '#')) for i, line in enumerate(LINES) if line[1] == 'unparsed'])}) v(k, shape) on p_partkey % {len(LINES)} = v.k group by 1""",
    "t_planted_fights": f"""select log_id, enc_id, t0 + to_seconds(a) as start_ts, t0 + to_seconds(b) as end_ts, end_reason, title, zone, npcs_killed, player_deaths, cast(blows * n + other as bigint) as damage
 from {_LOG} join (values {_values(HEADERS)}) v(k, enc_id, a, b, end_reason, title, zone, npcs_killed, player_deaths, blows, other) using (k)""",
    "t_planted_fighters": f"""select log_id, enc_id, fighter, cast(w.blows * n + w.other as bigint) as damage_done, cast(taken as bigint) as damage_taken, deaths, crit_hits, pets,
 (w.blows * n + w.other) / greatest(1.0, cast(b - a as double)) as dps, healed / greatest(1.0, cast(b - a as double)) as hps
 from {_LOG} join (values {_values(FIGHTERS)}) w(k, enc_id, fighter, blows, other, taken, deaths, crit_hits, pets, healed) using (k)
 join (values {_values([h[:4] for h in HEADERS])}) h(k, enc_id, a, b) using (k, enc_id)""",
    "p2_planted": f"""with o as (select o_orderkey as k, o_orderkey % 7 + (o_orderkey // 7) % 2 as layout, case when o_orderkey % 5 = 0 then 3 else 1 end as n from orders),
p as (select *, 'file' || layout || '_' || (k // 20000) as log_id from o),
l as (select *, sum(n) over (partition by log_id order by k) as last_line from p)
select log_id, cast(last_line - n + 1 as integer) as first_line, cast(last_line as integer) as last_line, strftime(timestamp '{START}' + to_seconds(k), '%Y-%m-%d %H:%M:%S') as entry_ts,
 case when layout = 4 then '' else {_LEVEL} end as log_level, {_COMP} as component from l""",
}
