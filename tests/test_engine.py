"""Parser, ownership, crits, roster and encounters on small logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skirmish.functions.names import name_key, resolve_name, term_key
from skirmish.operators.crits import critical_lines, match_marks
from skirmish.operators.encounters import FightMachine, build_encounters
from skirmish.operators.owners import asof_last, with_owners
from skirmish.operators.parse import parse_lines, parser_metrics, split_lines, unparsed_shapes
from skirmish.operators.roster import Roster, learn_roster
from skirmish.plans.parse_queries import b_battle_encounters, b_battle_fighters
from skirmish.plans.pipeline import analyze
from skirmish.plans.report import credits, defense_rollup, defenses, fighters, mobs, sources
from skirmish.schema import Options

T0 = dt.datetime(2026, 9, 3, 20, 0, 0)


def log(spark, entries, log_id="Mira_ashfall"):
    """Entries are (second, message)."""
    rows = [(log_id, i, f"[{T0 + dt.timedelta(seconds=s):%a %b %d %H:%M:%S %Y}] {m}") for i, (s, m) in enumerate(entries, 1)]
    return spark.createDataFrame(rows, "log_id string, line_no int, raw string")


CASES = [
    ("You have entered the Ashen Hall.", dict(outcome="zone", zone="the Ashen Hall")),
    ("You have entered an Instanced Version of the zone.", dict(outcome="ignored")),
    ("a rat has been slain by Bron!", dict(action="death", attacker="Bron", target="a rat")),
    ("You have slain a rat!", dict(action="death", attacker="Mira", target="a rat")),
    ("You have been slain by a rat!", dict(action="death", attacker="a rat", target="Mira")),
    ("You score a critical hit! (812)", dict(outcome="crit", amount=812, crit_is_self=True)),
    ("Bron delivers a critical blast! (90) (Ember Lance)", dict(outcome="crit", amount=90, spell="Ember Lance", crit_is_self=False)),
    ("Bron has shielded itself from 20 points of damage.", dict(outcome="ignored")),
    ("The Spellshield absorbed 5 of 9 points of damage", dict(outcome="ignored")),
    ("Your ward absorbs 1 point of damage", dict(outcome="ignored")),
    ("You have taken 7 points of damage.", dict(rule_id="R9", attacker=None, target="Mira", mechanic="non_melee", amount=7)),
    ("You have been healed for 40 points of damage. (Mending Rain)", dict(rule_id="R10", attacker=None, target="Mira", spell="Mending Rain")),
    ("Bron has healed himself for 41 points of damage.", dict(rule_id="R11", attacker="Bron", target="Bron", amount=41)),
    ("Grub (Owner: Bron) has healed itself for 3 points of damage.", dict(rule_id="R12", attacker="Grub", target="Grub", owner_hint="Bron")),
    ("You heal Bron for 50 points of damage.", dict(rule_id="R13", attacker="Mira", target="Bron")),
    ("a rat has taken 12 damage from Rot by Bron.", dict(rule_id="R14", attacker="Bron", spell="Rot", amount=12)),
    ("a rat has taken 13 damage from your Rot.", dict(rule_id="R15", attacker="Mira", spell="Rot")),
    ("Bron`s Ember Host hits a rat for 9 points of damage.", dict(rule_id="R16", attacker="Bron`s Ember Host", owner_hint="Bron", verb="hit", mechanic="melee", pet_tag="Bron`s Ember Host")),
    ("Bron`s Ember Host hit a rat for 9 points of non-melee damage. (Spark)", dict(rule_id="R16", mechanic="non_melee", verb=None, spell="Spark")),
    ("Bron`s Ember Host tries to bite a rat, but a rat parries!", dict(rule_id="R17", action="miss", miss_reason="parry", verb="bite")),
    ("a rat was hit by non-melee for 6 points of damage.", dict(rule_id="R18", mechanic="damage_shield", attacker=None)),
    ("Bron hit a rat for 100 points of non-melee damage. (Ember Lance)", dict(rule_id="R19", attacker="Bron", spell="Ember Lance")),
    ("Grub (Owner: Bron) hit a rat for 11 points of non-melee damage.", dict(rule_id="R20", attacker="Grub", owner_hint="Bron")),
    ("You kick a rat for 5 points of damage.", dict(rule_id="R21", attacker="Mira", verb="kick", mechanic="melee_special")),
    ("You try to crush a rat, but miss!", dict(rule_id="R22", action="miss", miss_reason="miss")),
    ("A rat bites YOU for 8 points of damage.", dict(rule_id="R23", attacker="a rat", target="Mira", verb="bite")),
    ("Bron  frenzies on the  Old King`s corpse for 8 points of damage. (Venom)", dict(rule_id="R24", attacker="Bron", target="the Old King", verb="frenzy", mechanic="melee_special", spell="Venom")),
    ("Grub (Owner: Bron) bites a rat for 4 points of damage. (Venom)", dict(rule_id="R25", attacker="Grub", spell=None)),
    ("Bron tries to hit a rat, but a rat's magical skin absorbs the blow!", dict(rule_id="R26", miss_reason="rune")),
    ("Something odd did 5 points of damage to it", dict(outcome="unparsed")),
    ("Bron tells you, 'hello'", dict(outcome="none")),
    ("You crush a rat for 99999999999999999999 points of damage.", dict(rule_id="R21", amount=0)),
]


def test_every_rule(spark):
    out = parse_lines(split_lines(log(spark, [(i, m) for i, (m, _) in enumerate(CASES)]))).orderBy("line_no").collect()
    assert len(out) == len(CASES)
    for row, (msg, want) in zip(out, CASES, strict=True):
        for k, v in want.items():
            assert row[k] == v, (msg, k, row[k], v)


def test_stamps(spark):
    raws = ["[Thu Sep 03 20:00:10 2026] ok", "[Fri Sep 03 20:00:10 2026] wrong day", "[Mon Feb 30 20:00:10 2026] none", "[Thu Sep 03 20:00:61 2026] none", "[Thu Sep 03 20:00:10 2026] ", "no stamp", None, "﻿[Sun Mar 08 02:30:00 2026] gap hour\r"]
    df = spark.createDataFrame([("A_b", i, r) for i, r in enumerate(raws)], "log_id string, line_no int, raw string")
    got = {r.line_no: (str(r.ts), r.message) for r in split_lines(df).collect()}
    assert got == {0: ("2026-09-03 20:00:10", "ok"), 4: ("2026-09-03 20:00:10", ""), 7: ("2026-03-08 02:30:00", "gap hour")}


def test_names(spark):
    raws = [" Bron  the   Bold ", "You", "Vexa's corpse", "vexa`S CORPSE", "Gnomiscorpse", "scorpse", "A rat", "The Old King", "an Imp", None, ""]
    df = spark.createDataFrame([(r,) for r in raws], "n string")
    got = [tuple(r) for r in df.select(resolve_name(F.col("n"), F.lit("Mira")), name_key(F.col("n")), term_key(F.col("n"))).collect()]
    assert [g[0] for g in got] == ["Bron the Bold", "Mira", "Vexa", "vexa", "Gnomi", "scorpse", "a rat", "The Old King", "an Imp", None, ""]
    assert got[2][1] == "vexa" and got[0][2] == "bron the bold" and got[10][2] is None


def test_metrics_and_shapes(spark):
    lines = log(spark, [(0, "Odd 12 points of damage 3"), (1, "Odd 7 points of damage 44"), (2, "You hit a rat for 1 points of damage.")])
    out = parse_lines(split_lines(lines))
    m = parser_metrics(lines, out).first()
    assert (m.total_lines, m.events, m.unparsed, round(m.coverage, 4)) == (3, 1, 2, 0.3333)
    s = unparsed_shapes(out).collect()
    assert [(r["shape"], r.n) for r in s] == [("Odd # points of damage #", 2)]


def test_owner_is_known_from_its_line_on(spark, monkeypatch):
    lines = log(spark, [(0, "Grub bites a rat for 1 points of damage."), (1, "Grub (Owner: Bron) bites a rat for 2 points of damage."), (2, "Grub bites a rat for 3 points of damage."), (3, "Grub tries to bite a rat, but misses!")])
    got = {r.line_no: r.attacker_owner for r in with_owners(parse_lines(split_lines(lines))).collect()}
    assert got == {1: None, 2: "Bron", 3: "Bron", 4: None}
    df = spark.createDataFrame([("k", i, "v" if i == 3 else None) for i in range(30)], "k string, i int, v string")
    assert [r.o for r in asof_last(df, ["k"], "i", "v", "o", chunk=4).orderBy("i").collect()] == [None] * 3 + ["v"] * 27


def test_crit_matching():
    assert match_marks([(0, 1, False, None, True), (1, 2, True, None, False)], 2) == [1]
    assert match_marks([(0, 1, True, None, False), (1, 2, False, None, True)], 2) == [2]
    assert match_marks([(0, 1, False, None, True), (3, 2, True, None, False)], 2) == []
    assert match_marks([(0, 1, False, None, True), (0, 2, False, None, True), (0, 3, True, None, False)], 2) == [2]
    assert match_marks([(0, 1, False, "Rot", False), (0, 2, True, "rot", False)], 2) == [1]
    assert match_marks([(0, 1, False, None, False), (0, 2, True, None, False)], 2) == []


def test_crits_cut_into_runs_equal_one_pass(spark):
    rng = random.Random(4)
    t, rows = 0, []
    for i in range(400):
        t += rng.choice([0, 0, 1, 2, 3, 40, 43_000])
        rows.append(("L", i, T0 + dt.timedelta(seconds=t), *(("crit", None, 5, None) if rng.random() < 0.4 else ("event", "damage", 5, "melee")), None))
    df = spark.createDataFrame(rows, "log_id string, line_no int, ts timestamp_ntz, outcome string, action string, amount bigint, mechanic string, spell string").repartition(3)
    got = sorted(r.line_no for r in critical_lines(df).collect())
    want = match_marks([((r[2] - T0).total_seconds(), r[1], r[3] == "crit", None, r[3] == "event") for r in rows], 2)
    assert got == sorted(want)


def test_roster_learns_in_order():
    r = Roster("Mira")
    r.observe("damage", "Emberking", "Bron", None)
    assert r.classify("Emberking") == "player"
    r.observe("damage", "Mira", "Emberking", None)
    assert r.classify("Emberking") == "npc"
    r.tag("Grub", "Bron")
    assert (r.classify("grub"), r.classify("Bron"), r.classify("a rat"), r.classify("Old King"), r.classify("Solo"), r.classify(None)) == ("pet", "player", "npc", "npc", "player", "unknown")


@pytest.mark.parametrize("seed", range(3))
def test_telling_observations_equal_the_full_sequence(spark, seed):
    rng = random.Random(seed)
    names = ["Mira", "Bron", "Vexa", "Emberking", "Old King", "a rat", "Grub", "Fang", None]
    rows = []
    for i in range(rng.choice([60, 400])):
        action = rng.choice(["damage", "damage", "miss", "heal", "death"])
        rows.append(("Mira_x", T0 + dt.timedelta(seconds=rng.randint(0, 200)), i, action, rng.choice(names), rng.choice(names), rng.choice([None] * 6 + ["Bron", "Vexa"])))
    tags = [("Mira_x", 5, "Grub", "Bron"), ("Mira_x", 9, "Grub", "Vexa"), ("Mira_x", 7, "Bron", "Vexa")][: rng.randint(0, 3)]
    ev = spark.createDataFrame(rows, "log_id string, ts timestamp_ntz, line_no int, action string, attacker string, target string, attacker_owner string").repartition(3)
    tg = spark.createDataFrame(tags, "log_id string, line_no int, pet string, owner string")
    r = Roster("Mira")
    for _, _, pet, owner in sorted(tags, key=lambda t: t[1]):
        r.tag(pet, owner)
    for row in sorted(rows, key=lambda x: (x[1], x[2])):
        r.observe(*row[3:])
    got = {x.name_key: x.kind for x in learn_roster(ev, tg).collect()}
    want = {**r.kind, **{k: "pet" for k in r.owner}}
    looks = Roster(None)
    for n in filter(None, names):
        assert got.get(n.lower(), looks.classify(n)) == want.get(n.lower(), looks.classify(n)), n


def hit(s, who, mob, n=10):
    return (s, f"{who} crushes {mob} for {n} points of damage." if who != "You" else f"You crush {mob} for {n} points of damage.")


def kill(s, mob):
    return (s, f"You have slain {mob}!")


A, B = "a cinder wolf", "a smoke imp"
SCENARIOS = {
    "kill closes": (Options(), [hit(0, "You", A), hit(2, "You", A), kill(3, A), hit(300, "You", B), kill(301, B)], [], [("all_mobs_dead", 1), ("all_mobs_dead", 1)]),
    "chain pull": (Options(), [hit(0, "You", A), kill(3, A), hit(10, "You", B), kill(13, B)], [], [("all_mobs_dead", 2)]),
    "pause splits": (Options(), [hit(0, "You", A), kill(3, A), hit(40, "You", B), kill(43, B)], [], [("all_mobs_dead", 1)] * 2),
    "strict per pull": (Options.from_rest_period(0), [hit(0, "You", A), kill(3, A), hit(5, "You", B), kill(7, B)], [], [("all_mobs_dead", 1)] * 2),
    "idle gap": (Options(), [hit(0, "You", A), hit(5, "You", A), hit(120, "You", B), hit(125, "You", B)], [], [("idle", 0), ("log_end", 0)]),
    "boundary 45": (Options.from_rest_period(45), [hit(0, "You", A), hit(3, "You", A), hit(48, "You", A), hit(51, "You", A)], [], [("log_end", 0)]),
    "boundary 46": (Options.from_rest_period(45), [hit(0, "You", A), hit(3, "You", A), hit(49, "You", A), hit(52, "You", A)], [], [("idle", 0), ("log_end", 0)]),
    "short fights drop": (Options.from_rest_period(45), [hit(0, "You", A), hit(46, "You", A)], [], []),
    "zone closes": (Options(), [hit(0, "You", A), hit(3, "You", A), hit(6, "You", A), (8, "You have entered Elsewhere."), hit(20, "You", B), hit(24, "You", B)], [], [("zone_change", 0), ("log_end", 0)]),
    "corpse run": (Options.from_rest_period(15), [hit(0, "You", A), (5, f"{A} hits YOU for 5 points of damage."), (6, f"You have been slain by {A}!"), (10, "You have entered Home."), (30, "You have entered Ashen Hall."), hit(45, "You", A), kill(80, A)], [], [("log_end", 0)]),
    "split": (Options.from_rest_period(60), [hit(0, "You", A), hit(5, "You", A), hit(10, "You", A), kill(12, A)], [8], [("manual", 0), ("log_end", 1)]),
    "barrier": (Options(reengage_s=60), [hit(0, "You", A), kill(2, A), hit(5, "You", B), kill(7, B)], [3], [("all_mobs_dead", 1)] * 2),
    "time cap": (Options(idle_s=400, max_duration_s=600), [hit(s, "You", A) for s in range(0, 1000, 100)], [], [("time_cap", 0), ("log_end", 0)]),
    "long silence": (Options(), [hit(0, "You", A), hit(5, "You", A), hit(5000, "You", A), hit(5004, "You", A), hit(9000, "You", B), kill(9001, B)], [], [("idle", 0), ("idle", 0), ("all_mobs_dead", 1)]),
}


def drive(options, entries, splits):
    """The machine alone on messages of the scenarios' few shapes; zones come first at a time, then splits."""
    m = FightMachine(options, "Mira")
    rows = [(s, 2, i, msg) for i, (s, msg) in enumerate(entries)] + [(s, 1, 0, "") for s in splits]
    rows = sorted((s, 0 if msg.startswith("You have entered") else o, i, msg) for s, o, i, msg in rows)
    for s, o, i, msg in rows:
        if o == 0:
            m.zone_change(s, msg[17:-1])
        elif o == 1:
            m.split(s)
        else:
            m.advance(s)
            mob = A if A in msg else B
            if "slain by" in msg:
                m.event(s, i, "death", mob, "Mira", "npc", "player", 0, None)
            elif "slain" in msg:
                m.event(s, i, "death", "Mira", mob, "player", "npc", 0, None)
            elif "YOU" in msg:
                m.event(s, i, "damage", mob, "Mira", "npc", "player", 5, "melee")
            else:
                m.event(s, i, "damage", "Mira", mob, "player", "npc", 10, "melee")
    return [(f.reason, len(f.killed)) for f in m.finish()]


@pytest.mark.parametrize("name", SCENARIOS)
def test_encounter_scenarios(name):
    options, entries, splits, want = SCENARIOS[name]
    got = drive(options, entries, splits)
    if name == "corpse run":
        assert len(got) == 1 and got[0][1] == 1
    else:
        assert got == want


def test_scenarios_through_the_pipeline(spark):
    plain = {n: v for n, v in SCENARIOS.items() if v[0] == Options() and not v[2]}
    logs = None
    for i, (_, entries, _, _) in enumerate(plain.values()):
        one = log(spark, entries, f"Mira_{i}")
        logs = one if logs is None else logs.unionByName(one)
    got = {}
    for r in analyze(logs).encounters.orderBy("log_id", "enc_id").collect():
        got.setdefault(r.log_id, []).append((r.end_reason, len(r.npcs_killed)))
    assert got == {f"Mira_{i}": v[3] for i, v in enumerate(plain.values())} and len(got) >= 5


def test_stretches_equal_one_long_fold(spark):
    """Cutting a log at silences and at days gives what one machine over all rows gives."""
    rng = random.Random(9)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1, 2, 5, 20, 46, 100]) if rng.random() < 0.97 else rng.choice([181, 400, 50_000])
        action = rng.choice(["damage", "damage", "damage", "miss", "heal", "death"])
        friend = rng.random() < 0.6
        a, v, ak, tk = ("Mira", rng.choice([A, B]), "player", "npc") if friend else (rng.choice([A, B]), rng.choice(["Mira", "Bron"]), "npc", "player")
        rows.append(("Mira_x", T0 + dt.timedelta(seconds=t), i, action, a, v, ak, tk, rng.choice([0, 5, 9]), rng.choice(["melee", "damage_shield"])))
    zones = [("Mira_x", T0 + dt.timedelta(seconds=rng.randint(0, t)), 10_000 + i, rng.choice(["Home", "Hall"])) for i in range(40)]
    splits = [("Mira_x", T0 + dt.timedelta(seconds=rng.randint(0, t))) for _ in range(20)]
    ev = spark.createDataFrame(rows, "log_id string, ts timestamp_ntz, line_no int, action string, attacker string, target string, attacker_kind string, target_kind string, amount bigint, mechanic string").repartition(4)
    heads, assigned = build_encounters(ev, spark.createDataFrame(zones, "log_id string, ts timestamp_ntz, line_no int, zone string"), spark.createDataFrame(splits, "log_id string, ts timestamp_ntz"))
    m = FightMachine(Options(), "Mira")
    sec = lambda x: int((x - T0).total_seconds())
    queue = sorted([(sec(z[1]), 0, z[2], z) for z in zones] + [(sec(s[1]), 1, 0, s) for s in splits] + [(sec(r[1]), 2, r[2], r) for r in rows], key=lambda x: x[:3])
    last = max(q[0] for q in queue if q[1] == 2)
    for s, o, _, r in queue:
        if o == 0:
            m.zone_change(s, r[3])
        elif o == 1:
            if s <= last:
                m.split(s)
        else:
            m.advance(s)
            m.event(s, r[2], *r[3:])
    want = {f.no: (f.start, f.end, f.reason, f.title, f.zone, sorted(f.lines)) for f in m.finish()}
    lines = {}
    for r in assigned.collect():
        lines.setdefault(r.enc_id, []).append(r.line_no)
    got = {r.enc_id: (sec(r.start_ts), sec(r.end_ts), r.end_reason, r.title, r.zone, sorted(lines[r.enc_id])) for r in heads.collect()}
    assert got == want and len(got) > 20


def test_reports_on_a_small_fight(spark):
    entries = [
        hit(0, "You", A, 500), (0, f"Grub (Owner: Mira) bites {A} for 300 points of damage."), (1, f"Grub bites {A} for 100 points of damage."), (1, f"Bron crushes {A} for 50 points of damage."),
        (2, f"{A} hits YOU for 100 points of damage."), (3, f"{A} hits YOU for 300 points of damage."), *[(4, f"{A} tries to hit YOU, but {r}!") for r in ("misses", "You parry", "You dodge", "You block with your shield")],
        (5, f"{A} tries to bash YOU, but You riposte"), (5, f"{A} tries to bash YOU, but You riposte!"), (7, f"{A} has been slain by Bron!"),
    ]
    ev = analyze(log(spark, entries)).events.where("enc_id is not null").cache()
    given = credits(ev)
    who = {r.fighter: r for r in fighters(given).collect()}
    assert set(who) == {"Mira", "Bron"} and who["Mira"].damage_done == 900 and who["Mira"].pets == ["Grub"] and who["Mira"].damage_taken == 400
    assert sum(r.total for r in sources(given).where("metric = 'done'").collect()) == 950
    d = {r.attack_type: r for r in defenses(ev).collect()}
    assert (d["hit"].swings, d["hit"].average, d["bash"].ripostes) == (6, 200.0, 1)
    roll = defense_rollup(defenses(ev), fighters(given)).first()
    assert (roll.melee_swings, roll.melee_hits, round(roll.avoid_rate, 4)) == (7, 2, round(5 / 7, 4))
    mob = mobs(ev).first()
    assert (mob.damage_taken, mob.ttk_s, mob.last_killer, mob.deaths) == (950, 7, "Bron", 1)


def test_empty_log(spark):
    b = analyze(spark.createDataFrame([], "log_id string, line_no int, raw string"))
    assert b.encounters.count() == 0 and b.events.count() == 0


def test_battle_queries_apply_split_markers(spark, tmp_path):
    lines = log(spark, [(s, "You crush a rat for 5 points of damage.") for s in (0, 5, 10, 15, 20, 25)])
    lines.withColumn("file_path", F.lit("/logs/game/eqlog_Mira_ashfall.txt")).write.parquet(f"{tmp_path}/raw_lines.parquet")
    at = [("Mira_ashfall", T0 + dt.timedelta(seconds=12), 0)] * 2 + [("Mira_ashfall", T0 + dt.timedelta(seconds=22), 1), ("Other_ashfall", T0, 0)]
    spark.createDataFrame(at, "log_id string, ts timestamp, kind int").write.parquet(f"{tmp_path}/split_markers.parquet")
    heads = b_battle_encounters(spark, str(tmp_path)).orderBy("enc_id").collect()
    assert [r.end_reason for r in heads] == ["manual", "log_end"]
    assert [str(r.start_ts)[-8:] for r in heads] == ["20:00:00", "20:00:15"]
    assert {r.enc_id for r in b_battle_fighters(spark, str(tmp_path)).collect()} == {r.enc_id for r in heads}
