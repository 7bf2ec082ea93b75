"""Reports over classified events: fighters, sources, monsters, defenses, classes.

Every event is turned once into the credits it gives (done, taken, heal, ...); all
fighter and source figures are group-bys over that one narrow table. Names group
without case and show the spelling seen first. ``by`` is what one report covers:
``[log_id, enc_id]`` for single encounters, ``[log_id]`` for a merged time range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.times import wall_seconds
from skirmish.operators.grammar import MISS_REASONS
from skirmish.operators.owners import credited, pet_of

ENCOUNTER = ["log_id", "enc_id"]
# Display names of damage categories and of sources without spell or verb.
CATEGORIES = {"melee": "Melee", "melee_special": "Melee Special", "non_melee": "Non-melee", "damage_shield": "Damage Shield"}
PLAIN_SOURCES = {"melee": "melee", "melee_special": "meleespecial", "non_melee": "nonmelee", "damage_shield": "damageshield"}


def _lookup(table: dict[str, str], c: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def ratio(n: Column, d: Column) -> Column:
    """Quotient, 0.0 where the denominator is not positive."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def _friend(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_kind").isin("player", "pet"), F.lit(False)) & F.col(side).isNotNull()


def _foe(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_kind") == "npc", F.lit(False)) & F.col(side).isNotNull()


def category(mechanic: Column) -> Column:
    return _lookup(CATEGORIES, mechanic, "Other")


def source_name(spell: Column, verb: Column, mechanic: Column) -> Column:
    return F.coalesce(spell, verb, _lookup(PLAIN_SOURCES, mechanic, "unknown"))


def credits(events: DataFrame, by: list[str] = ENCOUNTER) -> DataFrame:
    """``by``, seq, metric, fighter, pet, category, source, amount, swing, critical: one row per credit of an event.

    Metrics: done, taken, heal (healing done), healed (received, never credited to an owner), miss, death.
    Null amounts count as 0; events with unknown actors give what their known side earns. Owners, mechanic,
    spell, verb and is_critical may be missing as columns where the report does not show them.
    """

    def col(name: str) -> Column:
        return F.col(name) if name in events.columns else F.lit(None).cast("boolean" if name == "is_critical" else "string")

    att, tgt = (F.col("attacker_kind"), F.col("attacker"), col("attacker_owner")), (F.col("target_kind"), F.col("target"), col("target_owner"))
    is_ = {a: F.col("action") == a for a in ("damage", "miss", "heal", "death")}
    mech, no_text = col("mechanic"), F.lit(None).cast("string")
    swing = F.coalesce(mech.isin("melee", "melee_special"), F.lit(False))
    crit = F.coalesce(col("is_critical"), F.lit(False))
    incoming = F.coalesce(F.col("attacker_kind") == "npc", F.lit(False)) | F.col("attacker").isNull()

    def credit(metric: str, fighter: Column, pet: Column, cat: Column, source: Column, critical: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), fighter.alias("fighter"), pet.alias("pet"), cat.alias("category"), source.alias("source"), swing.alias("swing"), critical.alias("critical"))

    nobody = F.coalesce("attacker", F.when(mech == "damage_shield", "damage shield").otherwise("unknown"))
    given = F.array(
        F.when(is_["damage"] & _friend("attacker") & _foe("target"), credit("done", credited(*att), pet_of(*att), category(mech), source_name(col("spell"), col("verb"), mech), crit)),
        F.when(is_["damage"] & _friend("target") & incoming, credit("taken", credited(*tgt), pet_of(*tgt), category(mech), nobody, crit)),
        F.when(is_["miss"] & _friend("attacker") & _foe("target"), credit("miss", credited(*att), no_text, no_text, no_text, F.lit(False))),
        F.when(is_["heal"] & _friend("attacker"), credit("heal", credited(*att), pet_of(*att), F.lit("Heal"), F.coalesce(col("spell"), F.lit("heal")), F.lit(False))),
        F.when(is_["heal"] & _friend("target"), credit("healed", F.col("target"), no_text, no_text, no_text, F.lit(False))),
        F.when(is_["death"] & (F.col("target_kind") == "player"), credit("death", F.col("target"), no_text, no_text, no_text, F.lit(False))),
    )
    return events.select(
        *by, F.struct("ts", "line_no").alias("seq"), F.coalesce("amount", F.lit(0)).alias("amount"), F.explode(F.array_compact(given)).alias("c")
    ).select(*by, "seq", "amount", "c.*")


def fighters(given: DataFrame, by: list[str] = ENCOUNTER) -> DataFrame:
    """One row per fighter with totals, swings, rates, deaths, pets and first appearance."""
    m = F.col("metric")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(m == name, F.col("amount"))), F.lit(0))

    out = given.groupBy(*by, F.lower("fighter").alias("fighter_key")).agg(
        F.min(F.struct("seq", "fighter")).getField("fighter").alias("fighter"),
        F.min("seq").alias("first_seq"),
        total("done").alias("damage_done"),
        total("taken").alias("damage_taken"),
        total("heal").alias("healing_done"),
        total("healed").alias("healing_received"),
        F.count_if(m == "death").alias("deaths"),
        F.count_if((m == "done") & F.col("swing")).alias("swing_hits"),
        F.count_if(m == "miss").alias("swing_misses"),
        F.count_if((m == "done") & F.col("swing") & F.col("critical")).alias("crit_hits"),
        F.array_sort(F.collect_set("pet")).alias("pets"),
    )
    return out.withColumns(
        {
            "accuracy": ratio(F.col("swing_hits"), F.col("swing_hits") + F.col("swing_misses")),
            "crit_rate": ratio(F.col("crit_hits"), F.col("swing_hits")),
        }
    )


def sources(given: DataFrame, by: list[str] = ENCOUNTER) -> DataFrame:
    """Buckets ``metric, fighter, category, source, pet`` with total, hits, crits, min, max, average."""
    rows = given.where(F.col("metric").isin("done", "taken", "heal"))
    key = [*by, "metric", "fighter_key", "category", "source", "pet_key"]
    return (
        rows.withColumns({"fighter_key": F.lower("fighter"), "pet_key": F.lower("pet")})
        .groupBy(*key)
        .agg(
            F.min(F.struct("seq", "fighter")).getField("fighter").alias("fighter"),
            F.min(F.struct("seq", "pet")).getField("pet").alias("pet"),
            F.sum("amount").alias("total"),
            F.count(F.lit(1)).alias("hits"),
            F.count_if("critical").alias("crits"),
            F.min("amount").alias("min_hit"),
            F.max("amount").alias("max_hit"),
            ratio(F.sum("amount"), F.count(F.lit(1))).alias("average"),
        )
    )


def ranked(df: DataFrame, by: list[str], value: str, ties: list, k: int | None = None, rank: str = "rank_no") -> DataFrame:
    """Rows of positive ``value`` ranked in falling order within ``by``; only the first ``k`` if given.

    With ``k`` the rank filter is pushed into the window's partial step, so at most ``k``
    rows of a group leave each task before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    out = df.where(F.col(value) > 0).withColumn(rank, F.row_number().over(w))
    return out.where(F.col(rank) <= k) if k else out


def totals(given: DataFrame, by: list[str] = ENCOUNTER) -> DataFrame:
    """Total damage and healing of each report."""
    return given.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("amount"))), F.lit(0)).alias(n) for m, n in (("done", "total_damage"), ("heal", "total_healing"))])


def mobs(events: DataFrame, by: list[str] = ENCOUNTER) -> DataFrame:
    """Damage taken, deaths, last killer, first and last hit and time to kill of each monster that was hurt."""
    hurt = (F.col("action") == "damage") & (F.col("amount") > 0)
    died = F.col("action") == "death"
    seq = F.struct("ts", "line_no")
    killer = F.when(died & F.col("attacker").isNotNull() & (F.coalesce("attacker_kind", F.lit("")) != "npc"), F.struct(seq.alias("seq"), "attacker"))
    out = (
        events.where(_foe("target") & (hurt | died))
        .groupBy(*by, F.lower("target").alias("mob_key"))
        .agg(
            F.min(F.struct(seq.alias("seq"), "target")).getField("target").alias("mob"),
            F.min(seq).alias("first_seq"),
            F.coalesce(F.sum(F.when(hurt, F.col("amount"))), F.lit(0)).alias("damage_taken"),
            F.count_if(died).alias("deaths"),
            F.max(killer).getField("attacker").alias("last_killer"),
            F.min("ts").alias("first_hit"),
            F.max("ts").alias("last_hit"),
        )
    )
    return out.where("damage_taken > 0").withColumn("ttk_s", wall_seconds("last_hit") - wall_seconds("first_hit"))


def mob_sources(events: DataFrame, by: list[str] = ENCOUNTER) -> DataFrame:
    """Monster x fighter x source buckets of damage above 0."""
    rows = events.where((F.col("action") == "damage") & (F.col("amount") > 0) & _friend("attacker") & _foe("target"))
    att = (F.col("attacker_kind"), F.col("attacker"), F.col("attacker_owner"))
    cut = rows.select(
        *by, F.lower("target").alias("mob_key"), "target", F.struct("ts", "line_no").alias("seq"), credited(*att).alias("fighter"), pet_of(*att).alias("pet"),
        category(F.col("mechanic")).alias("category"), source_name(F.col("spell"), F.col("verb"), F.col("mechanic")).alias("source"), "amount", F.coalesce("is_critical", F.lit(False)).alias("critical"),
    )
    return cut.groupBy(*by, "mob_key", F.lower("fighter").alias("fighter_key"), "category", "source", F.lower("pet").alias("pet_key")).agg(
        F.min(F.struct("seq", "target")).getField("target").alias("mob"),
        F.min(F.struct("seq", "fighter")).getField("fighter").alias("fighter"),
        F.min(F.struct("seq", "pet")).getField("pet").alias("pet"),
        F.sum("amount").alias("total"),
        F.count(F.lit(1)).alias("hits"),
        F.count_if("critical").alias("crits"),
        F.min("amount").alias("min_hit"),
        F.max("amount").alias("max_hit"),
    )


def defenses(events: DataFrame, by: list[str] = ENCOUNTER) -> DataFrame:
    """How each kind of attack on each defender came out; kinds that never resolved are left out."""
    tgt = (F.col("target_kind"), F.col("target"), F.col("target_owner"))
    mech = F.col("mechanic")
    rows = events.where(
        F.col("action").isin("damage", "miss") & _friend("target") & ~F.coalesce(F.col("attacker_kind").isin("player", "pet"), F.lit(False)) & (F.coalesce(mech, F.lit("")) != "damage_shield")
    )
    kind = F.when(mech == "non_melee", F.concat(F.lit("non-melee"), F.coalesce(F.concat(F.lit(": "), "spell"), F.lit("")))).otherwise(F.coalesce("verb", F.lit("hit")))
    reason = F.when(F.col("miss_reason").isin(MISS_REASONS), F.col("miss_reason")).otherwise("miss")
    cut = rows.select(*by, F.struct("ts", "line_no").alias("seq"), credited(*tgt).alias("defender"), kind.alias("attack_type"), category(mech).alias("category"), (F.col("action") == "miss").alias("missed"), reason.alias("reason"), F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("is_critical", F.lit(False)).alias("critical"))
    hit = ~F.col("missed") & (F.col("amount") > 0)
    names = {"miss": "misses", "parry": "parries", "dodge": "dodges", "block": "blocks", "riposte": "ripostes", "rune": "absorbs", "invulnerable": "invulnerables"}
    out = cut.groupBy(*by, F.lower("defender").alias("defender_key"), F.lower("attack_type").alias("type_key")).agg(
        F.min(F.struct("seq", "defender")).getField("defender").alias("defender"),
        F.min(F.struct("seq", "attack_type")).getField("attack_type").alias("attack_type"),
        F.min(F.struct("seq", "category")).getField("category").alias("category"),
        F.count_if(hit).alias("hits"),
        *[F.count_if(F.col("missed") & (F.col("reason") == r)).alias(n) for r, n in names.items()],
        F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0)).alias("damage"),
        F.count_if(hit & F.col("critical")).alias("crits"),
        F.coalesce(F.min(F.when(hit, F.col("amount"))), F.lit(0)).alias("min_hit"),
        F.coalesce(F.max(F.when(hit, F.col("amount"))), F.lit(0)).alias("max_hit"),
    )
    avoided = sum((F.col(n) for n in names.values()), F.lit(0))
    return out.withColumn("swings", F.col("hits") + avoided).where("swings > 0").withColumn("average", ratio(F.col("damage"), F.col("hits")))


def defense_rollup(by_type: DataFrame, who: DataFrame, by: list[str] = ENCOUNTER) -> DataFrame:
    """Per defender: all swings and damage, melee-only rates, deaths."""
    melee = F.col("category").isin("Melee", "Melee Special")
    out = by_type.groupBy(*by, "defender_key").agg(
        F.min("defender").alias("defender"),
        F.sum("swings").alias("swings"),
        F.sum("hits").alias("hits"),
        F.sum("damage").alias("damage"),
        F.max("max_hit").alias("max_hit"),
        F.coalesce(F.sum(F.when(melee, F.col("swings"))), F.lit(0)).alias("melee_swings"),
        F.coalesce(F.sum(F.when(melee, F.col("hits"))), F.lit(0)).alias("melee_hits"),
    )
    deaths = who.select(*by, F.col("fighter_key").alias("defender_key"), "deaths")
    return out.join(deaths, [*by, "defender_key"], "left").withColumns(
        {
            "deaths": F.coalesce("deaths", F.lit(0)),
            "avoid_rate": ratio(F.col("melee_swings") - F.col("melee_hits"), F.col("melee_swings")),
            "hit_rate": ratio(F.col("melee_hits"), F.col("melee_swings")),
        }
    )


def class_evidence(events: DataFrame, catalog: DataFrame, least: int = 2) -> DataFrame:
    """``log_id, player, class_name, uses`` of signature spells and verbs used at least ``least`` times.

    ``catalog`` is (kind, signature, class_name).
    """
    uses = events.where((F.col("attacker_kind") == "player") & F.col("attacker").isNotNull())
    pair = F.explode(F.array(F.struct(F.lit("spell").alias("kind"), F.lower("spell").alias("sig")), F.struct(F.lit("verb").alias("kind"), F.lower("verb").alias("sig")))).alias("p")
    cat = catalog.select("kind", F.lower("signature").alias("sig"), "class_name").distinct()
    hits = uses.select("log_id", "attacker", F.struct("ts", "line_no").alias("seq"), pair).select("log_id", "attacker", "seq", "p.*").where("sig is not null").join(cat, ["kind", "sig"])
    return hits.groupBy("log_id", F.lower("attacker").alias("player_key"), "class_name").agg(F.min(F.struct("seq", "attacker")).getField("attacker").alias("player"), F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= least)


def class_labels(evidence: DataFrame, k: int = 3) -> DataFrame:
    """``log_id, player, label``: the top classes joined by `` / ``."""
    top = ranked(evidence, ["log_id", "player_key"], "uses", [F.asc("class_name")], k)
    return top.groupBy("log_id", "player_key").agg(
        F.min("player").alias("player"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "class_name"))), lambda x: x["class_name"]), " / ").alias("label")
    )


def summaries(headers: DataFrame, who: DataFrame) -> DataFrame:
    """List view of encounters: title, duration, total damage, deaths, top fighter and its damage per second."""
    sums = who.groupBy(*ENCOUNTER).agg(
        F.sum("damage_done").alias("total_damage"),
        F.sum("deaths").alias("deaths"),
        F.min(F.when(F.col("damage_done") > 0, F.struct((-F.col("damage_done")).alias("d"), "first_seq", "fighter"))).alias("top"),
    )
    out = headers.join(sums, ENCOUNTER, "left")
    seconds = F.greatest(F.lit(1.0), (wall_seconds("end_ts") - wall_seconds("start_ts")).cast("double"))
    return out.select(
        *ENCOUNTER, "start_ts", seconds.alias("duration_s"), "title", "end_reason", F.col("top.fighter").alias("top_fighter"),
        (F.coalesce(-F.col("top.d"), F.lit(0)) / seconds).alias("top_dps"), F.coalesce("total_damage", F.lit(0)).alias("total_damage"), F.coalesce("deaths", F.lit(0)).alias("deaths"),
    )


def per_second(who: DataFrame, headers: DataFrame) -> DataFrame:
    """Fighters with damage and healing per second of their encounter, which lasts at least one second."""
    lasted = headers.select(*ENCOUNTER, F.greatest(F.lit(1.0), (wall_seconds("end_ts") - wall_seconds("start_ts")).cast("double")).alias("seconds"))
    rates = {"dps": F.col("damage_done") / F.col("seconds"), "hps": F.col("healing_done") / F.col("seconds")}
    return who.join(lasted, ENCOUNTER).withColumns(rates).drop("seconds")


def time_range(headers: DataFrame, given: DataFrame) -> DataFrame:
    """One merged report per log: span, summed durations, totals."""
    seconds = F.greatest(F.lit(1.0), (wall_seconds("end_ts") - wall_seconds("start_ts")).cast("double"))
    span = headers.groupBy("log_id").agg(F.count(F.lit(1)).alias("n_encounters"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum(seconds).alias("duration_s"))
    return span.join(totals(given, ["log_id"]), "log_id", "left").na.fill(0, ["total_damage", "total_healing"])


def source_tree(given: DataFrame, metric: str, by: list[str] = ENCOUNTER) -> DataFrame:
    """Breakdown tree as grouping sets: fighter, group, leaf, each with its share of the parent.

    White melee without a pet is grouped as ``Melee``; pets are groups of their own; other sources
    are leaves below the fighter (group null).
    """
    rows = given.where(F.col("metric") == metric)
    grp = F.when(F.col("pet").isNotNull(), F.lower("pet")).when(F.col("category") == "Melee", "Melee").otherwise(F.col("source"))
    cut = rows.select(*by, F.lower("fighter").alias("fighter"), grp.alias("grp"), F.col("source").alias("leaf"), "amount")
    keys = [F.col(c) for c in by]
    sets = [[*keys, F.col("fighter")], [*keys, F.col("fighter"), F.col("grp")], [*keys, F.col("fighter"), F.col("grp"), F.col("leaf")]]
    tree = cut.groupingSets(sets, *keys, "fighter", "grp", "leaf").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("hits"), F.grouping_id().alias("g"))
    depth = F.when(F.col("g") == 3, 1).when(F.col("g") == 1, 2).otherwise(3)
    tree = tree.withColumn("depth", depth).drop("g")
    parent = F.when(F.col("depth") == 1, F.lit("")).when(F.col("depth") == 2, F.concat(F.lit("f:"), "fighter")).otherwise(F.concat(F.lit("g:"), "fighter", F.lit("\u0001"), "grp"))
    siblings = Window.partitionBy(*by, "depth", parent)
    return tree.withColumn("share", ratio(F.col("total"), F.sum("total").over(siblings)))


def chat_line(ranking: DataFrame, by: list[str], text: str, budget: int = 480) -> DataFrame:
    """``by, line``: the ranked entries that fit ``budget`` characters, then how many were left out.

    Fit is greedy from rank 1 on; entries are joined by `` | ``.
    """
    w = Window.partitionBy(*by).orderBy("rank_no").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length(text) + 3).over(w) - 3
    cut = ranking.select(*by, "rank_no", F.col(text).alias("t"), used.alias("used"))
    kept = F.col("used") <= budget
    out = cut.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(kept, F.struct("rank_no", "t")))).alias("x"), F.count_if(~kept).alias("more"))
    line = F.array_join(F.transform("x", lambda v: v["t"]), " | ")
    return out.select(*by, F.when(F.col("more") > 0, F.concat(line, F.lit(" (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise(line).alias("line"))


def compact_number(c: Column) -> Column:
    """12345 -> 12.3K, 1234567 -> 1.23M, below 1000 as is; halves round up, in whole numbers."""
    n = c.cast("bigint")
    hundredths, tenths = F.floor((n + 5_000) / 10_000), F.floor((n + 50) / 100)
    millions = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("M"))
    thousands = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("K"))
    return F.when(n >= 1_000_000, millions).when(n >= 1_000, thousands).otherwise(n.cast("string"))
