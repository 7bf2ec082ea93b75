"""Raw log lines into a sparse union of events, critical markers and zone changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.staging import staged
from skirmish.functions.names import SELF_TOKENS, collapse_spaces, resolve_name
from skirmish.operators.grammar import DAMAGE_LIKE, MISS_WORDS, PET_TAG, RULES, SLOTS, SPECIAL_VERBS, VERBS

_SEP = "\u0001"
_STAMP = r"^\[[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \d{4}\] $"
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def split_lines(lines: DataFrame) -> DataFrame:
    """``log_id, line_no, ts, message, raw`` of the stamped lines; others are dropped.

    A stamp counts if its date and time exist and its weekday is right. ``ts`` is
    local wall-clock time (TIMESTAMP_NTZ), built from its parts, so no time zone is
    involved. Null raw lines, BOM and trailing carriage returns are tolerated.
    """
    raw = F.when(F.col("raw").endswith("\r"), F.substring("raw", F.lit(1), F.length("raw") - 1)).otherwise(F.col("raw"))
    raw = F.when(raw.startswith("\ufeff"), F.substring(raw, 2, 1 << 30)).otherwise(raw)
    # a followed log that was replaced starts a new generation of line numbers
    keep = ["log_id", "line_no", *(["generation"] if "generation" in lines.columns else [])]
    cut = staged(lines.select(*keep, "raw"), {"__t": raw}).where(F.substring("__t", 1, 27).rlike(_STAMP))

    def nth(names: list[str], c: Column) -> Column:
        return F.element_at(F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(i))]), c)

    def num(at: int, n: int) -> Column:
        return F.substring("__t", at, n).cast("int")

    second = num(19, 2)
    ts = F.when(second < 60, F.call_function("try_make_timestamp_ntz", num(22, 4), nth(_MONTHS, F.substring("__t", 6, 3)), num(10, 2), num(13, 2), num(16, 2), second.cast("decimal(16,6)")))
    read = staged(cut, {"ts": ts, "__day": nth(_DAYS, F.substring("__t", 2, 3)), "message": F.substring("__t", 28, 1 << 30)})
    return read.where(F.col("ts").isNotNull() & (F.weekday(F.to_date("ts")) + 1 == F.col("__day"))).select("log_id", F.col("line_no").cast("int").alias("line_no"), *keep[2:], "ts", "message", "raw")


def normalize_verb(c: Column) -> Column:
    """Base form of a third-person verb, else the trimmed lower-case word."""
    table = F.create_map(*[x for k, v in VERBS.items() for x in (F.lit(k), F.lit(v))])
    low = F.lower(F.trim(c))
    return F.coalesce(F.element_at(table, low), low)


def classify_verb(verb: Column) -> Column:
    """melee or melee_special for a base verb; null stays null."""
    return F.when(verb.isin(SPECIAL_VERBS) | verb.contains(" "), "melee_special").when(verb.isNotNull(), "melee")


def miss_reason(c: Column) -> Column:
    """Canonical reason of an avoided swing; unknown wording is a miss, null stays null."""
    low = F.lower(c)
    out = F.when(low.isNotNull(), "miss")
    for word, reason in reversed(MISS_WORDS):
        out = F.when(low.contains(word), reason).otherwise(out)
    return out


def line_shape(c: Column) -> Column:
    """The message with every run of decimal digits as one ``#``."""
    return F.regexp_replace(c, r"\p{Nd}+", "#")


def _match(msg: Column, tagged: Column) -> tuple[Column, Column]:
    """Id of the first matching rule, and its captures as an array in SLOTS order."""
    rule = F.lit(None).cast("string")
    found = F.lit(None).cast("string")
    for r in reversed(RULES):
        hit = reduce(lambda a, n: a & msg.contains(n), r.need[1:], msg.contains(r.need[0])) & msg.rlike("(?d)" + r.pattern)
        if r.tag_only:
            hit = hit & tagged
        rule = F.when(hit, r.id).otherwise(rule)
        if r.slots:
            out = _SEP.join(f"${r.slots.index(s) + 1}" if s in r.slots else "" for s in SLOTS)
            whole = r.pattern if r.pattern.startswith("^") else "^.*?" + r.pattern
            found = F.when(F.col("__rule") == r.id, F.regexp_replace(msg, "(?ds)" + whole, out)).otherwise(found)
    return rule, F.split(found, _SEP, len(SLOTS))


def parse_lines(lines: DataFrame, character: Column | None = None, strict_compat: bool = True) -> DataFrame:
    """Outcome of every stamped line.

    ``lines`` is :func:`split_lines` output; ``character`` is an expression for the
    log's own character (default: the part of ``log_id`` before the first ``_``).
    Result: ``log_id, line_no, ts, outcome`` (event, crit, zone, ignored, unparsed,
    none), ``rule_id``, event fields, ``owner_hint``, ``pet_tag``/``pet_tag_owner`` (ownership seen
    on the line), ``zone``, ``crit_is_self``, ``message``, ``raw``, and ``generation`` if the lines have it. Amounts that do not fit a bigint are 0.

    Everything is a projection: two CASE cascades behind a cheap word test, no shuffle.
    """
    me = character if character is not None else F.split("log_id", "_").getItem(0)
    kept = ["generation"] if "generation" in lines.columns else []
    tag = F.col("message").contains(" (Owner: ") & F.col("message").rlike("(?d)" + PET_TAG)
    cut = staged(
        lines.select("log_id", "line_no", *kept, "ts", "message", "raw"),
        {
            "__tag": F.when(tag, F.regexp_extract("message", "(?d)" + PET_TAG, 1)),
            "__tag_owner": F.when(tag, F.regexp_extract("message", "(?d)" + PET_TAG, 2)),
            "__msg": F.when(tag, F.regexp_extract("message", "(?d)" + PET_TAG, 3)).otherwise(F.col("message")),
        },
    )
    msg = F.col("__msg")
    rule, found = _match(msg, F.col("__tag").isNotNull())
    cut = staged(cut, {"__rule": rule})
    cut = staged(cut, {"__s": found})
    slot = {s: F.nullif(F.col("__s").getItem(i), F.lit("")) for i, s in enumerate(SLOTS)}

    def by_rule(value_of) -> Column:
        table = {r.id: value_of(r) for r in RULES if value_of(r)}
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("__rule"))

    you = F.lit("You")
    swarm = F.concat(slot["owner"], F.lit("`s "), slot["pet"])
    who = {
        "self": you,
        "text": slot["attacker"],
        "tag": F.col("__tag"),
        "tag_or_text": F.coalesce(F.col("__tag"), slot["attacker"]),
        "swarm": swarm,
    }
    kind = by_rule(lambda r: r.attacker or None)
    instanced = F.lower(F.trim(slot["zone"])) == "an instanced version of the zone"
    outcome = (
        F.when((F.col("__rule") == "R1") & instanced, "ignored")
        .when(F.col("__rule").isNotNull(), by_rule(lambda r: r.outcome))
        .when(F.lower(msg).contains("damage") & msg.rlike(DAMAGE_LIKE), "unparsed")
        .otherwise("none")
    )
    cut = staged(
        cut,
        {
            "__kind": kind,
            "__actor": reduce(lambda acc, k: F.when(kind == k, who[k]).otherwise(acc), who, F.lit(None).cast("string")),
            "__victim": F.when(by_rule(lambda r: r.target) == "self", you).otherwise(slot["target"]),
            "__action": by_rule(lambda r: r.action or None),
            "__mech": by_rule(lambda r: r.mechanic or None),
            "__base": normalize_verb(slot["verb"]),
            "outcome": outcome,
        },
    )
    attacker, target, action, verb, mech = (F.col(c) for c in ("__actor", "__victim", "__action", "__base", "__mech"))
    cut = staged(cut, {"__from": resolve_name(attacker, me)})
    resolved_attacker, kind, outcome = F.col("__from"), F.col("__kind"), F.col("outcome")
    # a heal on a pronoun belongs to the healer
    reflexive = SELF_TOKENS if strict_compat else [t for t in SELF_TOKENS if t.lower().endswith("self")]
    heal_self = (action == "heal") & attacker.isNotNull() & F.coalesce(target.isin(reflexive), F.lit(False))
    resolved_target = F.when(heal_self, resolved_attacker).otherwise(resolve_name(target, me))
    magic = slot["magic"].isNotNull()
    mechanic = F.when(mech == "verb", classify_verb(verb)).when(mech == "swarm", F.when(magic, "non_melee").otherwise(classify_verb(verb))).otherwise(mech)
    spell = F.nullif(F.trim(slot["spell"]), F.lit(""))
    if strict_compat:
        spell = F.when(~F.col("__rule").isin([r.id for r in RULES if not r.keeps_spell]), spell)
    is_event = outcome == "event"
    hinted = F.coalesce(F.when(kind == "swarm", slot["owner"]), F.col("__tag_owner"))
    owner_hint = F.when(action.isin("damage", "heal") & resolved_attacker.isNotNull(), resolve_name(hinted, me))
    swung = F.coalesce(mech == "swarm", F.lit(False)) & magic
    out = {
        "rule_id": F.col("__rule"),
        "action": F.when(is_event, action),
        "attacker": F.when(is_event, resolved_attacker),
        "target": F.when(is_event, resolved_target),
        "owner_hint": F.when(is_event, owner_hint),
        "amount": F.when(outcome.isin("event", "crit"), F.coalesce(slot["amount"].try_cast("bigint"), F.lit(0))),
        "mechanic": F.when(is_event, mechanic),
        "verb": F.when(is_event & ~swung, verb),
        "spell": F.when(outcome.isin("event", "crit"), spell),
        "miss_reason": F.when(action == "miss", miss_reason(slot["reason"])),
        "zone": F.when(outcome == "zone", F.trim(slot["zone"])),
        "crit_is_self": F.when(outcome == "crit", collapse_spaces(slot["attacker"]).isin(SELF_TOKENS) | (F.lower(resolve_name(slot["attacker"], me)) == F.lower(me))),
        "pet_tag": F.coalesce(F.when(kind == "swarm", swarm), F.col("__tag")),
        "pet_tag_owner": hinted,
    }
    return staged(cut, out).select("log_id", "line_no", *kept, "ts", "outcome", *out, "message", "raw")


def parser_metrics(lines: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per log: line counts by outcome and the share of stamped lines that were not unparsed.

    ``coverage`` is 1.0 for a log without stamped lines.
    """
    total = lines.groupBy("log_id").agg(F.count(F.lit(1)).alias("total_lines"))
    by = outcomes.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("timestamped_lines"),
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("event", "events"), ("crit", "crit_markers"), ("zone", "zone_changes"), ("unparsed", "unparsed"))],
    )
    both = total.join(by, "log_id", "left").na.fill(0)
    return both.withColumn("coverage", F.when(F.col("timestamped_lines") > 0, 1 - F.col("unparsed") / F.col("timestamped_lines")).otherwise(1.0))


def unparsed_shapes(outcomes: DataFrame) -> DataFrame:
    """``shape, n, example`` of the lines that look like damage but no rule reads."""
    bad = outcomes.where("outcome = 'unparsed'").withColumn("shape", line_shape(F.col("message")))
    return bad.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("log_id", "line_no", "raw")).getField("raw").alias("example"))
