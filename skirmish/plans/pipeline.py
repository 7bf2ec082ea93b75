"""From raw lines to enriched events and encounters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.operators.crits import associate_crits
from skirmish.operators.encounters import build_encounters
from skirmish.operators.owners import final_owners, ownership_tags, with_owners
from skirmish.operators.parse import parse_lines, split_lines
from skirmish.operators.roster import classify, learn_roster
from skirmish.schema import Options
from skirmish.session import cut_lineage


@dataclass
class Battle:
    """Results of a batch run. Outcomes, events and folds are written while it is built; the rest is lazy."""

    outcomes: DataFrame
    events: DataFrame
    encounters: DataFrame
    tags: DataFrame
    roster: DataFrame


def analyze(lines: DataFrame, options: Options | None = None, splits: DataFrame | None = None, character: Column | None = None) -> Battle:
    """Parse, own, flag, classify and cut ``log_id, line_no, raw`` into encounters.

    The parsed outcomes feed several folds, so they are written to the shared
    folder once and read from there; so are the classified events.
    """
    opt = options or Options()
    outcomes = cut_lineage(parse_lines(split_lines(lines), character, opt.strict_compat).drop("message"))
    tags = ownership_tags(outcomes)
    owned = with_owners(outcomes)
    flagged = associate_crits(owned, opt.crit_window_s).where("outcome = 'event'")
    roster = learn_roster(flagged, tags)
    events = cut_lineage(classify(flagged, roster, final_owners(tags)))
    zones = outcomes.where("outcome = 'zone'").select("log_id", "ts", "line_no", "zone")
    headers, assigned = build_encounters(events, zones, splits, opt)
    placed = events.join(assigned, ["log_id", "line_no"], "left")
    return Battle(outcomes, placed, headers, tags, roster)
