"""Live state of one log, free of Spark: what a stateful stream keeps between batches.

What is known about names grows with a log, so it is handed in as a mapping of its own (``facts``); the rest is the
open and the last fight.

Differences to batch are those of the domain: names are classified as known at
the event, lines count in arrival order, and a pet whose owner becomes known is
credited to that owner for the whole open encounter.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import MutableMapping

from skirmish.operators.crits import Marks
from skirmish.operators.encounters import FightMachine
from skirmish.operators.roster import PET, Fact, Roster
from skirmish.schema import Options


class LiveLog:
    """Feed outcomes in line order; read revisions of encounters."""

    def __init__(self, log_id: str, options: Options | None = None, catalog: dict[tuple[str, str], str] | None = None, facts: MutableMapping[str, Fact] | None = None) -> None:
        self.log_id, self.opt = log_id, options or Options()
        self.catalog = catalog or {}
        me = log_id.split("_")[0]
        self.roster = Roster(me, facts)
        self.machine = FightMachine(self.opt, me)
        self.marks = Marks(self.opt.crit_window_s)
        self.splits: list[int] = []
        self.lines = Counter()
        self.damage: dict[int, Counter] = {}
        self.crits: dict[int, Counter] = {}
        self.revision: dict[int, int] = {}
        self.reported: dict[int, tuple] = {}
        self.last_event: int | None = None
        self.classes: dict[str, Counter] = {}

    # ---- input --------------------------------------------------------------------------------

    def add_split(self, at: int) -> None:
        """A split marker; those older than the first event never act."""
        if at not in self.splits:
            self.splits.append(at)
            self.splits.sort()

    def force_split(self) -> int | None:
        """Cut now, at the time of the last event; gives that time, None if nothing was read."""
        if self.last_event is not None:
            self.machine.split(self.last_event)
        return self.last_event

    def feed(self, row: dict) -> None:
        """One outcome: ``outcome, sec, line_no`` and the fields of its kind."""
        self.lines[row["outcome"]] += 1
        if row.get("pet_tag"):
            self.roster.tag(row["pet_tag"], row["pet_tag_owner"])
        kind = row["outcome"]
        if kind == "zone":
            self.machine.zone_change(row["sec"], row["zone"])
        elif kind == "crit":
            self._mark(row)
        elif kind == "event":
            self._event(row)

    def _mark(self, row: dict) -> None:
        found = self.marks.mark(row["sec"], row["amount"], row["spell"])
        if found is not None and found[0] is not None:
            no, actor = found
            self.crits.setdefault(no, Counter())[actor] += 1

    def _event(self, row: dict) -> None:
        now, action, a, t = row["sec"], row["action"], row["attacker"], row["target"]
        owner = row["owner_hint"]
        if owner is None and action in ("damage", "heal") and a:
            owner = self.roster.owner_of(a)
        self.roster.observe(action, a, t, owner)
        if self.last_event is None:
            self.splits = [s for s in self.splits if s >= now]
        self.last_event = now
        while self.splits and self.splits[0] <= now:
            self.machine.split(self.splits.pop(0))
        self.machine.advance(now)
        ak, tk = self.roster.classify(a), self.roster.classify(t)
        self.machine.event(now, None, action, a, t, ak, tk, row["amount"], row["mechanic"])
        if ak == "player":
            for kind in ("spell", "verb"):
                found = self.catalog.get((kind, (row.get(kind) or "").lower()))
                if found:
                    self.classes.setdefault(a.lower(), Counter())[found] += 1
        fight = self.machine.open
        if fight is None and self.machine.done and self.machine.done[-1].last == now:
            fight = self.machine.done[-1]
        no = fight.no if fight is not None else None
        if action == "damage" and row["amount"] > 0:
            actor = (a or "").lower()
            crit = self.marks.hit(now, row["amount"], row["spell"], row["mechanic"] in ("melee", "melee_special"), (no, actor))
            if no is not None and a and ak in ("player", PET) and tk == "npc":
                self.damage.setdefault(no, Counter())[actor] += row["amount"]
                if crit:
                    self.crits.setdefault(no, Counter())[actor] += 1

    def tick(self, now: int) -> None:
        """Wall clock: close what has gone quiet."""
        self.machine.advance(now)

    # ---- output -------------------------------------------------------------------------------

    def coverage(self) -> float:
        """Share of stamped lines that were understood or are no damage."""
        n = sum(self.lines.values())
        return 1 - self.lines["unparsed"] / n if n else 1.0

    def class_label(self, player: str, least: int = 2, k: int = 3) -> str:
        """The best-supported classes of a player, '' while nothing is certain."""
        uses = [(-n, c) for c, n in self.classes.get(player.lower(), {}).items() if n >= least]
        return " / ".join(c for _, c in sorted(uses)[:k])

    def fighters(self, no: int) -> dict[str, int]:
        """Damage per fighter of an encounter, pets credited to their owners as known by now."""
        out: Counter = Counter()
        for actor, amount in self.damage.get(no, {}).items():
            out[(self.roster.owner_of(actor) or actor).lower()] += amount
        return dict(out)

    def _report(self, no: int, by: dict[str, int]) -> str:
        """Fighters of an encounter as JSON, most damage first."""
        crits: Counter = Counter()
        for actor, n in self.crits.get(no, {}).items():
            crits[(self.roster.owner_of(actor) or actor).lower()] += n
        ranked = sorted(by.items(), key=lambda x: (-x[1], x[0]))
        return json.dumps([dict(fighter=who, damage=n, crits=crits[who], share=round(n / max(1, sum(by.values())), 4)) for who, n in ranked], ensure_ascii=False)

    def revisions(self) -> list[dict]:
        """Encounters that are new or changed since the last call.

        A fight that was reported while open and then proved too short to keep is taken back
        by a last revision with the reason ``dropped``.
        """
        fights = list(self.machine.done) + [f for f in (self.machine.parked, self.machine.open) if f is not None]
        out = []
        for no in set(self.reported) - {f.no for f in fights}:
            start, end, title = self.reported[no][0], self.reported[no][1], self.reported[no][3]
            out.append(
                dict(
                    log_id=self.log_id, enc_id=no, revision=self.revision[no] + 1, start_s=start, end_s=end, zone=None, active=False, end_reason="dropped", title=title,
                    total_damage=0, top_fighter=None, kills=0, player_deaths=0, crits=0, coverage=self.coverage(), fighters="[]",
                )
            )
        for f in fights:
            by = self.fighters(f.no)
            top = max(by, key=by.get) if by else None
            state = (f.start, f.end, f.reason, f.title, sum(by.values()), top, len(f.killed), len(f.player_deaths), sum(self.crits.get(f.no, {}).values()))
            if self.reported.get(f.no) == state:
                continue
            self.reported[f.no] = state
            self.revision[f.no] = self.revision.get(f.no, 0) + 1
            out.append(
                dict(
                    log_id=self.log_id, enc_id=f.no, revision=self.revision[f.no], start_s=f.start, end_s=f.end, zone=f.zone, active=not f.reason, end_reason=f.reason, title=f.title,
                    total_damage=state[4], top_fighter=top, kills=state[6], player_deaths=state[7], crits=state[8], coverage=self.coverage(), fighters=self._report(f.no, by),
                )
            )
        self._forget()
        return out

    def _forget(self) -> None:
        """Drop what can no longer change, so that state does not grow with the log."""
        keep = {f.no for f in self.machine.done[-1:]} | {f.no for f in (self.machine.open, self.machine.parked) if f is not None}
        if self.last_event is not None:
            self.marks.forget(self.last_event)
        for table in (self.damage, self.crits, self.reported, self.revision):
            for no in [n for n in table if n not in keep]:
                del table[no]
        del self.machine.done[:-1]

    def finish(self) -> list[dict]:
        """End of the log: close everything and give the last revisions."""
        self.machine.finish()
        return self.revisions()
