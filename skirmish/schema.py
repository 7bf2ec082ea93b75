"""Options and column sets of the combat-log engine."""

from __future__ import annotations

from dataclasses import dataclass, replace

EVENT_COLUMNS = [
    "log_id", "line_no", "ts", "action", "attacker", "target", "attacker_owner", "target_owner", "amount",
    "mechanic", "verb", "spell", "miss_reason", "is_critical", "attacker_kind", "target_kind",
]


@dataclass(frozen=True)
class Options:
    """Encounter settings in seconds.

    ``strict_compat`` keeps known oddities of the log format's established readers
    (see the README's table); without it they are put right.
    """

    idle_s: int = 45
    min_duration_s: int = 3
    max_duration_s: int = 600
    split_on_all_dead: bool = True
    reengage_s: int = 12
    bridge_recovery: bool = True
    recovery_s: int = 180
    crit_window_s: int = 2
    strict_compat: bool = True

    @staticmethod
    def from_rest_period(seconds: int) -> Options:
        """Settings for a rest period of 0-300 s; 0 means one encounter per pull."""
        r = max(0, min(300, int(seconds)))
        if r == 0:
            return Options(idle_s=6, reengage_s=0, bridge_recovery=False)
        return Options(idle_s=r, reengage_s=r, split_on_all_dead=False, max_duration_s=1200)

    def with_idle(self, seconds: int) -> Options:
        return replace(self, idle_s=int(seconds))

    @property
    def forgets_after_s(self) -> int:
        """After a longer silence of events no encounter state is left."""
        return max(self.idle_s, self.recovery_s, self.reengage_s)
