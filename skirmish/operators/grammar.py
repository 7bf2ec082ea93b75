"""The line grammar as data: ordered rules, verbs and miss words.

Rules are tried in order; the first that matches decides. A rule names the
groups of its pattern in ``slots``. Extend the grammar by adding rules.
"""

from __future__ import annotations

from dataclasses import dataclass

# Third-person combat verbs and their base forms.
VERBS = {
    "hits": "hit", "crushes": "crush", "slashes": "slash", "pierces": "pierce", "bites": "bite", "claws": "claw", "gores": "gore",
    "stings": "sting", "mauls": "maul", "smashes": "smash", "slams": "slam", "rends": "rend", "burns": "burn", "freezes": "freeze",
    "slices": "slice", "kicks": "kick", "punches": "punch", "bashes": "bash", "backstabs": "backstab", "strikes": "strike",
    "frenzies on": "frenzy",
}
SPECIAL_VERBS = ["kick", "punch", "bash", "backstab", "frenzy", "strike", "strikethrough"]
# Fragments of an avoided swing's reason, in order of precedence.
MISS_WORDS = [
    ("miss", "miss"), ("parr", "parry"), ("dodge", "dodge"), ("block", "block"), ("riposte", "riposte"),
    ("invulnerable", "invulnerable"), ("rune", "rune"), ("absorb", "rune"), ("magical skin", "rune"),
]
MISS_REASONS = ["miss", "parry", "dodge", "block", "riposte", "invulnerable", "rune"]

# Fixed patterns of the log's wording.
NAME = r"[A-Z][A-Za-z`'-]+"
PETS = r"[A-Z][A-Za-z '-]+?"
_3P = "|".join(VERBS)
_PTS = r"(\d+) points? of damage\."
_SPELL = r"(?: \((.+)\))?$"
PET_TAG = rf"^({NAME}) \(Owner: ({NAME})\) (.+)$"
DAMAGE_LIKE = r"(?i)points? of (?:non-melee )?damage|has taken \d+ damage"


@dataclass(frozen=True)
class Rule:
    """``outcome`` is event, crit, zone or ignored; an event has an ``action``.

    ``attacker``/``target``: 'self' (You), 'tag' (the stripped pet or nobody), 'tag_or_text'
    (the tag, else the captured text), 'text' (captured text), 'swarm' (owner and pet words), or
    '' (nobody). ``mechanic``: a fixed one, 'verb' (by verb) or 'swarm'. ``tag_only`` rules need a
    stripped tag. ``need`` are substrings every match contains; they are looked for
    before the pattern is tried.
    """

    id: str
    pattern: str
    slots: tuple[str, ...] = ()
    outcome: str = "event"
    action: str = ""
    attacker: str = ""
    target: str = "text"
    mechanic: str = ""
    tag_only: bool = False
    keeps_spell: bool = True
    need: tuple[str, ...] = ()


# Fixed patterns: the lines of the log, in the order in which they are tried.
RULES = [
    Rule("R1", r"^You have entered (.+?)\.$", ("zone",), outcome="zone", need=("You have entered ",)),
    Rule("R2", r"^(.+?) has been slain by (.+?)!$", ("target", "attacker"), action="death", attacker="text", need=(" has been slain by ",)),
    Rule("R3", r"^You have slain (.+?)!$", ("target",), action="death", attacker="self", need=("You have slain ",)),
    Rule("R4", r"^You have been slain by (.+?)!$", ("attacker",), action="death", attacker="text", target="self", need=("You have been slain by ",)),
    Rule("R5", rf"^(.+?) (?:scores? a critical hit|lands? a Crippling Blow|delivers? a critical blast)! \((\d+)\){_SPELL}", ("attacker", "amount", "spell"), outcome="crit", need=("! (",)),
    Rule("R6", r"\b(?:has|have) shielded .+? from \d+ points? of damage\.", outcome="ignored", need=(" shielded ",)),
    Rule("R7", r"^The Spellshield absorbed \d+ of \d+ points? of damage$", outcome="ignored", need=("The Spellshield absorbed ",)),
    Rule("R8", r"\babsorbs? \d+ (?:of \d+ )?points? of damage", outcome="ignored", need=("absorb",)),
    Rule("R9", rf"You have taken {_PTS}$", ("amount",), action="damage", target="self", mechanic="non_melee", need=("You have taken ",)),
    Rule("R10", rf"^You have been healed for {_PTS}{_SPELL}", ("amount", "spell"), action="heal", target="self", need=("You have been healed for ",)),
    Rule("R11", rf"^(.+?) (?:has|have) healed (.+?) for {_PTS}{_SPELL}", ("attacker", "target", "amount", "spell"), action="heal", attacker="tag_or_text", need=(" healed ",)),
    Rule("R12", rf"^(?:has|have) healed (.+?) for {_PTS}{_SPELL}", ("target", "amount", "spell"), action="heal", attacker="tag", tag_only=True, need=("healed ",)),
    Rule("R13", rf"^You heal (.+?) for {_PTS}{_SPELL}", ("target", "amount", "spell"), action="heal", attacker="self", need=("You heal ",)),
    Rule("R14", r"^(.+?) has taken (\d+) damage from (.+?) by (.+?)\.$", ("target", "amount", "spell", "attacker"), action="damage", attacker="text", mechanic="non_melee", need=(" damage from ", " by ")),
    Rule("R15", r"^(.+?) has taken (\d+) damage from your (.+?)\.$", ("target", "amount", "spell"), action="damage", attacker="self", mechanic="non_melee", need=(" damage from your ",)),
    Rule("R16", rf"^({NAME})`s ({PETS}) (hit|{_3P}) (.+?) for (\d+) points? of (non-melee )?damage\.{_SPELL}", ("owner", "pet", "verb", "target", "amount", "magic", "spell"), action="damage", attacker="swarm", mechanic="swarm", need=("`s ", " damage.")),
    Rule("R17", rf"^({NAME})`s ({PETS}) tries to ([a-z]+) (.+?), but ([^!]+)!$", ("owner", "pet", "verb", "target", "reason"), action="miss", attacker="swarm", mechanic="verb", need=("`s ", " tries to ")),
    Rule("R18", rf"^(.+?) was hit by non-melee for {_PTS}$", ("target", "amount"), action="damage", attacker="tag", mechanic="damage_shield", need=(" was hit by non-melee for ",)),
    Rule("R19", rf"^(.+?) hit (.+?) for (\d+) points? of non-melee damage\.{_SPELL}", ("attacker", "target", "amount", "spell"), action="damage", attacker="tag_or_text", mechanic="non_melee", need=(" hit ", " non-melee damage.")),
    Rule("R20", rf"^hit (.+?) for (\d+) points? of non-melee damage\.{_SPELL}", ("target", "amount", "spell"), action="damage", attacker="tag", mechanic="non_melee", need=("hit ", " non-melee damage.")),
    Rule("R21", rf"^You ([a-z]+) (.+?) for {_PTS}{_SPELL}", ("verb", "target", "amount", "spell"), action="damage", attacker="self", mechanic="verb", need=("You ", " of damage.")),
    Rule("R22", r"^You try to ([a-z]+) (.+?), but ([^!]+)!$", ("verb", "target", "reason"), action="miss", attacker="self", mechanic="verb", need=("You try to ",)),
    Rule("R23", rf"^(.+?) ([a-z]+) YOU for {_PTS}{_SPELL}", ("attacker", "verb", "amount", "spell"), action="damage", attacker="text", target="self", mechanic="verb", need=(" YOU for ",)),
    Rule("R24", rf"^(.+?) ({_3P}) (.+?) for {_PTS}{_SPELL}", ("attacker", "verb", "target", "amount", "spell"), action="damage", attacker="tag_or_text", mechanic="verb", need=(" of damage.",)),
    Rule("R25", rf"^({_3P}) (.+?) for {_PTS}{_SPELL}", ("verb", "target", "amount", "spell"), action="damage", attacker="tag", mechanic="verb", keeps_spell=False, need=(" of damage.",)),
    Rule("R26", r"^(.+?) tries to ([a-z]+) (.+?), but ([^!]+)!$", ("attacker", "verb", "target", "reason"), action="miss", attacker="text", mechanic="verb", need=(" tries to ",)),
]
SLOTS = ["attacker", "target", "amount", "verb", "spell", "reason", "owner", "pet", "magic", "zone"]
