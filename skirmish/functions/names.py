"""Name and label normalisation as column expressions (no Python in the hot path)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens by which a log refers to its own character (case-sensitive).
SELF_TOKENS = [
    "You", "YOU", "you", "Your", "your", "YOUR", "yourself", "Yourself",
    "himself", "Himself", "herself", "Herself", "itself",
]


def collapse_spaces(c: Column) -> Column:
    """Trim and turn runs of spaces into one space; null stays null."""
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def strip_corpse(c: Column) -> Column:
    """Remove a corpse suffix: ``'s corpse``, `` `s corpse`` or a fused ``scorpse``.

    The fused form only counts on a single word of more than eight characters.
    """
    fused = F.regexp_replace(c, "(?i)^(?=[^ ]{9,}$)(.*)scorpse$", "$1")
    return F.rtrim(F.regexp_replace(fused, "(?i)['`]s corpse$", ""))


def lower_article(c: Column) -> Column:
    """``A rat`` -> ``a rat`` when the word after the article starts in lower case."""
    for article in ("A", "An", "The"):
        c = F.regexp_replace(c, rf"^{article} (?=\p{{Ll}})", f"{article.lower()} ")
    return c


def resolve_name(c: Column, character: Column) -> Column:
    """Display name of an actor: spaces, pronouns, corpse suffix, leading article.

    ``character`` is the log's own character; where it is null a pronoun becomes
    ``You``. Null input gives null.
    """
    me = F.coalesce(character, F.lit("You"))
    bare = strip_corpse(collapse_spaces(c))
    worked = F.when(bare.isin(SELF_TOKENS), me).otherwise(lower_article(bare))
    untidy = reduce(or_, [c.contains("  "), c.startswith(" "), c.endswith(" "), F.lower(c).endswith("corpse"), *[c.startswith(a) for a in ("A ", "An ", "The ")]])
    return F.when(c.isin(SELF_TOKENS), me).when(untidy, worked).otherwise(c)


def name_key(c: Column) -> Column:
    """Comparison form of a name: collapsed, without corpse suffix, lower case."""
    return F.lower(strip_corpse(collapse_spaces(c)))


def term_key(c: Column) -> Column:
    """Comparison form of a spell or verb; blank becomes null."""
    return F.nullif(F.lower(collapse_spaces(c)), F.lit(""))


def has_article(c: Column) -> Column:
    """True for names that begin with a/an/the (any case)."""
    return F.coalesce(c.rlike("(?i)^(a|an|the) "), F.lit(False))
