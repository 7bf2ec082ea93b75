"""Pets and their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES_PER_CHUNK = 65_536


def ownership_tags(outcomes: DataFrame) -> DataFrame:
    """``log_id, line_no, pet, owner`` wherever a line states an ownership."""
    return outcomes.where("pet_tag is not null").select("log_id", "line_no", F.col("pet_tag").alias("pet"), F.col("pet_tag_owner").alias("owner"))


def final_owners(tags: DataFrame) -> DataFrame:
    """``log_id, pet_key, owner``: the last owner stated for each pet of a log."""
    last = F.max(F.struct("line_no", "owner")).getField("owner")
    return tags.groupBy("log_id", F.lower("pet").alias("pet_key")).agg(last.alias("owner"))


def asof_last(df: DataFrame, keys: list[str], seq: str, value: str, out: str, chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row, by ``keys`` and ``seq``.

    The as-of join over rows that carry their own right side (union both sides first).
    Windows run per (keys, chunk of ``seq``), so one hot key is spread; what an earlier
    chunk leaves behind is one value, carried by a window over the chunks. Null keys
    form a group.
    """
    cut = df.withColumn("__chunk", F.expr(f"{seq} div {chunk}"))
    within = Window.partitionBy(*keys, "__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__v", F.last(value, ignorenulls=True).over(within))
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(seq, value))).getField(value)
    chunks = cut.groupBy(*keys, "__chunk").agg(last.alias("__e"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("__c", F.last("__e", ignorenulls=True).over(before)).drop("__e")
    return local.join(carried, [*keys, "__chunk"], "left").withColumn(out, F.coalesce("__v", "__c")).drop("__chunk", "__v", "__c")


def with_owners(outcomes: DataFrame) -> DataFrame:
    """Add ``attacker_owner`` as known at the line: the line's own hint, else the last tag before it.

    Only damage and heals look an owner up; misses and deaths do not.
    """
    keyed = outcomes.withColumn("__actor", F.lower(F.coalesce("pet_tag", "attacker")))
    known = asof_last(keyed, ["log_id", "__actor"], "line_no", "pet_tag_owner", "__known")
    looks_up = F.col("action").isin("damage", "heal") & F.col("attacker").isNotNull() & (F.lower("attacker") == F.col("__actor"))
    return known.withColumn("attacker_owner", F.coalesce("owner_hint", F.when(looks_up, F.col("__known")))).drop("__actor", "__known")


def credited(kind: Column, actor: Column, owner: Column) -> Column:
    """The fighter an actor's deeds count for: a pet's known owner, else the actor."""
    return F.when((kind == "pet") & owner.isNotNull() & (F.lower(owner) != F.lower(actor)), owner).otherwise(actor)


def pet_of(kind: Column, actor: Column, owner: Column) -> Column:
    """The pet's own name where its deeds are credited to an owner."""
    return F.when((kind == "pet") & owner.isNotNull() & (F.lower(owner) != F.lower(actor)), actor)
