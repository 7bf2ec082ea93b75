"""All core queries and their SQL twins, gathered for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skirmish.plans import parse_queries, planted, problems, queries, sinks

QUERIES = {**problems.QUERIES, **queries.QUERIES, **parse_queries.QUERIES, **planted.QUERIES, **sinks.QUERIES}
ORACLES = {**problems.ORACLES, **queries.ORACLES, **parse_queries.ORACLES, **planted.ORACLES, **sinks.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, healing, swings and deaths of every fighter of every encounter."""
    return queries.r_fighters(spark, sf_dir)
