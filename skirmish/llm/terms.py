"""Frequencies of every distinct value, with a mark on the too rare and too common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_frequencies(df: DataFrame, terms: dict[str, Column], record: list[str], few: int, common_share: float, records: DataFrame | None = None) -> DataFrame:
    """Occurrences and record counts of every term of every field.

    ``terms`` maps a field name to its expression over ``df`` (null: no term);
    ``record`` are the columns that identify a record. A row with a null in any
    record column counts as an occurrence but belongs to no record. Result:
    ``field, term, n_occurrences, n_records, mark`` with mark ``rare`` below
    ``few`` records, ``common`` above ``common_share`` of all records, else
    ``kept``. Repeated rows count as often as they stand there; an empty table
    gives no rows.

    Counts per (term, record) are combined by hash before the first shuffle, so
    the number of records of a term is a plain count afterwards and the second
    aggregate again combines before it shuffles: a term that every row uses costs
    one row per task. The number of all records is a scalar subquery over ``records`` (default: ``df``),
    any table with the record columns, such as the raw one where ``df`` is costly to make.
    """
    ids = [f"__r{i}" for i in range(len(record))]
    keyed = [F.col(r).alias(i) for r, i in zip(record, ids, strict=True)]
    known = F.lit(True)
    for i in ids:
        known = known & F.col(i).isNotNull()
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), e.alias("term")) for f, e in terms.items()])
    emitted = df.select(*keyed, F.explode(pairs).alias("__p")).select(*ids, "__p.field", "__p.term").where("term is not null")
    per_record = emitted.groupBy("field", "term", *ids).agg(F.count(F.lit(1)).alias("__n"))
    summed = per_record.groupBy("field", "term").agg(F.sum("__n").alias("n_occurrences"), F.count(F.when(known, 1)).alias("n_records"))
    total = (df if records is None else records).select(*keyed).where(known).distinct().agg(F.count(F.lit(1))).scalar()
    mark = F.when(F.col("n_records") < few, "rare").when(F.col("n_records") > total * common_share, "common").otherwise("kept")
    return summed.select("field", "term", "n_occurrences", "n_records", mark.alias("mark"))
