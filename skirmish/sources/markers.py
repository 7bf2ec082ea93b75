"""Split markers in JSON side files: ``{"Identity": ..., "Markers": [{"Timestamp": ..., "Kind": 0}]}``."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "Identity string, Markers array<struct<Timestamp:string,Kind:int>>"


def default_path(identity: str) -> str:
    """Where the markers of a character's logs are kept: a folder in the user's home."""
    return os.path.join(os.path.expanduser("~"), ".skirmish", "markers", identity + ".json")


def load_markers(spark: SparkSession, path: str) -> DataFrame:
    """``log_id, ts, kind`` of all marker files under ``path``; broken or missing files give no rows."""
    try:
        docs = spark.read.schema(_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # noqa: BLE001 - a missing folder is an empty store
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "log_id string, ts timestamp_ntz, kind int")
    marks = docs.select(F.col("Identity").alias("log_id"), F.explode("Markers").alias("m"))
    ts = F.substring(F.replace(F.col("m.Timestamp"), F.lit("T"), F.lit(" ")), 1, 19).try_cast("timestamp_ntz")
    return marks.select("log_id", ts.alias("ts"), F.col("m.Kind").alias("kind")).where("ts is not null")


def _read(path: str, identity: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        if isinstance(doc, dict) and isinstance(doc.get("Markers"), list):
            return doc
    except (OSError, ValueError):
        pass
    return {"Identity": identity, "Markers": []}


def _write(path: str, doc: dict) -> None:
    doc["Markers"].sort(key=lambda m: m["Timestamp"])
    with open(path + ".part", "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2)
    os.replace(path + ".part", path)


def add_split(path: str, identity: str, at: datetime) -> None:
    """Add a split to a side file; an equal stamp is not added twice; the list stays sorted."""
    doc, stamp = _read(path, identity), at.isoformat()
    if all(m["Timestamp"] != stamp for m in doc["Markers"]):
        doc["Markers"].append({"Timestamp": stamp, "Kind": 0})
        _write(path, doc)


def remove_split(path: str, identity: str, at: datetime) -> bool:
    """Remove the split nearest to ``at`` if less than a second away; True if one was removed."""
    doc = _read(path, identity)
    near = [(abs((datetime.fromisoformat(m["Timestamp"]) - at).total_seconds()), i) for i, m in enumerate(doc["Markers"])]
    if not near or min(near)[0] >= 1:
        return False
    del doc["Markers"][min(near)[1]]
    _write(path, doc)
    return True
