"""Session helpers: table loading and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_cleaned: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    # the JVM may be gone before this process is
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared checkpoint folder.

    The folder is the one named by ``spark.checkpoint.dir``. Only where nothing
    is set and the master is local (tests, a laptop) a temporary folder is used;
    a cluster without the setting is an error, because executors would not see
    a driver-local folder. What the application wrote there (Spark gives it a folder of its own) is
    removed when the process ends; with ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes a
    checkpoint as soon as nothing refers to it.
    """
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if not given.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="skirmish-checkpoint-")
            atexit.register(_remove, spark, folder)
        sc.setCheckpointDir(folder)
        given = sc._jsc.sc().getCheckpointDir()
    own = given.get()
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_remove, spark, own)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost one re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over at least as many tasks as there are cores, before work that is heavy per row.

    A file with few row groups would otherwise keep most cores idle. Scans that already
    have enough splits, as any large table has, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
