"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session without that setting
    falls back to a folder of this machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if configured is None and not current.isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="quillguard-")
    if not current.isDefined():
        sc.setCheckpointDir(configured)
    return configured or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
