"""Reliable cuts of lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, stored by a reliable checkpoint in ``shared_dir``."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Without one, a temporary folder will do where driver and executors are one process; elsewhere that would
    lose data, and is refused."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    given = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if given:
        return given
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="seqloom-")
