"""Cutting the lineage of tables that later steps read again and again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    A local session that has none, as in tests, gets a folder of its own; on a
    cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
            place = tempfile.mkdtemp(prefix="trailforge-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The table as it is now, written to the shared folder, so that a lost executor costs no more than reading it."""
    folder(df.sparkSession)
    return df.checkpoint()
