"""Lineage cuts of operators that go on in rounds, and folders for tables that they write."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir, or, in a session on one machine only, a folder of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-varcohort-"))
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def keep_as_dealt(df: DataFrame) -> DataFrame:
    """``df`` written with what is known of how its rows are dealt: sums and joins by the key of its last join or repartition move none of them.

    An adaptive plan would not hand this on, so this one isn't.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return keep(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def keep_dealt(df: DataFrame, by: str, least: int = 0) -> DataFrame:
    """``df`` dealt by ``by``, into ``least`` partitions at least, and written (``keep_as_dealt``)."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)
    return keep_as_dealt(df.repartition(n, by))


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    return f"{checkpoints(spark)}/{name}-{uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
