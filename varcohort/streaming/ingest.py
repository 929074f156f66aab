"""Incremental counts from a landing folder of genotype files: new files only, each batch merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTS = ("n_rr", "n_ra", "n_aa", "n_missing")


def counts(gt: DataFrame) -> DataFrame:
    g = F.col("gt")
    return gt.groupBy("v").agg(F.count_if(g == 0).alias("n_rr"), F.count_if(g == 1).alias("n_ra"), F.count_if(g == 2).alias("n_aa"), F.count_if(g.isNull()).alias("n_missing"))


def ingest_counts(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's partial counts under its batch number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        counts(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema("v int, s int, gt int").parquet(landing)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("v").agg(*[F.sum(c).alias(c) for c in COUNTS])
