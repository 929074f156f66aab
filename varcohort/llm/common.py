"""What several operators of this subpackage share: tables, lineage cuts, ids and spans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on one machine gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-varcohort-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes what an operator wrote into the shared folder and needs no more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: DataFrame, how: str = "inner", share: int = 1000, salts: int = 64) -> DataFrame:
    """``left`` joined to ``right``, which has a row for each ``key``, where a few keys may hold most rows of ``left``.

    ``rows`` is (key, n), n rows of ``left`` each. Keys with over a ``share``-th of all rows, of which there are fewer
    than ``share``, are sent to all tasks; their rows are dealt over ``salts``, and their rows of ``right`` copied so often.
    """
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = rows.where(F.col("n") > max(total // share, 1)).select(key, F.lit(True).alias("__hot"))
    seed = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__hot"), seed).otherwise(0)).drop("__hot")  # fewer than ``share`` rows
    copies = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def cut(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends there: a lost executor costs at most the tasks of the step at hand.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``df``; the rest, clashing names included, are dropped here."""
    return df.select(*columns)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (value, start, end) for the leftmost non-overlapping matches of ``pattern``.

    Positions are code points, ``end`` exclusive. ``split`` gives what lies between the matches that
    ``regexp_extract_all`` gives, so the running sum of both lengths is the start of each match.
    ``value`` is the capture group ``group``; the pattern must never match the empty string.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(between.alias("gap"), whole.alias("hit"), value.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<value:string,start:int,end:int>>)").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        hit = F.struct(part["value"].alias("value"), start.alias("start"), end.alias("end"))
        return F.when(part["hit"].isNull(), F.struct(start.alias("at"), acc["found"].alias("found"))).otherwise(
            F.struct(end.alias("at"), F.concat(acc["found"], F.array(hit)).alias("found"))
        )

    return F.aggregate(parts, zero, step, lambda acc: acc["found"])
