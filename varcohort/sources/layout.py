"""Tables laid out on disk by position: files that interval queries skip, and databases that join without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a clustered table keeps its list of files; readers of the table pass over names with an underscore.
FILES = "_files"


def write_clustered(df: DataFrame, path: str, rows: int = 4_000_000, contig: str = "contig", pos: str = "pos") -> None:
    """Parquet clustered by (contig, pos), about ``rows`` rows a file, and a list of files with the stretch that each holds.

    Rows are dealt by ranges, so a contig of any length is many files and none holds more than its range. A file may end
    one contig and begin the next; it is listed once for each. Null contigs or positions are kept and never listed: no interval asks for them.
    """
    n = max(1, -(-df.count() // rows))
    df.repartitionByRange(n, contig, pos).sortWithinPartitions(contig, pos).write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    listed = spark.read.schema(df.schema).parquet(path).where(F.col(contig).isNotNull() & F.col(pos).isNotNull())
    listed = listed.groupBy(F.col("_metadata.file_name").alias("file"), F.col(contig).alias("contig"))
    listed.agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{FILES}")


def inside(intervals: list[tuple[str, int | None, int | None]], contig: Column, first: Column, last: Column) -> Column:
    """Whether (first, last) meets any of (contig, from, to), ends inclusive; a null end is open, so that (contig, null, null) is all of it."""
    terms = []
    for name, low, high in intervals:
        term = contig == name
        term = term if low is None else term & (last >= low)
        terms.append(term if high is None else term & (first <= high))
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def files_of(spark: SparkSession, path: str, intervals: list[tuple[str, int | None, int | None]]) -> list[str]:
    """Files of a clustered table that may hold a row of the intervals: a row a file is looked at, whatever the table's size."""
    hit = spark.read.parquet(f"{path}/{FILES}").where(inside(intervals, F.col("contig"), F.col("first"), F.col("last")))
    return [f"{path}/{r['file']}" for r in hit.select("file").distinct().orderBy("file").collect()]


def read_intervals(spark: SparkSession, path: str, intervals: list[tuple[str, int | None, int | None]], contig: str = "contig", pos: str = "pos") -> DataFrame:
    """Rows of a clustered table inside literal intervals; only files that may hold one are opened, and their row groups are pruned in turn."""
    files = files_of(spark, path, intervals)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(path).limit(0)
    return rows.where(inside(intervals, F.col(contig), F.col(pos), F.col(pos)))


def allele(ref: Column, alt: Column) -> Column:
    return F.concat(ref, F.lit(">"), alt)


def by_position(db: DataFrame, fields: list[str]) -> DataFrame:
    """A database of split alleles (contig, pos, ref, alt, fields) as a row a position: ``alleles``, a map from ref>alt to the fields.

    An allele that comes more than once keeps its smallest fields; rows with a null in the key are left out.
    """
    rows = db.dropna(subset=["contig", "pos", "ref", "alt"]).groupBy("contig", F.col("pos").cast("long").alias("pos"), allele(F.col("ref"), F.col("alt")).alias("__a"))
    one = rows.agg(F.min(F.struct(*fields)).alias("__f"))
    return one.groupBy("contig", "pos").agg(F.map_from_entries(F.collect_list(F.struct("__a", "__f"))).alias("alleles"))


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """``df`` as a table of the catalogue, its files bucketed by (contig, pos); returned as read back.

    Tables with the same number of buckets join by (contig, pos) where they lie. The number is part of the layout and has
    to be the same for all: a bucket should fit one task's memory.
    """
    rows = df.withColumn("pos", F.col("pos").cast("long")).repartition(buckets, "contig", "pos")
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "contig", "pos").sortBy("contig", "pos").saveAsTable(name)
    return df.sparkSession.table(name)


def annotate_sites(sites: DataFrame, databases: dict[str, DataFrame]) -> DataFrame:
    """Sites (contig, pos, ref, alts, ...) with an array for each database: its fields for every alternate, null where it has none.

    Sites and databases (as of ``by_position``) come from ``write_bucketed`` with one number of buckets, so that however many
    databases there are nothing is shuffled, and a site's alleles are never taken apart and put together again.
    """
    out = sites
    for root, db in databases.items():
        side = db.select("contig", "pos", F.col("alleles").alias(f"__{root}"))
        out = out.join(side.hint("merge"), ["contig", "pos"], "left")
    found = lambda root: F.transform("alts", lambda a: F.try_element_at(F.col(f"__{root}"), allele(F.col("ref"), a)))
    return out.withColumns({root: found(root) for root in databases}).drop(*[f"__{root}" for root in databases])
