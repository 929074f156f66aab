"""Cohort-shaped views of the given tables, once as DataFrames and once as SQL.

Integer arithmetic only, so that both engines agree: ``samples`` (every customer), ``variants`` (every part, insertions,
deletions and multi-allelic sites among them), ``genotypes`` (a cell for each part and customer that share an order line),
``pools`` (the same, with a nation's customers pooled as one sample, so that most cells have a call), ``libraries`` (the
same, with suppliers for samples: some hundred loci each, and more samples at each scale), ``regions``,
``features`` (a second interval set), ``trace``, ``bases`` (a reference sequence with gaps) and ``models`` (polygenic
score models). Positions spread over contigs whose length grows with the parts.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTIGS = ("1", "2", "3", "4", "X")
#: Length of a contig's end on which no variant lies.
TAIL = 10_000


class Span(NamedTuple):
    """Numbers of samples and variants, and the length over which positions are spread."""

    n_samples: int
    n_variants: int
    length: int


SPAN: ContextVar[Span] = ContextVar("span")


def spanned(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``f`` with the sizes of its tables known: two counts that the files' footers answer."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = read(spark, sf_dir, "part").count()
        before = SPAN.set(Span(read(spark, sf_dir, "customer").count(), n, 100_000 * max(1, -(-n // 300))))
        try:
            return f(spark, sf_dir)
        finally:
            SPAN.reset(before)

    return run


def n_samples() -> int:
    return SPAN.get().n_samples


def n_variants() -> int:
    return SPAN.get().n_variants


def length() -> int:
    return SPAN.get().length


def contig_length() -> int:
    return length() + TAIL


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def contig(n: Column) -> Column:
    return F.when(n == 5, "X").otherwise(n.cast("string"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("s"), (F.col("c_nationkey") % 5).cast("int").alias("pop"))
    cohort = F.when(F.col("s") % 3 == 0, "A").when(F.col("s") % 3 == 1, "B").otherwise("Z")
    return rows.select("s", "pop", (F.col("s") % 2 == 1).alias("is_female"), cohort.alias("cohort"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey").cast("long"), F.col("p_size")
    base = lambda n: F.substring(F.lit("ACGT"), n.cast("int"), F.lit(1))
    first, other = base(1 + k % 4), base(1 + (k + 1 + size % 3) % 4)
    rows = read(spark, sf_dir, "part").select(
        k.cast("int").alias("v"), contig(1 + k % 5).alias("contig"), (1 + (k * 104729) % length()).cast("long").alias("pos"),
        F.when(size % 13 == 0, F.concat(first, F.lit("TG"))).otherwise(first).alias("ref"),
        F.when(size % 13 == 0, first).when(size % 11 == 0, F.concat(first, other)).otherwise(other).alias("alt"),
        size.cast("int").alias("size"), F.col("p_brand").alias("symbol"), "p_retailprice",
    )
    second = F.element_at(F.filter(F.array(*map(F.lit, "ACGT")), lambda b: (b != F.col("ref")) & (b != F.col("alt"))), 1)
    return rows.withColumn("alts", F.when(F.col("size") % 7 == 0, F.array("alt", second)).otherwise(F.array("alt")))


def first_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants cut to the first base of their reference allele, for queries that ask where a position lies."""
    return variants(spark, sf_dir).withColumn("ref", F.substring("ref", 1, 1))


def parts(spark: SparkSession, sf_dir: str, most: int = 1 << 18) -> int:
    """Into how many partitions order lines, and their cells, are dealt: ``most`` lines in each on average, so that a task's memory doesn't follow the tables; few for few lines."""
    n = read(spark, sf_dir, "lineitem").count()  # the file's footer answers
    return max(1, n // most + 1, min(spark.sparkContext.defaultParallelism, n >> 14))


def called(rows: DataFrame, sample: Column, n_parts: int) -> DataFrame:
    """Summed reads of each part and sample over order lines, and the call that they support; dealt by cell into ``n_parts``.

    Few cells have several lines, so lines are not summed before they are dealt.
    """
    v, n = F.col("l_partkey").cast("int"), F.col("l_quantity").cast("long")
    draw = (F.col("l_suppkey") * 7 + F.col("l_orderkey") * 13 + F.col("l_linenumber") * 29) % 100 * 100
    t = (5 + (v * 37) % 90).cast("long")  # the alternate's share, of a hundred
    reads = F.when(draw < t * t, n).when(draw < 200 * t - t * t, F.floor(n / 2)).otherwise(0)
    rows = rows.select(v.alias("v"), sample.cast("int").alias("s"), n.alias("n"), reads.alias("reads")).repartition(n_parts, "v", "s")
    rows = rows.groupBy("v", "s").agg(F.sum("n").alias("dp"), F.sum("reads").alias("ad"))
    dp, ad = F.col("dp"), F.col("ad")
    return rows.withColumn("gt", F.when(dp < 5, None).when(5 * ad < dp, 0).when(5 * ad > 4 * dp, 2).otherwise(1))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


def cells(spark: SparkSession, sf_dir: str, pooled: bool) -> DataFrame:
    """The cells of customers or, ``pooled``, of their nations."""
    n = parts(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("merge")  # as large as its files say, times the packing
    if pooled:  # orders meet their customers before the lines, which are more
        orders = orders.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = lines(spark, sf_dir).repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return called(rows, F.col("c_nationkey" if pooled else "o_custkey"), n)


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of suppliers: some 600 loci each, and as many more samples as there are suppliers."""
    return called(lines(spark, sf_dir), F.col("l_suppkey"), parts(spark, sf_dir))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, False)


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, True)


def n_pools(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "nation").count()


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    start = (k * 7919) % length()
    return read(spark, sf_dir, "supplier").select(contig(1 + k % 5).alias("contig"), start.alias("start0"), (start + 200 + k % 800).alias("end0"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    start = (k * 6151) % length()
    return read(spark, sf_dir, "part").select(contig(1 + k % 5).alias("contig"), start.alias("start0"), (start + 50 + (k * 31) % 900).alias("end0"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("series"), order.cast("long").alias("pos"), "event_type", F.col("value").alias("value"))


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base for each event of a user, in order; every ninth position is not known."""
    t = trace(spark, sf_dir).where("pos % 9 <> 0")
    return t.select(F.concat_ws(":", "series", "pos").alias("v"), F.col("series").cast("string").alias("contig"), "pos", F.substring(F.lit("ACGT"), (1 + F.floor("value") % 4).cast("int"), F.lit(1)).alias("ref"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score models: variant, allele frequency of the model (percent of a hundred, exact) and coefficient."""
    k = F.col("v")
    return variants(spark, sf_dir).select(
        F.concat(F.lit("m"), (k % 4).cast("string")).alias("id"), "v", (((k * 17) % 100) / F.lit(100.0)).alias("aaf"), (((k * 29) % 201 - 100) / F.lit(100.0)).alias("coef")
    )


SQL = {
    "span": """span AS (
        SELECT (SELECT count(*) FROM customer) AS n_samples, count(*) AS n_variants, 100000 * greatest(1, (count(*) + 299) // 300) AS length FROM part)""",
    "samples": """samples AS (
        SELECT s, pop, s % 2 = 1 AS is_female, CASE s % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Z' END AS cohort
        FROM (SELECT CAST(c_custkey AS INT) AS s, CAST(c_nationkey % 5 AS INT) AS pop FROM customer))""",
    "variants": """variants AS (
        SELECT *, CASE WHEN size % 7 = 0 THEN [alt, [b FOR b IN ['A','C','G','T'] IF b <> ref AND b <> alt][1]] ELSE [alt] END AS alts FROM (
        SELECT v, contig, pos, CASE WHEN size % 13 = 0 THEN a || 'TG' ELSE a END AS ref, CASE WHEN size % 13 = 0 THEN a WHEN size % 11 = 0 THEN a || b ELSE b END AS alt, size, symbol, p_retailprice FROM (
        SELECT CAST(p_partkey AS INT) AS v, CASE WHEN p_partkey % 5 = 4 THEN 'X' ELSE CAST(1 + p_partkey % 5 AS VARCHAR) END AS contig,
               CAST(1 + (p_partkey::BIGINT * 104729) % (SELECT length FROM span) AS BIGINT) AS pos, substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS a,
               substr('ACGT', CAST(1 + (p_partkey + 1 + p_size % 3) % 4 AS INT), 1) AS b, CAST(p_size AS INT) AS size, p_brand AS symbol, p_retailprice
        FROM part)))""",
    **{name: f"""{name} AS (
        SELECT v, s, dp, ad, CASE WHEN dp < 5 THEN NULL WHEN 5 * ad < dp THEN 0 WHEN 5 * ad > 4 * dp THEN 2 ELSE 1 END AS gt FROM (
        SELECT CAST(l_partkey AS INT) AS v, CAST({sample} AS INT) AS s, CAST(sum(n) AS BIGINT) AS dp,
               CAST(sum(CASE WHEN draw < t * t THEN n WHEN draw < 200 * t - t * t THEN n // 2 ELSE 0 END) AS BIGINT) AS ad
        FROM (SELECT *, (l_suppkey * 7 + l_orderkey * 13 + l_linenumber * 29) % 100 * 100 AS draw, 5 + (l_partkey * 37) % 90 AS t, CAST(l_quantity AS BIGINT) AS n FROM lineitem) {more} GROUP BY 1, 2))""" for name, sample, more in (
        ("genotypes", "o_custkey", "JOIN orders ON l_orderkey = o_orderkey"), ("pools", "c_nationkey", "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"), ("libraries", "l_suppkey", ""))},
    "regions": """regions AS (
        SELECT CASE WHEN s_suppkey % 5 = 4 THEN 'X' ELSE CAST(1 + s_suppkey % 5 AS VARCHAR) END AS contig,
               (s_suppkey * 7919) % (SELECT length FROM span) AS start0, (s_suppkey * 7919) % (SELECT length FROM span) + 200 + s_suppkey % 800 AS end0 FROM supplier)""",
    "features": """features AS (
        SELECT CASE WHEN p_partkey % 5 = 4 THEN 'X' ELSE CAST(1 + p_partkey % 5 AS VARCHAR) END AS contig,
               (p_partkey * 6151) % (SELECT length FROM span) AS start0, (p_partkey * 6151) % (SELECT length FROM span) + 50 + (p_partkey * 31) % 900 AS end0 FROM part)""",
    "trace": """trace AS (
        SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type, value FROM events)""",
    "bases": """bases AS (
        SELECT series || ':' || pos AS v, series::VARCHAR AS contig, pos, substr('ACGT', CAST(1 + floor(value)::BIGINT % 4 AS INT), 1) AS ref FROM trace WHERE pos % 9 <> 0)""",
    "models": """models AS (
        SELECT 'm' || (v % 4) AS id, v, ((v * 17) % 100) / 100.0 AS aaf, ((v * 29) % 201 - 100) / 100.0 AS coef FROM variants)""",
}
NEEDS = {"models": ("variants",), "bases": ("trace",)}


def sql(views: str, body: str) -> str:
    """``body`` after the common table expressions of the views named in ``views``."""
    names = ["span"]
    for v in views.split():
        names += [n for n in (*NEEDS.get(v, ()), v) if n not in names]
    body = body.strip()
    head = "WITH " + ",\n".join(SQL[n] for n in names)
    return f"{head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"
