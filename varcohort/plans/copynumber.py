"""Queries of depth models, copy number, smooth effects, factors and linkage, over libraries and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calling as K
from ..operators import copynumber as C
from ..operators import factor
from ..operators import genotype as G
from ..operators import series as S
from ..operators import smooth
from ..operators.shared import keep
from . import fixtures as X
from .cohort import KING
from .registry import query, rounded


def gc_shares(spark, sf):
    """GC share of each variant's surroundings in three widths, the wider ones near to the narrow."""
    v = F.col("v").cast("long")
    narrow = (30 + (v * 37) % 41).cast("double")
    return X.variants(spark, sf).select("v", (narrow / 100).alias("gc100"), ((narrow + (v * 11) % 7) / 100).alias("gc200"), ((narrow + (v * 11) % 7 + (v * 13) % 5) / 100).alias("gc400"))


def expected_depth(spark, sf):
    cells = keep(X.libraries(spark, sf).select("v", "s", "dp", "ad"))
    affinity = S.depth_affinity(cells, "s", "v", "dp")
    return smooth.depth_anomaly(cells, affinity, gc_shares(spark, sf), ["gc100", "gc200", "gc400"], pieces=4)


@query()
def depth_anomaly(spark, sf):
    """Depth expected of two copies, by affinity and GC, at every locus of every library."""
    return rounded(expected_depth(spark, sf)[1], "lambda")


@query()
def copy_number_segments(spark, sf):
    """From depths to segments: affinity, depth model, het loci, windows, copies; with the chosen model of each library."""
    trace = expected_depth(spark, sf)[1]
    het = K.mark_fixed(trace, 0.02, 0.01).where("het").join(X.variants(spark, sf).where("contig <> 'X'").select("v", "contig", "pos"), "v")
    segments, models = C.segment_copy_number(het, "s", 50)
    best = models.where("best").select("s", "bic", F.when(F.col("mink") == 0, F.col("maxk")).alias("max_copies"))
    return rounded(segments.join(best, "s"), "f", "ll", "bic")


@query()
def smooth_perm_test(spark, sf):
    """Whether the part of a customer's money spent late tells anything of their balance, beside orders and spending, by sex, in the training and the validation rows."""
    orders = X.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"), F.avg(F.dayofyear("o_orderdate").cast("double")).alias("day"))
    rows = X.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("y"), F.when(F.col("c_custkey") % 2 == 1, "female").otherwise("male").alias("sex")).join(orders, "k")
    parted = smooth.split_rows(rows, "sex", "k", 314159).withColumn("test", F.concat_ws(":", "sex", "split"))
    return rounded(smooth.smooth_perm_test(parted, "test", "k", "y", ["orders", "spent"], ["day"], 10_000, 314159), "deviance", "p")


def burden_matrix(spark, sf):
    """Alternate reads of each library by class of variant: contig and both alleles."""
    kinds = X.variants(spark, sf).select("v", F.concat_ws(":", F.substring("ref", 1, 1), F.substring("alt", 1, 1), (F.col("v") % 3).cast("string")).alias("kind"))
    return X.libraries(spark, sf).where("gt > 0").join(kinds, "v").groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"))


@query()
def nmf_fits(spark, sf):
    """Every rank and restart of the factorisation of burdens."""
    fits = factor.Factors(burden_matrix(spark, sf), "kind", "s", "n", [2, 3, 4, 5], 4).fits
    return rounded(spark.createDataFrame(fits, "k int, restart int, rss double, explained double"), "rss", "explained")


@query()
def nmf_exposures(spark, sf):
    """Each library's share in three signatures."""
    return factor.Factors(burden_matrix(spark, sf), "kind", "s", "n", [3], 4).exposures(3).withColumn("exposure", F.round("exposure", 3))


@query("variants libraries", """
WITH n AS (SELECT a.v AS v1, b.v AS v2 FROM variants a JOIN variants b ON a.contig = b.contig AND b.pos > a.pos AND b.pos - a.pos <= 9000),
t AS (SELECT v1, v2, count(*) AS n, sum(x.gt)::DOUBLE AS sx, sum(y.gt)::DOUBLE AS sy, sum(x.gt * x.gt)::DOUBLE AS sxx, sum(y.gt * y.gt)::DOUBLE AS syy, sum(x.gt * y.gt)::DOUBLE AS sxy
  FROM n JOIN libraries x ON x.v = v1 JOIN libraries y ON y.v = v2 AND y.s = x.s WHERE x.gt IS NOT NULL AND y.gt IS NOT NULL GROUP BY 1, 2)
SELECT v1, v2, n, sign(n * sxy - sx * sy)::DOUBLE AS sign, round((n * sxy - sx * sy)^2 / ((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) AS r2
FROM t WHERE n * sxx > sx * sx AND n * syy > sy * sy""")
def ld_r2_libraries(spark, sf):
    """Linkage over all libraries, whose number grows with the tables."""
    return rounded(G.ld_r2(X.libraries(spark, sf), X.variants(spark, sf), 9000), "sign", "r2")


#: Calls of strangers, both alleles drawn by themselves, and a copy of each tenth library with every ninth variant's call turned.
DRAWN = "CAST((v::BIGINT * v * 13 + s::BIGINT * s * 7 + v::BIGINT * s * 29) % 101 < t AS INT) + CAST((v::BIGINT * v * 19 + s::BIGINT * s * 23 + v::BIGINT * s * 53 + 41) % 103 < t AS INT)"
COPIES = f"""drawn AS (SELECT v, s, {DRAWN} AS gt FROM (SELECT v, s, 5 + (v * 37) % 90 AS t FROM libraries)),
genotypes AS (SELECT v, s, gt FROM drawn UNION ALL SELECT v, s + 3000000 AS s, CASE WHEN v % 9 = 0 THEN (gt + 1) % 3 ELSE gt END AS gt FROM drawn WHERE s % 10 = 0)"""


@query("libraries", f"""
WITH {COPIES}, {KING},
d AS (SELECT s1, s2, CASE WHEN round(kin, 6) >= 2.0^(-1.5) THEN 0 WHEN round(kin, 6) >= 2.0^(-2.5) THEN 1 WHEN round(kin, 6) >= 2.0^(-3.5) THEN 2 ELSE 5 END AS degree FROM kin WHERE kin IS NOT NULL AND n_sites >= 100)
SELECT DISTINCT unnest(CASE WHEN degree = 0 AND s1 % 3 = s2 % 3 THEN [s1, s2] ELSE [greatest(s1, s2)] END) AS s FROM d WHERE degree <= 2""")
def relatives_to_drop(spark, sf):
    """Related libraries among strangers, judged over a hundred shared sites at least."""
    v, s, t = F.col("v").cast("long"), F.col("s").cast("long"), 5 + (F.col("v") * 37) % 90
    drawn = ((v * v * 13 + s * s * 7 + v * s * 29) % 101 < t).cast("int") + ((v * v * 19 + s * s * 23 + v * s * 53 + 41) % 103 < t).cast("int")
    cells = X.libraries(spark, sf).select("v", "s", drawn.alias("gt"))
    copies = cells.where("s % 10 = 0").select("v", (F.col("s") + 3_000_000).alias("s"), F.when(F.col("v") % 9 == 0, (F.col("gt") + 1) % 3).otherwise(F.col("gt")).alias("gt"))
    gt = cells.union(copies)
    cohorts = gt.select("s").distinct().withColumn("cohort", F.col("s") % 3)
    return G.related_to_drop(rounded(G.king_kinship(gt), "kin"), cohorts, 100)
