"""Queries over allele-frequency tables."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from ..operators import af as AF
from ..operators import annotate as A
from . import fixtures as X
from .registry import query, rounded

COUNTS = """counts AS (SELECT v, 'p' || pop AS cohort, count(*) FILTER (gt = 0) AS n_rr, count(*) FILTER (gt = 1) AS n_ra, count(*) FILTER (gt = 2) AS n_aa, count(*) FILTER (gt IS NULL) AS n_missing
  FROM genotypes JOIN samples USING (s) GROUP BY v, pop)"""
POPS = [f"p{i}" for i in range(5)]
WIDE = "wide AS (SELECT v, " + ", ".join(f"max({n}) FILTER (cohort = '{p}') AS {n}_{p}" for p in POPS for n in AF.COUNTS) + " FROM counts GROUP BY v)"


def counts(spark, sf) -> DataFrame:
    g = F.col("gt")
    rows = X.genotypes(spark, sf).join(X.samples(spark, sf).select("s", F.concat(F.lit("p"), F.col("pop").cast("string")).alias("cohort")), "s")
    return rows.groupBy("v", "cohort").agg(F.count_if(g == 0).alias("n_rr"), F.count_if(g == 1).alias("n_ra"), F.count_if(g == 2).alias("n_aa"), F.count_if(g.isNull()).alias("n_missing"))


@query("samples genotypes", f"WITH {COUNTS}, {WIDE} SELECT * FROM wide")
def af_outer(spark, sf):
    c = counts(spark, sf)
    return AF.af_outer({p: c.where(F.col("cohort") == p) for p in POPS})


@query("samples genotypes", f"WITH {COUNTS} SELECT * FROM counts")
def af_long(spark, sf):
    return AF.af_long(AF.af_wide(counts(spark, sf), POPS), POPS)


@query("samples genotypes", f"WITH {COUNTS} SELECT v, cohort, round((n_ra + 2 * n_aa)::DOUBLE / nullif(2 * (n_rr + n_ra + n_aa), 0), 6) AS af FROM counts")
def af_from_counts(spark, sf):
    return rounded(counts(spark, sf).select("v", "cohort", AF.allele_frequency().alias("af")), "af")


@query("samples genotypes variants", f"""
WITH {COUNTS}, t AS (SELECT c.*, CASE WHEN v % 3 = 0 THEN alt WHEN v % 7 = 1 THEN 'N' ELSE ref END AS tref, CASE WHEN v % 3 = 0 THEN ref ELSE alt END AS talt, ref, alt FROM counts c JOIN variants USING (v) WHERE cohort = 'p1')
SELECT v, ref, alt, CASE WHEN tref = ref THEN n_rr ELSE n_aa END AS n_rr, n_ra, CASE WHEN tref = ref THEN n_aa ELSE n_rr END AS n_aa, n_missing
FROM t WHERE (tref = ref AND talt = alt) OR (tref = alt AND talt = ref)""")
def orient_counts(spark, sf):
    v = X.variants(spark, sf).select("v", "ref", "alt")
    third = F.col("v") % 3 == 0
    ref = F.when(third, F.col("alt")).when(F.col("v") % 7 == 1, "N").otherwise(F.col("ref"))
    t = counts(spark, sf).where("cohort = 'p1'").join(v, "v").withColumns({"ref": ref, "alt": F.when(third, F.col("ref")).otherwise(F.col("alt"))})
    return AF.orient_counts(t, v)


@query("samples genotypes", f"""
WITH {COUNTS}, f AS (SELECT *, (n_rr + n_ra + n_aa)::DOUBLE / (n_rr + n_ra + n_aa + n_missing) AS rate, (n_ra + 2 * n_aa)::DOUBLE / nullif(2 * (n_rr + n_ra + n_aa), 0) AS af FROM counts)
SELECT v, count(*) AS n_cohorts, round(min(rate), 6) AS min_rate, round(max(af) - min(af), 6) AS delta_af FROM f GROUP BY v HAVING count(*) = 5 AND min(rate) >= 0.9 AND max(af) - min(af) < 0.35""")
def af_quality(spark, sf):
    return rounded(AF.filter_af_quality(counts(spark, sf), 5, 0.9, 0.35), "min_rate", "delta_af")


@query("samples genotypes", f"WITH {COUNTS}, {WIDE} SELECT v FROM wide WHERE " + " AND ".join(f"coalesce((n_ra_{p} + 2 * n_aa_{p})::DOUBLE / nullif(2 * (n_rr_{p} + n_ra_{p} + n_aa_{p}), 0) < 0.6, true)" for p in POPS))
def rare_in_all(spark, sf):
    return AF.rare_in_all(AF.af_wide(counts(spark, sf), POPS), POPS, 0.6).select("v")


@query("samples genotypes", f"WITH {COUNTS}, {WIDE} SELECT v, " + ", ".join(f"{n}_p0 + {n}_p1 AS {n}_sum" for n in AF.COUNTS) + " FROM wide")
def sum_cohorts(spark, sf):
    out = AF.sum_cohorts(AF.af_wide(counts(spark, sf), POPS), ["p0", "p1"], "sum")
    return out.select("v", *[f"{n}_sum" for n in AF.COUNTS])


@query("samples genotypes", f"""
WITH {COUNTS}, a AS (SELECT v, n_ra + 2 * n_aa AS ac FROM counts WHERE cohort = 'p0'), b AS (SELECT v, n_ra + 2 * n_aa AS ac FROM counts WHERE cohort = 'p1')
SELECT CASE WHEN coalesce(a.ac, 0) > 0 AND coalesce(b.ac, 0) > 0 THEN 'Both' WHEN coalesce(a.ac, 0) > 0 THEN 'A only' WHEN coalesce(b.ac, 0) > 0 THEN 'B only' ELSE 'Neither' END AS class, count(*) AS n
FROM a FULL JOIN b USING (v) GROUP BY 1""")
def presence_class(spark, sf):
    c = counts(spark, sf)
    ac = F.col("n_ra") + 2 * F.col("n_aa")
    a, b = c.where("cohort = 'p0'").select("v", ac.alias("a")), c.where("cohort = 'p1'").select("v", ac.alias("b"))
    return a.join(b, "v", "full").groupBy(V.presence_class(F.col("a"), F.col("b")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


VB = f"""{COUNTS}, vb AS (SELECT v, CASE WHEN v % 3 = 0 THEN 'syn' ELSE 'nonsyn' END AS class, CAST(coalesce(sum(n_ra + 2 * n_aa) FILTER (cohort IN ('p0', 'p1')), 0) AS BIGINT) AS ac_a, CAST(coalesce(sum(2 * (n_rr + n_ra + n_aa)) FILTER (cohort IN ('p0', 'p1')), 0) AS BIGINT) AS an_a,
  CAST(coalesce(sum(n_ra + 2 * n_aa) FILTER (cohort NOT IN ('p0', 'p1')), 0) AS BIGINT) AS ac_b, CAST(coalesce(sum(2 * (n_rr + n_ra + n_aa)) FILTER (cohort NOT IN ('p0', 'p1')), 0) AS BIGINT) AS an_b FROM counts GROUP BY v)"""


def variant_burden(spark, sf) -> DataFrame:
    a = F.col("cohort").isin("p0", "p1")
    ac, an = F.col("n_ra") + 2 * F.col("n_aa"), 2 * (F.col("n_rr") + F.col("n_ra") + F.col("n_aa"))
    total = lambda who, x: F.sum(F.when(who, x).otherwise(0))
    out = counts(spark, sf).groupBy("v").agg(total(a, ac).alias("ac_a"), total(a, an).alias("an_a"), total(~a, ac).alias("ac_b"), total(~a, an).alias("an_b"))
    return out.withColumn("class", F.when(F.col("v") % 3 == 0, "syn").otherwise("nonsyn"))


@query("samples genotypes", f"""
WITH {VB}, s AS (SELECT CAST(sum(ac_a) FILTER (class = 'nonsyn') AS BIGINT) AS nonsyn_a, CAST(sum(ac_a) FILTER (class = 'syn') AS BIGINT) AS syn_a, CAST(sum(ac_b) FILTER (class = 'nonsyn') AS BIGINT) AS nonsyn_b, CAST(sum(ac_b) FILTER (class = 'syn') AS BIGINT) AS syn_b FROM vb)
SELECT *, round(nonsyn_a::DOUBLE / syn_a, 6) AS ratio_a, round(nonsyn_b::DOUBLE / syn_b, 6) AS ratio_b, round((nonsyn_a::DOUBLE / syn_a) / (nonsyn_b::DOUBLE / syn_b), 6) AS ratio FROM s""")
def burden_stats(spark, sf):
    return rounded(AF.burden_stats(variant_burden(spark, sf)), "ratio_a", "ratio_b", "ratio")


@query("samples genotypes", f"""
WITH {VB}, s AS (SELECT sum(ac_a) FILTER (class = 'nonsyn') + 0.5 AS da, sum(ac_b) FILTER (class = 'nonsyn') + 0.5 AS db, sum(ac_a) FILTER (class = 'syn') + 0.5 AS na, sum(ac_b) FILTER (class = 'syn') + 0.5 AS nb FROM vb)
SELECT da::DOUBLE AS da, db::DOUBLE AS db, na::DOUBLE AS na, nb::DOUBLE AS nb, round(ln(da::DOUBLE * nb::DOUBLE / (db::DOUBLE * na::DOUBLE)), 6) AS log_odds FROM s""")
def enrichment(spark, sf):
    return rounded(AF.enrichment(variant_burden(spark, sf)), "da", "db", "na", "nb", "log_odds")


@query("samples genotypes", f"""
WITH {COUNTS}, r AS (SELECT cohort, sum(n_ra::DOUBLE / (n_rr + n_ra + n_aa)) AS dominant, sum(n_aa::DOUBLE / (n_rr + n_ra + n_aa)) AS recessive, count(*) AS n_loci FROM counts WHERE n_rr + n_ra + n_aa > 0 GROUP BY cohort)
SELECT cohort, round(dominant, 6) AS dominant, round(recessive, 6) AS recessive, n_loci, round(recessive / (dominant + recessive), 6) AS recessive_share FROM r""")
def rare_burden(spark, sf):
    return rounded(AF.rare_burden(counts(spark, sf)), "dominant", "recessive", "recessive_share")


@query("samples genotypes", f"""
WITH {COUNTS}, f AS (SELECT v, cohort, (n_ra + 2 * n_aa)::DOUBLE / nullif(2 * (n_rr + n_ra + n_aa), 0) AS af FROM counts)
SELECT a.cohort AS a, b.cohort AS b, round(corr(a.af, b.af), 6) AS r FROM f a JOIN f b ON a.v = b.v AND a.cohort < b.cohort GROUP BY 1, 2""")
def af_correlation(spark, sf):
    f = counts(spark, sf).select("v", "cohort", AF.allele_frequency().alias("af"))
    wide = f.groupBy("v").pivot("cohort", POPS).agg(F.max("af"))
    pairs = [(a, b) for i, a in enumerate(POPS) for b in POPS[i + 1 :]]
    out = wide.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])
    return rounded(out.select(F.inline(rows)), "r")


@query("samples genotypes", f"""
WITH {COUNTS}, f AS (SELECT v, (n_ra + 2 * n_aa)::DOUBLE / nullif(2 * (n_rr + n_ra + n_aa), 0) AS af, cohort FROM counts)
SELECT v FROM (SELECT v, max(af) FILTER (cohort = 'p0') AS a, max(af) FILTER (cohort = 'p1') AS b FROM f GROUP BY v) WHERE (v % 4 = 0 OR coalesce(v % 6 = 0, false)) AND greatest(coalesce(a, 0), coalesce(b, 0)) < 0.5""")
def rare_deleterious(spark, sf):
    f = counts(spark, sf).select("v", "cohort", AF.allele_frequency().alias("af")).groupBy("v").pivot("cohort", ["p0", "p1"]).agg(F.max("af"))
    return A.rare_deleterious(f, [F.col("v") % 4 == 0, F.when(F.col("v") % 6 == 0, True)], ["p0", "p1"], 0.5).select("v")


@query("samples genotypes", f"""
WITH {COUNTS} SELECT v FROM counts WHERE cohort = 'p0' INTERSECT SELECT v FROM counts WHERE cohort = 'p1' EXCEPT SELECT v FROM counts WHERE cohort = 'p2' AND n_aa > 3""")
def set_algebra(spark, sf):
    c = counts(spark, sf)
    of = lambda p: c.where(F.col("cohort") == p).select("v")
    return of("p0").intersect(of("p1")).subtract(c.where("cohort = 'p2' AND n_aa > 3").select("v"))


@query("samples genotypes", f"WITH {COUNTS} SELECT v FROM counts WHERE n_ra + n_aa > 0 GROUP BY v HAVING count(DISTINCT cohort) = 5")
def in_all_sets(spark, sf):
    return counts(spark, sf).where("n_ra + n_aa > 0").groupBy("v").agg(F.countDistinct("cohort").alias("n")).where("n = 5").select("v")


@query("samples genotypes", f"WITH {COUNTS}, w AS (SELECT v, max((n_ra + 2 * n_aa)::DOUBLE / nullif(2 * (n_rr + n_ra + n_aa), 0)) - min((n_ra + 2 * n_aa)::DOUBLE / nullif(2 * (n_rr + n_ra + n_aa), 0)) AS d FROM counts GROUP BY v) SELECT v, round(d, 6) AS delta FROM w WHERE d IS NOT NULL ORDER BY round(d, 6) DESC, v LIMIT 20")
def top_delta(spark, sf):
    """The twenty variants whose frequency differs most between cohorts."""
    f = counts(spark, sf).withColumn("af", AF.allele_frequency()).groupBy("v").agg((F.max("af") - F.min("af")).alias("delta"))
    return rounded(f.where("delta IS NOT NULL"), "delta").orderBy(F.desc("delta"), "v").limit(20)


