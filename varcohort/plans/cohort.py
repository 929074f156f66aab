"""Queries over variants, genotypes and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import variant as V
from ..operators import annotate as A
from ..operators import genotype as G
from . import fixtures as X
from .registry import query, rounded


@query("samples variants genotypes", """
SELECT g.v, contig, count(*) AS ns,
  count(*) FILTER (is_female AND gt = 0) AS female_0, count(*) FILTER (is_female AND gt = 1) AS female_1, count(*) FILTER (is_female AND gt = 2) AS female_2,
  count(*) FILTER (NOT is_female AND gt = 0) AS male_0, count(*) FILTER (NOT is_female AND gt = 1) AS male_1, count(*) FILTER (NOT is_female AND gt = 2) AS male_2,
  round(sum(gt * CASE WHEN NOT is_female AND contig = 'X' THEN 0.5 ELSE 1.0 END)::DOUBLE, 6) AS ac, round(sum(2 * CASE WHEN NOT is_female AND contig = 'X' THEN 0.5 ELSE 1.0 END)::DOUBLE, 6) AS an,
  round(sum(gt * CASE WHEN NOT is_female AND contig = 'X' THEN 0.5 ELSE 1.0 END)::DOUBLE / sum(2 * CASE WHEN NOT is_female AND contig = 'X' THEN 0.5 ELSE 1.0 END)::DOUBLE, 6) AS af
FROM genotypes g JOIN samples s USING (s) JOIN variants v ON g.v = v.v WHERE gt IS NOT NULL AND cohort <> 'Z' GROUP BY g.v, contig""")
def cohort_allele_counts(spark, sf):
    out = G.cohort_allele_counts(X.genotypes(spark, sf), X.samples(spark, sf), X.variants(spark, sf))
    return rounded(out, "ac", "an", "af")


QC = """qc AS (SELECT v, count(gt) AS n_called, count(*) FILTER (gt = 0) AS n_hom_ref, count(*) FILTER (gt = 1) AS n_het, count(*) FILTER (gt = 2) AS n_hom_var,
  CAST(coalesce(sum(gt), 0) AS BIGINT) AS ac, round(avg(dp), 6) AS dp_mean, round(stddev_pop(dp), 6) AS dp_stdev FROM genotypes GROUP BY v)"""


@query("genotypes", f"""
WITH {QC}
SELECT *, round(n_called / (SELECT n_samples FROM span), 6) AS call_rate, round(ac::DOUBLE / (2 * nullif(n_called, 0)), 6) AS af, round(n_het::DOUBLE / nullif(n_called, 0), 6) AS r_het FROM qc""")
def variant_qc(spark, sf):
    return rounded(G.variant_qc(X.genotypes(spark, sf), X.n_samples()), "dp_mean", "dp_stdev", "call_rate", "af", "r_het")


@query("genotypes", f"""
WITH {QC},
f AS (SELECT *, (n_hom_ref + n_het + n_hom_var)::DOUBLE AS n, (2 * n_hom_ref + n_het)::DOUBLE / nullif(2 * (n_hom_ref + n_het + n_hom_var), 0) AS p FROM qc)
SELECT v, CASE WHEN n > 0 AND p > 0 AND p < 1 THEN round((n_hom_ref - n*p*p)^2 / (n*p*p) + (n_het - 2*n*p*(1-p))^2 / (2*n*p*(1-p)) + (n_hom_var - n*(1-p)*(1-p))^2 / (n*(1-p)*(1-p)), 6) END AS hwe_chisq FROM f""")
def hwe_chisq(spark, sf):
    return rounded(G.hwe_chisq(G.variant_qc(X.genotypes(spark, sf), X.n_samples())).select("v", "hwe_chisq"), "hwe_chisq")


SAMPLE = """a AS (SELECT v, ref, alt, length(ref) = 1 AND length(alt) = 1 AS snp, ref || alt IN ('AG','GA','CT','TC') AS ts FROM variants),
c AS (SELECT v, sum(gt) AS site_ac FROM genotypes GROUP BY v),
sq AS (SELECT s, count(gt) AS n_called, round(avg(dp), 6) AS dp_mean, round(stddev_pop(dp), 6) AS dp_stdev, count(*) FILTER (gt = 1) AS n_het, count(*) FILTER (gt = 2) AS n_hom_var,
  count(*) FILTER (gt > 0 AND snp) AS n_snp, count(*) FILTER (gt > 0 AND NOT snp AND length(ref) < length(alt)) AS n_insertion, count(*) FILTER (gt > 0 AND NOT snp AND length(ref) > length(alt)) AS n_deletion, count(*) FILTER (gt > 0 AND site_ac = 1) AS n_singleton,
  count(*) FILTER (gt > 0 AND snp AND ts) AS n_ti, count(*) FILTER (gt > 0 AND snp AND NOT ts) AS n_tv, round(count(gt) / (SELECT n_variants FROM span), 6) AS call_rate
  FROM genotypes JOIN a USING (v) JOIN c USING (v) GROUP BY s)"""


@query("variants genotypes", f"""
WITH {SAMPLE}
SELECT *, round(n_ti::DOUBLE / nullif(n_tv, 0), 6) AS r_ti_tv, round(n_het::DOUBLE / nullif(n_hom_var, 0), 6) AS r_het_hom FROM sq""")
def sample_qc(spark, sf):
    out = G.sample_qc(X.genotypes(spark, sf), X.variants(spark, sf), X.n_variants())
    return rounded(out, "dp_mean", "dp_stdev", "call_rate", "r_ti_tv", "r_het_hom")


HET = "hr AS (SELECT s, count(*) AS n_het, round(stddev_pop((dp - ad)::DOUBLE / ad), 6) AS het_ratio_sd FROM genotypes WHERE gt = 1 AND ad > 0 GROUP BY s)"


@query("genotypes", f"WITH {HET} SELECT * FROM hr")
def het_ratio(spark, sf):
    return rounded(G.het_ratio_stdev(X.genotypes(spark, sf)), "het_ratio_sd")


@query("variants genotypes", f"""
WITH {SAMPLE}, {HET}
SELECT s, CASE WHEN call_rate >= 0.7 AND dp_mean >= 50 AND coalesce(het_ratio_sd <= 1.0, false) THEN 1 WHEN call_rate >= 0.7 AND dp_mean >= 50 THEN 2 WHEN call_rate >= 0.7 THEN 3 ELSE 4 END AS tier
FROM sq LEFT JOIN hr USING (s)""")
def sample_tiers(spark, sf):
    gt = X.genotypes(spark, sf)
    qc = G.sample_qc(gt, X.variants(spark, sf), X.n_variants(), singletons=False).join(G.het_ratio_stdev(gt).select("s", "het_ratio_sd"), "s", "left")
    qc = rounded(qc, "call_rate", "dp_mean", "het_ratio_sd")
    return qc.select("s", G.sample_tier(call_rate=0.7, dp=50.0).alias("tier"))


@query("variants pools", f"""
WITH {SAMPLE.replace("genotypes", "pools")}, keep AS (SELECT s FROM sq WHERE call_rate >= 0.6 AND dp_mean >= 40)
SELECT v, count(*) AS n, CAST(sum(gt) AS BIGINT) AS ac FROM pools WHERE gt IS NOT NULL AND s IN (SELECT s FROM keep) GROUP BY v HAVING sum(gt) > 0""")
def genome_sample_filter(spark, sf):
    """Samples that pass quality control, and the variants that they still carry."""
    gt = X.pools(spark, sf)
    qc = rounded(G.sample_qc(gt, X.variants(spark, sf), X.n_variants()), "call_rate", "dp_mean")
    kept = gt.join(qc.where("call_rate >= 0.6 AND dp_mean >= 40").select("s"), "s", "left_semi").where("gt IS NOT NULL")
    return kept.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("gt").cast("long").alias("ac")).where("ac > 0")


@query("variants", "SELECT v, contig, pos, ref, unnest(alts) AS alt, generate_subscripts(alts, 1)::INT AS a_index, len(alts) > 1 AS was_split FROM variants")
def split_multi(spark, sf):
    return G.split_multi(X.variants(spark, sf)).select("v", "contig", "pos", "ref", "alt", F.col("a_index").cast("int"), "was_split")


PADDED = "m AS (SELECT v, pos, 'CA' || ref || 'GT' AS ref, 'CA' || alt || (CASE WHEN v % 3 = 0 THEN '' ELSE 'GT' END) AS alt FROM variants)"


@query("variants", f"""
WITH {PADDED},
t AS (SELECT *, coalesce(list_max([i FOR i IN range(1, least(length(ref), length(alt))) IF right(ref, i::INT) = right(alt, i::INT)]), 0) AS tail FROM m),
r AS (SELECT v, pos, left(ref, length(ref) - tail) AS ref, left(alt, length(alt) - tail) AS alt FROM t),
h AS (SELECT *, coalesce(list_max([i FOR i IN range(1, least(length(ref), length(alt))) IF left(ref, i::INT) = left(alt, i::INT)]), 0) AS head FROM r)
SELECT v, pos + head AS pos, substr(ref, head + 1) AS ref, substr(alt, head + 1) AS alt FROM h""")
def min_rep(spark, sf):
    v = X.variants(spark, sf)
    padded = v.select("v", "pos", F.concat(F.lit("CA"), "ref", F.lit("GT")).alias("ref"), F.concat(F.lit("CA"), F.col("alt"), F.when(F.col("v") % 3 == 0, "").otherwise("GT")).alias("alt"))
    return G.min_rep(padded).select("v", "pos", "ref", "alt")


@query("variants", """
WITH c AS (SELECT v, ref, alts, CASE WHEN v % 5 = 0 THEN NULL ELSE (v % (len(alts) + 1))::INT END AS a1, ((v // 2) % (len(alts) + 1))::INT AS a2 FROM variants),
u AS (SELECT *, list_sort(list_distinct([a FOR a IN [a1, a2] IF a > 0])) AS used FROM c)
SELECT v, ref, [alts[i] FOR i IN used] AS alts, CASE WHEN a1 = 0 THEN 0 ELSE list_position(used, a1) END::INT AS a1, CASE WHEN a2 = 0 THEN 0 ELSE list_position(used, a2) END::INT AS a2
FROM u WHERE len(used) > 0""")
def minimal_alleles(spark, sf):
    n = F.size("alts") + 1
    calls = X.variants(spark, sf).select("v", "ref", "alts", F.when(F.col("v") % 5 == 0, None).otherwise(F.col("v") % n).cast("int").alias("a1"), (F.floor(F.col("v") / 2) % n).cast("int").alias("a2"))
    return G.minimal_alleles(calls).select("v", "ref", "alts", "a1", "a2")


@query("variants", """
SELECT v, [a FOR a IN alts IF a IN ('A', 'C', 'G')] AS alts, len([a FOR a IN alts IF a IN ('A', 'C', 'G')]) AS n FROM variants WHERE len([a FOR a IN alts IF a IN ('A', 'C', 'G')]) > 0""")
def filter_alleles(spark, sf):
    out = G.filter_alleles(X.variants(spark, sf), lambda a: a.isin("A", "C", "G"))
    return out.select("v", "alts", F.size("index_map").cast("long").alias("n"))


@query("samples genotypes", """
SELECT v, pop, count(*) FILTER (gt = 0) AS n_rr, count(*) FILTER (gt = 1) AS n_ra, count(*) FILTER (gt = 2) AS n_aa, count(*) FILTER (gt IS NULL) AS n_missing
FROM genotypes JOIN samples USING (s) GROUP BY GROUPING SETS ((v, pop), (v))""")
def genotype_counts_by_group(spark, sf):
    return G.genotype_counts(X.genotypes(spark, sf), X.samples(spark, sf), "pop", parts=X.parts(spark, sf))


@query("variants genotypes", """
WITH a AS (SELECT v, contig, ref, unnest(alts) AS alt, len(alts) AS n FROM variants)
SELECT (SELECT count(*) FROM a WHERE length(ref) = 1 AND length(alt) = 1) AS n_snp, (SELECT count(*) FROM a WHERE length(alt) > length(ref) AND starts_with(alt, ref)) AS n_insertion,
  (SELECT count(*) FROM a WHERE length(ref) > length(alt) AND starts_with(ref, alt)) AS n_deletion, (SELECT count(*) FROM a WHERE length(ref) > length(alt) AND NOT starts_with(ref, alt)) AS n_complex, 0::BIGINT AS n_star, (SELECT count(*) FROM variants) AS n_variants,
  (SELECT count(*) FROM variants WHERE len(alts) > 1) AS n_multiallelic, (SELECT max(len(alts) + 1) FROM variants)::INT AS max_alleles, (SELECT count(DISTINCT contig) FROM variants) AS n_contigs,
  (SELECT count(gt) FROM genotypes) AS n_calls, round((SELECT count(gt) FROM genotypes) / ((SELECT count(*) FROM variants) * (SELECT n_samples FROM span)), 6) AS call_rate""")
def summarize(spark, sf):
    return rounded(G.summarize(X.variants(spark, sf), X.genotypes(spark, sf), X.n_samples()), "call_rate")


@query("variants genotypes", """
WITH x AS (SELECT v, s, gt FROM genotypes JOIN variants USING (v) WHERE contig = 'X' AND gt IS NOT NULL),
p AS (SELECT v, sum(gt) / (2.0 * count(*)) AS p, count(*) AS n FROM x GROUP BY v),
e AS (SELECT v, 1 - 2 * p * (1 - p) * (2.0 * n) / (2 * n - 1) AS e_hom FROM p WHERE n > 1 AND p > 0 AND p < 1),
f AS (SELECT s, count(*) FILTER (gt <> 1) AS o_hom, sum(e_hom) AS e_hom, count(*) AS n FROM x JOIN e USING (v) GROUP BY s),
g AS (SELECT *, CASE WHEN n > e_hom THEN (o_hom - e_hom) / (n - e_hom) END AS f FROM f)
SELECT s, o_hom, round(e_hom, 6) AS e_hom, n, round(f, 6) AS f, CASE WHEN f < 0.2 THEN 'female' WHEN f > 0.8 THEN 'male' END AS sex FROM g""")
def impute_sex(spark, sf):
    return rounded(G.impute_sex(X.genotypes(spark, sf), X.variants(spark, sf)), "e_hom", "f").select("s", "o_hom", "e_hom", "n", "f", "sex")


KING = """k AS (SELECT a.s AS s1, b.s AS s2, count(*) FILTER (a.gt = 1 AND b.gt = 1) AS het_het, count(*) FILTER (abs(a.gt - b.gt) = 2) AS opposite,
  count(*) FILTER (a.gt = 1) AS het1, count(*) FILTER (b.gt = 1) AS het2, count(*) AS n_sites
  FROM genotypes a JOIN genotypes b ON a.v = b.v AND a.s < b.s WHERE a.gt IS NOT NULL AND b.gt IS NOT NULL GROUP BY 1, 2),
kin AS (SELECT *, CASE WHEN least(het1, het2) > 0 THEN (het_het - 2 * opposite) / (2.0 * least(het1, het2)) + 0.5 - 0.25 * (het1 + het2) / least(het1, het2) END AS kin FROM k)"""


@query("genotypes", f"WITH {KING} SELECT s1, s2, het_het, opposite, het1, het2, n_sites, round(kin, 6) AS kin FROM kin")
def king_kinship(spark, sf):
    return rounded(G.king_kinship(X.genotypes(spark, sf)), "kin")


@query("samples genotypes", f"""
WITH {KING}, d AS (SELECT s1, s2, CASE WHEN round(kin, 6) >= 2.0^(-1.5) THEN 0 WHEN round(kin, 6) >= 2.0^(-2.5) THEN 1 WHEN round(kin, 6) >= 2.0^(-3.5) THEN 2 ELSE 5 END AS degree FROM kin WHERE kin IS NOT NULL),
p AS (SELECT d.*, a.cohort AS c1, b.cohort AS c2 FROM d JOIN samples a ON s1 = a.s JOIN samples b ON s2 = b.s WHERE degree <= 2)
SELECT DISTINCT unnest(CASE WHEN degree = 0 AND c1 = c2 THEN [s1, s2] ELSE [greatest(s1, s2)] END) AS s FROM p""")
def related_to_drop(spark, sf):
    return G.related_to_drop(rounded(G.king_kinship(X.genotypes(spark, sf)), "kin"), X.samples(spark, sf))


@query("variants genotypes", """
WITH n AS (SELECT a.v AS v1, b.v AS v2 FROM variants a JOIN variants b ON a.contig = b.contig AND b.pos > a.pos AND b.pos - a.pos <= 2000),
t AS (SELECT v1, v2, count(*) AS n, sum(x.gt)::DOUBLE AS sx, sum(y.gt)::DOUBLE AS sy, sum(x.gt * x.gt)::DOUBLE AS sxx, sum(y.gt * y.gt)::DOUBLE AS syy, sum(x.gt * y.gt)::DOUBLE AS sxy
  FROM n JOIN genotypes x ON x.v = v1 JOIN genotypes y ON y.v = v2 AND y.s = x.s WHERE x.gt IS NOT NULL AND y.gt IS NOT NULL GROUP BY 1, 2)
SELECT v1, v2, n, sign(n * sxy - sx * sy)::DOUBLE AS sign, round((n * sxy - sx * sy)^2 / ((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) AS r2
FROM t WHERE n * sxx > sx * sx AND n * syy > sy * sy""")
def ld_r2(spark, sf):
    return rounded(G.ld_r2(X.genotypes(spark, sf), X.variants(spark, sf), 2000), "sign", "r2")


SECOND = "h AS (SELECT v, s, CASE WHEN dp < 8 THEN NULL WHEN 10 * ad < dp THEN 0 WHEN 10 * ad > 9 * dp THEN 2 ELSE 1 END AS gt FROM genotypes WHERE (v + s) % 7 <> 0)"


@query("genotypes", f"""
WITH {SECOND}, g AS (SELECT v, s, gt, 1 AS here FROM genotypes WHERE (v + s) % 11 <> 0)
SELECT CASE WHEN g.here IS NULL THEN 'NoData' WHEN g.gt IS NULL THEN 'NoCall' WHEN g.gt = 0 THEN 'HomRef' WHEN g.gt = 1 THEN 'Het' ELSE 'HomVar' END AS a,
  CASE WHEN h.here IS NULL THEN 'NoData' WHEN h.gt IS NULL THEN 'NoCall' WHEN h.gt = 0 THEN 'HomRef' WHEN h.gt = 1 THEN 'Het' ELSE 'HomVar' END AS b, count(*) AS n
FROM g FULL JOIN (SELECT *, 1 AS here FROM h) h ON g.v = h.v AND g.s = h.s GROUP BY 1, 2""")
def concordance(spark, sf):
    gt = X.genotypes(spark, sf)
    dp, ad = F.col("dp"), F.col("ad")
    other = gt.where("(v + s) % 7 <> 0").select("v", "s", F.when(dp < 8, None).when(10 * ad < dp, 0).when(10 * ad > 9 * dp, 2).otherwise(1).alias("gt"))
    return G.concordance(gt.where("(v + s) % 11 <> 0"), other)


@query("genotypes", f"""
WITH {SECOND}, g AS (SELECT v, s, gt FROM genotypes WHERE (v + s) % 11 <> 0), j AS (SELECT g.s, g.gt AS a, h.gt AS b FROM g JOIN h ON g.v = h.v AND g.s = h.s WHERE g.gt IS NOT NULL AND h.gt IS NOT NULL)
SELECT s, CASE WHEN a > 0 AND b > 0 THEN CASE WHEN a = b THEN 'TP' ELSE 'DZ' END WHEN a > 0 THEN 'FP' WHEN b > 0 THEN 'FN' ELSE 'TN' END AS judgement, count(*) AS n FROM j GROUP BY 1, 2""")
def concordance_by_sample(spark, sf):
    """Each sample's true and false calls against a second call set."""
    gt = X.genotypes(spark, sf)
    dp, ad = F.col("dp"), F.col("ad")
    other = gt.where("(v + s) % 7 <> 0").select("v", "s", F.when(dp < 8, None).when(10 * ad < dp, 0).when(10 * ad > 9 * dp, 2).otherwise(1).alias("gt"))
    states = G.concordance(gt.where("(v + s) % 11 <> 0"), other, by=("s",)).withColumn("judgement", G.judgement(F.col("a"), F.col("b")))
    return states.where("judgement IS NOT NULL").groupBy("s", "judgement").agg(F.sum("n").alias("n"))


@query("pools", f"SELECT v, {', '.join(f'max(gt) FILTER (s = {i}) AS s{i}' for i in range(25))} FROM pools GROUP BY v")
def genotype_wide(spark, sf):
    return G.genotype_wide(X.pools(spark, sf), list(range(X.n_pools(spark, sf))))


@query("variants", """
WITH db AS (SELECT contig, pos, ref, unnest(alts) AS alt, v * 10 + generate_subscripts(alts, 1) AS score FROM variants WHERE v % 3 <> 1)
SELECT v.v, i::INT AS a_index, d.score FROM (SELECT v, contig, pos, ref, unnest(alts) AS alt, generate_subscripts(alts, 1) AS i FROM variants) v
LEFT JOIN db d ON v.contig = d.contig AND v.pos = d.pos AND v.ref = d.ref AND v.alt = d.alt AND NOT (v.v % 2 = 0 AND i = 2)""")
def annotate_nonsplit_from_split(spark, sf):
    v = X.variants(spark, sf)
    db = G.split_multi(v.where("v % 3 <> 1")).where("NOT (v % 2 = 0 AND a_index = 2)").select("contig", "pos", "ref", "alt", (F.col("v").cast("long") * 10 + F.col("a_index")).alias("score"))
    out = A.annotate_nonsplit_from_split(v, db, ["score"])
    return out.select("v", F.posexplode("found").alias("i", "x")).select("v", (F.col("i") + 1).cast("int").alias("a_index"), F.col("x.score").alias("score"))


@query("variants", """
SELECT v, contig || ':' || pos || ':' || ref || ':' || alt AS vid, ref || alt NOT IN ('AT', 'TA', 'CG', 'GC') AS strand_specific, ref || alt IN ('AG', 'GA', 'CT', 'TC') AS transition,
  CASE WHEN length(ref) = length(alt) THEN 'snp' WHEN length(ref) < length(alt) THEN 'insertion' ELSE 'deletion' END AS category,
  CASE WHEN length(ref) = length(alt) THEN 'SNV' WHEN length(ref) < length(alt) THEN 'ins_small' ELSE 'del_small' END AS size_class, contig <> 'X' AS autosomal FROM variants""")
def variant_predicates(spark, sf):
    ref, alt = F.col("ref"), F.col("alt")
    return X.variants(spark, sf).select(
        "v", V.vid(F.col("contig"), F.col("pos"), ref, alt).alias("vid"), V.strand_specific(ref, alt).alias("strand_specific"), V.is_transition(ref, alt).alias("transition"),
        V.category(ref, alt).alias("category"), V.size_class(ref, alt).alias("size_class"), V.is_autosomal(F.col("contig")).alias("autosomal"),
    )


@query("variants", """
WITH l AS (SELECT DISTINCT CASE WHEN v % 2 = 0 THEN 'even' ELSE 'third' END AS list, symbol FROM variants WHERE v % 2 = 0 OR v % 3 = 0)
SELECT v, symbol IN (SELECT symbol FROM l WHERE list = 'even') AS in_even, symbol IN (SELECT symbol FROM l WHERE list = 'third') AS in_third FROM variants""")
def membership_flags(spark, sf):
    v = X.variants(spark, sf)
    lists = v.where("v % 2 = 0 OR v % 3 = 0").select(F.when(F.col("v") % 2 == 0, "even").otherwise("third").alias("list"), "symbol").distinct()
    return A.membership_flags(v, lists, ["even", "third"]).select("v", "in_even", "in_third")


@query("variants", "SELECT v, first_v FROM variants JOIN (SELECT symbol, min(v) AS first_v FROM variants GROUP BY symbol) USING (symbol)")
def lookup_first(spark, sf):
    v = X.variants(spark, sf)
    return A.lookup_first(v, v.select("symbol", F.col("v").alias("first_v"), F.col("v").alias("n")), "symbol", "n").select("v", "first_v")


@query("genotypes", "SELECT v, s, dp, ad FROM genotypes WHERE gt = 1 AND dp <> ad AND ad > 0")
def het_trace(spark, sf):
    """Depth and alternate reads at heterozygous loci, as written for each sample."""
    return X.genotypes(spark, sf).where("gt = 1 AND dp <> ad AND ad > 0").select("v", "s", "dp", "ad")


@query("genotypes samples", """
WITH a AS (SELECT v, s, gt FROM genotypes JOIN samples USING (s) WHERE cohort = 'A'), b AS (SELECT v, s, gt FROM genotypes JOIN samples USING (s) WHERE cohort = 'B')
SELECT v, s, gt FROM a WHERE v IN (SELECT v FROM b) UNION ALL SELECT v, s, gt FROM b WHERE v IN (SELECT v FROM a)""")
def join_cohorts(spark, sf):
    """Genotypes of two cohorts at the variants that both have."""
    gt = X.genotypes(spark, sf).join(X.samples(spark, sf).select("s", "cohort"), "s")
    a, b = gt.where("cohort = 'A'").select("v", "s", "gt"), gt.where("cohort = 'B'").select("v", "s", "gt")
    return a.join(b.select("v").distinct(), "v", "left_semi").union(b.join(a.select("v").distinct(), "v", "left_semi"))


@query("genotypes", "SELECT v, s FROM genotypes WHERE gt > 0 QUALIFY count(*) OVER (PARTITION BY v) = 1")
def singletons(spark, sf):
    gt = X.genotypes(spark, sf).where("gt > 0").select("v", "s")
    return gt.join(gt.groupBy("v").count().where("count = 1").select("v"), "v", "left_semi")
