"""Queries over alternates, and over the score, catalogue and report sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alleles as L
from ..sources import readers as R
from . import fixtures as X
from .registry import query, rounded

CALLS = """calls AS (SELECT v, s, dp, (dp * 3 + s) % 99 AS gq, CASE WHEN gt IS NULL THEN NULL WHEN gt = 2 THEN 1 ELSE 0 END AS a1, CASE WHEN gt IS NULL THEN NULL WHEN gt = 0 THEN 0 WHEN len(alts) > 1 AND s % 2 = 0 THEN 2 ELSE 1 END AS a2,
  CASE WHEN len(alts) > 1 THEN [dp - ad, ad - ad // 2, ad // 2] ELSE [dp - ad, ad] END AS ads FROM genotypes JOIN variants USING (v)),
parts AS (SELECT c.v, s, i::INT AS a_index, ref, alts[i] AS alt, (a1 = i)::INT + (a2 = i)::INT AS gt, ads[i + 1] AS ad, dp - ads[i + 1] AS ref_ad, dp, gq
  FROM calls c JOIN (SELECT *, unnest(range(1, len(alts) + 1)) AS i FROM variants) x ON c.v = x.v)"""
FIELDS = ["Allele", "Consequence", "SYMBOL"]


def calls(spark, sf) -> DataFrame:
    g, many, half = F.col("gt"), F.size("alts") > 1, F.floor(F.col("ad") / 2)
    rows = X.genotypes(spark, sf).repartition(X.parts(spark, sf), "v").join(X.variants(spark, sf).select("v", "alts").hint("merge"), "v")
    second = F.when(g.isNull(), None).when(g == 0, 0).when(many & (F.col("s") % 2 == 0), 2).otherwise(1)
    reads = F.when(many, F.array(F.col("dp") - F.col("ad"), F.col("ad") - half, half)).otherwise(F.array(F.col("dp") - F.col("ad"), F.col("ad")))
    return rows.select("v", "s", F.when(g.isNull(), None).when(g == 2, 1).otherwise(0).alias("a1"), second.alias("a2"), reads.alias("ads"), "dp", ((F.col("dp") * 3 + F.col("s")) % 99).alias("gq"))


def parts(spark, sf) -> DataFrame:
    return L.split_calls(X.variants(spark, sf), calls(spark, sf))


@query("variants genotypes", f"""
WITH {CALLS}, e AS (SELECT v, contig, pos, ref, alts, CASE WHEN v % 5 = 0 THEN NULL ELSE [alts[1] || '|missense_variant|' || symbol, alts[1] || '|intron_variant|', 'Q|synonymous_variant|' || symbol] END AS csq FROM variants),
k AS (SELECT c.*, contig, pos, ref, alts, csq, unnest([a FOR a IN [a1, a2] IF a > 0]) AS a FROM calls c JOIN e USING (v)),
x AS (SELECT *, alts[a] AS alt, unnest(CASE WHEN csq IS NULL THEN ['||'] ELSE [y FOR y IN csq IF split_part(y, '|', 1) = alts[a]] END) AS entry FROM k)
SELECT s, v, contig, pos, ref, list_aggregate([CASE WHEN b = 0 THEN ref ELSE alts[b] END FOR b IN [a1, a2]], 'string_agg', '/') AS genotype, alt, ads[a + 1] AS alt_ad, dp,
  split_part(entry, '|', 1) AS "csq_Allele", split_part(entry, '|', 2) AS "csq_Consequence", split_part(entry, '|', 3) AS "csq_SYMBOL" FROM x""")
def vcf_to_long(spark, sf):
    """Carriers, a row a copy and consequence; every fifth site has no consequences, second alternates have no entry."""
    one = F.element_at("alts", 1)
    csq = F.concat(one, F.lit("|missense_variant|"), "symbol", F.lit(","), one, F.lit("|intron_variant|,Q|synonymous_variant|"), "symbol")
    sites = X.variants(spark, sf).select("v", "contig", "pos", "ref", "alts", F.when(F.col("v") % 5 != 0, csq).alias("csq"))
    return L.vcf_to_long(sites, calls(spark, sf), FIELDS)


METRICS = ", ".join(
    f"sum(CASE WHEN {who} THEN gt ELSE 0 END)::BIGINT AS {n}ac, 2 * count(gt) FILTER ({who}) AS {n}an, count(*) FILTER ({who} AND gt = 1) AS {n}het, count(*) FILTER ({who} AND gt = 2) AS {n}hom"
    for n, who in (("", "true"), ("female_", "is_female"), ("male_", "NOT is_female"))
)


@query("variants genotypes samples", f"""
WITH {CALLS}, m AS (SELECT v, a_index, {METRICS} FROM parts JOIN samples USING (s) GROUP BY v, a_index)
SELECT a.v, a.i::INT AS a_index, ac, an, het, hom, female_ac, female_an, female_het, female_hom, male_ac, male_an, male_het, male_hom,
  round(ac::DOUBLE / nullif(an, 0), 6) AS af, round(female_ac::DOUBLE / nullif(female_an, 0), 6) AS female_af, round(male_ac::DOUBLE / nullif(male_an, 0), 6) AS male_af
FROM (SELECT v, unnest(range(1, len(alts) + 1)) AS i FROM variants) a LEFT JOIN m ON a.v = m.v AND a.i = m.a_index""")
def allele_metrics(spark, sf):
    """Counts and frequencies of every alternate, in all and by sex."""
    rows = parts(spark, sf).select("v", "s", "a_index", "gt").repartition(X.parts(spark, sf), "s")
    rows = rows.join(X.samples(spark, sf).select("s", "is_female").hint("merge"), "s")
    out = L.annotate_alleles(X.variants(spark, sf).select("v", "alts"), rows, L.allele_metrics())
    out = out.select("v", F.posexplode("alleles").alias("i", "x")).select("v", (F.col("i") + 1).cast("int").alias("a_index"), "x.*")
    return rounded(out, "af", "female_af", "male_af")


@query("variants genotypes", f"""
WITH {CALLS} SELECT v, a_index, round(median(CASE WHEN gt > 0 AND dp > 0 THEN ref_ad::DOUBLE / dp * dp END), 6) AS median_dp_ref, round(median(CASE WHEN gt > 0 THEN gq::DOUBLE END), 6) AS median_gq, round(median(CASE WHEN gt > 0 THEN gt::DOUBLE END), 6) AS median_dosage
FROM parts GROUP BY v, a_index""")
def allele_medians(spark, sf):
    """Medians among the carriers of every alternate; the balance p is left to the tests."""
    out = L.annotate_alleles(X.variants(spark, sf).select("v", "alts"), L.with_balance(parts(spark, sf)), L.allele_medians())
    out = out.select("v", F.posexplode("alleles").alias("i", "x")).where("x IS NOT NULL").select("v", (F.col("i") + 1).cast("int").alias("a_index"), "x.median_dp_ref", "x.median_gq", "x.median_dosage")
    return rounded(out, "median_dp_ref", "median_gq", "median_dosage")


@query("variants", """
WITH n AS (SELECT *, CASE WHEN len(alts) > 1 THEN sum((len(alts) > 1)::INT) OVER (ORDER BY contig, pos ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS split FROM variants)
SELECT v, contig, pos, ref, split, unnest(alts) AS alt, v * 10 + generate_subscripts(alts, 1) AS ao FROM n""")
def split_multi_info(spark, sf):
    v = X.variants(spark, sf).select("v", "contig", "pos", "ref", "alts", F.transform("alts", lambda a, i: F.col("v").cast("long") * 10 + i + 1).alias("ao"))
    return L.split_multi_info(v, ["ao"])


@query("genotypes", "SELECT v, CASE WHEN s % 2 = 0 THEN 'x' || s ELSE s::VARCHAR END AS s, gt FROM genotypes")
def rename_samples(spark, sf):
    s = F.col("s").cast("string")
    names = X.samples(spark, sf).where("s % 2 = 0").select(s.alias("s"), F.concat(F.lit("x"), s).alias("name"))
    return L.rename_samples(X.genotypes(spark, sf).select("v", s.alias("s"), "gt"), names).select("v", "s", "gt")


@query("variants", "SELECT v, contig, pos FROM variants WHERE NOT (contig = 'X' OR (contig = '2' AND pos BETWEEN 1000 AND 50000))")
def filter_intervals(spark, sf):
    return L.filter_intervals(X.variants(spark, sf), [("X",), ("2", 1000, 50000)], keep=False).select("v", "contig", "pos")


@query("variants", "SELECT v, ref, alts[1] AS alt FROM variants WHERE len(alts) = 1")
def filter_multi(spark, sf):
    return L.filter_multi(X.variants(spark, sf)).select("v", "ref", "alt")


@query("genotypes", "SELECT v, s, gt, dp / nullif(ad, 0) AS ratio FROM genotypes WHERE gt IS NOT NULL AND ad <> 0")
def complete_cases(spark, sf):
    gt = X.genotypes(spark, sf).withColumn("ratio", F.when(F.col("ad") != 0, F.col("dp") / F.col("ad")))
    return rounded(L.complete_cases(gt, ["gt", "ratio"]).select("v", "s", "gt", "ratio"))


@query("variants", """
WITH b AS (SELECT v AS vid, symbol FROM variants)
SELECT vid, symbol, a.pos AS pos, c.alt AS alt FROM b JOIN (SELECT v, pos FROM variants WHERE v % 3 > 0) a ON vid = a.v LEFT JOIN (SELECT v, alt FROM variants WHERE v % 4 = 0) c ON vid = c.v""")
def merge_annotations(spark, sf):
    v = X.variants(spark, sf).withColumnRenamed("v", "vid")
    return L.merge_annotations(v.select("vid", "symbol"), v.where("vid % 3 > 0").select("vid", "pos"), v.where("vid % 4 = 0").select("vid", "alt")).select("vid", "symbol", "pos", "alt")


@query("samples", "SELECT cohort, cut, count(*) FILTER (s % 100 < cut) AS n FROM samples, (SELECT unnest([10, 50, 90]) AS cut) GROUP BY cohort, cut")
def parameter_grid(spark, sf):
    """Samples below each cut in each cohort: the grid's columns meet the samples by cohort."""
    g = L.grid(spark, cohort=["A", "B", "Z"], cut=[10, 50, 90])
    return X.samples(spark, sf).join(g, "cohort").groupBy("cohort", "cut").agg(F.count_if(F.col("s") % 100 < F.col("cut")).alias("n"))


@query("variants", "WITH l AS (SELECT v, contig, pos, lag(contig) OVER (ORDER BY v) AS c, lag(pos) OVER (ORDER BY v) AS p FROM variants) SELECT v, contig, pos FROM l WHERE c > contig OR (c = contig AND p > pos)")
def order_violations(spark, sf):
    """Variants that break the genome's order when listed by key."""
    return L.order_violations(X.variants(spark, sf), "v")


@query("genotypes", "SELECT s, round(sum(dp)::DOUBLE / count(*), 6) AS mean_dp FROM genotypes GROUP BY s")
def mean_depth(spark, sf):
    return rounded(L.mean_depth(X.genotypes(spark, sf).groupBy("s", "dp").agg(F.count(F.lit(1)).alias("n"))), "mean_dp")


@query("variants genotypes", """
SELECT contig, pos, ref, alt, count(*) FILTER (gt = 0) AS n_rr, count(*) FILTER (gt = 1) AS n_ra, count(*) FILTER (gt = 2) AS n_aa, count(*) FILTER (gt IS NULL) AS n_missing
FROM genotypes JOIN variants USING (v) GROUP BY v, contig, pos, ref, alt""")
def frqx_counts(spark, sf):
    """Counts through frequency reports whose first allele is the alternate or, at every third site, the reference."""
    g, third = F.col("gt"), F.col("v") % 3 == 0
    n = X.genotypes(spark, sf).groupBy("v").agg(F.count_if(g == 0).alias("rr"), F.count_if(g == 1).alias("het"), F.count_if(g == 2).alias("aa"), F.count_if(g.isNull()).alias("missing"))
    t = n.join(X.variants(spark, sf), "v").select(
        F.concat_ws(":", "contig", "pos", "ref", "alt").alias("vid"), F.when(third, F.col("ref")).otherwise(F.col("alt")).alias("a1"),
        F.when(third, F.col("rr")).otherwise(F.col("aa")).alias("hom_a1"), "het", F.when(third, F.col("aa")).otherwise(F.col("rr")).alias("hom_a2"), "missing",
    )
    return R.frqx_to_counts(t)


@query("variants pools", "SELECT contig, pos, ref, alt, CAST(sum(gt) AS BIGINT) AS ac, 2 * count(gt) AS an FROM pools JOIN variants USING (v) GROUP BY v, contig, pos, ref, alt")
def dosage_counts(spark, sf):
    """Allele counts from a digit a sample, in text."""
    digit = F.coalesce(F.col("gt").cast("string"), F.lit("."))
    t = X.pools(spark, sf).groupBy("v").agg(F.array_join(F.collect_list(digit), "").alias("calls")).join(X.variants(spark, sf), "v")
    out = R.ac_an(t.select(F.concat(F.concat_ws(":", "contig", "pos", "ref", "alt"), F.lit("\t"), "calls").alias("value")))
    return out.withColumn("ac", F.when(F.col("an") > 0, F.col("ac")))


@query("bases", """
WITH t AS (SELECT contig, pos, ref, CASE pos % 5 WHEN 0 THEN 'var' WHEN 1 THEN 'ins' WHEN 2 THEN 'del' WHEN 3 THEN 'bad' ELSE 'none' END AS kind, lag(ref) OVER w AS up, lag(pos) OVER w AS prev FROM bases WINDOW w AS (PARTITION BY contig ORDER BY pos))
SELECT contig, CASE WHEN kind = 'del' THEN pos - 1 ELSE pos END AS pos, CASE WHEN kind = 'del' THEN up || ref ELSE ref END AS ref, CASE kind WHEN 'var' THEN 'GATTACA' WHEN 'ins' THEN ref || 'TT' ELSE up END AS alt,
  'Pathogenic/LikelyPathogenic,RiskFactor' AS significance, 'CriteriaProvidedSingleSubmitter' AS review, pos AS allele_id
FROM t WHERE kind IN ('var', 'ins') OR (kind = 'del' AND prev = pos - 1)""")
def clinvar_to_variants(spark, sf):
    """A catalogue made of the reference: substitutions, insertions, deletions, wrong reference bases and rows to leave out."""
    b, k = X.bases(spark, sf), F.col("pos") % 5
    wrong = F.translate("ref", "ACGT", "CGTA")
    t = b.select(
        F.when(k == 4, "GRCh38").otherwise("GRCh37").alias("assembly"), "contig", F.col("pos").alias("start"), F.when(k == 1, F.col("pos") + 1).otherwise(F.col("pos")).alias("stop"),
        F.when(k == 1, "-").when(k == 3, wrong).otherwise(F.col("ref")).alias("ref"), F.when(k == 2, "-").when(k == 1, "TT").otherwise("GATTACA").alias("alt"),
        F.lit("Pathogenic/Likely pathogenic,risk factor").alias("significance"), F.lit("criteria provided, single submitter").alias("review"), F.col("pos").alias("allele_id"),
    )
    return R.clinvar_to_variants(t, b)


@query("variants", "SELECT contig, pos, ref, alt, v / 8.0::DOUBLE AS raw, v / 4.0::DOUBLE AS phred FROM variants")
def cadd_scores(spark, sf):
    cells = ["contig", F.col("pos").cast("string"), "ref", "alt", (F.col("v") / 8).cast("string"), (F.col("v") / 4).cast("string")]
    lines = X.variants(spark, sf).select(F.concat_ws("\t", *cells).alias("value"))
    return R.scores_to_variants(lines.union(spark.createDataFrame([("## a comment",), ("#Chrom\tPos",)], "value string")), "cadd")


@query("variants", "SELECT contig, pos, 'rs' || v AS id, ref, alt, v / 8.0::DOUBLE AS score, CASE v % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS strand, 'M' || v % 7 AS motif, (v % 9)::BIGINT AS motif_pos, 2::BIGINT AS n_cell_types FROM variants")
def cato_scores(spark, sf):
    k = F.col("v")
    text = lambda c: c.cast("string")
    strand = F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise(".")
    cells = [F.concat(F.lit("chr"), "contig"), text(F.col("pos") - 1), text(F.col("pos")), F.concat(F.lit("rs"), text(k)), text(k / 8), strand, F.concat(F.lit("M"), text(k % 7)), text(k % 9), "ref", "alt", F.lit("a;b")]
    lines = X.variants(spark, sf).select(F.concat_ws("\t", *cells).alias("value"))
    out = R.scores_to_variants(lines.union(spark.createDataFrame([("chrom\tstart\tstop",)], "value string")), "cato")
    return out.withColumn("n_cell_types", F.size("cell_types").cast("long")).drop("cell_types")


@query("variants", "SELECT contig, pos, ref, alt, v / 8.0::DOUBLE AS raw, v / 4.0::DOUBLE AS phred, v / 2.0::DOUBLE AS pc_raw, v::DOUBLE AS pc_phred FROM variants")
def eigen_scores(spark, sf):
    k = F.col("v")
    cells = ["contig", F.col("pos").cast("string"), "ref", "alt", *[F.lit("x") for _ in range(13)], *[(k / d).cast("string") for d in (8, 4, 2, 1)]]
    lines = X.variants(spark, sf).select(F.concat_ws("\t", *cells).alias("value"))
    return R.scores_to_variants(lines.union(spark.createDataFrame([("chr\tposition\tref",)], "value string")), "eigen")
