"""Queries that render tables as the text formats and read them back through the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import af as AF
from ..operators import genotype as G
from ..sources import readers as R
from ..sources import writers as W
from . import fixtures as X
from .registry import query


def sample_ids(spark, sf) -> list[str]:
    """Every pooled sample in order, as a header names them."""
    return [str(r["n_nationkey"]) for r in X.read(spark, sf, "nation").orderBy("n_nationkey").collect()]


@query("variants pools", "SELECT contig, pos, ref, s::VARCHAR AS s, CASE WHEN gt IS NULL THEN NULL WHEN gt = 2 THEN 1 ELSE 0 END AS a1, CASE WHEN gt IS NULL THEN NULL WHEN gt >= 1 THEN 1 ELSE 0 END AS a2, dp - ad AS rd, ad, dp::INT AS dp FROM pools JOIN variants USING (v)")
def vcf_genotypes(spark, sf):
    """Genotypes through VCF text and its parser."""
    gt = X.pools(spark, sf)
    ids = sample_ids(spark, sf)
    call = F.concat(F.when(F.col("gt").isNull(), "./.").when(F.col("gt") == 0, "0/0").when(F.col("gt") == 1, "0|1").otherwise("1/1"), F.lit(":"), (F.col("dp") - F.col("ad")).cast("string"), F.lit(","), F.col("ad").cast("string"), F.lit(":"), F.col("dp").cast("string"))
    wide = gt.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct(F.col("s").cast("string"), call))).alias("calls")).join(X.variants(spark, sf), "v")
    calls = F.transform(R.texts(ids), lambda s: F.coalesce(F.try_element_at("calls", s), F.lit("-")))
    cells = ["contig", F.col("pos").cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:AD:DP"), F.array_join(calls, "\t")]
    lines = wide.select(F.concat_ws("\t", *cells).alias("value"))
    _, out = R.parse_vcf(lines, ids)
    return out.where("dp IS NOT NULL").select("contig", "pos", "ref", "s", "a1", "a2", F.col("ads")[0].alias("rd"), F.col("ads")[1].alias("ad"), "dp")


@query("variants", "SELECT contig, pos, ref, len(alts) AS n_alts, v::VARCHAR AS svid FROM variants")
def vcf_variants(spark, sf):
    v = X.variants(spark, sf).withColumn("svid", F.col("v").cast("string"))
    out, _ = R.parse_vcf(W.vcf_lines(v, ["svid"]), [])
    return out.select("contig", "pos", "ref", F.size("alts").cast("long").alias("n_alts"), F.col("info")["SVID"].alias("svid"))


@query("pools", "SELECT v::VARCHAR AS vid, x.s::VARCHAR AS s, g.gt AS dosage FROM (SELECT DISTINCT v FROM pools) k CROSS JOIN (SELECT n_nationkey AS s FROM nation) x LEFT JOIN pools g USING (v, s)")
def dosage_text(spark, sf):
    names = sample_ids(spark, sf)
    gt = X.pools(spark, sf).select(F.col("v").alias("vid"), F.col("s").cast("string").alias("s"), "gt")
    return R.parse_dosages(W.dosage_lines(gt, names), names).select("vid", "s", F.col("dosage").cast("int").alias("dosage"))


@query("variants models", "SELECT id, 'v' || v AS vid, round(aaf::DOUBLE, 6) AS aaf, round(coef::DOUBLE, 6) AS coef FROM models")
def model_text(spark, sf):
    m = X.models(spark, sf)
    lines = m.select(F.concat_ws("\t", "id", F.concat(F.lit("v"), F.col("v").cast("string")), F.col("aaf").cast("string"), F.col("coef").cast("string")).alias("value"))
    out, _ = R.parse_models(lines)
    return out.select("id", "vid", F.round("aaf", 6).alias("aaf"), F.round("coef", 6).alias("coef"))


@query("variants", "SELECT contig, pos, 'rs' || v AS rsid, ref, alts[1] AS alt, v % 2 = 0 AS reverse FROM variants WHERE contig <> 'X' AND len(alts) = 1 AND length(ref) = 1 AND length(alts[1]) = 1 AND ref || alts[1] NOT IN ('AT', 'TA', 'CG', 'GC')")
def strand_specific_snvs(spark, sf):
    v = X.variants(spark, sf).withColumn("rsid", F.concat(F.lit("rs"), F.col("v").cast("string")))
    v = v.withColumn("info", F.when(F.col("v") % 2 == 0, F.create_map(F.lit("RV"), F.lit(""))))
    return R.strand_specific_snvs(v)


@query("variants", "SELECT contig, pos, ref, alts[1] AS alt, CAST(floor(1000 - (v % 100) / 2.0) AS BIGINT) AS n_missing, (v % 11)::BIGINT AS n_ra, CAST(floor((v % 7) / 2.0) AS BIGINT) AS n_aa, 1000 - CAST(floor(1000 - (v % 100) / 2.0) AS BIGINT) - v % 11 - CAST(floor((v % 7) / 2.0) AS BIGINT) AS n_rr FROM variants WHERE len(alts) = 1")
def af_vcf_to_counts(spark, sf):
    k = F.col("v")
    info = F.create_map(F.lit("AN"), (k % 100).cast("string"), F.lit("AC_Het"), (k % 11).cast("string"), F.lit("AC_Hom"), (k % 7).cast("string"))
    return R.af_vcf_to_counts(X.variants(spark, sf).withColumn("info", info))


@query("regions", "SELECT contig || chr(9) || start0 || chr(9) || end0 AS value FROM regions")
def bed_text(spark, sf):
    return W.bed_lines(X.regions(spark, sf))


@query("variants genotypes", """
WITH c AS (SELECT v, s, ref, alts, dp, ad, gt, CASE WHEN gt = 2 THEN 1 ELSE 0 END AS a1, CASE WHEN gt = 0 THEN 0 WHEN len(alts) > 1 AND s % 2 = 0 THEN 2 ELSE 1 END AS a2,
  CASE WHEN len(alts) > 1 THEN [dp - ad, ad - ad // 2, ad // 2] ELSE [dp - ad, ad] END AS ads FROM genotypes JOIN variants USING (v) WHERE gt IS NOT NULL),
u AS (SELECT *, unnest(alts) AS alt, generate_subscripts(alts, 1) AS i FROM c)
SELECT v, s, i::INT AS a_index, ref, alt, (a1 = i)::INT + (a2 = i)::INT AS gt, ads[i + 1] AS ad, dp - ads[i + 1] AS ref_ad FROM u""")
def downcoded(spark, sf):
    """Genotypes and allele reads of all samples at every alternate, after splitting sites and down-coding."""
    g, many, half = F.col("gt"), F.size("alts") > 1, F.floor(F.col("ad") / 2)
    sites = X.variants(spark, sf)
    calls = X.genotypes(spark, sf).where("gt IS NOT NULL").join(sites.select("v", "alts"), "v")
    second = F.when(g == 0, 0).when(many & (F.col("s") % 2 == 0), 2).otherwise(1)
    reads = F.when(many, F.array(F.col("dp") - F.col("ad"), F.col("ad") - half, half)).otherwise(F.array(F.col("dp") - F.col("ad"), F.col("ad")))
    raw = calls.select("v", "s", F.when(g == 2, 1).otherwise(0).alias("a1"), second.alias("a2"), reads.alias("ads"))
    alleles = G.split_multi(sites)
    out = G.downcode(raw, alleles, "v").join(alleles.select("v", "a_index", "ref", "alt"), ["v", "a_index"])
    return out.select("v", "s", F.col("a_index").cast("int").alias("a_index"), "ref", "alt", F.col("gt").cast("int").alias("gt"), "ad", "ref_ad")


@query("variants", "SELECT v, contig, pos FROM variants")
def assert_key(spark, sf):
    """The table itself, failing if (contig, pos) occurs twice."""
    return AF.assert_key(X.variants(spark, sf).select("v", "contig", "pos"), "contig", "pos")
