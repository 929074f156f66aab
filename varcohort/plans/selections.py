"""Queries that choose rows, count them by another rule, or read many files as one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import af as AF
from ..operators import alleles as L
from ..operators import annotate as A
from ..operators import intervals as I
from ..operators import series as S
from ..operators import stats as T
from ..operators.shared import delete, folder, keep
from ..sources import readers as R
from ..sources import writers as W
from . import fixtures as X
from .frequencies import COUNTS, counts
from .regions import GENOME, genome, merged
from .registry import query, rounded

SECOND = "'Brand#' || (1 + v % 5) || (1 + v % 4)"


@query("variants regions", f"""
WITH a AS (SELECT v, symbol FROM variants UNION ALL SELECT v, {SECOND} FROM variants WHERE len(alts) > 1)
SELECT v, contig, pos FROM variants WHERE v IN (SELECT v FROM a WHERE symbol IN (SELECT 'Brand#1' || (1 + s_suppkey % 3) FROM supplier))""")
def gene_list_variants(spark, sf):
    """Variants of which any alternate lies in a gene of a list; the second alternate has a gene of its own."""
    v = X.variants(spark, sf)
    second = F.concat(F.lit("Brand#"), (1 + F.col("v") % 5).cast("string"), (1 + F.col("v") % 4).cast("string"))
    alleles = v.select("v", F.explode(F.when(F.size("alts") > 1, F.array("symbol", second)).otherwise(F.array("symbol"))).alias("symbol"))
    wanted = X.read(spark, sf, "supplier").select(F.concat(F.lit("Brand#1"), (1 + F.col("s_suppkey") % 3).cast("string")).alias("symbol"))
    return A.any_symbol_in(v, alleles, wanted).select("v", "contig", "pos")


@query("variants pools", """
WITH a AS (SELECT v, contig, pos, ref, unnest(alts) AS alt, generate_subscripts(alts, 1) AS i FROM variants),
o AS (SELECT v, CAST(sum(ad) AS BIGINT) AS ad, CAST(sum(dp) AS BIGINT) AS dp FROM pools GROUP BY v)
SELECT v, alt, CASE WHEN i = 1 THEN ad END AS ad, CASE WHEN i = 1 THEN round(ad::DOUBLE / dp, 6) END AS vaf FROM a LEFT JOIN o USING (v)""")
def annotate_from_dataset(spark, sf):
    """Split variants with the reads that another dataset has of the same alternates: of the first ones only."""
    v = X.variants(spark, sf)
    other = X.pools(spark, sf).groupBy("v").agg(F.sum("ad").alias("ad"), F.sum("dp").alias("dp")).join(v, "v")
    split = v.select("v", "contig", "pos", "ref", F.explode("alts").alias("alt"))
    out = A.annotate_from_dataset(split, other, {"ad": F.col("ad"), "vaf": F.col("ad") / F.col("dp")}, "reads")
    return out.select("v", "alt", F.col("reads.ad").alias("ad"), F.round("reads.vaf", 6).alias("vaf"))


@query("", """
SELECT l_partkey, l_orderkey, l_linenumber, round(l_quantity::DOUBLE, 6) AS l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1""")
def first_rows(spark, sf):
    """The first line of every part."""
    rows = X.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    return rounded(L.first_rows(rows, ["l_partkey"], ["l_orderkey", "l_linenumber"]), "l_quantity")


@query("", """
SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER w AS i, lag(event_type) OVER w AS was FROM events WINDOW w AS (ORDER BY event_id))
WHERE i = 1 OR event_type IS DISTINCT FROM was""")
def drop_repeats(spark, sf):
    """Events without those that follow one of their own type."""
    return L.drop_repeats(X.read(spark, sf, "events").select("event_id", "event_type"), "event_id", ["event_type"])


@query("libraries", """
WITH d AS (SELECT s, CAST(15 + dp // (2 + s % 3) AS BIGINT) AS x FROM libraries), r AS (SELECT s, x, row_number() OVER (PARTITION BY s ORDER BY x) AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
h AS (SELECT *, ((n + 3) // 2) / 2.0 AS q FROM r),
f AS (SELECT s, min(x)::DOUBLE AS "min", (max(x) FILTER (i = floor(q)) + max(x) FILTER (i = ceil(q))) / 2.0 AS lower, (max(x) FILTER (i = floor((n + 1) / 2.0)) + max(x) FILTER (i = ceil((n + 1) / 2.0))) / 2.0 AS median,
  (max(x) FILTER (i = floor(n + 1 - q)) + max(x) FILTER (i = ceil(n + 1 - q))) / 2.0 AS upper, max(x)::DOUBLE AS "max" FROM h GROUP BY s)
SELECT * FROM f WHERE upper - lower <= 10 AND median >= 20 AND "max" <= 100 AND 2 * median + 15 >= "max" """)
def good_depth_samples(spark, sf):
    """Libraries whose depths, scaled down by one of three factors, are even and deep enough."""
    d = X.libraries(spark, sf).select("s", (15 + F.floor(F.col("dp") / (2 + F.col("s") % 3))).alias("depth"))
    out = T.good_depth_samples(d, "s", "depth")
    return out.select("s", *[F.col(c).cast("double").alias(c) for c in ("min", "lower", "median", "upper", "max")])


CHANGED = "substr('ACGT', CAST(1 + (instr('ACGT', ref) + pos % 3) % 4 AS INT), 1)"


@query("bases", f"""
WITH t AS (SELECT CAST(contig AS BIGINT) % 10 AS sample, pos, ref, {CHANGED} AS alt, CASE WHEN lag(pos) OVER w = pos - 1 AND lead(pos) OVER w = pos + 1 THEN lag(ref) OVER w || ref || lead(ref) OVER w END AS x
  FROM bases WINDOW w AS (PARTITION BY contig ORDER BY pos)),
c AS (SELECT sample, pos, CASE WHEN ref IN ('A', 'G') THEN translate(reverse(x), 'ACGT', 'TGCA') ELSE x END AS triplet, CASE WHEN ref IN ('A', 'G') THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS alt FROM t WHERE x IS NOT NULL),
o AS (SELECT sample, triplet, count(*) AS background FROM c GROUP BY 1, 2), k AS (SELECT sample, triplet, alt, count(*) AS n FROM c WHERE pos % 4 = 1 GROUP BY 1, 2, 3),
b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b),
g AS (SELECT s.sample, l.b || r.b || n.b AS triplet, a.b AS alt FROM (SELECT DISTINCT sample FROM o) s, b l, b r, b n, b a WHERE r.b IN ('C', 'T') AND a.b <> r.b)
SELECT sample, triplet, alt, coalesce(n, 0) AS n, coalesce(background, 0) AS background, round(coalesce(n, 0) * 1e6 / nullif(background, 0), 6) AS burden
FROM g LEFT JOIN o USING (sample, triplet) LEFT JOIN k USING (sample, triplet, alt)""")
def signature_spectrum(spark, sf):
    """All 96 classes for each of ten samples: every fourth position is called, and every position with both neighbours is an opportunity."""
    t = S.triplet_context(X.bases(spark, sf))
    alt = F.substring(F.lit("ACGT"), F.expr("int(1 + (instr('ACGT', ref) + pos % 3) % 4)"), F.lit(1))
    called = F.when(F.col("pos") % 4 == 1, S.substitution(alt))
    loci = t.select((F.col("contig").cast("long") % 10).alias("sample"), "triplet", called.alias("alt"))
    return rounded(S.signature_spectrum(loci, "sample", "alt"), "burden")


@query("samples variants genotypes", """
WITH p AS (SELECT s, cohort, row_number() OVER (PARTITION BY cohort ORDER BY (s * 37) % 61, s) AS i, count(*) OVER (PARTITION BY cohort) AS n FROM samples),
b AS (SELECT s, ref || '>' || alt AS class, CAST(sum(gt) AS BIGINT) AS value FROM genotypes JOIN variants USING (v) WHERE gt > 0 AND length(ref) = 1 AND length(alt) = 1 GROUP BY 1, 2),
c AS (SELECT cohort, CAST(floor((i - 1) * greatest(round(n / 16.0), 1) / n) AS BIGINT) AS bucket, class, CAST(sum(value) AS BIGINT) AS value FROM b JOIN p USING (s) GROUP BY 1, 2, 3)
SELECT *, round(value::DOUBLE / sum(value) OVER (PARTITION BY cohort, bucket), 6) AS share FROM c""")
def collapse_burden(spark, sf):
    """Alternates by substitution of age-ordered groups of about sixteen customers."""
    snv = X.variants(spark, sf).where("length(ref) = 1 AND length(alt) = 1").select("v", F.concat_ws(">", "ref", "alt").alias("class"))
    burden = X.genotypes(spark, sf).where("gt > 0").join(snv, "v").groupBy("s", "class").agg(F.sum("gt").cast("long").alias("value"))
    people = X.samples(spark, sf).withColumn("age", F.col("s") * 37 % 61)
    return rounded(S.collapse_burden(burden, people, "cohort", ["age", "s"], 16), "share")


@query("samples genotypes", f"""
WITH {COUNTS}, w AS (SELECT v, unnest(['alleles', 'het', 'hom']) AS counted, unnest([n_ra + 2 * n_aa, n_ra, n_aa]) AS ac, cohort IN ('p0', 'p1') AS a FROM counts),
s AS (SELECT counted, 0.5 + sum(ac) FILTER (a AND v % 3 <> 0) AS da, 0.5 + sum(ac) FILTER (NOT a AND v % 3 <> 0) AS db, 0.5 + sum(ac) FILTER (a AND v % 3 = 0) AS na, 0.5 + sum(ac) FILTER (NOT a AND v % 3 = 0) AS nb FROM w GROUP BY counted)
SELECT counted, da::DOUBLE AS da, db::DOUBLE AS db, na::DOUBLE AS na, nb::DOUBLE AS nb, round(ln(da::DOUBLE * nb::DOUBLE / (db::DOUBLE * na::DOUBLE)), 6) AS log_odds FROM s""")
def enrichment_by_zygosity(spark, sf):
    """Log odds of classes between two cohorts, by alleles, heterozygotes and homozygotes."""
    vb = AF.by_zygosity(counts(spark, sf), F.col("cohort").isin("p0", "p1")).withColumn("class", F.when(F.col("v") % 3 == 0, "syn").otherwise("nonsyn"))
    return rounded(AF.enrichment(vb, "counted"), "da", "db", "na", "nb", "log_odds")


WIDER = "SELECT contig, greatest(start0 - 600, 0) AS start0, end0 + 600 AS end0 FROM features"


@query("features", f"""
WITH {GENOME}, x AS ({WIDER}),
e AS (SELECT contig, start0 AS p, 1 AS d FROM x UNION ALL SELECT contig, end0, -1 FROM x UNION ALL SELECT contig, start0, 0 FROM genome UNION ALL SELECT contig, end0, 0 FROM genome),
n AS (SELECT contig, p, sum(d) AS d FROM e GROUP BY 1, 2), r AS (SELECT contig, p AS start0, lead(p) OVER w AS end0, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS depth FROM n WINDOW w AS (PARTITION BY contig ORDER BY p)),
b AS (SELECT contig, start0 - 65 AS start0, end0 + 65 AS end0 FROM r WHERE end0 IS NOT NULL AND depth < 0.95 * 2), {merged('m', 'b')}
SELECT contig, greatest(start0 + 65, 0) AS start0, end0 - 65 AS end0 FROM m WHERE end0 - greatest(start0 + 65, 0) - 65 > 10""")
def bad_depth_regions(spark, sf):
    """Places that fewer than 0.95 of two samples cover, closed."""
    wide = I.slop(X.features(spark, sf), 600)
    return I.bad_depth_regions(I.coverage(wide, genome(spark)), 2)


@query("features", "SELECT contig, start0, end0, 's' || (end0 % 3) AS sample FROM features")
def sorted_union(spark, sf):
    """Intervals written as a file a sample and read back as one table in order."""
    at, rows = folder(spark, "union"), X.features(spark, sf)
    for i in range(3):
        W.write_bed(rows.where(F.col("end0") % 3 == i), f"{at}/s{i}.bed")
    out = keep(R.read_sorted_union(spark, [f"{at}/s{i}.bed" for i in range(3)]))
    delete(spark, at)
    return out


@query("", """
WITH c AS (SELECT p_size AS x, p_retailprice AS y, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2),
s AS (SELECT (SELECT sum(a.n * b.n) FROM c a, c b WHERE a.x < b.x AND a.y < b.y) AS concordant, (SELECT sum(a.n * b.n) FROM c a, c b WHERE a.x > b.x AND a.y < b.y) AS discordant,
  (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM c GROUP BY x)) AS ties_x, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM c GROUP BY y)) AS ties_y, (SELECT sum(n) FROM c) AS n)
SELECT *, round((concordant - discordant) / sqrt((n * (n - 1) / 2 - ties_x) * (n * (n - 1) / 2 - ties_y)), 6) AS tau FROM s""")
def kendall_correlation(spark, sf):
    """Tau of two columns, one with very many values."""
    return rounded(T.kendall_tau(X.read(spark, sf, "part"), "p_size", "p_retailprice"), "tau")
