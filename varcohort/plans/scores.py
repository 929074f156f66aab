"""Queries over polygenic scores, nulls and catalogue models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import resample as R
from ..operators import scores as S
from ..operators.blocked import scan
from ..operators.shared import keep
from . import fixtures as X
from .frequencies import counts, variant_burden
from .registry import query, rounded

SCORE = """f AS (SELECT v, count(*) AS n, sum(gt) AS ac FROM pools WHERE gt IS NOT NULL GROUP BY v),
m AS (SELECT models.*, coalesce(n >= (SELECT count(*) FROM nation) * 0.6, false) AS usable, ac::DOUBLE / n AS mean FROM models LEFT JOIN f USING (v)),
b AS (SELECT id, sum(coef * CASE WHEN usable THEN mean ELSE 2 * aaf END) AS base FROM m GROUP BY id),
o AS (SELECT id, s, sum(coef * (gt - mean)) AS own FROM m JOIN pools USING (v) WHERE usable AND gt IS NOT NULL GROUP BY id, s),
score AS (SELECT b.id, n_nationkey AS s, base + coalesce(own, 0) AS score FROM b CROSS JOIN nation LEFT JOIN o ON o.id = b.id AND o.s = n_nationkey)"""


def pool_ids(spark, sf) -> DataFrame:
    return X.read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("s"))


def scored(spark, sf) -> DataFrame:
    return S.score(X.pools(spark, sf), X.models(spark, sf), pool_ids(spark, sf), 0.4)


@query("variants pools models", f"WITH {SCORE} SELECT id, s, round(score::DOUBLE, 8) AS score FROM score")
def polygenic_score(spark, sf):
    # seven digits can be exact, and their last a five: eight are asked for
    return scored(spark, sf).withColumn("score", F.round("score", 8))


@query("variants pools models", f"""
WITH {SCORE}, c AS (SELECT id, score::DOUBLE AS x, avg(score::DOUBLE) OVER (PARTITION BY id) AS m FROM score),
k AS (SELECT id, avg(x) AS m1, avg((x - m)^2) AS m2, avg((x - m)^3) AS c3, avg((x - m)^4) AS c4 FROM c GROUP BY id)
SELECT id, round(m1, 6) AS m1, round(m2, 6) AS m2, round(c3 / m2^1.5, 6) AS m3, round(c4 / m2^2, 6) AS m4 FROM k""")
def score_moments(spark, sf):
    return rounded(S.moments(scored(spark, sf), "id"), "m1", "m2", "m3", "m4")


AFS = """a AS (SELECT v, 'p' || pop AS cohort, sum(gt)::DOUBLE / (2 * count(*)) AS af FROM genotypes JOIN samples USING (s) WHERE gt IS NOT NULL GROUP BY v, pop)"""


@query("samples variants genotypes models", f"""
WITH {AFS}, z AS (SELECT id, count(*) AS size, sum(2 * aaf * coef) AS base FROM models GROUP BY id),
k AS (SELECT id, cohort, sum(2 * (af - aaf) * coef) AS shift FROM models JOIN a USING (v) GROUP BY id, cohort)
SELECT id, cohort, round(((base + shift) / size)::DOUBLE, 6) AS mean_score FROM k JOIN z USING (id)""")
def cohort_mean_score(spark, sf):
    gt = X.genotypes(spark, sf).where("gt IS NOT NULL").join(X.samples(spark, sf), "s")
    af = gt.groupBy("v", F.concat(F.lit("p"), F.col("pop").cast("string")).alias("cohort")).agg((F.sum("gt") / (2 * F.count(F.lit(1)))).alias("af"))
    return rounded(S.cohort_mean_score(af, X.models(spark, sf)), "mean_score")


@query()
def null_scores(spark, sf):
    """Moments of scores by frequency-matched random models, by model and iteration."""
    gt = X.pools(spark, sf)
    freq = gt.where("gt IS NOT NULL").groupBy("v").agg((F.sum("gt") / (2 * F.count(F.lit(1)))).alias("af"))
    null = S.null_models(X.models(spark, sf), freq, 20)
    return rounded(S.moments(S.score(gt, null, pool_ids(spark, sf), 0.4, ("iter",)), "id", "iter"), "m1", "m2", "m3", "m4")


@query("trace", """
WITH o AS (SELECT event_type, avg(value) AS obs FROM trace GROUP BY 1), s AS (SELECT series, event_type, avg(value) AS x FROM trace GROUP BY 1, 2)
SELECT event_type, count(*) AS n, count(*) FILTER (round(x, 6) < round(obs, 6)) AS below, count(*) FILTER (round(x, 6) > round(obs, 6)) AS above,
  round((least(count(*) FILTER (round(x, 6) < round(obs, 6)), count(*) FILTER (round(x, 6) > round(obs, 6))) + 1.0) / (count(*) + 1), 6) AS p
FROM s JOIN o USING (event_type) GROUP BY event_type""")
def perm_test(spark, sf):
    t = X.trace(spark, sf)
    obs = rounded(t.groupBy("event_type").agg(F.avg("value").alias("obs")), "obs")
    null = rounded(t.groupBy("series", "event_type").agg(F.avg("value").alias("x")), "x")
    out = S.permutation_p(null.join(obs, "event_type"), "obs", "x", "event_type")
    return rounded(out.select("event_type", "n", "below", "above", "p"), "p")


@query("samples genotypes variants models", f"""
WITH {AFS}, w AS (SELECT v, max(af) FILTER (cohort = 'p0') AS a, max(af) FILTER (cohort = 'p1') AS b FROM a GROUP BY v), x AS (SELECT coef, a, b FROM models JOIN w USING (v) WHERE coef <> 0 AND a <> b)
SELECT count(*) FILTER (a > b AND coef > 0) AS up_pos, count(*) FILTER (a > b AND coef < 0) AS up_neg, count(*) FILTER (a < b AND coef > 0) AS down_pos, count(*) FILTER (a < b AND coef < 0) AS down_neg FROM x""")
def depletion_counts(spark, sf):
    gt = X.genotypes(spark, sf).where("gt IS NOT NULL").join(X.samples(spark, sf), "s")
    af = gt.groupBy("v").pivot("pop", [0, 1]).agg(F.sum("gt").cast("double") / (2 * F.count(F.lit(1)))).select("v", F.col("0").alias("a"), F.col("1").alias("b"))
    return S.depletion_counts(X.models(spark, sf), af, "a", "b")


@query("variants", """
WITH a AS (SELECT 't' || (v % 6) AS trait, 'rs' || v || '-' || CASE WHEN v % 2 = 0 THEN ref WHEN v % 5 = 0 THEN '?' ELSE alt END AS snp, 1 + (v % 9) / 10.0 AS odds, v * 100 AS n FROM variants),
d AS (SELECT 'rs' || v AS rsid, v, ref, alt, (v % 50) / 100.0 AS af FROM variants WHERE ref || alt NOT IN ('AT', 'TA', 'CG', 'GC')),
j AS (SELECT trait, v, af, CASE WHEN split_part(snp, '-', 2) = ref THEN -ln(odds) ELSE ln(odds) END AS coef, CASE WHEN split_part(snp, '-', 2) = ref THEN 2 * ln(odds) ELSE 0 END AS shift
  FROM a JOIN d ON rsid = split_part(snp, '-', 1) WHERE n >= 5000 AND regexp_matches(snp, '^rs[0-9]+-[ACGT]$') AND split_part(snp, '-', 2) IN (ref, alt)),
k AS (SELECT trait, sum(shift) AS shift FROM j GROUP BY trait HAVING count(*) >= 5)
SELECT trait AS id, v, round(af::DOUBLE, 6) AS aaf, round(coef, 6) + 0.0 AS coef FROM j WHERE trait IN (SELECT trait FROM k) UNION ALL SELECT trait, NULL, NULL, round(shift, 6) + 0.0 FROM k""")
def gwas_to_models(spark, sf):
    v = X.variants(spark, sf)
    k = F.col("v")
    risk = F.when(k % 2 == 0, F.col("ref")).when(k % 5 == 0, "?").otherwise(F.col("alt"))
    rs = F.concat(F.lit("rs"), k.cast("string"))
    assoc = v.select(F.concat(F.lit("t"), (k % 6).cast("string")).alias("trait"), F.concat_ws("-", rs, risk).alias("snp_allele"), (1 + (k % 9) / 10).alias("odds_ratio"), (k * 100).alias("n"))
    db = v.where(~F.concat("ref", "alt").isin("AT", "TA", "CG", "GC")).select(rs.alias("rsid"), "v", "ref", "alt", ((k % 50) / 100).alias("af"))
    return rounded(S.gwas_to_models(assoc, db), "aaf", "coef")


@query()
def multinomial_bootstrap(spark, sf):
    """Mean allele frequency of each cohort over bootstrap replicates of its genotype counts."""
    reps = R.multinomial_draw(counts(spark, sf), 5, 7, "v", "cohort")
    n = F.col("n_rr") + F.col("n_ra") + F.col("n_aa")
    return rounded(reps.groupBy("cohort", "rep").agg((F.sum(F.col("n_ra") + 2 * F.col("n_aa")) / (2 * F.sum(n))).alias("af")), "af")


@query()
def burden_permutation(spark, sf):
    """Class ratio of cohort a by label-permuted replicate; sums over both cohorts never change."""
    reps = R.burden_permutations(variant_burden(spark, sf), 10, 3)
    pick = lambda c: F.sum(F.when(F.col("class") == c, F.col("ac_a")).otherwise(0))
    return reps.groupBy("rep").agg(pick("nonsyn").cast("long").alias("nonsyn_a"), pick("syn").cast("long").alias("syn_a"), F.sum(F.col("ac_a") + F.col("ac_b")).cast("long").alias("total"))


@query()
def drift_null(spark, sf):
    """Mean simulated frequency by replicate, from observed normalised differences of two cohorts."""
    gt = X.genotypes(spark, sf).where("gt IS NOT NULL").join(X.samples(spark, sf), "s")
    af = gt.groupBy("v").pivot("pop", [0, 1]).agg(F.sum("gt").cast("double") / (2 * F.count(F.lit(1)))).select("v", F.col("0").alias("af"), F.col("1").alias("b")).where("af > 0 AND af < 1 AND b IS NOT NULL")
    ones = scan(af.withColumn("one", F.lit(1)), [], "v", F.floor(F.col("v") / 65536), "one", "i")  # numbered in blocks of keys
    d = ones.select(((F.col("b") - F.col("af")) / F.sqrt(F.col("af") * (1 - F.col("af")))).alias("d"), (F.col("i") - 1).cast("int").alias("i"))
    return rounded(R.drift_null(af, d, 10, 5).groupBy("rep").agg(F.avg("af").alias("af"), F.count(F.lit(1)).alias("n")), "af")


@query()
def ld_prune(spark, sf):
    from ..operators import genotype as G

    v = X.variants(spark, sf)
    return M.ld_prune(G.ld_r2(X.pools(spark, sf), v, 3000), v, 0.2)


@query()
def pca(spark, sf):
    return rounded(M.pca(X.pools(spark, sf), 4)[0], "pc1", "pc2", "pc3", "pc4")


@query()
def pca_loadings(spark, sf):
    return rounded(M.pca(X.pools(spark, sf), 2)[1], "l1", "l2")


@query()
def pc_relate(spark, sf):
    """Kinship of pooled samples, allowing for two components."""
    gt = keep(X.pools(spark, sf).select("v", "s", "gt"))
    return rounded(M.pc_relate(gt, M.pca(gt, 2)[0], ["pc1", "pc2"]), "kin")


@query()
def enrichment_interval(spark, sf):
    """Log odds of classes between two cohorts on every contig, with bias-corrected intervals."""
    vb = variant_burden(spark, sf).join(X.variants(spark, sf).select("v", "contig"), "v")
    return rounded(R.enrichment_interval(vb, ["contig"], 50, 5), "observed", "low", "high")


@query()
def subsampled_burden(spark, sf):
    """Loci per person of two cohorts drawn down to two people a locus."""
    return rounded(R.subsampled_burden(counts(spark, sf), ("p0", "p1"), 2, 20, 7), "mean_a", "mean_b", "share_a", "p")


@query()
def nmf_best(spark, sf):
    """Fits of the event-type by user matrix over ranks and restarts."""
    t = X.trace(spark, sf)
    kinds = F.pmod(F.hash("event_type"), F.lit(97))
    m = t.groupBy(F.col("series").cast("int").alias("user"), kinds.cast("int").alias("kind")).agg(F.count(F.lit(1)).cast("float").alias("n"))
    return rounded(M.nmf_best(m, "user", "kind", "n", [1, 2, 3], 2)[2], "rss", "explained")


@query()
def gda_predict(spark, sf):
    """Embedding classes by a Gaussian discriminant on four components, trained on the even ids."""
    e = X.read(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)])
    cols = [f"x{i}" for i in range(4)]
    model = M.gda_fit(e.where("vec_id % 2 = 0"), "label", cols)
    return rounded(M.gda_predict(e, model, "label", cols), "probability").select("vec_id", "label", "predicted", "probability")


@query()
def nmf(spark, sf):
    """Factors of the event-type by user matrix."""
    t = X.trace(spark, sf)
    kinds = F.pmod(F.hash("event_type"), F.lit(97))
    m = t.groupBy(F.col("series").cast("int").alias("user"), kinds.cast("int").alias("kind")).agg(F.count(F.lit(1)).cast("float").alias("n"))
    users, _ = M.nmf(m, "user", "kind", "n", 2)
    return users.select("id", F.transform("features", lambda x: F.round(x.cast("double"), 4)).alias("features"))


@query("genotypes", """
WITH g(state, k1, k2, f) AS (VALUES (0, 1, 1, 0.0), (1, 0, 1, 0.5), (2, 0, 1, 0.9), (3, 1, 2, 0.5), (4, 1, 2, 0.9)),
h AS (SELECT state, k1, k2, f::DOUBLE AS f, least(greatest(((1 - f) + f * k1)::DOUBLE / (((1 - f) + f * k1) + ((1 - f) + f * k2)), 0.01), 0.99) AS p FROM g),
l AS (SELECT s, v // 100 AS w, state, k1, k2, f, ad * ln(p) + (dp - ad) * ln(1 - p) AS a, ad * ln(1 - p) + (dp - ad) * ln(p) AS b FROM genotypes, h WHERE gt = 1),
t AS (SELECT s, w, state, k1, k2, f, sum(greatest(a, b) + ln((exp(a - greatest(a, b)) + exp(b - greatest(a, b))) / 2)) AS ll, count(*) AS n FROM l GROUP BY ALL)
SELECT s, w::BIGINT AS w, state, k1, k2, round(f, 6) AS f, round(ll, 4) AS log_likelihood, n FROM t QUALIFY row_number() OVER (PARTITION BY s, w ORDER BY round(ll, 9) DESC, state) = 1""")
def copy_number_states(spark, sf):
    t = X.genotypes(spark, sf).where("gt = 1").withColumn("w", F.floor(F.col("v") / 100))
    out = M.copy_number(t, ["s", "w"], [(1, 1, 0.0), (0, 1, 0.5), (0, 1, 0.9), (1, 2, 0.5), (1, 2, 0.9)])
    return rounded(out, "f").withColumn("log_likelihood", F.round("log_likelihood", 4))
