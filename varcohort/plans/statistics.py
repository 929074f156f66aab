"""Queries of ranks, tests and group statistics over events, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.variant import af_bin, band
from ..operators import series as SE
from ..operators import stats as S
from . import fixtures as X
from .registry import query, rounded


def events(spark, sf):
    return X.read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("", "SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events")
def avg_rank(spark, sf):
    return S.avg_rank(events(spark, sf), "value", ["event_type"]).select("event_id", "event_type", F.col("rank").cast("double").alias("rank"))


PV = "p AS (SELECT p_partkey AS k, p_size, (1 + (p_partkey * 7919) % 10007) / 10008.0 AS p FROM part)"


def pvalues(spark, sf):
    k = F.col("p_partkey")
    return X.read(spark, sf, "part").select(k.alias("k"), "p_size", ((1 + (k * 7919) % 10007) / F.lit(10008.0)).alias("p"))


ADJ = "m AS (SELECT *, count(*) OVER (PARTITION BY p_size) AS m, row_number() OVER (PARTITION BY p_size ORDER BY p, k) AS i FROM p)"


@query("", f"WITH {PV}, {ADJ} SELECT k, round(least(1.0, max(p * (m - i + 1)) OVER (PARTITION BY p_size ORDER BY p, k ROWS UNBOUNDED PRECEDING))::DOUBLE, 6) AS p_adj FROM m")
def p_adjust_holm(spark, sf):
    return rounded(S.p_adjust(pvalues(spark, sf), "p", "holm", "k", ["p_size"]).select("k", "p_adj"), "p_adj")


@query("", f"WITH {PV}, {ADJ} SELECT k, round(least(1.0, min(p * m / i) OVER (PARTITION BY p_size ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING))::DOUBLE, 6) AS p_adj FROM m")
def p_adjust_bh(spark, sf):
    return rounded(S.p_adjust(pvalues(spark, sf), "p", "bh", "k", ["p_size"]).select("k", "p_adj"), "p_adj")


@query("", f"WITH {PV}, {ADJ} SELECT k, round(least(1.0, min(p * m / i * list_sum([1.0::DOUBLE / j FOR j IN range(1, m + 1)])) OVER (PARTITION BY p_size ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING))::DOUBLE, 6) AS p_adj FROM m")
def p_adjust_by(spark, sf):
    return rounded(S.p_adjust(pvalues(spark, sf), "p", "by", "k", ["p_size"]).select("k", "p_adj"), "p_adj")


@query("", """
WITH r AS (SELECT event_type, value AS x, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events WHERE value IS NOT NULL),
d AS (SELECT *, floor((n + 3) / 2.0) / 2 AS n4 FROM r)
SELECT event_type, min(x) AS min, round((max(x) FILTER (i = floor(n4)) + max(x) FILTER (i = ceil(n4))) / 2, 6) AS lower, round((max(x) FILTER (i = floor((n + 1) / 2.0)) + max(x) FILTER (i = ceil((n + 1) / 2.0))) / 2, 6) AS median,
  round((max(x) FILTER (i = floor(n + 1 - n4)) + max(x) FILTER (i = ceil(n + 1 - n4))) / 2, 6) AS upper, max(x) AS max FROM d GROUP BY event_type""")
def fivenum(spark, sf):
    return rounded(S.fivenum(events(spark, sf), "event_type", "value"), "lower", "median", "upper")


LABELLED = "j AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def labelled(spark, sf):
    return X.read(spark, sf, "documents").select("doc_id", "n_chars").join(X.read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").where("quality IS NOT NULL")


@query("", f"""
WITH {LABELLED}, a AS (SELECT n_chars, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality <> 1) AS b FROM j GROUP BY 1), t AS (SELECT sum(a) AS na, sum(b) AS nb FROM a),
r AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM a WINDOW w AS (ORDER BY n_chars ROWS UNBOUNDED PRECEDING))
SELECT CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, round(max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)), 6) AS ks FROM r, t""")
def ks2(spark, sf):
    return rounded(S.ks2(labelled(spark, sf), "n_chars", F.col("quality") == 1).select("n_a", "n_b", "ks"), "ks")


@query("", f"""
WITH {LABELLED}, r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM j), s AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n, sum(r) FILTER (quality = 1) AS w FROM r)
SELECT p AS n_pos, n AS n_neg, round((w - p * (p + 1) / 2.0) / (p::DOUBLE * n), 6) AS auc FROM s""")
def auc(spark, sf):
    return rounded(S.auc(labelled(spark, sf), "n_chars", F.col("quality") == 1), "auc")


@query("", """
WITH u AS (SELECT user_id, round(avg(value) FILTER (event_id % 2 = 0) - avg(value) FILTER (event_id % 2 = 1), 6) AS d FROM events GROUP BY 1), z AS (SELECT d, abs(d) AS a FROM u WHERE d <> 0),
r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM z)
SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r""")
def wilcoxon(spark, sf):
    """Signed ranks of users' means of even events less those of odd ones; sums go in the order of events, and digits are cut as the SQL cuts them."""
    rows = events(spark, sf).select("user_id", "event_id", "value", (F.col("event_id") % 2).alias("odd")).where("odd IN (0, 1)")
    means = S.mean_in_order(rows, ["user_id", "odd"], "value", "event_id", "mean")
    mean = lambda odd: F.max(F.when(F.col("odd") == odd, F.col("mean")))
    d = means.groupBy("user_id").agg((F.round((mean(0) - mean(1)) * 1e6) / 1e6).alias("d"))
    return rounded(S.wilcoxon_signed_rank(d, "d").select("n", "w_plus", "w_minus"), "w_plus", "w_minus")


@query("", "SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def crosstab(spark, sf):
    d = X.read(spark, sf, "documents").select("doc_id", "lang").join(X.read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 1, "good").otherwise("bad")
    return d.withColumn("q", q).groupBy("lang").pivot("q", ["good", "bad", "unlabelled"]).count().na.fill(0)


@query("", """
WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), d AS (SELECT event_id, event_type, value, m, abs(value - m) AS d FROM events JOIN m USING (event_type)), s AS (SELECT event_type, median(d) AS s FROM d GROUP BY 1)
SELECT event_id, round((value - m) / (1.4826 * nullif(s, 0)), 6) AS scaled FROM d JOIN s USING (event_type)""")
def robust_scale(spark, sf):
    return rounded(S.robust_scale(events(spark, sf), "value", "event_type").select("event_id", "scaled"), "scaled")


@query("", "SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def z_scale(spark, sf):
    return rounded(S.z_scale(events(spark, sf), "value", "event_type").select("event_id", "scaled"), "scaled")


@query("", "SELECT event_type, regr_count(value, user_id)::BIGINT AS n, round(regr_slope(value, user_id), 6) AS slope, round(regr_intercept(value, user_id), 6) AS intercept, round(regr_r2(value, user_id), 6) AS r2 FROM events GROUP BY event_type")
def trend(spark, sf):
    return rounded(S.trend(events(spark, sf), "value", "user_id", "event_type"), "slope", "intercept", "r2")


@query("", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def boot_interval(spark, sf):
    return rounded(S.boot_interval(events(spark, sf), ["event_type"], "value"), "low", "high", "mean")


@query("", """
WITH r AS (SELECT event_type, value AS low, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT a.event_type, a.low, b.low AS high FROM r a JOIN r b ON a.event_type = b.event_type AND b.i = a.i + ceil(a.n * 0.95) - 1)
SELECT event_type, low, high FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY high - low, low) = 1""")
def shortest_interval(spark, sf):
    return S.shortest_interval(events(spark, sf).where("value IS NOT NULL"), "event_type", "value")


@query("", """
WITH t AS (SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i FROM events)
SELECT event_id, CAST(floor((i - 1) * greatest(round(n / 16.0), 1) / n) AS BIGINT) AS bucket FROM t""")
def collapse_groups(spark, sf):
    return SE.collapse_groups(events(spark, sf), "event_type", ["value", "event_id"], 16).select("event_id", "bucket")


@query("", """
SELECT p_partkey, least(19, floor(p_size / 50.0 * 20))::INT AS bin, CASE WHEN p_size >= 1 AND p_size < 10 THEN '1-9' WHEN p_size >= 10 AND p_size < 30 THEN '10-29' WHEN p_size >= 30 AND p_size < 51 THEN '30-50' END AS band FROM part""")
def binning(spark, sf):
    return X.read(spark, sf, "part").select("p_partkey", af_bin(F.col("p_size") / 50.0, 20).alias("bin"), band(F.col("p_size"), [1, 10, 30, 51]).alias("band"))


@query("", f"""
WITH {LABELLED}, t AS (SELECT n_chars AS x, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS q FROM j GROUP BY 1)
SELECT x::DOUBLE AS threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(q) OVER w / sum(q) OVER (), 6) AS fpr FROM t WINDOW w AS (ORDER BY x DESC ROWS UNBOUNDED PRECEDING)""")
def roc_points(spark, sf):
    return rounded(S.roc_points(labelled(spark, sf), "n_chars", F.col("quality") == 1), "tpr", "fpr")


@query("", "WITH r AS (SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank FROM events) SELECT event_id, rank::DOUBLE AS rank FROM r")
def rank_all(spark, sf):
    """Average ranks without a group: no task orders all rows."""
    return S.avg_rank(events(spark, sf), "value").select("event_id", F.col("rank").cast("double").alias("rank"))


@query("", "SELECT event_type, count(value) AS n, round(avg(value - 50), 6) AS mean, round(avg(value - 50) / stddev_samp(value) * sqrt(count(value)), 6) AS t FROM events GROUP BY event_type")
def paired_t(spark, sf):
    """Differences from fifty; the p is left to the fixed vectors."""
    d = events(spark, sf).select("event_type", (F.col("value") - 50).alias("d"))
    return rounded(S.paired_t(d, "d", "event_type").select("event_type", "n", "mean", "t"), "mean", "t")


@query("", """
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), x AS (SELECT n, sum(n) OVER (PARTITION BY lang) AS r, sum(n) OVER (PARTITION BY source) AS c, sum(n) OVER () AS m FROM c)
SELECT round(sum(2 * n * ln(n * m / (r * c))), 6) AS g, CAST(max(m) AS BIGINT) AS n, ((SELECT count(DISTINCT lang) FROM documents) - 1) * ((SELECT count(DISTINCT source) FROM documents) - 1) AS df FROM x""")
def g_test(spark, sf):
    return rounded(S.g_test(X.read(spark, sf, "documents"), "lang", "source").select("g", "n", "df"), "g")


@query("", """
WITH c AS (SELECT p_size AS x, p_partkey % 7 AS y, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2)
SELECT (SELECT sum(a.n * b.n) FROM c a, c b WHERE a.x < b.x AND a.y < b.y) AS concordant, (SELECT sum(a.n * b.n) FROM c a, c b WHERE a.x > b.x AND a.y < b.y) AS discordant""")
def kendall_tau(spark, sf):
    return S.kendall_tau(X.read(spark, sf, "part").withColumn("y", F.col("p_partkey") % 7), "p_size", "y").select("concordant", "discordant")


@query("", """
WITH g AS (SELECT event_type, count(*) AS n, regr_sxx(value, user_id) AS sxx, regr_sxy(value, user_id) AS sxy, regr_syy(value, user_id) AS syy FROM events WHERE value IS NOT NULL GROUP BY 1),
s AS (SELECT sum(n) AS n, count(*) AS k, sum(syy) - sum(sxy)^2 / sum(sxx) AS rss, sum(syy - sxy^2 / sxx) AS own FROM g)
SELECT k - 1 AS df1, CAST(n - 2 * k AS BIGINT) AS df2, round((rss - own) / (k - 1) / (own / (n - 2 * k)), 6) AS f FROM s""")
def slope_interaction(spark, sf):
    return rounded(S.slope_interaction(events(spark, sf), "value", "user_id", "event_type").select("df1", "df2", "f"), "f")


@query()
def score_logit(spark, sf):
    """Quality by length: log odds, standard error and Wald p."""
    d = labelled(spark, sf).select((F.col("quality") == 1).cast("int").alias("y"), F.log1p("n_chars").alias("x"))
    return rounded(S.score_logit(d, "y", "x"), "beta", "se", "z", "p")


def exact(table: str) -> str:
    """SQL for exact Hardy-Weinberg p (``p``, and ``mid``) of each (aa, ab, bb) of a table, as ``hwe``."""
    return f"""hx AS (SELECT DISTINCT aa, ab, bb, 2 * least(aa, bb) + ab AS rare, aa + ab + bb AS n FROM {table}),
hh AS (SELECT *, unnest(range(rare % 2, rare + 1, 2)) AS het FROM hx),
hw AS (SELECT *, het * ln(2) - lgamma((rare - het) // 2 + 1) - lgamma(het + 1) - lgamma(n - het - (rare - het) // 2 + 1) AS l FROM hh),
he AS (SELECT aa, ab, bb, het, exp(l - max(l) OVER (PARTITION BY aa, ab, bb)) AS e FROM hw),
ho AS (SELECT aa, ab, bb, sum(e) AS total, max(e) FILTER (het = ab) AS own FROM he GROUP BY aa, ab, bb),
hwe AS (SELECT aa, ab, bb, least(1, sum(e) FILTER (e <= own * (1 + 1e-9)) / max(total)) AS p, least(1, sum(e) FILTER (e <= own * (1 + 1e-9)) / max(total) - max(own) / max(total) / 2) AS mid FROM he JOIN ho USING (aa, ab, bb) GROUP BY aa, ab, bb)"""


@query("genotypes", f"""
WITH c AS (SELECT v, count(*) FILTER (gt = 0) AS aa, count(*) FILTER (gt = 1) AS ab, count(*) FILTER (gt = 2) AS bb FROM genotypes GROUP BY v), {exact('c')} SELECT v, round(p, 6) AS p FROM c JOIN hwe USING (aa, ab, bb)""")
def hwe_exact(spark, sf):
    """Exact Hardy-Weinberg p of each variant, computed once for each distinct triple of counts."""
    from ..operators import genotype as G

    qc = G.variant_qc(X.genotypes(spark, sf), X.n_samples()).select("v", "n_hom_ref", "n_het", "n_hom_var")
    return rounded(S.with_hwe(qc).select("v", F.col("hwe_p").alias("p")), "p")


@query("genotypes", """
WITH h AS (SELECT * FROM genotypes WHERE gt = 1 AND dp > 10), d AS (SELECT DISTINCT ad, dp FROM h), k AS (SELECT *, unnest(range(0, dp + 1)) AS i FROM d),
e AS (SELECT ad, dp, i, exp(lgamma(dp + 1) - lgamma(i + 1) - lgamma(dp - i + 1) + dp * ln(0.5)) AS w FROM k), o AS (SELECT ad, dp, max(w) FILTER (i = ad) AS own FROM e GROUP BY 1, 2),
p AS (SELECT ad, dp, least(1, sum(w) FILTER (w <= own * (1 + 1e-7))) AS p FROM e JOIN o USING (ad, dp) GROUP BY 1, 2)
SELECT v, s, ad, dp, round(p, 6) AS p FROM h JOIN p USING (ad, dp) WHERE p >= 0.1""")
def het_balance(spark, sf):
    """Heterozygous calls whose allele balance an exact binomial test allows, by distinct (reads, depth)."""
    het = X.genotypes(spark, sf).where("gt = 1 AND dp > 10")
    pairs = het.select("ad", "dp").distinct().withColumn("p", S.binom_test("ad", "dp"))
    return rounded(het.join(pairs, ["ad", "dp"]).where("p >= 0.1").select("v", "s", "ad", "dp", "p"), "p")
