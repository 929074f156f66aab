"""Statistics: ranks, adjustment, two-sample tests, tail probabilities."""

from __future__ import annotations

from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.consequence import good_depth
from .blocked import scan, value_blocks
from .shared import keep


def distinct_values(df: DataFrame, col: str, by: list[str], **counts: Column) -> tuple[DataFrame, Column]:
    """A row for each value of each group, with ``n`` and further counts, and the block that each value lies in."""
    at = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])
    return at, value_blocks(at, "__x")


def avg_rank(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``rank``: average rank among ties, null for null. Ranks come from counts of distinct values, in blocks of values."""
    by = by or []
    at, block = distinct_values(df, col, by)
    ranked = scan(at, by, "__x", block, "n", "upto").select(*by, "__x", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    return df.withColumn("__x", F.col(col).cast("double")).join(ranked, [*by, "__x"], "left").drop("__x")


def p_adjust(df: DataFrame, p: str, method: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``p_adj`` by Holm, BH or BY. Equal p share one value, so only distinct ones are ordered, in blocks of values."""
    by = by or []
    at, block = distinct_values(df, p, by)
    total = at.groupBy(*by).agg(F.sum("n").alias("m")) if by else at.agg(F.sum("n").alias("m"))
    rows = scan(at, by, "__x", block, "n", "upto")
    rows = rows.join(total, by) if by else rows.join(F.broadcast(total))  # one row
    if method == "holm":
        rows = scan(rows.withColumn("raw", F.col("__x") * (F.col("m") - F.col("upto") + F.col("n"))), by, "__x", block, "raw", "adj", "max")
    elif method in ("bh", "by"):
        raw = F.col("__x") * F.col("m") / F.col("upto")
        if method == "by":
            harmonic = total.select(*by, F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("k")).groupBy(*by).agg(F.sum(1 / F.col("k")).alias("h"))
            rows = (rows.join(harmonic, by) if by else rows.join(F.broadcast(harmonic)))  # one row
            raw = raw * F.col("h")
        rows = scan(rows.withColumn("raw", raw), by, "__x", block, "raw", "adj", "min", ahead=True)
    else:
        raise ValueError(method)
    out = df.withColumn("__x", F.col(p).cast("double")).join(rows.select(*by, "__x", F.least("adj", F.lit(1.0)).alias("p_adj")), [*by, "__x"], "left")
    return out.drop("__x")


def fivenum(df: DataFrame, by: str, col: str) -> DataFrame:
    """Minimum, lower hinge, median, upper hinge, maximum (Tukey's hinges)."""
    w = Window.partitionBy(by)
    rows = df.where(F.col(col).isNotNull()).select(by, F.col(col).alias("__x"), F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(w.orderBy(col)).alias("__i"))
    n4 = F.floor((F.col("n") + 3) / 2) / 2

    def at(d: Column) -> Column:
        lo, hi = F.floor(d), F.ceil(d)
        pick = lambda i: F.max(F.when(F.col("__i") == i, F.col("__x")))
        return (pick(lo) + pick(hi)) / 2

    n = F.col("n")
    return rows.groupBy(by).agg(F.min("__x").alias("min"), at(n4).alias("lower"), at((n + 1) / 2).alias("median"), at(n + 1 - n4).alias("upper"), F.max("__x").alias("max"))


def good_depth_samples(df: DataFrame, by: str, depth: str) -> DataFrame:
    """Five numbers of each sample's depths, where these are even, deep enough and without a long tail."""
    return fivenum(df, by, depth).where(good_depth(F.col("lower"), F.col("upper"), F.col("median"), F.col("max")))


@F.pandas_udf(DoubleType())
def kolmogorov(z: pd.Series) -> pd.Series:
    """Upper tail of the limiting distribution of the scaled two-sample statistic."""
    out = []
    for x in z.astype(float):
        k = np.arange(1, 101)
        if not np.isfinite(x):
            out.append(np.nan)
        elif x < 1:  # the series that converges for small values
            out.append(float(1 - np.sqrt(2 * np.pi) / x * np.exp(-((2 * k - 1) ** 2) * np.pi**2 / (8 * x * x)).sum()) if x > 0 else 1.0)
        else:
            out.append(float(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)).sum()))
    return pd.Series(out)


def ks2(df: DataFrame, value: str, label: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic between rows where ``label`` holds and the others, and its asymptotic p."""
    at, block = distinct_values(df, value, [], a=F.count_if(label), b=F.count_if(~label))
    total = at.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = scan(scan(at, [], "__x", block, "a", "ca"), [], "__x", block, "b", "cb").join(F.broadcast(total))  # one row
    out = run.agg(F.max("na").alias("n_a"), F.max("nb").alias("n_b"), F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"))
    return out.withColumn("p", kolmogorov(F.col("ks") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))))


def roc_points(df: DataFrame, score: str, label: Column) -> DataFrame:
    """(threshold, tpr, fpr) of calling everything at or above each distinct score."""
    at, block = distinct_values(df.where(label.isNotNull()), score, [], p=F.count_if(label), q=F.count_if(~label))
    total = at.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    run = scan(scan(at, [], "__x", block, "p", "cp", ahead=True), [], "__x", block, "q", "cq", ahead=True).join(F.broadcast(total))  # one row
    return run.select(F.col("__x").alias("threshold"), (F.col("cp") / F.nullif("tp", F.lit(0))).alias("tpr"), (F.col("cq") / F.nullif("tq", F.lit(0))).alias("fpr"))


def auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """Area under the ROC curve by average ranks: counts per distinct score, then running sums over them."""
    at, block = distinct_values(df.where(label.isNotNull()), score, [], p=F.count_if(label), q=F.count_if(~label))
    rows = scan(at, [], "__x", block, "q", "upto")
    s = rows.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("upto") - F.col("q") / 2)).alias("u"))
    return s.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a normal deviate, by a rational fit of the error function (error below 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = reduce(lambda acc, c: acc * t + c, reversed(fit), F.lit(0.0))
    return t * F.exp(-x * x + poly)


def mean_in_order(df: DataFrame, by: list[str], value: str, order: str, name: str) -> DataFrame:
    """(by, ``name``): each group's mean, its sum added up in the order of ``order`` (no row's twice), so that its last digit doesn't follow the tasks.

    A running sum over a sorted partition, which may spill; nulls take no part, and a group of nulls only has none.
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.where(F.col(value).isNotNull()).select(*by, F.sum(value).over(upto).alias("__s"), F.count(value).over(upto).alias("__n"))
    return sums.groupBy(*by).agg((F.max_by("__s", "__n") / F.max("__n")).alias(name))


def wilcoxon_signed_rank(df: DataFrame, diff: str) -> DataFrame:
    """Sums of the ranks of positive and of negative differences, zeros dropped, and the normal p with ties corrected."""
    rows = avg_rank(df.where(F.col(diff) != 0).withColumn("__a", F.abs(diff)), "__a")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(diff) > 0, F.col("rank")).otherwise(0)).alias("w_plus"), F.sum(F.when(F.col(diff) < 0, F.col("rank")).otherwise(0)).alias("w_minus"))
    ties = rows.groupBy("__a").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    centred = F.greatest(F.abs(F.col("w_plus") - n * (n + 1) / 4) - 0.5, F.lit(0.0))
    return out.join(F.broadcast(ties)).withColumn("p", F.when(sd > 0, normal_tail(centred / sd))).drop("ties")  # one row


@F.pandas_udf(DoubleType())
def beta_tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Regularised incomplete beta function, by its continued fraction from the last term on."""

    def one(x: float, a: float, b: float) -> float:
        if not np.isfinite(x) or x <= 0:
            return 0.0 if x <= 0 else np.nan
        if x >= 1:
            return 1.0
        if x > (a + 1) / (a + b + 2):
            return 1 - one(1 - x, b, a)
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        value = 1.0
        for i in range(200 + int(2 * np.sqrt(max(a, b))), 0, -1):
            m = i // 2
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            value = 1 + d / value
        return float(front / value)

    return pd.Series([one(*t) for t in zip(x.astype(float), a.astype(float), b.astype(float), strict=True)])


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return beta_tail((df / (df + t * t)).cast("double"), (df / 2).cast("double"), F.lit(0.5))


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of F."""
    return beta_tail((d2 / (d2 + d1 * f)).cast("double"), (d2 / 2).cast("double"), (d1 / 2).cast("double"))


@F.pandas_udf(DoubleType())
def chisq_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-square, by the series of the incomplete gamma function or its continued fraction."""

    def one(x: float, a: float) -> float:
        if x <= 0:
            return 1.0
        front = np.exp(a * np.log(x) - x - lgamma(a))
        if x < a + 1:
            total, term, k = 1 / a, 1 / a, a
            while term > total * 1e-16:
                k += 1
                term *= x / k
                total += term
            return float(1 - front * total)
        value = 0.0
        for i in range(300, 0, -1):
            value = i * (i - a) / (x + 2 * i + 1 - a - value)
        return float(front / (x + 1 - a - value))

    return pd.Series([np.nan if not np.isfinite(v) else one(v / 2, d / 2) for v, d in zip(x.astype(float), df.astype(float), strict=True)])


def paired_t(df: DataFrame, diff: str, *by: str) -> DataFrame:
    """Mean difference, t and its two-sided p."""
    out = df.groupBy(*by).agg(F.count(diff).alias("n"), F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sd"))
    out = out.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt("n")))
    return out.withColumn("p", F.when(F.col("t").isNotNull(), t_tail(F.coalesce("t", F.lit(0.0)), F.greatest(F.col("n") - 1, F.lit(1)))))


def g_test(df: DataFrame, row: str, col: str) -> DataFrame:
    """Log-likelihood ratio of independence of two columns, degrees of freedom and p."""
    cells = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    r, c = cells.groupBy(row).agg(F.sum("n").alias("r")), cells.groupBy(col).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("m"))
    size = r.agg(F.count(F.lit(1)).alias("nr")).join(F.broadcast(c.agg(F.count(F.lit(1)).alias("nc"))))  # one row each
    out = cells.join(r, row).join(c, col).join(F.broadcast(total)).agg(F.sum(2 * F.col("n") * F.log(F.col("n") * F.col("m") / (F.col("r") * F.col("c")))).alias("g"), F.max("m").alias("n"))
    out = out.join(F.broadcast(size)).withColumn("df", (F.col("nr") - 1) * (F.col("nc") - 1)).drop("nr", "nc")
    return out.withColumn("p", chisq_tail(F.col("g"), F.col("df").cast("double")))


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column]:
    """(z, two-sided p) of equal shares, pooled."""
    p = (x1 + x2) / (n1 + n2)
    z = (x1 / n1 - x2 / n2) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return z, normal_tail(z)


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b of two numeric columns, with its concordant, discordant and tied pairs, by merge counts.

    Two rows with different x part at exactly one bit of the ranks of x. So for each bit, rows that agree on the bits above
    are one group, and a running sum over y counts those with a zero before each with a one. A row is copied once for
    each bit, whatever the number of distinct values; groups run in blocks of y. Nulls are left out.
    """
    cells = keep(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    values = keep(cells.groupBy("x").agg(F.lit(1).alias("one")))
    bits = max(values.count() - 1, 1).bit_length()
    ranked = cells.join(scan(values, [], "x", value_blocks(values, "x"), "one", "rank").withColumn("rank", F.col("rank") - 1), "x")
    split = ranked.select("y", "n", "rank", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    split = split.select("y", "n", "bit", F.expr("shiftright(rank, bit + 1)").alias("above"), F.expr("shiftright(rank, bit) & 1").alias("own"))
    sides = split.groupBy("bit", "above", "y").agg(F.sum(F.when(F.col("own") == 0, F.col("n")).otherwise(0.0)).alias("zeros"), F.sum(F.when(F.col("own") == 1, F.col("n")).otherwise(0.0)).alias("ones"))
    upto = scan(sides, ["bit", "above"], "y", value_blocks(cells, "y"), "zeros", "upto")
    s = upto.agg(F.sum(F.col("ones") * (F.col("upto") - F.col("zeros"))).alias("concordant"), F.sum(F.col("ones") * F.col("upto")).alias("not_discordant"))
    tied = lambda c: cells.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"ties_{c}"))
    n = cells.agg(F.sum("n").alias("n"))
    pairs_n = F.col("n") * (F.col("n") - 1) / 2
    out = s.join(F.broadcast(tied("x"))).join(F.broadcast(tied("y"))).join(F.broadcast(n))  # one row each
    out = out.withColumn("discordant", pairs_n - F.col("ties_x") - F.col("not_discordant")).drop("not_discordant")
    return out.withColumn("tau", (F.col("concordant") - F.col("discordant")) / F.sqrt(F.nullif((pairs_n - F.col("ties_x")) * (pairs_n - F.col("ties_y")), F.lit(0.0))))


def slope_interaction(df: DataFrame, y: str, x: str, by: str) -> DataFrame:
    """F test of different slopes in each group against one slope and a level for each group, from sums of squares."""
    g = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    s = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("sxx").alias("sxx"), F.sum("sxy").alias("sxy"), F.sum("syy").alias("syy"), F.sum(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")).alias("rss_full"))
    s = s.withColumn("rss", F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    d1, d2 = F.col("k") - 1, F.col("n") - 2 * F.col("k")
    s = s.withColumns({"df1": d1, "df2": d2, "f": (F.col("rss") - F.col("rss_full")) / d1 / (F.col("rss_full") / d2)})
    return s.select("df1", "df2", "f", f_tail(F.col("f"), F.col("df1"), F.col("df2")).alias("p"))


def score_logit(df: DataFrame, case: str, score: str, least: int = 40) -> DataFrame:
    """Log odds of case status by score, with standard error and Wald p, where there are ``least`` cases and as many others.

    Newton steps whose sums are aggregates over the rows; two numbers go to the driver each time. Where scores part the
    cases from the others there is no finite estimate: beta, se, z and p are null.
    """
    rows = df.where(F.col(case).isNotNull() & F.col(score).isNotNull()).select(F.col(case).cast("double").alias("y"), F.col(score).cast("double").alias("x"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("cases"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")).first()
    schema = "n long, cases long, beta double, se double, z double"
    if not n["n"] or n["cases"] < least or n["n"] - n["cases"] < least or not n["sd"]:
        return df.sparkSession.createDataFrame([], schema).withColumn("p", F.lit(None).cast("double"))
    ends = rows.agg(*[f(F.when(F.col("y") == y, F.col("x"))) for y in (0.0, 1.0) for f in (F.min, F.max)]).first()
    if ends[1] <= ends[2] or ends[3] <= ends[0]:  # all others at or below all cases, or the other way
        return df.sparkSession.createDataFrame([(n["n"], int(n["cases"]), None, None, None)], schema).withColumn("p", F.lit(None).cast("double"))
    u = (F.col("x") - n["m"]) / n["sd"]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + F.exp(-(F.lit(float(w[0])) + F.lit(float(w[1])) * u)))
        r, v = F.col("y") - p, p * (1 - p)
        t = rows.agg(F.sum(r).alias("g0"), F.sum(r * u).alias("g1"), F.sum(v).alias("h00"), F.sum(v * u).alias("h01"), F.sum(v * u * u).alias("h11")).first()
        h = np.array([[t["h00"], t["h01"]], [t["h01"], t["h11"]]])
        step = np.linalg.solve(h, [t["g0"], t["g1"]])
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    beta, se = float(w[1] / n["sd"]), float(np.linalg.inv(h)[1, 1] ** 0.5 / n["sd"])
    out = df.sparkSession.createDataFrame([(n["n"], int(n["cases"]), beta, se, beta / se)], schema)
    return out.withColumn("p", normal_tail(F.col("z")))


def robust_scale(df: DataFrame, col: str, by: str) -> DataFrame:
    """Adds ``scaled``: distance from the group's median in units of 1.4826 median absolute deviations."""
    m = df.groupBy(by).agg(F.percentile(col, F.lit(0.5)).alias("__m"))
    rows = df.join(m, by).withColumn("__d", F.abs(F.col(col) - F.col("__m")))
    mad = rows.groupBy(by).agg(F.percentile("__d", F.lit(0.5)).alias("__s"))
    return rows.join(mad, by).withColumn("scaled", F.when(F.col("__s") > 0, (F.col(col) - F.col("__m")) / (1.4826 * F.col("__s")))).drop("__m", "__d", "__s")


def z_scale(df: DataFrame, col: str, by: str) -> DataFrame:
    """Adds ``scaled``: distance from the group's mean in standard deviations."""
    m = df.groupBy(by).agg(F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s"))
    return df.join(m, by).withColumn("scaled", F.when(F.col("__s") > 0, (F.col(col) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def trend(df: DataFrame, y: str, x: str, by: str) -> DataFrame:
    """Least-squares slope, intercept and r2 of each group."""
    return df.groupBy(by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def boot_interval(reps: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return reps.groupBy(*by).agg(F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"), F.avg(value).alias("mean"))


def shortest_interval(reps: DataFrame, by: str, value: str, level: float = 0.95) -> DataFrame:
    """Highest-density interval: the shortest that holds ``level`` of the replicates."""
    w = Window.partitionBy(by)
    rows = reps.select(by, F.col(value).alias("low"), F.row_number().over(w.orderBy(value)).alias("__i"), F.count(F.lit(1)).over(w).alias("__n"))
    held = F.ceil(F.col("__n") * F.lit(level)).cast("int") - 1
    pairs = rows.withColumn("__j", F.col("__i") + held)
    ends = rows.select(by, F.col("low").alias("high"), F.col("__i").alias("__j"))
    out = pairs.join(ends, [by, "__j"]).withColumn("width", F.col("high") - F.col("low"))
    return out.groupBy(by).agg(F.min_by(F.struct("low", "high"), F.struct("width", "low")).alias("x")).select(by, "x.low", "x.high")


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    g = np.vectorize(lgamma, otypes=[float])
    return g(n + 1.0) - g(k + 1.0) - g(n - k + 1.0)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    if k >= n or p <= 0:
        return 1.0 if k >= 0 else 0.0
    if k < 0:
        return 0.0
    if p >= 1:
        return 0.0
    i = np.arange(k + 1)
    return float(min(1.0, np.exp(log_choose(np.full(k + 1, n), i) + i * np.log(p) + (n - i) * np.log1p(-p)).sum()))


def binomial_test(k: int, n: int, p: float = 0.5) -> float:
    """Exact two-sided p: outcomes no likelier than the one seen."""
    if n == 0:
        return 1.0
    i = np.arange(n + 1)
    w = np.exp(log_choose(np.full(n + 1, n), i) + i * np.log(p) + (n - i) * np.log1p(-p))
    return float(min(1.0, w[w <= w[k] * (1 + 1e-7)].sum()))


@F.pandas_udf(DoubleType())
def binom_test(k: pd.Series, n: pd.Series) -> pd.Series:
    seen: dict[tuple[int, int], float] = {}
    out = []
    for pair in zip(k.tolist(), n.tolist(), strict=True):
        if pair not in seen:
            seen[pair] = binomial_test(int(pair[0]), int(pair[1]))
        out.append(seen[pair])
    return pd.Series(out)


def hardy_weinberg(aa: int, ab: int, bb: int, mid: bool = False) -> float:
    """Exact test over numbers of heterozygotes with the same allele counts."""
    n, rare = aa + ab + bb, 2 * min(aa, bb) + ab
    if n == 0:
        return 1.0
    het = np.arange(rare % 2, rare + 1, 2)
    g = np.vectorize(lgamma, otypes=[float])
    r, c = (rare - het) // 2, n - het - (rare - het) // 2
    w = het * np.log(2.0) - g(r + 1.0) - g(het + 1.0) - g(c + 1.0)
    w = np.exp(w - w.max())
    w /= w.sum()
    own = w[het == ab][0]
    p = w[w <= own * (1 + 1e-9)].sum()
    return float(min(1.0, p - (own / 2 if mid else 0)))


def _hwe(mid: bool):
    @F.pandas_udf(DoubleType())
    def p(aa: pd.Series, ab: pd.Series, bb: pd.Series) -> pd.Series:
        seen: dict[tuple[int, int, int], float] = {}
        out = []
        for t in zip(aa.astype(int), ab.astype(int), bb.astype(int), strict=True):
            if t not in seen:
                seen[t] = hardy_weinberg(*t, mid)
            out.append(seen[t])
        return pd.Series(out)

    return p


hwe_exact, hwe_mid = _hwe(False), _hwe(True)


def with_hwe(df: DataFrame, mid: bool = False, counts: tuple[str, str, str] = ("n_hom_ref", "n_het", "n_hom_var")) -> DataFrame:
    """Adds ``hwe_p``, computed once for each triple of counts that occurs."""
    p = df.select(*counts).distinct().withColumn("hwe_p", (hwe_mid if mid else hwe_exact)(*counts))
    return df.join(p, list(counts))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table."""
    row, col, n = a + b, a + c, a + b + c + d
    x = np.arange(max(0, col - (n - row)), min(row, col) + 1)
    w = log_choose(np.full(len(x), row), x) + log_choose(np.full(len(x), n - row), col - x)
    w = np.exp(w - w.max())
    w /= w.sum()
    return float(min(1.0, w[w <= w[x == a][0] * (1 + 1e-7)].sum()))


@F.pandas_udf(DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)])
