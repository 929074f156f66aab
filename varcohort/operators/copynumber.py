"""Subclonal copy number: windows merged by a two-sample test, likelihoods over copies and cell share, a model by BIC.

Windows of a sample's contig carry counts of their values on a fixed grain, which add up when windows merge. In a round
every pair of neighbours that is likelier to be one than the pairs on both its sides merges, in all samples at once, so
the rounds grow as the logarithm of the windows. Likelihoods are summed over chunks of loci for whole lists of
candidate cell shares, and the list is narrowed around each local maximum; samples share every job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocked import scan
from .series import merge_segments
from .shared import keep

GRAIN = 64  # cells of a window's table for each unit of log depth
EMPTY = -(1 << 30)
TABLE = T.StructType([T.StructField("cell", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType()))])


def kolmogorov(x: np.ndarray) -> np.ndarray:
    """Upper tail of the Kolmogorov distribution, by the series that converges faster at each value."""
    x = np.asarray(x, dtype=float)
    k = np.arange(1, 40)[:, None]
    far = 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k**2 * x**2)).sum(0)
    near = 1 - np.sqrt(2 * np.pi) / np.maximum(x, 1e-3) * np.exp(-((2 * k - 1) ** 2) * np.pi**2 / (8 * np.maximum(x, 1e-3) ** 2)).sum(0)
    return np.clip(np.where(x < 1, near, far), 0.0, 1.0)


def tables_differ(cells_a: np.ndarray, n_a: np.ndarray, cells_b: np.ndarray, n_b: np.ndarray) -> float:
    """p of the two-sample Kolmogorov-Smirnov test of two tables of counts, by the limiting distribution."""
    cells, at = np.unique(np.concatenate([cells_a, cells_b]), return_inverse=True)
    a = np.bincount(at[: len(cells_a)], weights=n_a, minlength=len(cells)).cumsum()
    b = np.bincount(at[len(cells_a) :], weights=n_b, minlength=len(cells)).cumsum()
    d = np.abs(a / a[-1] - b / b[-1]).max()
    return float(kolmogorov(np.array([d * np.sqrt(a[-1] * b[-1] / (a[-1] + b[-1]))]))[0])


@F.pandas_udf(T.DoubleType())
def difference(a: pd.DataFrame, b: pd.DataFrame, wanted: pd.Series) -> pd.Series:
    return pd.Series([tables_differ(ca, na, cb, nb) if w else None for ca, na, cb, nb, w in zip(a["cell"], a["n"], b["cell"], b["n"], wanted)], dtype=float)


@F.pandas_udf(TABLE)
def joined(a: pd.DataFrame, b: pd.DataFrame, wanted: pd.Series) -> pd.DataFrame:
    out = []
    for ca, na, cb, nb, w in zip(a["cell"], a["n"], b["cell"], b["n"], wanted):
        if w:
            cells, at = np.unique(np.concatenate([ca, cb]), return_inverse=True)
            ca, na = cells, np.bincount(at, weights=np.concatenate([na, nb]), minlength=len(cells)).astype(np.int64)
        out.append((ca, na))
    return pd.DataFrame(out, columns=["cell", "n"])


def first_windows(rows: DataFrame, sample: str, size: int) -> DataFrame:
    """Adds ``window``: a sample's loci in the order of its contigs and positions, ``size`` at a time, parted at contigs."""
    ranked = scan(rows.withColumn("__one", F.lit(1)), [sample, "contig"], "pos", F.floor(F.col("pos") / (1 << 20)), "__one", "__rank")
    sizes = rows.groupBy(sample, "contig").agg(F.count(F.lit(1)).alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(sample).orderBy("contig").rowsBetween(Window.unboundedPreceding, -1))  # a row a contig
    at = F.col("__rank") + F.coalesce("__o", F.lit(0))
    return ranked.join(sizes.select(sample, "contig", before.alias("__o")), [sample, "contig"]).withColumn("window", F.floor(at / size).cast("long")).drop("__one", "__rank", "__o")


def merge_windows(rows: DataFrame, sample: str = "s", size: int = 100, alpha: float = 0.01) -> DataFrame:
    """(sample, contig, first, last, n_values, p_next, n_tests): windows of ``first_windows`` merged while neighbours don't differ.

    ``rows`` is (sample, contig, window, dp, ad, lambda); a window's values are log(reads / lambda) of both alleles, on a
    grain of 1/64, those without reads in a cell of their own. A pair merges while p times the tests made so far in its
    sample is at least ``alpha`` and p is a local maximum, equal ones in an order drawn by hash; at the end no pair is
    left that should. Unlike a strictly greedy order, several pairs of a sample merge before any is tested anew.
    """
    reads = F.explode(F.array(F.col("dp") - F.col("ad"), F.col("ad")))
    cell = F.when(F.col("reads") > 0, F.floor(F.log(F.col("reads") / F.col("lambda")) * GRAIN)).otherwise(EMPTY).cast("int")
    counts = rows.select(sample, "contig", "window", "lambda", reads.alias("reads")).groupBy(sample, "contig", "window", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    tables = counts.groupBy(sample, "contig", F.col("window").alias("first")).agg(F.struct(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n")).alias("table"))
    state = keep(tables.select("*", F.col("first").alias("last"), F.lit(None).cast("double").alias("p"), F.lit(0).cast("long").alias("tests"), F.lit(True).alias("merged")))
    chain = Window.partitionBy(sample, "contig").orderBy("first")
    rest = state
    while True:
        known = rest.withColumn("__next", F.lead("table").over(chain)).withColumn("__untested", F.col("p").isNull() & F.col("__next").isNotNull())
        tested = known.withColumn("p", F.when(F.col("__untested"), difference("table", F.coalesce("__next", "table"), "__untested")).otherwise(F.col("p")))
        tested = keep(tested)
        made = tested.groupBy(sample).agg((F.max("tests") + F.count_if("__untested")).alias("__made"))
        rank = F.when(F.col("p").isNotNull(), F.struct("p", F.xxhash64(sample, "contig", "first").alias("draw"), "first"))
        ranked = tested.drop("tests").join(made, sample).withColumn("__rank", rank)
        above = lambda side: F.coalesce(F.col("__rank") > side("__rank").over(chain), F.lit(True))
        take = F.col("p").isNotNull() & (F.col("p") * F.col("__made") >= alpha) & above(F.lag) & above(F.lead)
        taken = ranked.withColumn("__take", take)
        taken = taken.withColumn("__gone", F.coalesce(F.lag("__take").over(chain), F.lit(False))).withColumn("__before", F.coalesce(F.lead("__take").over(chain), F.lit(False))).withColumn("__end", F.lead("last").over(chain))
        left = taken.where("NOT __gone").select(
            sample, "contig", "first", F.when(F.col("__take"), F.col("__end")).otherwise(F.col("last")).alias("last"),
            joined("table", F.coalesce("__next", "table"), "__take").alias("table"),
            F.when(~F.col("__take") & ~F.col("__before"), F.col("p")).alias("p"), F.col("__made").alias("tests"), F.col("__take").alias("merged"),
        )
        rest = keep(left)
        if not rest.where("merged").take(1):
            n = F.aggregate("table.n", F.lit(0).cast("long"), lambda x, y: x + y)
            return rest.select(sample, "contig", "first", "last", n.alias("n_values"), F.col("p").alias("p_next"), F.col("tests").alias("n_tests"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 7.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + i) for i in range(7))


def pairs(most: int, least: int = 0) -> list[tuple[int, int]]:
    """Copies (k1, k2) of both alleles, k1 >= k2, as ``k2`` then ``k1`` count up."""
    return [(k1, k2) for k2 in range(least, most + 1) for k1 in range(k2, most + 1)]


def window_likelihoods(d1: np.ndarray, d2: np.ndarray, mu: np.ndarray, starts: np.ndarray, points: list[tuple[float, float]], copies: list[tuple[int, int]]) -> np.ndarray:
    """(windows x points x copies), summed over each window's loci: reads of both alleles, whichever is which, where a share f of cells has k1 and k2 copies.

    Windows begin at ``starts``. A point is (f, isize): Poisson, or negative binomial of size 1 / (2 isize) an allele where
    ``isize`` > 0. Poisson likelihoods need a window's sums and how often each difference of reads occurs, and are one product of matrices.
    """
    out, own = np.zeros((len(starts), len(points), len(copies))), {}
    total = lambda x: np.add.reduceat(x, starts)
    sizes = np.diff(np.append(starts, len(mu)))
    f, isize, (k1, k2) = np.array([p[0] for p in points])[:, None], np.array([p[1] for p in points]), np.array(copies).T
    plain = np.flatnonzero(isize <= 0)
    if len(plain):
        a, b = ((k * f[plain] + 1 - f[plain]) / 2 for k in (k1, k2))
        apart, at = np.unique(np.abs(d1 - d2), return_inverse=True)
        n = np.bincount(np.repeat(np.arange(len(starts)), sizes) * len(apart) + at, minlength=len(starts) * len(apart)).reshape(len(starts), -1)
        far = np.abs(np.log(a) - np.log(b)).ravel()[:, None] * apart
        mixed = (n @ (far / 2 + np.log1p(np.exp(-far))).T).reshape(len(starts), *a.shape)
        known = total((d1 + d2) * np.log(mu) - log_gamma(d1 + 1.0) - log_gamma(d2 + 1.0)) - sizes * np.log(2)
        out[:, plain] = mixed + known[:, None, None] + total(d1 + d2)[:, None, None] * (np.log(a) + np.log(b)) / 2 - total(mu)[:, None, None] * (a + b)
    for i in np.flatnonzero(isize > 0):
        size = 0.5 / isize[i]
        if isize[i] not in own:
            own[isize[i]] = total(log_gamma(d1 + size) + log_gamma(d2 + size) - log_gamma(d1 + 1.0) - log_gamma(d2 + 1.0)) - 2 * sizes * float(log_gamma(np.array([size]))[0])
        for j, ks in enumerate(copies):
            a, b = ((k * f[i, 0] + 1 - f[i, 0]) / 2 for k in ks)
            pa, pb = np.log(a * mu / (size + a * mu)), np.log(b * mu / (size + b * mu))
            rest = size * (np.log(size / (size + a * mu)) + np.log(size / (size + b * mu)))
            out[:, i, j] = own[isize[i]] + total(rest + np.logaddexp(d1 * pa + d2 * pb, d1 * pb + d2 * pa) - np.log(2))
    return out


def log_likelihood(d1: np.ndarray, d2: np.ndarray, mu: np.ndarray, k1: int, k2: int, f: float, isize: float) -> float:
    return float(window_likelihoods(d1, d2, mu, np.array([0]), [(f, isize)], [(k1, k2)])[0, 0, 0])


def chunks(rows: DataFrame, sample: str, tasks: int, size: int = 4096) -> DataFrame:
    """(sample, part, window array of (contig, first, start), d1, d2, mu): loci of a sample's merged windows (``first``) as arrays, window by window, in parts of about ``size``; a window lies in one part."""
    windows = rows.groupBy(sample, "contig", "first").agg(F.collect_list(F.struct((F.col("dp") - F.col("ad")).cast("double").alias("d1"), F.col("ad").cast("double").alias("d2"), F.col("lambda").cast("double").alias("mu"))).alias("x"), F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.sum("n").over(Window.partitionBy(sample)) / size)
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("contig", "first"), parts)).groupBy(sample, "part").agg(F.array_sort(F.collect_list(F.struct("contig", "first", "n", "x"))).alias("w"))
    flat = dealt.select(sample, "part", "w", F.flatten("w.x").alias("x"))
    start = lambda i: F.aggregate(F.slice("w.n", F.lit(1), i), F.lit(0).cast("long"), lambda a, n: a + n)
    window = F.transform("w", lambda w, i: F.struct(w["contig"].alias("contig"), w["first"].alias("first"), start(i).alias("start")))
    return flat.select(sample, "part", window.alias("window"), "x.d1", "x.d2", "x.mu").repartition(tasks, sample)


LIST = "maxk array<int>, mink array<int>, size array<int>, f array<double>, isize array<double>"


def models_of(maxk, mink, size, f, isize) -> list[tuple[int, int, list[tuple[float, float]]]]:
    """(most copies, least, points) of the models in a sample's lists."""
    ends = np.cumsum(size)
    return [(int(k), int(j), list(zip(f[e - n : e].tolist(), isize[e - n : e].tolist()))) for k, j, n, e in zip(maxk, mink, size, ends)]


def listed(models: list[tuple[int, int, list[tuple[float, float]]]]) -> tuple:
    points = [p for _, _, own in models for p in own]
    return [m[0] for m in models], [m[1] for m in models], [len(m[2]) for m in models], [float(p[0]) for p in points], [float(p[1]) for p in points]


def states(values: np.ndarray) -> np.ndarray:
    """The likeliest copies of each window at each point, the first of equal ones."""
    return np.round(values, 9).argmax(-1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def best_sums(d1: pd.Series, d2: pd.Series, mu: pd.Series, starts: pd.Series, maxk: pd.Series, mink: pd.Series, size: pd.Series, f: pd.Series, isize: pd.Series) -> pd.Series:
    """Log likelihood at each of a sample's candidates, summed over windows, each with its likeliest copies."""
    out = []
    for a, b, m, at, *lists in zip(d1, d2, mu, starts, maxk, mink, size, f, isize):
        sums = []
        for k, j, points in models_of(*lists):
            values = window_likelihoods(a, b, m, np.asarray(at), points, pairs(k, j))
            sums.append(np.take_along_axis(values, states(values)[..., None], -1).sum((0, 2)))
        out.append(np.concatenate(sums))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StructType([T.StructField("state", T.ArrayType(T.IntegerType())), T.StructField("ll", T.ArrayType(T.DoubleType()))]))
def best_states(d1: pd.Series, d2: pd.Series, mu: pd.Series, starts: pd.Series, maxk: pd.Series, mink: pd.Series, f: pd.Series, isize: pd.Series) -> pd.DataFrame:
    """Each window's likeliest copies, and their log likelihood, in a sample's chosen model."""
    out = []
    for a, b, m, at, k, j, share, disp in zip(d1, d2, mu, starts, maxk, mink, f, isize):
        values = window_likelihoods(a, b, m, np.asarray(at), [(share, disp)], pairs(int(k), int(j)))
        best = states(values)
        out.append((best[:, 0].astype(np.int32), np.take_along_axis(values, best[..., None], -1)[:, 0, 0]))
    return pd.DataFrame(out, columns=["state", "ll"])


def evaluate(loci: DataFrame, candidates: DataFrame, sample: str) -> DataFrame:
    """(sample, lists of candidates, ll array of arrays): a sample's candidates and the sums of each of its parts.

    ``candidates`` is a row a sample, with the models and points to try as short lists (``LIST``).
    """
    names = [c.split()[0] for c in LIST.split(", ")]
    rows = loci.join(candidates.hint("merge"), sample).select(sample, "part", *names, best_sums("d1", "d2", "mu", "window.start", *names).alias("ll"))
    out = rows.groupBy(sample).agg(*[F.first(c).alias(c) for c in names], F.array_sort(F.collect_list(F.struct("part", "ll"))).alias("__p"))
    return out.select(sample, *names, F.col("__p.ll").alias("ll"))


def first_shares(maxk: int) -> list[float]:
    """Cell shares from 0.05 to 0.99, ten for each copy, a little denser where they are low."""
    power = 0.05
    return (np.linspace(0.99**-power, 0.05**-power, maxk * 10)[::-1] ** (-1 / power)).tolist()


def narrowed(f: np.ndarray, isize: np.ndarray, ll: np.ndarray, family: str, width: int = 6) -> list[tuple[float, float]]:
    """Candidates between the neighbours of every local maximum of a sample's summed likelihoods."""
    order = np.lexsort((isize, f))
    f, isize, ll = f[order], isize[order], ll[order]
    starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    ends = np.r_[starts[1:], len(f)]
    at = np.array([a + ll[a:b].argmax() for a, b in zip(starts, ends)])
    top, out = ll[at], []
    for i in np.flatnonzero((top > np.r_[-np.inf, top[:-1]]) & (top >= np.r_[top[1:], -np.inf])):
        low, high = f[at[max(i - 1, 0)]], f[at[min(i + 1, len(at) - 1)]]
        shares = sorted({*np.linspace(low, high, width + 1).tolist(), float(f[at[i]])})
        if family == "poisson":
            sizes = [0.0]
        else:
            own = sorted(set(isize[starts[i] : ends[i]].tolist()))
            j = own.index(isize[at[i]])
            sizes = [1 / 1000, 1 / 500, 1 / 100, 1 / 20, 1 / 4, 1.0] if own == [0.0] else sorted({*np.geomspace(own[max(j - 1, 0)], own[min(j + 1, len(own) - 1)], 4).tolist(), own[j]})
        out += [(x, y) for x in shares for y in sizes]
    return sorted(set(out))


def fit_windows(rows: DataFrame, sample: str = "s", max_copies: int = 2, family: str = "poisson", rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(models (sample, maxk, f, isize, ll, p, bic, best), windows (sample, contig, first, k1, k2, f, isize, ll)) of loci in merged windows.

    ``rows`` is (sample, contig, first, pos, dp, ad, lambda). For each number of copies up to ``max_copies`` the cell
    share with the greatest likelihood is looked for on a list, then ``rounds`` times on finer ones between the
    neighbours of every local maximum, with the dispersion beside it for the negative binomial (``nb``); of maxima within
    one unit of likelihood the largest share is taken. The model has the least BIC, one copy of each allele among them.

    In a round a sample's lists meet its loci, and what moves is a number a candidate; the number of tasks follows the loci.
    """
    n = keep(rows.groupBy(sample).agg(F.count(F.lit(1)).alias("__n")))
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, (n.agg(F.sum("__n")).first()[0] or 0) >> 14)
    loci = keep(chunks(rows, sample, tasks))
    sizes = [0.0] if family == "poisson" else [1 / 1000, 1 / 500, 1 / 100, 1 / 20, 1 / 4, 1.0]
    first = listed([(k, 0, [(f, 0.0) for f in first_shares(k)]) for k in range(1, max_copies + 1)] + [(1, 1, [(0.0, s) for s in sizes])])
    names = [c.split()[0] for c in LIST.split(", ")]
    candidates = n.select(sample, *[F.array(*map(F.lit, x)).alias(c) for c, x in zip(names, first)])

    @F.pandas_udf(LIST)
    def narrow(maxk: pd.Series, mink: pd.Series, size: pd.Series, f: pd.Series, isize: pd.Series, ll: pd.Series) -> pd.DataFrame:
        out = []
        for *lists, parts in zip(maxk, mink, size, f, isize, ll):
            total, at, finer = np.sum(np.stack(parts), axis=0), 0, []
            for k, least, points in models_of(*lists):
                own, sums = np.array(points), total[at : at + len(points)]
                at += len(points)
                if least < 1:
                    finer.append((k, least, narrowed(own[:, 0], own[:, 1], sums, family)))
                elif family == "poisson":  # one copy of each: only the dispersion is looked for
                    finer.append((k, least, [(0.0, 0.0)]))
                else:
                    order = np.argsort(own[:, 1], kind="stable")
                    tried, i = own[order, 1], int(sums[order].argmax())
                    low, high = tried[max(i - 1, 0)], tried[min(i + 1, len(tried) - 1)]
                    finer.append((k, least, [(0.0, s) for s in sorted({*np.geomspace(low, high, 6).tolist(), float(tried[i])})]))
            out.append(listed(finer))
        return pd.DataFrame(out, columns=names)

    @F.pandas_udf("array<struct<maxk int, mink int, f double, isize double, ll double>>")
    def choose(maxk: pd.Series, mink: pd.Series, size: pd.Series, f: pd.Series, isize: pd.Series, ll: pd.Series) -> pd.Series:
        out = []
        for *lists, parts in zip(maxk, mink, size, f, isize, ll):
            total, at, found = np.sum(np.stack(parts), axis=0), 0, []
            for k, least, points in models_of(*lists):
                found.append({"maxk": k, "mink": least, **largest_share(np.array(points), total[at : at + len(points)])})
                at += len(points)
            out.append(found)
        return pd.Series(out, dtype=object)

    for _ in range(rounds):
        tried = evaluate(loci, candidates, sample)
        candidates = keep(tried.select(sample, narrow(*names, "ll").alias("x")).select(sample, "x.*"))
    # the last, finest list holds its own best point of every maximum
    chosen = evaluate(loci, candidates, sample).select(sample, F.inline(choose(*names, "ll")))
    free = F.when(F.col("mink") == 1, 0 if family == "poisson" else 1).otherwise(F.ceil(F.log2((F.col("maxk") + 1) * (F.col("maxk") + 2) / 2)) + (1 if family == "poisson" else 2)).cast("int")
    models = chosen.join(n, sample).withColumn("p", free).withColumn("bic", -2 * F.col("ll") + F.log("__n") * F.col("p")).drop("__n")
    order = Window.partitionBy(sample).orderBy("bic", "maxk", F.desc("mink"))
    models = keep(models.withColumn("best", F.row_number().over(order) == 1))
    final = models.where("best").select(sample, "maxk", "mink", "f", "isize")
    told = loci.join(final.hint("merge"), sample).withColumn("__b", best_states("d1", "d2", "mu", "window.start", "maxk", "mink", "f", "isize"))
    told = told.select(sample, "maxk", "mink", "f", "isize", F.inline(F.arrays_zip("window", F.col("__b.state").alias("state"), F.col("__b.ll").alias("ll"))))
    table = {(k, j): pairs(k, j) for k, j in [(1, 1)] + [(k, 0) for k in range(1, max_copies + 1)]}
    copies = F.create_map(*[x for (k, j), p in table.items() for x in (F.lit(f"{k}:{j}"), F.array(*[F.struct(F.lit(a).alias("k1"), F.lit(b).alias("k2")) for a, b in p]))])
    k = copies[F.concat_ws(":", "maxk", "mink")][F.col("state")]
    return models, told.select(sample, "window.contig", "window.first", k["k1"].alias("k1"), k["k2"].alias("k2"), "f", "isize", "ll")


def largest_share(points: np.ndarray, ll: np.ndarray) -> dict:
    """Of a list's points near the best, those around one maximum differ by little: the best of the group with the largest share."""
    near = np.flatnonzero(ll.max() - ll < 1)
    near = near[np.argsort(points[near, 0], kind="stable")]
    group = np.cumsum(np.diff(points[near, 0], prepend=points[near[0], 0]) > 0.02)
    last = near[group == group[-1]]
    at = last[ll[last].argmax()]
    return {"f": float(points[at, 0]), "isize": float(points[at, 1]), "ll": float(ll[at])}


def segment_copy_number(trace: DataFrame, sample: str = "s", size: int = 100, alpha: float = 0.01, max_copies: int = 2, family: str = "poisson", rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(segments (sample, contig, start, end, n, k1, k2, f, isize, ll), models) of het loci (sample, contig, pos, dp, ad, lambda).

    Windows are merged by ``merge_windows`` and fitted by ``fit_windows``; neighbours of one contig with equal copies are
    one segment. Positions are unique within a sample's contig; loci without a positive ``lambda`` drop out.
    """
    rows = keep(first_windows(trace.where(F.col("lambda") > 0).select(sample, "contig", "pos", "dp", "ad", "lambda"), sample, size))
    merged = merge_windows(rows, sample, size, alpha)
    of = merged.select(sample, "contig", "first", F.explode(F.sequence("first", "last")).alias("window"))
    placed = keep(rows.join(of, [sample, "contig", "window"]).drop("window"))
    models, windows = fit_windows(placed, sample, max_copies, family, rounds)
    ends = placed.groupBy(sample, "contig", "first").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"))
    whole = keep(windows.join(ends, [sample, "contig", "first"]).withColumn("__by", F.struct(sample, "contig")).withColumn("__state", F.struct("k1", "k2", "f", "isize")))
    runs = merge_segments(whole, "__by", "start", "__state", "ll").select("__by", F.col("first").alias("start"), F.col("last").alias("__last"), "__state", F.col("ll").alias("total"))
    sizes = whole.select("__by", F.col("start").alias("__start"), "end", "n", "__state")
    # a segment's end and size are those of its windows: the state alone doesn't tell segments apart, places do
    held = runs.join(sizes, ["__by", "__state"]).where(F.col("__start").between(F.col("start"), F.col("__last")))
    out = held.groupBy("__by", "start", "__state", "total").agg(F.max("end").alias("end"), F.sum("n").alias("n"))
    return out.select(F.col(f"__by.{sample}").alias(sample), "__by.contig", "start", "end", "n", "__state.k1", "__state.k2", "__state.f", "__state.isize", F.col("total").alias("ll")), models
