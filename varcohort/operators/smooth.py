"""Smooth effects: penalised splines fitted from normal equations, one fit a group, and permutation tests of them.

A term is a cubic B-spline over equal pieces of its range with a penalty on second differences. Blocks of rows give
partial normal equations, which add up; a group's fit then needs its sums only, the strength of the penalty included,
which generalised cross-validation picks from a grid (one strength for all terms of a fit).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocked import scan
from .shared import keep, keep_as_dealt, keep_dealt

GRID = tuple(10.0**e for e in range(-4, 6))


def spline(x: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, pieces: int) -> np.ndarray:
    """Values of the ``pieces`` + 3 cubic B-splines over ``low`` .. ``high``; beyond the ends, and with one value only, those at the end."""
    width = np.where(np.asarray(high) > low, np.asarray(high) - low, 1.0)
    return spline_at(np.clip((x - low) / width * pieces, 0, pieces), pieces)


def spline_at(u: np.ndarray, pieces: int) -> np.ndarray:
    """Values of the splines at places 0 .. ``pieces`` of their range."""
    j = np.minimum(u.astype(np.int64), pieces - 1)
    t = u - j
    rest, square = 1 - t, t * t
    out, at = np.zeros((len(u), pieces + 3)), np.arange(len(u)) * (pieces + 3) + j
    for k, w in enumerate((rest * rest * rest, (3 * t - 6) * square + 4, ((3 - 3 * t) * t + 3) * t + 1, square * t)):
        out.ravel()[at + k] = w / 6
    return out


def roughness(n_terms: int, pieces: int) -> np.ndarray:
    """Penalty matrix of an intercept and ``n_terms`` splines: squared second differences of each one's coefficients."""
    d = np.diff(np.eye(pieces + 3), 2, axis=0)
    size = 1 + n_terms * (pieces + 3)
    out = np.zeros((size, size))
    for i in range(n_terms):
        a = 1 + i * (pieces + 3)
        out[a : a + pieces + 3, a : a + pieces + 3] = d.T @ d
    return out


def penalised(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, penalty: np.ndarray, grid: tuple[float, ...] = GRID) -> tuple[np.ndarray, float, float, float]:
    """(coefficients, residual sum of squares, strength, degrees of freedom) with the least generalised cross-validation score."""
    beta, rss, strength, df = penalised_many(xx[None], xy[None], np.array([yy]), np.array([n]), penalty, grid)
    return beta[0], float(rss[0]), float(strength[0]), float(df[0])


def penalised_many(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, n: np.ndarray, penalty: np.ndarray, grid: tuple[float, ...] = GRID) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``penalised`` of many fits at once, whose sums are stacked.

    The intercept and each spline's constant are told apart by a ridge of 1e-9 of the mean diagonal.
    """
    size = xx.shape[1]
    ridge = 1e-9 * np.maximum(np.trace(xx, axis1=1, axis2=2) / size, 1e-300)[:, None, None] * np.eye(size)
    sides = np.concatenate([xy[:, :, None], xx], axis=2)
    best = None
    for strength in grid:
        solved = np.linalg.solve(xx + strength * penalty + ridge, sides)
        beta, df = solved[:, :, 0], np.trace(solved[:, :, 1:], axis1=1, axis2=2)
        rss = np.maximum(yy - 2 * (beta * xy).sum(1) + ((beta[:, None] @ xx)[:, 0] * beta).sum(1), 0.0)
        score = n * rss / np.maximum(n - df, 1e-9) ** 2
        new = (score, beta, rss, np.full(len(n), strength), df)
        if best is None:
            best = new
        else:
            less = score < best[0]
            best = tuple(np.where(less[:, None] if a.ndim == 2 else less, a, b) for a, b in zip(new, best))
    return best[1:]


def design(rows: pd.DataFrame, terms: list[str], pieces: int) -> np.ndarray:
    """Intercept and splines of each row; the ends of a term's range are in ``<term>_low`` and ``<term>_high``."""
    parts = [spline(rows[t].to_numpy(float), rows[f"{t}_low"].to_numpy(float), rows[f"{t}_high"].to_numpy(float), pieces) for t in terms]
    return np.column_stack([np.ones(len(rows)), *parts])


def ends(rows: DataFrame, by: str, terms: list[str]) -> DataFrame:
    """Each group's number of rows, and the ends of its terms' ranges."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), *[f(t).alias(f"{t}_{end}") for t in terms for f, end in ((F.min, "low"), (F.max, "high"))])


def place(term: str, pieces: int) -> Column:
    """A value's place, 0 .. ``pieces``, in its term's range (``ends``)."""
    low, high = F.col(f"{term}_low"), F.col(f"{term}_high")
    width = F.when(high > low, high - low).otherwise(1.0)
    return F.greatest(F.least((F.col(term) - low) / width * pieces, F.lit(float(pieces))), F.lit(0.0))


def totals(rows: Iterable[tuple[object, np.ndarray]], by: str, size: int = 256) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Sums of the arrays of neighbours with the same key, ``size`` keys at a time: (keys, sums in rows)."""
    sums = ((k, reduce(np.add, (x for _, x in own))) for k, own in groupby(rows, key=lambda r: r[0]))
    while some := list(islice(sums, size)):
        yield pd.Series([k for k, _ in some], name=by), np.stack([x for _, x in some])


def smooth_fit(rows: DataFrame, by: str, key: str, y: str, terms: list[str], pieces: int = 8, block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(fits (by, n, beta, rss, strength, df), rows with ``fitted``): a penalised additive fit of ``y`` for each group.

    Rows lie by group or, where some group has more than ``block``, are dealt by hash blocks of ``key`` of about that many
    too; a block hands on one matrix, and a group's fit needs as many matrices as it has blocks. Batches hold the rows, or the fits, of many groups.
    """
    kind, wide = dict(rows.dtypes)[by], pieces + 3
    size = 1 + len(terms) * wide
    upper = np.triu_indices(size + 1)  # the target is the last column, and the intercept's square the number of rows
    known = keep(ends(rows, by, terms))  # a row a group
    placed = rows.join(known.hint("merge"), by).withColumns({f"__u{i}": place(t, pieces) for i, t in enumerate(terms)})
    at = [f"__u{i}" for i in range(len(terms))]

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray]]:
        for part in batches:
            if len(part):
                x = np.column_stack([np.ones(len(part)), *[spline_at(part[u].to_numpy(float), pieces) for u in at], part[y].to_numpy(float)])
                keys = part[by].to_numpy()
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(part)]
                yield from ((keys[a], (x[a:b].T @ x[a:b])[upper]) for a, b in zip(cuts, cuts[1:]))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, total in totals(squares(batches), by):
            yield pd.DataFrame({by: keys, "sums": list(total)})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, total in totals((r for part in batches for r in zip(part[by], part["sums"])), by):
            xx = np.zeros((len(keys), size + 1, size + 1))
            xx[:, upper[0], upper[1]] = xx[:, upper[1], upper[0]] = total
            n = np.round(xx[:, 0, 0]).astype(int)
            beta, rss, strength, df = penalised_many(xx[:, :-1, :-1], xx[:, :-1, -1], xx[:, -1, -1], n, roughness(len(terms), pieces))
            yield pd.DataFrame({by: keys, "n": n, "beta": list(beta), "rss": rss, "strength": strength, "df": df})

    if (known.agg(F.max("__n")).first()[0] or 0) <= block:  # the join by group has brought a group's rows together
        blocks = placed.select(by, y, *at).sortWithinPartitions(by)
    else:
        blocks = placed.select(by, y, *at, F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / block)).alias("__block"))
        blocks = blocks.repartition(by, "__block").sortWithinPartitions(by).drop("__block")
    parts = blocks.mapInPandas(sums, f"{by} {kind}, sums array<double>").repartition(by).sortWithinPartitions(by)
    fits = keep(parts.mapInPandas(solve, f"{by} {kind}, n long, beta array<double>, rss double, strength double, df double"))

    def curve(i: int) -> Column:
        """A term's part of the fit: four splines reach a place."""
        j = F.least(F.floor(at[i]), F.lit(pieces - 1))
        t = F.col(at[i]) - j
        weights = ((1 - t) * (1 - t) * (1 - t), 3 * t * t * t - 6 * t * t + 4, -3 * t * t * t + 3 * t * t + 3 * t + 1, t * t * t)
        return sum((w / 6 * F.get("beta", (j + (1 + i * wide + k)).cast("int")) for k, w in enumerate(weights)), F.lit(0.0))

    out = placed.join(fits.select(by, "beta").hint("merge"), by).withColumn("fitted", sum((curve(i) for i in range(len(terms))), F.get("beta", F.lit(0))))
    return fits, out.select(*rows.columns, "fitted")


def components(rows: DataFrame, by: str, columns: list[str], **also: Column) -> DataFrame:
    """Adds ``pc1`` ..: each group's principal components of centred and scaled columns, from its correlation matrix; and the group's aggregates ``also``.

    The largest entry of a component's loadings is positive; a constant column has no weight.
    """
    m, pairs = len(columns), [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    facts = rows.groupBy(by).agg(
        F.array(*[F.avg(c) for c in columns]).alias("__mean"), F.array(*[F.stddev_samp(c) for c in columns]).alias("__sd"), F.array(*[F.corr(a, b) for a, b in pairs]).alias("__corr"), *[x.alias(n) for n, x in also.items()]
    )

    @F.pandas_udf("array<double>")
    def rotate(sd: pd.Series, corr: pd.Series) -> pd.Series:
        if not len(sd):
            return pd.Series([], dtype=object)
        c, s = np.tile(np.eye(m), (len(sd), 1, 1)), np.stack(sd).astype(float)
        above = np.triu_indices(m, 1)
        c[:, above[0], above[1]] = c[:, above[1], above[0]] = np.nan_to_num(np.stack(corr).astype(float).reshape(len(sd), -1))
        vectors = np.linalg.eigh(c)[1][:, :, ::-1]
        vectors = vectors * np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1))
        turned = vectors.transpose(0, 2, 1) * np.where(s > 0, 1 / np.where(s > 0, s, 1), 0.0)[:, None]
        return pd.Series(list(turned.reshape(len(sd), -1)))

    turned = keep(facts.select(by, "__mean", rotate("__sd", "__corr").alias("__turn"), *also))  # a row a group
    score = lambda i: sum(((F.col(c) - F.col("__mean")[j]) * F.col("__turn")[i * m + j] for j, c in enumerate(columns)), F.lit(0.0))
    return rows.join(turned.hint("merge"), by).select(*rows.columns, *also, *[score(i).alias(f"pc{i + 1}") for i in range(m)])


def depth_anomaly(trace: DataFrame, affinity: DataFrame, gc: DataFrame, columns: list[str], sample: str = "s", key: str = "v", pieces: int = 8) -> tuple[DataFrame, DataFrame]:
    """(fits, trace with ``lambda``): the depth expected of two copies, by what each sample's depth owes to affinity and GC.

    log(depth) less the sample's log mean and the locus's log affinity is fitted by splines over log affinity and over
    the sample's principal components of the GC windows in ``columns``; the fit is turned back and scaled so that depth
    over expected depth has a mean of one in each sample. Loci without depth, affinity or GC drop out.
    """
    loci = affinity.where("affinity > 0").select(key, "affinity").join(gc.select(key, *columns), key).na.drop(subset=columns)
    rows = trace.where("dp > 0").join(loci, key)
    rows = keep_dealt(rows, sample, trace.count() >> 18)  # a sample's rows meet here, once
    rows = components(rows, sample, columns, __depth=F.avg("dp"))
    terms = ["log_a", *[f"pc{i + 1}" for i in range(len(columns))]]
    # not written: the columns derived here are wider than those they come from
    rows = rows.withColumn("log_a", F.log("affinity")).withColumn("__y", F.log("dp") - F.log("__depth") - F.col("log_a")).drop("affinity", *columns)
    fits, out = smooth_fit(rows, sample, key, "__y", terms, pieces)
    out = keep_as_dealt(out.select(*trace.columns, F.exp(F.log("__depth") + F.col("log_a") + F.col("fitted")).alias("__raw")))
    bias = out.groupBy(sample).agg(F.avg(F.col("dp") / F.col("__raw")).alias("__bias"))
    return fits, out.join(bias.hint("merge"), sample).select(*trace.columns, (F.col("__raw") * F.col("__bias")).alias("lambda"))


def numbered(df: DataFrame, by: str, key: str, seed: int, name: str = "i") -> DataFrame:
    """Adds ``name``: each row's place, from 0, in the order of a hash of ``key`` within ``by``; ranges of hashes are numbered apart."""
    rows = df.withColumn("__one", F.lit(1)).withColumn("__at", F.struct(F.xxhash64(F.lit(seed), key), key))
    block = F.shiftright(F.xxhash64(F.lit(seed), key), 54)
    return scan(rows, [by], "__at", block, "__one", name).withColumn(name, (F.col(name) - 1).cast("long")).drop("__one", "__at")


def split_rows(df: DataFrame, by: str, key: str, seed: int, share: float = 0.25) -> DataFrame:
    """Adds ``split``: ``training`` for round(``share`` n) rows of each group, drawn by hash, ``validation`` for the rest."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    rows = numbered(df, by, key, seed, "__i").join(n, by)
    return rows.withColumn("split", F.when(F.col("__i") < F.round(F.col("__n") * share), "training").otherwise("validation")).drop("__i", "__n")


def shuffled(i: np.ndarray, n: int, seed: int, rep: int) -> np.ndarray:
    """Where replicate ``rep`` sends each place of 0 .. n - 1: a permutation that any task can tell for its own places.

    A place is a row and a column of a square of about ``n`` places; six rounds turn one of them by a hash of the other.
    Places beyond ``n`` go round again.
    Replicate 0 leaves all where they are.
    """
    if rep == 0:
        return i.astype(np.int64)
    n_left = isqrt(max(n - 1, 0)) + 1
    n_right = -(-n // n_left)
    keys = np.random.SeedSequence([seed, rep]).generate_state(6, np.uint64)

    def turned(at: np.ndarray) -> np.ndarray:
        sizes = np.uint64(n_left), np.uint64(n_right)
        left, right = np.divmod(at, sizes[1])
        for k in keys:
            x = right + k
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x >>= np.uint64(32)
            x *= sizes[0]
            x >>= np.uint64(32)
            x += left
            np.minimum(x, x - sizes[0], out=x)  # a difference below zero is a huge number
            left, right, sizes = right, x, sizes[::-1]
        return left * sizes[1] + right

    out = turned(i.astype(np.uint64))
    open_ = np.flatnonzero(out >= np.uint64(n))
    while len(open_):
        out[open_] = again = turned(out[open_])
        open_ = open_[again >= np.uint64(n)]
    return out.astype(np.int64)


def strips(rows: DataFrame, by: str, y: str, fixed: list[str], permuted: list[str], pieces: int, block: int, held: int, strip: int) -> DataFrame:
    """(by, of, a, b, first, n, fixed, permuted, sums): a row for some ``strip`` numbered rows, which lie in one block ``a`` and one block ``b``.

    ``fixed`` and ``permuted`` are the bytes of a column of doubles for each term, places in its range, ``fixed`` with ``y``
    as its last; ``sums`` are the strip's normal equations, and ``of`` is the group's number of rows.
    """
    kind, terms = dict(rows.dtypes)[by], [*fixed, *permuted]
    at = [f"__u{j}" for j in range(len(terms))]
    placed = rows.join(ends(rows, by, terms), by).select(by, "i", y, F.col("__n").alias("of"), *[place(t, pieces).alias(u) for t, u in zip(terms, at)])
    keys = [F.floor(F.col("i") / size).alias(c) for size, c in ((block, "a"), (held, "b"), (strip, "strip"))]

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        u, target = part[at].to_numpy(float).T, part[y].to_numpy(float)
        x = np.column_stack([np.ones(len(part)), *[spline_at(p, pieces) for p in u]])
        sums = np.concatenate([(x.T @ x).ravel(), x.T @ target, [target @ target, len(part)]])
        one = {c: [part[c].iloc[0]] for c in (by, "of", "a", "b")}
        return pd.DataFrame({**one, "first": [part["i"].iloc[0]], "n": [len(part)], "fixed": [np.vstack([u[: len(fixed)], target]).tobytes()], "permuted": [u[len(fixed) :].tobytes()], "sums": [sums]})

    out = f"{by} {kind}, of long, a long, b long, first long, n int, fixed binary, permuted binary, sums array<double>"
    return placed.select("*", *keys).groupBy(by, "a", "b", "strip").applyInPandas(pack, out)


def smooth_perm_test(
    df: DataFrame, by: str, key: str, y: str, fixed: list[str], permuted: list[str], reps: int, seed: int, pieces: int = 6, block: int = 1 << 18, chunk: int = 500, held: int = 1 << 21, strip: int = 1 << 15
) -> DataFrame:
    """(by, n, deviance, below, reps, p): whether the permuted terms tell anything of ``y`` beside the fixed ones, in each group.

    The deviance of the additive fit is held against those of ``reps`` fits in which the rows' permuted columns are dealt
    anew, all by the same permutation: p = (those not above it + 0.5) / (reps + 1). Products among the fixed columns, and
    among the permuted ones, are the same for all replicates and summed once. What is left, products of fixed with
    permuted columns, comes from tasks of ``block`` rows, ``chunk`` replicates and the permuted columns of ``held`` rows;
    places of rows are permuted by a rule, so nothing is sorted or joined for a replicate. Up to ``held`` rows in a group
    each row is permuted once a replicate; beyond, once for every ``held`` rows. Rows with a null take no part.

    Rows reach these tasks as the bytes of some ``strip`` of them (``strips``): a task has 8 bytes for a row's term.
    """
    kind, terms = dict(df.dtypes)[by], [*fixed, *permuted]
    rows = df.select(by, key, *[F.col(c).cast("double").alias(c) for c in (y, *terms)]).na.drop()
    packed = keep(strips(numbered(rows, by, key, seed), by, y, fixed, permuted, pieces, block, held, strip))
    wide, last = pieces + 3, reps // chunk
    nf, nz = 1 + len(fixed) * wide, len(permuted) * wide

    def total(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: part[by].iloc[:1], "sums": [np.sum(np.stack(part["sums"]), axis=0)]})

    gram = packed.select(by, "sums").groupBy(by).applyInPandas(total, f"{by} {kind}, sums array<double>")

    def across(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, _, b, c = keys
        n, first = int(part["of"].iloc[0]), int(b) * held
        z = np.empty((len(permuted), min(held, n - first)))  # places in their terms' ranges: splines would be nine times as large, and slower to reach
        for _, own in part[part["side"] == 1].iterrows():
            z[:, own["first"] - first : own["first"] - first + own["n"]] = np.frombuffer(own["data"]).reshape(-1, own["n"])
        every = range(int(c) * chunk, min(int(c) * chunk + chunk, reps + 1))
        sums = np.zeros((len(every), nf + 1, nz))
        for _, own in part[part["side"] == 0].iterrows():
            *u, target = np.frombuffer(own["data"]).reshape(-1, own["n"])
            x = np.vstack([np.ones(own["n"]), *[spline_at(t, pieces).T for t in u], target])
            places = np.arange(own["first"], own["first"] + own["n"])
            for at, rep in enumerate(every):
                to = shuffled(places, n, seed, rep) - first
                own_x = x
                if z.shape[1] < n:
                    here = np.flatnonzero((to >= 0) & (to < z.shape[1]))
                    own_x, to = x[:, here], to[here]
                for j, u in enumerate(z):
                    sums[at, :, j * wide : j * wide + wide] += own_x @ spline_at(u[to], pieces)
        return pd.DataFrame({by: [keys[0]] * len(every), "c": c, "rep": every, "cross": list(sums.reshape(len(every), -1))})

    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("of") / size) - 1))
    left = packed.select(by, "of", "a", every(held).alias("b"), "first", "n", F.lit(0).alias("side"), F.col("fixed").alias("data"))
    right = packed.select(by, "of", every(block).alias("a"), "b", "first", "n", F.lit(1).alias("side"), F.col("permuted").alias("data"))
    dealt = left.unionByName(right).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(last))))
    # a number of tasks of its own: a row makes a thousand permutations, so bytes don't tell how to split the work
    n_tasks = packed.groupBy(by).agg(((F.max("a") + 1) * (F.max("b") + 1) * (last + 1)).alias("n")).agg(F.sum("n")).first()[0] or 1  # one row
    dealt = dealt.repartition(min(2 * n_tasks, 10_000), by, "a", "b", "c")
    cross = dealt.groupBy(by, "a", "b", "c").applyInPandas(across, f"{by} {kind}, c int, rep int, cross array<double>")

    def deviances(keys: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if part.empty or known.empty:
            return pd.DataFrame({by: [], "n": [], "rep": [], "deviance": []}, dtype=object)
        size = 1 + len(terms) * wide
        sums = np.asarray(known["sums"].iloc[0])
        rep, at = np.unique(part["rep"].to_numpy(), return_inverse=True)
        cross = np.zeros((len(rep), nf + 1, nz))
        np.add.at(cross, at, np.stack(part["cross"]).reshape(-1, nf + 1, nz))
        xx = np.tile(sums[: size * size].reshape(size, size), (len(rep), 1, 1))
        xy = np.tile(sums[size * size : -2], (len(rep), 1))
        xx[:, :nf, nf:], xx[:, nf:, :nf], xy[:, nf:] = cross[:, :nf], cross[:, :nf].transpose(0, 2, 1), cross[:, nf]
        rss = penalised_many(xx, xy, np.full(len(rep), sums[-2]), np.full(len(rep), int(sums[-1])), roughness(len(terms), pieces))[1]
        return pd.DataFrame({by: [keys[0]] * len(rep), "n": int(sums[-1]), "rep": rep, "deviance": rss})

    known = gram.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(last))))
    fits = keep(cross.groupBy(by, "c").cogroup(known.groupBy(by, "c")).applyInPandas(deviances, f"{by} {kind}, n long, rep int, deviance double"))
    seen = fits.where("rep = 0").select(by, "n", F.col("deviance").alias("observed"))
    out = fits.where("rep > 0").join(seen.drop("n"), by).groupBy(by).agg(F.count_if(F.col("deviance") <= F.col("observed") * (1 + 1e-12)).alias("below"))
    return seen.join(out, by, "left").select(by, "n", F.col("observed").alias("deviance"), F.coalesce("below", F.lit(0)).alias("below"), F.lit(reps).alias("reps"), ((F.coalesce("below", F.lit(0)) + 0.5) / (reps + 1)).alias("p"))
