"""Cohort scores by replicate, and their tests: bootstrap of genotype counts, and drift whose draws all cohorts share.

Replicates are the columns of a matrix inside each task, never rows beside cohorts: a task hands on one sum for each
model, cohort and replicate. Draws follow (seed, replicate, variant), so they don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import two_sided, uniforms
from .shared import keep
from .stats import p_adjust

#: Pairs of model and cohort of which a task holds sums before it hands them on.
HELD = 256


def by_replicate(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sums over (by, sums: an array over replicates): a row a replicate, numbered from 1."""
    rows = parts.select(*by, F.posexplode("sums").alias("__i", "__x"))
    return rows.groupBy(*by, (F.col("__i") + 1).alias("rep")).agg(F.sum("__x").alias("sum"))


def boot_scores(counts: DataFrame, models: DataFrame, reps: int, seed: int, key: str = "v") -> DataFrame:
    """(id, cohort, rep, score): mean score of each cohort over parametric draws of its genotype counts, loci unlinked.

    ``counts`` is (v, cohort, n_rr, n_ra, n_aa), ``models`` (id, v, aaf, coef). A variant that a cohort lacks, or has no
    call of, counts with the model's frequency in every replicate, and a row without coefficient or frequency adds nothing; a cohort without any variant of a model has no row.

    Variants of one model, cohort and coefficient whose counts are the same are drawn together: the sum of m draws with
    the same shares is a draw of m times as many people. So draws grow as the distinct counts, not as the variants.
    """
    known = counts.where("n_rr + n_ra + n_aa > 0").select(key, "cohort", "n_rr", "n_ra", "n_aa")
    same = ["id", "cohort", "coef", "n_rr", "n_ra", "n_aa"]
    rows = models.dropna(subset=["coef", "aaf"]).join(known, key).groupBy(*same).agg(F.count(F.lit(1)).alias("__m"), F.sum("aaf").alias("__aaf"))
    types = dict(rows.dtypes)
    rows = keep(rows.select("id", "cohort", "coef", "__aaf", "n_rr", "n_ra", "n_aa", "__m", F.pmod(F.xxhash64(F.lit(seed), *same), F.lit(1 << 62)).alias("__seed")))
    # a number of tasks of its own: a row is some thousand draws, so its bytes don't tell how to split the work
    rows = rows.repartition(min(max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() >> 11), 10_000))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame({"id": [k[0] for k in held], "cohort": [k[1] for k in held], "sums": list(held.values())})
            held.clear()
            return out

        for b in batches:
            for who, cohort, coef, aaf, rr, ra, aa, m, s in b.itertuples(index=False):
                n = np.random.default_rng(s).multinomial(m * (rr + ra + aa), np.array([rr, ra, aa]) / (rr + ra + aa), size=reps)
                shift = coef * ((n[:, 1] + 2 * n[:, 2]) / (rr + ra + aa) - 2 * aaf)
                at = held.get((who, cohort))
                if at is None:
                    held[who, cohort] = shift
                else:
                    at += shift
                if len(held) >= HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    parts = rows.mapInPandas(draw, f"id {types['id']}, cohort {types['cohort']}, sums array<double>")
    base = models.groupBy("id").agg(F.sum(2 * F.col("aaf") * F.col("coef")).alias("base"), F.count(F.lit(1)).alias("size"))
    return by_replicate(parts, ["id", "cohort"]).join(base, "id").select("id", "cohort", "rep", ((F.col("base") + F.col("sum")) / F.col("size")).alias("score"))


def boot_compare(scores: DataFrame, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Every two cohorts of a model by differences of their replicates: (id, cohort1, cohort2, median, low, high, below, above, p).

    ``draws`` differences are taken, each of two replicates chosen at random with replacement. p is
    (0.5 + min(below, above)) * 2 / (draws + 1), at most 1. A cohort's replicates travel as one array: their number is the
    bootstrap's, not the data's.
    """
    one = scores.groupBy("id", "cohort").agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "score"))), lambda x: x["score"]).alias("x"))
    pairs = one.select("id", F.col("cohort").alias("cohort1"), F.col("x").alias("x1")).join(one.select("id", F.col("cohort").alias("cohort2"), F.col("x").alias("x2")), "id").where("cohort1 < cohort2")
    ends = [(1 - level) / 2, 0.5, (1 + level) / 2]

    @F.pandas_udf("median double, low double, high double, below long, above long")
    def compare(x1: pd.Series, x2: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, k in zip(x1, x2, s, strict=True):
            rng = np.random.default_rng(k)
            d = rng.choice(np.asarray(a), draws) - rng.choice(np.asarray(b), draws)
            low, mid, high = np.quantile(d, ends)
            out.append((mid, low, high, int((d < 0).sum()), int((d > 0).sum())))
        return pd.DataFrame(out, columns=["median", "low", "high", "below", "above"])

    seeds = F.pmod(F.xxhash64(F.lit(seed), "id", "cohort1", "cohort2"), F.lit(1 << 62))
    out = pairs.select("id", "cohort1", "cohort2", compare("x1", "x2", seeds).alias("r")).select("id", "cohort1", "cohort2", "r.*")
    return out.withColumn("p", F.least(F.lit(1.0), (0.5 + F.least("below", "above")) * 2 / F.lit(draws + 1)))


def normalised_differences(af: DataFrame, target: str, sources: list[str], key: str = "v") -> DataFrame:
    """(key, d_<source>): (target - f) / sqrt(f (1 - f)) at loci where every source lies strictly between 0 and 1 and the target is known."""
    known = af.where(F.col(target).isNotNull())
    for s in sources:
        known = known.where((F.col(s) > 0) & (F.col(s) < 1))
    return known.select(key, *[((F.col(target) - F.col(s)) / F.sqrt(F.col(s) * (1 - F.col(s)))).alias(f"d_{s}") for s in sources])


def block_numbers(n_rows: int, n_drawn: int, rows: int, drawn: int, least: int) -> tuple[int, int]:
    """Blocks of model rows and of differences."""
    return max(1, -(-n_rows // rows), min(least, n_rows >> 10)), max(1, -(-n_drawn // drawn))


def drift_scores(af: DataFrame, diffs: DataFrame, models: DataFrame, sources: list[str], reps: int, seed: int, key: str = "v", rows: int = 1 << 18, drawn: int = 1 << 22, strip: int = 256, least: int = 32) -> DataFrame:
    """(id, source, rep, score) of frequencies that drifted from each source: f + d sqrt(f (1 - f)), clipped to [0, 1].

    d is drawn from ``diffs`` (key, d_<source>) with replacement; in one replicate all sources use the same drawn locus of
    ``diffs`` at a variant, so their scores can be compared. ``af`` is (key, one column a source); variants that any
    source lacks take no part, nor do rows of models with a null. A score is twice the sum of coefficient times frequency, divided by the number of
    coefficients that aren't zero (null if there are none).

    Model rows lie in blocks of about ``rows`` (and in ``least`` blocks, if there are a thousand for each) and differences
    in blocks of about ``drawn``. Every pair of blocks is a task, which looks up those draws that fall into its
    differences, ``strip`` replicates at a time or fewer, so that it holds about a million draws. A block of differences
    holds millions of them, so that up to there each draw is made once; beyond, a task makes all draws of its
    rows, but looks up its own only. Without any differences the result is empty.
    """
    known = af.select(key, *sources).dropna()
    m = models.select("id", key, "coef").dropna().join(known, key)
    d = diffs.select(key, *[f"d_{s}" for s in sources]).dropna()
    n_rows, n_drawn = m.count(), d.count()
    n_m, n_d = block_numbers(n_rows, n_drawn, rows, drawn, least)
    hashed = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    d = d.select(F.xxhash64(key).alias("__k"), *[f"d_{s}" for s in sources], hashed(n_d, F.lit(seed), key).alias("part"))
    sizes = {r["part"]: r["count"] for r in d.groupBy("part").count().collect()}  # a row a block
    ends = np.cumsum([sizes.get(i, 0) for i in range(n_d)])
    left = m.select("id", "coef", *sources, F.xxhash64(F.lit(seed), key).alias("__h"), hashed(n_m, "id", key).alias("block"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    right = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_m - 1))))
    kind = dict(models.dtypes)["id"]
    # a number of tasks of its own: the sides are small for the work that they make, so their bytes don't tell how to split it
    left, right = (x.repartition(min(n_m * n_d, 20_000), "block", "part") for x in (left, right))

    def simulate(keys: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "source": [], "sums": []}, dtype=object)
        a, b = a.sort_values("id", kind="stable"), b.sort_values(["__k", *[f"d_{s}" for s in sources]])
        ids = a["id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        coef, h, first = 2 * a["coef"].to_numpy(float), a["__h"].to_numpy(), ends[keys[1]] - len(b)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(a))))
        sums = {s: np.zeros((len(starts), reps)) for s in sources}
        sides = {s: (f, np.sqrt(f * (1 - f)), b[f"d_{s}"].to_numpy()) for s in sources for f in [a[s].to_numpy(float)]}
        wide = max(1, min(strip, (1 << 20) // len(a)))
        for r in range(0, reps, wide):
            at = np.floor(uniforms(h, np.arange(r, min(r + wide, reps))) * ends[-1]).astype(np.int64) - first
            if len(b) < ends[-1]:
                i, c = np.nonzero((at >= 0) & (at < len(b)))
                at, place = at[i, c], of[i] * wide + c
                for s, (f, w, d) in sides.items():
                    x = coef[i] * np.clip(f[i] + d[at] * w[i], 0, 1)
                    sums[s][:, r : r + wide] = np.bincount(place, weights=x, minlength=len(starts) * wide).reshape(len(starts), wide)[:, : reps - r]
                continue
            for s, (f, w, d) in sides.items():
                x = d[at]
                x *= w[:, None]
                x += f[:, None]
                np.clip(x, 0, 1, out=x)
                x *= coef[:, None]
                sums[s][:, r : r + wide] = np.add.reduceat(x, starts, axis=0)
        return pd.DataFrame({"id": np.tile(ids[starts], len(sources)), "source": np.repeat(sources, len(starts)), "sums": [x for s in sources for x in sums[s]]})

    parts = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(simulate, f"id {kind}, source string, sums array<double>")
    size = m.groupBy("id").agg(F.nullif(F.count_if(F.col("coef") != 0), F.lit(0)).alias("size"))
    return by_replicate(parts, ["id", "source"]).join(size, "id").select("id", "source", "rep", (F.col("sum") / F.col("size")).alias("score"))


def stress_test(af: DataFrame, models: DataFrame, target: str, sources: list[str], reps: int, seed: int, key: str = "v", level: float = 0.95, **blocks: int) -> DataFrame:
    """Whether the target's score lies where drift alone would take each source's: a row for each model and source.

    (id, source, observed: the target's score, n_reps, mean, low, high: of simulated less observed, below, above, p, p_holm, p_bh).
    Only variants that the target and all sources know take part.
    """
    known = af.select(key, target, *sources).dropna()
    scores = drift_scores(known, normalised_differences(af, target, sources, key), models, sources, reps, seed, key, **blocks)
    m = models.select("id", key, "coef").dropna().join(known, key)
    observed = m.groupBy("id").agg((2 * F.sum(F.col("coef") * F.col(target)) / F.nullif(F.count_if(F.col("coef") != 0), F.lit(0))).alias("observed"))
    rel = scores.join(observed, "id").withColumn("rel", F.col("score") - F.col("observed")).where("rel IS NOT NULL")
    rel = keep(rel)
    test = two_sided(rel, "rel", "id", "source", "observed").withColumnRenamed("reps", "n_reps")
    spread = rel.groupBy("id", "source").agg(F.avg("rel").alias("mean"), F.percentile("rel", (1 - level) / 2).alias("low"), F.percentile("rel", (1 + level) / 2).alias("high"))
    out = keep(test.join(spread, ["id", "source"]).withColumn("__key", F.concat_ws("\x1f", F.col("id").cast("string"), "source")))
    for method in ("holm", "bh"):
        out = out.join(p_adjust(out.select("__key", "p"), "p", method, "__key").drop("p").withColumnRenamed("p_adj", f"p_{method}"), "__key")
    return out.drop("__key")
