"""Burden of two classes of variants in two sets of genes and two cohorts: sums, ratios, and their permutation test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import permutation_two_sided
from .stress import by_replicate

#: Class (n: nonsynonymous, s: synonymous), set (t: test, c: control) and cohort of each sum.
SUMS = tuple(f"{cls}{who}_{cohort}" for cohort in "ab" for who in "tc" for cls in "ns")
#: Each ratio by the two values that it divides.
RATIOS = {
    "rt_a": ("nt_a", "st_a"), "rc_a": ("nc_a", "sc_a"), "rt_b": ("nt_b", "st_b"), "rc_b": ("nc_b", "sc_b"),
    "r_a": ("rt_a", "rc_a"), "r_b": ("rt_b", "rc_b"), "rt": ("rt_a", "rt_b"), "rc": ("rc_a", "rc_b"), "r": ("r_a", "r_b"),
}


def with_ratios(sums: DataFrame) -> DataFrame:
    """The nine ratios of the eight sums; null where a divisor is zero or null."""
    for name, (a, b) in RATIOS.items():
        sums = sums.withColumn(name, F.when(F.col(b) != 0, F.col(a) / F.col(b)))
    return sums


def cell(cls: str, who: str) -> Column:
    return (F.col("class") == {"n": "nonsyn", "s": "syn"}[cls]) & (F.col("set") == {"t": "test", "c": "control"}[who])


def burden_ratios(vb: DataFrame) -> DataFrame:
    """One row: sums of frequencies by class, set and cohort, and their ratios, in one aggregation.

    ``vb`` is (class: syn or nonsyn, set: test or control, ac_a, an_a, ac_b, an_b); other classes and sets take no part. A
    cohort without any call of a variant has frequency zero there.
    """
    af = lambda cohort: F.coalesce(F.col(f"ac_{cohort}") / F.nullif(f"an_{cohort}", F.lit(0)), F.lit(0.0))
    one = {s: F.coalesce(F.sum(F.when(cell(s[0], s[1]), af(s[3]))), F.lit(0.0)) for s in SUMS}
    return with_ratios(vb.agg(*[x.alias(s) for s, x in one.items()]))


def permuted_sums(vb: DataFrame, reps: int, seed: int, key: str = "v") -> DataFrame:
    """(rep, the eight sums) with people dealt anew to the cohorts at every variant, whose sizes and genotypes stay.

    ``vb`` is that of ``burden_ratios`` with (key, aa_a, aa_b: people with two alternates). Heterozygous people of cohort a are
    drawn first, then those with two alternates among the rest, both by the hypergeometric distribution. A cohort without
    a called number at a variant gets in each replicate one drawn from its known ones (nothing, if it has none). Replicates
    are columns of a task's arrays; a task hands on eight sums a replicate. The known numbers reach the tasks as counts of
    distinct values, of which there are at most as many as people in a cohort.
    """
    used = vb.where(F.col("class").isin("syn", "nonsyn") & F.col("set").isin("test", "control"))
    n = {c: used.where(f"an_{c} > 0").groupBy(F.floor(F.col(f"an_{c}") / 2).cast("long").alias("n")).count().orderBy("n").collect() for c in "ab"}
    sizes = {c: np.repeat(0, 1) if not n[c] else np.array([r["n"] for r in n[c]]) for c in "ab"}
    shares = {c: np.ones(1) if not n[c] else np.array([r["count"] for r in n[c]]) / sum(r["count"] for r in n[c]) for c in "ab"}
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    rows = used.select(F.when(F.col("class") == "nonsyn", 0).otherwise(1).alias("cls"), F.when(F.col("set") == "test", 0).otherwise(1).alias("who"), *[number(f"{x}_{c}") for c in "ab" for x in ("ac", "an", "aa")], F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 62)).alias("__seed"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 2, 2, reps))  # cohort, set, class
        for b in batches:
            for cls, who, ac_a, an_a, aa_a, ac_b, an_b, aa_b, s in b.itertuples(index=False):
                rng = np.random.default_rng(s)
                people = [np.full(reps, an // 2) if an else rng.choice(sizes[c], reps, p=shares[c]) for c, an in (("a", an_a), ("b", an_b))]
                het, hom = ac_a + ac_b - 2 * (aa_a + aa_b), aa_a + aa_b
                rest = np.maximum(people[0] + people[1] - het - hom, 0)
                first = np.minimum(people[0], het + hom + rest)
                het_a = rng.hypergeometric(het, rest + hom, first)
                hom_a = rng.hypergeometric(hom, rest, np.minimum(first - het_a, hom + rest))
                for i, (alleles, of) in enumerate(((het_a + 2 * hom_a, people[0]), (het - het_a + 2 * (hom - hom_a), people[1]))):
                    sums[i, who, cls] += np.where(of > 0, alleles / np.maximum(2 * of, 1), 0.0)
        yield pd.DataFrame({"name": list(SUMS), "sums": [sums["ab".index(x[3]), "tc".index(x[1]), "ns".index(x[0])] for x in SUMS]})

    parts = by_replicate(rows.mapInPandas(deal, "name string, sums array<double>"), ["name"])
    return parts.groupBy("rep").agg(*[F.coalesce(F.max(F.when(F.col("name") == s, F.col("sum"))), F.lit(0.0)).alias(s) for s in SUMS])


def burden_perm_test(vb: DataFrame, reps: int, seed: int, key: str = "v") -> DataFrame:
    """(statistic, observed, reps, below, above, p) of three ratios: r, in test against control genes and cohort a against b, rt and rc, in either set alone.

    p is min(1, 2 (min(below, above) + 1) / (reps + 1)); ties count on both sides, and replicates without a ratio on none. A
    ratio that isn't there has null for observed and p 1.
    """
    names = ("r", "rt", "rc")
    long = lambda df, to: df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("statistic"), F.col(x).alias(to)) for x in names])).alias("x"), *[c for c in ("rep",) if c in df.columns])
    seen = long(burden_ratios(vb), "observed").select("x.*")
    null = long(with_ratios(permuted_sums(vb, reps, seed, key)), "null").select("x.*", "rep")
    return permutation_two_sided(null.join(F.broadcast(seen), "statistic"), "observed", "null", "statistic", "observed")  # three rows
