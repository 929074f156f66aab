"""Allele-frequency tables: long counts (v, cohort, n_rr, n_ra, n_aa, n_missing) and what is made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("n_rr", "n_ra", "n_aa", "n_missing")


def allele_frequency(rr: str = "n_rr", ra: str = "n_ra", aa: str = "n_aa") -> Column:
    """(ra + 2 aa) / (2 (rr + ra + aa)), null without calls."""
    n = F.col(rr) + F.col(ra) + F.col(aa)
    return F.when(n > 0, (F.col(ra) + 2 * F.col(aa)) / (2 * n))


def af_outer(tables: dict[str, DataFrame], key: str = "v") -> DataFrame:
    """Full outer join of any number of cohort tables: one union in long form and one pivot, no chain of joins."""
    long = reduce(DataFrame.unionByName, [t.select(key, F.lit(name).alias("cohort"), *COUNTS) for name, t in tables.items()])
    return af_wide(long, list(tables), key)


def af_wide(long: DataFrame, cohorts: list[str], key: str = "v") -> DataFrame:
    """Long to wide; a cohort without the variant stays null."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col("cohort") == c, F.col(n))).alias(f"{n}_{c}") for c in cohorts for n in COUNTS])


def af_long(wide: DataFrame, cohorts: list[str], key: str = "v") -> DataFrame:
    """Wide to long; rows of cohorts without the variant are dropped."""
    parts = F.array(*[F.struct(F.lit(c).alias("cohort"), *[F.col(f"{n}_{c}").alias(n) for n in COUNTS]) for c in cohorts])
    return wide.select(key, F.inline(parts)).where("n_rr IS NOT NULL")


def counts_from_ac(df: DataFrame, n: Column) -> DataFrame:
    """Genotype counts from ac and the number of homozygotes."""
    return df.withColumn("n_aa", F.col("hom")).withColumn("n_ra", F.col("ac") - 2 * F.col("hom")).withColumn("n_rr", n - F.col("n_ra") - F.col("n_aa"))


def orient_counts(t: DataFrame, ref: DataFrame, key: str = "v") -> DataFrame:
    """Counts oriented to the reference alleles: kept where they agree, swapped where they are exchanged, else dropped."""
    j = t.join(ref.select(key, F.col("ref").alias("r_ref"), F.col("alt").alias("r_alt")), key)
    same = (F.col("ref") == F.col("r_ref")) & (F.col("alt") == F.col("r_alt"))
    swapped = (F.col("ref") == F.col("r_alt")) & (F.col("alt") == F.col("r_ref"))
    rr, aa = F.when(same, F.col("n_rr")).otherwise(F.col("n_aa")), F.when(same, F.col("n_aa")).otherwise(F.col("n_rr"))
    return j.where(same | swapped).select(key, F.col("r_ref").alias("ref"), F.col("r_alt").alias("alt"), rr.alias("n_rr"), "n_ra", aa.alias("n_aa"), "n_missing")


def filter_af_quality(long: DataFrame, n_cohorts: int, rate: float = 0.97, delta: float = 0.04, key: str = "v") -> DataFrame:
    """Variants genotyped well in every one of the cohorts and of nearly one frequency in all of them."""
    called = F.col("n_rr") + F.col("n_ra") + F.col("n_aa")
    g = long.withColumn("rate", called / (called + F.col("n_missing"))).withColumn("af", allele_frequency()).groupBy(key)
    out = g.agg(F.count(F.lit(1)).alias("n_cohorts"), F.min("rate").alias("min_rate"), (F.max("af") - F.min("af")).alias("delta_af"))
    return out.where((F.col("n_cohorts") == n_cohorts) & (F.col("min_rate") >= rate) & (F.col("delta_af") < delta))


def rare_in_all(wide: DataFrame, cohorts: list[str], cap: float = 0.01) -> DataFrame:
    """Variants rare in every cohort; an unknown frequency counts as rare."""
    rare = [F.coalesce(allele_frequency(f"n_rr_{c}", f"n_ra_{c}", f"n_aa_{c}") < cap, F.lit(True)) for c in cohorts]
    return wide.where(reduce(lambda a, b: a & b, rare))


def sum_cohorts(wide: DataFrame, parts: list[str], total: str) -> DataFrame:
    """A cohort that is the sum of its parts; null where any part is."""
    return wide.withColumns({f"{n}_{total}": reduce(lambda a, b: a + b, [F.col(f"{n}_{p}") for p in parts]) for n in COUNTS})


def assert_key(df: DataFrame, *key: str) -> DataFrame:
    """``df``, failing at run time if a key occurs twice."""
    again = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return df.withColumn("__n", again).where(F.assert_true(F.col("__n") == 1, f"{key} is not a key").isNull()).drop("__n")


def burden_stats(vb: DataFrame) -> DataFrame:
    """dN/dS-like ratios over (class, n_case, n_control): allele sums of both classes in both cohorts, and their ratios."""
    pick = lambda cls, col: F.coalesce(F.sum(F.when(F.col("class") == cls, F.col(col))), F.lit(0))
    s = vb.agg(pick("nonsyn", "ac_a").alias("nonsyn_a"), pick("syn", "ac_a").alias("syn_a"), pick("nonsyn", "ac_b").alias("nonsyn_b"), pick("syn", "ac_b").alias("syn_b"))
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = s.withColumn("ratio_a", div("nonsyn_a", "syn_a")).withColumn("ratio_b", div("nonsyn_b", "syn_b"))
    return out.withColumn("ratio", div("ratio_a", "ratio_b"))


def enrichment(vb: DataFrame, *by: str) -> DataFrame:
    """Log odds that an allele of a class is in cohort a rather than b, deleterious against neutral; for each group of ``by``."""
    pick = lambda cls, col: F.coalesce(F.sum(F.when(F.col("class") == cls, F.col(col))), F.lit(0)) + 0.5
    s = vb.groupBy(*by).agg(pick("nonsyn", "ac_a").alias("da"), pick("nonsyn", "ac_b").alias("db"), pick("syn", "ac_a").alias("na"), pick("syn", "ac_b").alias("nb"))
    return s.withColumn("log_odds", F.log(F.col("da") * F.col("nb") / (F.col("db") * F.col("na"))))


def by_zygosity(counts: DataFrame, case: Column, key: str = "v") -> DataFrame:
    """(key, counted, ac_a, ac_b): a row for each way of counting what cohorts (key, n_ra, n_aa) carry: alleles, heterozygotes, homozygotes.

    ``case`` tells cohort a from b. ``enrichment`` and ``enrichment_interval`` take the result by ``counted``.
    """
    ways = {"alleles": F.col("n_ra") + 2 * F.col("n_aa"), "het": F.col("n_ra"), "hom": F.col("n_aa")}
    side = lambda who, n: F.sum(F.when(who, n).otherwise(0))
    sums = counts.groupBy(key).agg(*[side(who, n).alias(f"{c}_{w}") for w, n in ways.items() for c, who in (("a", case), ("b", ~case))])
    rows = F.array(*[F.struct(F.lit(w).alias("counted"), F.col(f"a_{w}").alias("ac_a"), F.col(f"b_{w}").alias("ac_b")) for w in ways])
    return sums.select(key, F.inline(rows))


def rare_burden(long: DataFrame) -> DataFrame:
    """Expected loci per person with one, and with two, alternate alleles, by cohort, and the recessive share."""
    n = F.col("n_rr") + F.col("n_ra") + F.col("n_aa")
    rows = long.where(n > 0).groupBy("cohort").agg(F.sum(F.col("n_ra") / n).alias("dominant"), F.sum(F.col("n_aa") / n).alias("recessive"), F.count(F.lit(1)).alias("n_loci"))
    return rows.withColumn("recessive_share", F.when(F.col("dominant") + F.col("recessive") > 0, F.col("recessive") / (F.col("dominant") + F.col("recessive"))))
