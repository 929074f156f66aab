"""Operators over alternates: long tables of carriers, values of each alternate, and small named filters and joins.

Calls are (v, s, a1, a2, ads, dp, gq): allele numbers, null where not called, and reads of each allele.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variant as V
from .blocked import neighbour, running_sum
from .genotype import downcode, split_multi
from .stats import binom_test


def vcf_to_long(sites: DataFrame, calls: DataFrame, fields: list[str], key: str = "v") -> DataFrame:
    """A row for each sample, copy of an alternate that it carries, and consequence entry of that alternate.

    ``sites`` is (key, ..., ref, alts, csq): entries separated by commas, their values by bars in the order of ``fields``, of
    which ``Allele`` names the alternate. Two copies give two rows; an alternate without an entry gives none, but a
    site without any ``csq`` gives one row with empty values.
    """
    rows = calls.join(sites, key)
    called = F.filter(F.array("a1", "a2"), lambda a: a.isNotNull())
    alleles = F.concat(F.array("ref"), F.col("alts"))
    rows = rows.withColumn("genotype", F.array_join(F.transform(called, lambda a: F.element_at(alleles, a + 1)), "/"))
    rows = rows.withColumn("__a", F.explode(F.filter(called, lambda a: a > 0)))
    rows = rows.withColumns({"alt": F.element_at("alts", F.col("__a")), "alt_ad": F.element_at("ads", F.col("__a") + 1)})
    own = F.filter(F.transform(F.split("csq", ","), lambda e: F.split(e, r"\|")), lambda e: e[fields.index("Allele")] == F.col("alt"))
    none = F.array(F.array(*[F.lit("") for _ in fields]))
    rows = rows.withColumn("__e", F.explode(F.when(F.col("csq").isNull(), none).otherwise(own)))
    kept = [c for c in sites.columns if c not in ("alts", "csq")]
    return rows.select("s", *kept, "genotype", "alt", "alt_ad", "dp", *[F.coalesce(F.get("__e", F.lit(i)), F.lit("")).alias(f"csq_{f}") for i, f in enumerate(fields)])


def split_calls(sites: DataFrame, calls: DataFrame, key: str = "v") -> DataFrame:
    """Calls at split sites, down-coded: (key, s, a_index, alt, gt, ad, ref_ad) and what else the calls have."""
    alleles = split_multi(sites, key)
    return downcode(calls, alleles, key, ("alt",))


def annotate_alleles(sites: DataFrame, rows: DataFrame, values: dict[str, Column], key: str = "v") -> DataFrame:
    """``sites`` with ``alleles``: for each alternate, in order, a struct of ``values``, aggregates over its split ``rows``; null without rows."""
    each = rows.groupBy(key, "a_index").agg(F.struct(*[x.alias(n) for n, x in values.items()]).alias("x"))
    found = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("a_index").cast("int"), "x"))).alias("__m"))
    filled = F.transform(F.sequence(F.lit(1), F.size("alts")), lambda i: F.try_element_at(F.col("__m"), i))
    return sites.join(found, key, "left").withColumn("alleles", filled).drop("__m")


def allele_metrics() -> dict[str, Column]:
    """Counts and frequency of an alternate in all and by sex, over split rows with ``is_female``."""
    g, female = F.col("gt"), F.col("is_female")
    out = {}
    for name, who in (("", F.lit(True)), ("female_", female), ("male_", ~female)):
        ac, an = F.sum(F.when(who, g).otherwise(0)), 2 * F.count_if(who & g.isNotNull())
        out |= {f"{name}ac": ac.cast("long"), f"{name}an": an, f"{name}het": F.count_if(who & (g == 1)), f"{name}hom": F.count_if(who & (g == 2)), f"{name}af": F.when(an > 0, ac / an)}
    return out


def allele_medians() -> dict[str, Column]:
    """Medians over split rows: reference part of the depth, quality and dosage among carriers, allele balance p among heterozygotes."""
    g, reads = F.col("gt"), F.col("ad") + F.col("ref_ad")
    median = lambda who, x: F.percentile(F.when(who, x.cast("double")), F.lit(0.5))
    return {
        "median_dp_ref": median((g > 0) & (reads > 0), F.col("ref_ad") / F.when(reads > 0, reads) * F.col("dp")), "median_gq": median(g > 0, F.col("gq")),
        "median_dosage": median(g > 0, g), "median_p_ab": median(g == 1, F.col("p_ab")),
    }


def with_balance(rows: DataFrame) -> DataFrame:
    """Adds ``p_ab``, the two-sided binomial p of an even split of reads: computed once for each pair of counts that occurs."""
    pairs = rows.select("ad", "ref_ad").distinct()
    p = pairs.withColumn("p_ab", binom_test(F.col("ad").cast("long"), (F.col("ad") + F.col("ref_ad")).cast("long")))
    return rows.join(p, ["ad", "ref_ad"], "left")


def split_multi_info(v: DataFrame, listed: list[str], by: str = "contig", pos: str = "pos") -> DataFrame:
    """Sites with lists of a value for each alternate as a row an alternate: ``split`` numbers the multi-allelic sites, 0 is not split.

    Numbers follow the genome's order, from counts inside contigs and contigs' offsets.
    """
    many = (F.size("alts") > 1).cast("int")
    ranked = running_sum(v.withColumn("__many", many), by, pos, ["__many"])
    sizes = ranked.groupBy(by).agg(F.sum("__many").alias("__n"))
    later = sizes.select(F.col(by).alias("__c"), F.col("__n").alias("__before"))
    offsets = sizes.join(later, F.col("__c") < F.col(by), "left").groupBy(by).agg(F.coalesce(F.sum("__before"), F.lit(0)).alias("__o"))  # a row a contig
    rows = ranked.join(offsets, by).withColumn("split", F.when(F.col("__many") == 1, F.col("run___many") + F.col("__o")).otherwise(0).cast("long"))
    zipped = F.arrays_zip(F.col("alts").alias("alt"), *[F.col(c) for c in listed])
    rest = [c for c in v.columns if c not in ("alts", "alt", *listed)]
    return rows.select(*rest, "split", F.inline(zipped))


def rename_samples(gt: DataFrame, names: DataFrame) -> DataFrame:
    """Samples named anew by (s, name); those that are not listed keep their names."""
    return gt.join(names.select("s", F.col("name").alias("__to")), "s", "left").withColumn("s", F.coalesce("__to", "s")).drop("__to")


def filter_intervals(v: DataFrame, intervals: list[tuple], keep: bool = True) -> DataFrame:
    """Variants inside, or outside, literal intervals: (contig,) or (contig, first, last), 1-based and closed. The scan gets the predicate."""

    def one(i: tuple) -> Column:
        here = F.col("contig") == i[0]
        return here & F.col("pos").between(i[1], i[2]) if len(i) == 3 else here

    inside = reduce(lambda a, b: a | b, map(one, intervals), F.lit(False))
    return v.where(inside if keep else ~inside)


def filter_multi(v: DataFrame) -> DataFrame:
    """Sites with one alternate."""
    return v.where(F.size("alts") == 1)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null, or a value that is no number, in the columns."""
    return df.na.drop(subset=columns)


def merge_annotations(base: DataFrame, must: DataFrame, *may: DataFrame, key: str = "vid") -> DataFrame:
    """``base`` with one table that every row must be in, and others it may be in."""
    return reduce(lambda df, t: df.join(t, key, "left"), may, base.join(must, key))


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of short lists of parameters: lists are literals and are exploded, nothing is joined."""
    return reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), values.items(), spark.range(1)).drop("id")


def order_violations(df: DataFrame, index: str, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """Rows (index, contig, pos) that come, in the order of ``index``, before what they follow in contig and position."""
    rows = df.select(F.lit(0).alias("__all"), index, F.struct(contig, pos).alias("__at"))
    seen = neighbour(rows, "__all", index, "__at", "__was", False)
    return seen.where(F.col("__was") > F.col("__at")).select(index, F.col(f"__at.{contig}").alias(contig), F.col(f"__at.{pos}").alias(pos))


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in the order of ``order``, nulls last, then of its other columns, so that ties don't depend on the tasks.

    An aggregate, so that copies of a key never meet in one task.
    """
    rest = [c for c in df.columns if c not in key]
    place = [x for c in order for x in (F.col(c).isNull().alias(f"__no_{c}"), F.col(c))]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*place, *[c for c in rest if c not in order])).alias("__row")).select(*key, "__row.*").select(*df.columns)


def drop_repeats(df: DataFrame, index: str, key: list[str]) -> DataFrame:
    """The first row of every run of rows with one key, in the order of ``index``, a number that is no row's twice; nulls are equal."""
    rows = df.withColumns({"__all": F.lit(0), "__k": F.struct(*key)})
    seen = neighbour(rows, "__all", index, "__k", "__was", False)
    return seen.where(~F.col("__k").eqNullSafe(F.col("__was"))).select(*df.columns)


def mean_depth(depths: DataFrame) -> DataFrame:
    """Mean depth of each sample over its positions (s, n, dp): dp seen at n positions."""
    return depths.groupBy("s").agg((F.sum(F.col("n") * F.col("dp")) / F.sum("n")).alias("mean_dp"))


def category_counts(rows: DataFrame) -> DataFrame:
    """Alternates by category over split rows."""
    return rows.groupBy(V.category(F.col("ref"), F.col("alt")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
