"""Operators over long genotypes (v, s, gt, dp, ad), variants (v, contig, pos, ref, alts) and samples (s, ...).

``gt`` counts alternate alleles, null is no call. Aggregates group by variant or sample with partial aggregation;
sample tables are dimension tables and joined by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variant as V


def split_multi(v: DataFrame, key: str = "v") -> DataFrame:
    """One row per alternate allele: ``a_index`` from 1, ``alt``, ``was_split``."""
    rows = v.drop("alt") if "alt" in v.columns else v
    out = rows.select("*", F.posexplode("alts").alias("__i", "alt"))
    return out.withColumn("a_index", F.col("__i") + 1).withColumn("was_split", F.size("alts") > 1).drop("__i", "alts")


def downcode(gt: DataFrame, alleles: DataFrame, key: str = "v", also: tuple[str, ...] = ()) -> DataFrame:
    """Genotypes (a1, a2, ads) at split sites, with the alleles' columns ``also``: other alternates count as reference, their reads too."""
    rows = gt.join(alleles.select(key, "a_index", *also).hint("merge"), key)  # sites grow with the cells
    one = lambda a: F.when(F.col(a) == F.col("a_index"), 1).when(F.col(a).isNotNull(), 0)
    ad = F.element_at("ads", F.col("a_index") + 1)
    total = F.aggregate("ads", F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.withColumn("gt", one("a1") + one("a2")).withColumn("ad", ad).withColumn("ref_ad", total - ad)


def min_rep(v: DataFrame) -> DataFrame:
    """Minimal representation of biallelic rows (contig, pos, ref, alt)."""
    return v.withColumn("__m", V.min_rep(F.col("pos"), F.col("ref"), F.col("alt"))).withColumns({c: F.col(f"__m.{c}") for c in ("pos", "ref", "alt")}).drop("__m")


def filter_alleles(v: DataFrame, keep) -> DataFrame:
    """Alternates for which ``keep(allele)`` holds, with ``index_map`` from old to new allele numbers; empty sites go."""
    numbered = F.filter(F.transform("alts", lambda a, i: F.struct(a.alias("alt"), (i + 1).alias("old"))), lambda x: keep(x["alt"]))
    out = v.withColumn("__k", numbered).where(F.size("__k") > 0)
    entries = F.transform("__k", lambda x, i: F.struct(x["old"], (i + 1)))
    return out.withColumn("alts", F.transform("__k", lambda x: x["alt"])).withColumn("index_map", F.map_from_entries(entries)).drop("__k")


def minimal_alleles(calls: DataFrame) -> DataFrame:
    """One sample's calls (contig, pos, ref, alts, a1, a2) with only the alternates they carry, and the genotype recoded.

    Sites where the sample carries no alternate but the star are dropped.
    """
    star = F.array_position("alts", "*")
    used = F.array_sort(F.array_distinct(F.filter(F.array("a1", "a2"), lambda a: (a > 0) & (a != star))))
    code = lambda a: F.when(F.col(a).isNull(), None).when(F.col(a) == 0, 0).otherwise(F.array_position("used", F.col(a)).cast("int"))
    rows = calls.withColumn("used", used).where(F.size("used") > 0)
    new = F.transform("used", lambda i: F.element_at(F.col("alts"), i))
    return rows.withColumns({"n1": code("a1"), "n2": code("a2"), "alts": new}).withColumns({"a1": F.col("n1"), "a2": F.col("n2")}).drop("n1", "n2", "used")


def unphase_sort(gt: Column) -> Column:
    """Genotype text with alleles in order and unphased."""
    part = F.split(F.regexp_replace(gt, r"\|", "/"), "/")
    number = F.transform(part, lambda a: F.when(a == ".", F.lit(-1)).otherwise(a.cast("int")))
    return F.array_join(F.transform(F.array_sort(number), lambda a: F.when(a < 0, ".").otherwise(a.cast("string"))), "/")


def variant_qc(gt: DataFrame, n_samples: int, key: str = "v") -> DataFrame:
    """Call rate, counts, allele frequency, depth moments and heterozygosity of each variant."""
    n = lambda c: F.count_if(c)
    g = F.col("gt")
    out = gt.groupBy(key).agg(
        n(g.isNotNull()).alias("n_called"), n(g == 0).alias("n_hom_ref"), n(g == 1).alias("n_het"), n(g == 2).alias("n_hom_var"),
        F.coalesce(F.sum(g), F.lit(0)).cast("long").alias("ac"), F.avg("dp").alias("dp_mean"), F.stddev_pop("dp").alias("dp_stdev"),
    )
    called = F.when(F.col("n_called") > 0, F.col("n_called"))
    return out.withColumns({"call_rate": F.col("n_called") / n_samples, "af": F.col("ac") / (2 * called), "r_het": F.col("n_het") / called})


def hwe_chisq(df: DataFrame, a: str = "n_hom_ref", b: str = "n_het", c: str = "n_hom_var") -> DataFrame:
    """Adds ``hwe_chisq``: squared departure from Hardy-Weinberg proportions, null where one allele is absent."""
    n = F.col(a) + F.col(b) + F.col(c)
    p = (2 * F.col(a) + F.col(b)) / F.nullif(2 * n, F.lit(0))
    expect = {a: n * p * p, b: 2 * n * p * (1 - p), c: n * (1 - p) * (1 - p)}
    chisq = sum(((F.col(k) - e) * (F.col(k) - e) / e for k, e in expect.items()), F.lit(0.0))
    return df.withColumn("hwe_chisq", F.when((n > 0) & (p > 0) & (p < 1), chisq))


def sample_qc(gt: DataFrame, alleles: DataFrame, n_variants: int, key: str = "v", singletons: bool = True) -> DataFrame:
    """Call rate, depth, class counts, singletons (these need the cells a second time), Ti/Tv and het/hom ratio of each sample."""
    g, carried = F.col("gt"), F.col("gt") > 0
    info = alleles.select(key, V.is_snp(F.col("ref"), F.col("alt")).alias("snp"), V.is_transition(F.col("ref"), F.col("alt")).alias("ts"), V.is_insertion(F.col("ref"), F.col("alt")).alias("ins"), V.is_deletion(F.col("ref"), F.col("alt")).alias("del"))
    rows = gt.join(info, key)
    if singletons:
        rows = rows.join(gt.groupBy(key).agg(F.sum("gt").alias("__ac")), key)
    single = [F.count_if(carried & (F.col("__ac") == 1)).alias("n_singleton")] if singletons else []
    quality = [F.avg("gq").alias("gq_mean"), F.stddev_pop("gq").alias("gq_stdev")] if "gq" in gt.columns else []
    out = rows.groupBy("s").agg(
        *quality,
        F.count_if(g.isNotNull()).alias("n_called"), F.avg("dp").alias("dp_mean"), F.stddev_pop("dp").alias("dp_stdev"),
        F.count_if(g == 1).alias("n_het"), F.count_if(g == 2).alias("n_hom_var"), F.count_if(carried & F.col("snp")).alias("n_snp"),
        F.count_if(carried & F.col("ins")).alias("n_insertion"), F.count_if(carried & F.col("del")).alias("n_deletion"),
        *single, F.count_if(carried & F.col("snp") & F.col("ts")).alias("n_ti"), F.count_if(carried & F.col("snp") & ~F.col("ts")).alias("n_tv"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"call_rate": F.col("n_called") / n_variants, "r_ti_tv": ratio("n_ti", "n_tv"), "r_het_hom": ratio("n_het", "n_hom_var")})


def het_ratio_stdev(gt: DataFrame) -> DataFrame:
    """Spread of alternate over reference reads among heterozygotes with alternate reads, by sample."""
    ref = F.col("dp") - F.col("ad")
    rows = gt.where((F.col("gt") == 1) & (F.col("ad") > 0))
    return rows.groupBy("s").agg(F.count(F.lit(1)).alias("n_het"), F.stddev_pop(ref / F.col("ad")).alias("het_ratio_sd"))


def sample_tier(qc: Column | None = None, call_rate: float = 0.9, dp: float = 20.0, sd: float = 1.0) -> Column:
    """Tier 1 passes everything, 2 all but the spread, 3 all but depth, 4 is the rest."""
    good = F.col("call_rate") >= call_rate
    deep, tight = F.col("dp_mean") >= dp, F.coalesce(F.col("het_ratio_sd") <= sd, F.lit(False))
    return F.when(good & deep & tight, 1).when(good & deep, 2).when(good, 3).otherwise(4)


#: Fixed values of two profiles: exome-like autosomes, and whole genomes. Slopes and levels of spread against depth, and Ti/Tv ranges.
PROFILES = {
    "autosomes": {"dp_sd": 8, "dp_line": (0.12, 2.7), "gq_line": (-0.68, 36), "ti_tv": (3.8, 4.3), "singletons": 0.001, "sex": True},
    "genomes": {"dp_sd": 6, "dp_line": (-0.05, 7.5), "gq_line": (-0.68, 38), "ti_tv": (2.05, 2.15), "singletons": None, "sex": False},
}


def quality_tier(profile: str) -> Column:
    """Tier 1 to 4 of a sample from its metrics, as ``sample_qc`` and ``het_ratio_stdev`` name them, and ``f`` of ``impute_sex``.

    Under ``autosomes`` few of the alternates may be singletons, and the sex must be clear.
    """
    c, p = F.col, PROFILES[profile]
    share = c("n_singleton") / F.nullif(c("n_snp") + c("n_insertion") + c("n_deletion"), F.lit(0))
    always = (c("het_ratio_sd") < 1.0) & (c("r_het_hom") < 2) & (share < p["singletons"] if p["singletons"] is not None else F.lit(True)) & (((c("f") < 0.2) | (c("f") > 0.8)) if p["sex"] else F.lit(True))
    line = lambda name: p[name][0] * c("dp_mean") + p[name][1]
    one = (c("call_rate") > 0.996) & (c("dp_stdev") < p["dp_sd"]) & (c("het_ratio_sd") < 0.7) & (c("dp_stdev") < line("dp_line")) & (c("gq_stdev") < line("gq_line")) & (c("r_ti_tv") > p["ti_tv"][0]) & (c("r_ti_tv") < p["ti_tv"][1])
    return F.when(always & one, 1).when(always & (c("call_rate") > 0.98) & (c("dp_stdev") < 10), 2).when(always & (c("call_rate") > 0.96), 3).otherwise(4)


def sex_match(imputed: Column, reported_female: Column) -> Column:
    """Whether the imputed sex is the reported one; no where none was imputed."""
    return F.coalesce((imputed == "female") == reported_female, F.lit(False))


def cohort_allele_counts(gt: DataFrame, s: DataFrame, v: DataFrame, controls: str = "Z", key: str = "v") -> DataFrame:
    """Genotype counts and allele counts by sex, without controls; on X a male's alleles count half."""
    rows = gt.join(s.where(F.col("cohort") != controls).select("s", "is_female"), "s").join(v.select(key, "contig"), key).where("gt IS NOT NULL")
    female, male_x = F.col("is_female"), ~F.col("is_female") & (F.col("contig") == "X")
    weight = F.when(male_x, 0.5).otherwise(1.0)
    pick = lambda who, g: F.count_if(who & (F.col("gt") == g))
    out = rows.groupBy(key, "contig").agg(
        F.count(F.lit(1)).alias("ns"),
        *[pick(female, g).alias(f"female_{g}") for g in range(3)], *[pick(~female, g).alias(f"male_{g}") for g in range(3)],
        F.sum(F.col("gt") * weight).alias("ac"), F.sum(2 * weight).alias("an"),
    )
    return out.withColumn("af", F.when(F.col("an") > 0, F.col("ac") / F.col("an")))


def genotype_counts(gt: DataFrame, by: DataFrame, group: str, key: str = "v", parts: int | None = None) -> DataFrame:
    """nRR, nRA, nAA and n_missing of each variant in each group and (null group) in all, by one pass of grouping sets; cells meet their samples in ``parts`` partitions, if given."""
    g = F.col("gt")
    gt = gt.repartition(parts, "s") if parts else gt
    rows = gt.join(by.select("s", group).hint("merge"), "s")  # samples grow with the cells
    sets = rows.groupingSets([[F.col(key), F.col(group)], [F.col(key)]], key, group)
    return sets.agg(F.count_if(g == 0).alias("n_rr"), F.count_if(g == 1).alias("n_ra"), F.count_if(g == 2).alias("n_aa"), F.count_if(g.isNull()).alias("n_missing"))


def summarize(v: DataFrame, gt: DataFrame, n_samples: int) -> DataFrame:
    """One row: variants, multi-allelics, alleles by category, most alleles, call rate."""
    alleles = split_multi(v)
    kinds = alleles.groupBy().agg(*[F.count_if(V.category(F.col("ref"), F.col("alt")) == k).alias(f"n_{k}") for k in ("snp", "insertion", "deletion", "complex", "star")])
    sites = v.agg(F.count(F.lit(1)).alias("n_variants"), F.count_if(F.size("alts") > 1).alias("n_multiallelic"), F.max(F.size("alts") + 1).alias("max_alleles"), F.countDistinct("contig").alias("n_contigs"))
    calls = gt.agg(F.count_if(F.col("gt").isNotNull()).alias("n_calls"))
    one = F.lit(1)
    out = kinds.withColumn("k", one).join(sites.withColumn("k", one), "k").join(calls.withColumn("k", one), "k").drop("k")
    return out.withColumn("call_rate", F.col("n_calls") / (F.col("n_variants") * n_samples))


def impute_sex(gt: DataFrame, v: DataFrame, key: str = "v") -> DataFrame:
    """Inbreeding on X: observed against expected homozygotes; female below 0.2, male above 0.8."""
    x = gt.where("gt IS NOT NULL").join(v.where(F.col("contig") == "X").select(key), key)
    freq = x.groupBy(key).agg((F.sum("gt") / (2.0 * F.count(F.lit(1)))).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1 AND p > 0 AND p < 1")
    hom = 1 - 2 * F.col("p") * (1 - F.col("p")) * (2 * F.col("n")) / (2 * F.col("n") - 1)
    rows = x.join(freq.select(key, hom.alias("e_hom")), key)
    out = rows.groupBy("s").agg(F.count_if(F.col("gt") != 1).alias("o_hom"), F.sum("e_hom").alias("e_hom"), F.count(F.lit(1)).alias("n"))
    f = (F.col("o_hom") - F.col("e_hom")) / (F.col("n") - F.col("e_hom"))
    out = out.withColumn("f", F.when(F.col("n") > F.col("e_hom"), f))
    return out.withColumn("sex", F.when(F.col("f") < 0.2, "female").when(F.col("f") > 0.8, "male"))


def pair_sums(cells: DataFrame, values: list[str], forms: dict[str, list[tuple[int, int]]], of: str, key: str = "v", sites: int = 4096, people: int = 512, itself: bool = False) -> DataFrame:
    """(s1, s2, names of ``forms``): sums over sites for every pair of samples that share one, by blocks.

    ``cells`` is (key, s, values). A form is a sum of products, each of a value of the first sample and one of the second, by
    their numbers; after the values comes a last one that is 1 in every cell. The last form counts the shared sites.

    Cells are dealt into blocks of about ``sites`` sites and, once for each other block of samples, pairs of blocks of
    about ``people`` samples. A task multiplies matrices (sites x samples) or, where cells are few, looks at the pairs of cells
    only. What moves are cells times blocks of samples and a row a pair and block of sites, never a row for each
    pair at each site. Where the pairs of cells themselves are fewer than that, as with many samples of a few cells
    each, sites bring their pairs together (``pairs_of_sites``), and what moves is their number.
    """
    g = cells.select(F.xxhash64(key).alias("__v"), "s", *values)
    n = g.agg(F.approx_count_distinct("__v").alias("v"), F.approx_count_distinct("s").alias("s"), F.count(F.lit(1)).alias("n")).first()
    n_sites, n_people = max(1, -(-n["v"] // sites)), max(1, -(-n["s"] // people))
    meet = n["n"] * n["n"] // max(1, 2 * n["v"])
    if meet < n["n"] * n_people + n["s"] * n["s"] // 2 * n_sites:
        return pairs_of_sites(g, values, forms, of, itself, max(g.sparkSession.sparkContext.defaultParallelism, meet >> 20))
    rows = g.select("*", F.pmod("__v", F.lit(n_sites)).alias("block"), F.pmod(F.xxhash64("s"), F.lit(n_people)).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_people - 1))))
    rows = rows.select("__v", "s", *values, "own", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = dict(cells.dtypes)["s"]

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__v")
        _, place = np.unique(part["__v"].to_numpy(), return_inverse=True)
        names, who = np.unique(part["s"].to_numpy(), return_inverse=True)
        cell = np.stack([*[part[v].to_numpy(float) for v in values], np.ones(len(part))])
        own, n = part["own"].to_numpy(), place.max() + 1
        one, two = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        in_one, in_two = np.bincount(place[one], minlength=n), np.bincount(place[two], minlength=n)
        meet = int((in_one * in_two).sum())
        size = len(names)
        if meet < 1 << 24 and 50 * meet < n * len(np.unique(who[one])) * len(np.unique(who[two])):
            each = in_two[place[one]]
            p = np.repeat(one, each)
            q = two[np.repeat((np.cumsum(in_two) - in_two)[place[one]] - np.cumsum(each) + each, each) + np.arange(len(p))]
            p, q = np.where(who[p] <= who[q], p, q), np.where(who[p] <= who[q], q, p)
            pairs, at = np.unique(who[p] * size + who[q], return_inverse=True)
            x, y = pairs // size, pairs % size
            sums = np.stack([np.bincount(at, weights=sum(cell[i][p] * cell[j][q] for i, j in form), minlength=len(pairs)) for form in forms.values()])
            if key[1] == key[2]:  # both orders of a pair were met
                sums = np.where(x == y, sums, sums / 2)
        else:
            every = np.zeros((len(cell), n, size))
            every[:, place, who] = cell
            left, right = np.unique(who[one]), np.unique(who[two])
            a, b = every[:, :, left], every[:, :, right]
            sums = np.stack([sum(a[i].T @ b[j] for i, j in form) for form in forms.values()])
            back = np.stack([sum(a[j].T @ b[i] for i, j in form) for form in forms.values()])
            x, y = np.nonzero((sums[-1] > 0) & ((left[:, None] <= right[None, :]) if key[1] == key[2] else True))
            sums, back, x, y = sums[:, x, y], back[:, x, y], left[x], right[y]
            sums = np.where(x <= y, sums, back)  # the smaller sample first, and what belongs to either with it
            x, y = np.minimum(x, y), np.maximum(x, y)
        keep = np.full(len(x), True) if itself else x != y
        x, y, sums = x[keep], y[keep], sums[:, keep]
        if of == "long":
            sums = np.rint(sums).astype(np.int64)
        return pd.DataFrame({"s1": names[x], "s2": names[y]}).assign(**dict(zip(forms, sums, strict=True)))

    part = rows.groupBy("block", "i", "j").applyInPandas(count, f"s1 {kind}, s2 {kind}, " + ", ".join(f"{c} {of}" for c in forms))
    return part.groupBy("s1", "s2").agg(*[F.sum(c).alias(c) for c in forms])


def pairs_of_sites(g: DataFrame, values: list[str], forms: dict[str, list[tuple[int, int]]], of: str, itself: bool, parts: int, most: int = 2048, room: int = 1 << 22) -> DataFrame:
    """As ``pair_sums``, of cells (__v, s, values): every site pairs its own cells.

    A site of more than ``most`` cells is dealt as pairs of chunks, so that none is one task's work. A task sums the pairs
    of many sites, about ``room`` at a time, and hands on a row a first sample, with its partners and their sums as
    arrays; these meet in ``parts`` parts by the first sample.
    """
    kind = dict(g.dtypes)["s"]
    small = "int" if of == "long" else of
    chunks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("__v")) / most)
    rows = g.withColumn("m", chunks).withColumn("own", F.when(F.col("m") > 1, F.pmod(F.xxhash64("s"), F.col("m"))).otherwise(0).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)))
    rows = rows.select("__v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "s", *values)
    rows = rows.repartition(parts, "__v", "i", "j").sortWithinPartitions("__v", "i", "j")

    def summed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda c: t.column(c).to_numpy()
        group = np.concatenate([[0], np.cumsum((np.diff(col("__v")) != 0) | (np.diff(col("i")) != 0) | (np.diff(col("j")) != 0))])
        names, who = np.unique(t.column("s").to_pandas().to_numpy(), return_inverse=True)
        cell = np.stack([*[col(v).astype(float) for v in values], np.ones(len(group))])
        one, two = col("own") == col("i"), col("own") == col("j")
        n = group[-1] + 1
        in_one, in_two = np.bincount(group[one], minlength=n), np.bincount(group[two], minlength=n)
        part = np.cumsum(in_one * in_two) // room
        first = np.searchsorted(group, np.arange(n + 1))
        for a in np.unique(part):
            low, high = first[np.searchsorted(part, a)], first[np.searchsorted(part, a, "right")]
            p1, p2 = low + np.flatnonzero(one[low:high]), low + np.flatnonzero(two[low:high])
            each = in_two[group[p1]]
            start = np.searchsorted(group[p2], group[p1])
            p = np.repeat(p1, each)
            q = p2[np.repeat(start - np.cumsum(each) + each, each) + np.arange(len(p))]
            whole = np.repeat(two[p1], each)  # chunks paired with themselves meet both orders
            keep = np.where(whole, who[p] < who[q], who[p] != who[q]) | (itself & (p == q))
            p, q = p[keep], q[keep]
            p, q = np.where(who[p] <= who[q], p, q), np.where(who[p] <= who[q], q, p)
            pairs, at = np.unique(who[p] * len(names) + who[q], return_inverse=True)
            if not len(pairs):
                continue
            sums = [np.bincount(at, weights=sum(cell[x][p] * cell[y][q] for x, y in form), minlength=len(pairs)) for form in forms.values()]
            left, cut = np.unique(pairs // len(names), return_index=True)
            ends = pa.array(np.append(cut, len(pairs)).astype(np.int32))
            listed = lambda x, ends=ends: pa.ListArray.from_arrays(ends, pa.array(x))
            of_type = (lambda x: np.rint(x).astype(np.int32)) if of == "long" else (lambda x: x)
            yield pa.RecordBatch.from_arrays([pa.array(names[left]), listed(names[pairs % len(names)]), *[listed(of_type(x)) for x in sums]], names=["s1", "s2", *forms])

    def whole_sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 1 << 16:
                t = pa.Table.from_batches(held)
                key = [t.column(c).to_numpy() for c in ("__v", "i", "j")]
                other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
                done = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
                if done:
                    yield from summed(t.slice(0, done))
                held = t.slice(done).combine_chunks().to_batches()
        if sum(x.num_rows for x in held):
            yield from summed(pa.Table.from_batches(held))

    names = list(forms)
    part = rows.mapInArrow(whole_sites, f"s1 {kind}, s2 array<{kind}>, " + ", ".join(f"{c} array<{small}>" for c in names)).repartition(parts, "s1")
    flat = part.select("s1", F.inline(F.arrays_zip("s2", *names)))
    return flat.groupBy("s1", "s2").agg(*[F.sum(c).alias(c) for c in names])


def king_kinship(gt: DataFrame, key: str = "v", sites: int = 4096, people: int = 512) -> DataFrame:
    """KING-robust kinship of every pair of samples that share called sites: counts of genotype pairs, by blocks."""
    cells = gt.where("gt IS NOT NULL").select(key, "s", *[(F.col("gt") == i).cast("int").alias(f"g{i}") for i in range(3)])
    forms = {"het_het": [(1, 1)], "opposite": [(0, 2), (2, 0)], "het1": [(1, 3)], "het2": [(3, 1)], "n_sites": [(3, 3)]}
    sums = pair_sums(cells, ["g0", "g1", "g2"], forms, "long", key, sites, people)
    least = F.least("het1", "het2")
    kin = (F.col("het_het") - 2 * F.col("opposite")) / (2.0 * least) + 0.5 - 0.25 * (F.col("het1") + F.col("het2")) / least
    return sums.withColumn("kin", F.when(least > 0, kin))


def related_to_drop(pairs: DataFrame, s: DataFrame, least_sites: int = 1) -> DataFrame:
    """Samples to drop: the same person twice in one cohort drops both, otherwise one (the higher id) of any pair up to degree 2.

    Pairs that share fewer than ``least_sites`` called sites (``n_sites``) are not judged: over a few sites strangers may look alike.
    """
    named = pairs.where(F.col("n_sites") >= least_sites).withColumn("degree", V.kin_degree(F.col("kin"))).where("kin IS NOT NULL AND degree <= 2")
    c = s.select("s", "cohort")
    rows = named.join(c.select(F.col("s").alias("s1"), F.col("cohort").alias("c1")), "s1").join(c.select(F.col("s").alias("s2"), F.col("cohort").alias("c2")), "s2")
    both = (F.col("degree") == 0) & (F.col("c1") == F.col("c2"))
    return rows.select(F.explode(F.when(both, F.array("s1", "s2")).otherwise(F.array(F.greatest("s1", "s2")))).alias("s")).distinct()


def ld_blocks(n_cells: int, n_sites: int, bases: int, people: int, fill: int) -> tuple[int, int]:
    """(bases of a bin of about ``fill`` cells, blocks of samples of about ``people`` cells of a variant): neither grows with the number of samples."""
    return min(max(1 << 12, bases * fill // max(1, n_cells)), 1 << 26), max(1, -(-n_cells // max(1, n_sites * people)))


def ld_r2(gt: DataFrame, v: DataFrame, window: int, key: str = "v", parts: int = 1, people: int = 1024, strip: int = 512, least: int | None = None, fill: int = 1 << 15) -> DataFrame:
    """Squared correlation of dosages for pairs of variants at most ``window`` bases apart on one contig.

    Variants lie in bins of a ``parts``-th of the window, or of ``least`` bases where that is more (without it, so many
    that a bin has about ``fill`` cells), and samples in blocks: as many as ``people`` goes into a variant's mean number of cells, so
    that few cells are not dealt out to very many tasks. A task has two bins that may hold a pair and one block of samples, as matrices of dosages and of
    calls whose products are the sums of its pairs, ``strip`` variants at a time; where cells are few it meets pairs of
    cells instead. What moves are cells,
    once for every bin that they may pair with, and a row a pair and block of samples where there are several, never a row for each pair and sample.
    """
    calls = gt.where("gt IS NOT NULL").select(key, "s", F.col("gt").cast("long").alias("gt"))
    n_cells = calls.count()
    spans = v.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), (F.max("pos") - F.min("pos") + 1).cast("long").alias("bases")).agg(F.sum("n").alias("n"), F.sum("bases").alias("bases")).first()  # one row
    filled, n_blocks = ld_blocks(n_cells, spans["n"] or 0, spans["bases"] or 0, people, fill)
    width = max(-(-window // parts), least or filled)
    parts = -(-window // width)
    at_site = v.select(key, "contig", F.col("pos").cast("long").alias("pos")).hint("merge")  # sites grow with the cells
    cells = calls.join(at_site, key).withColumn("block", F.pmod(F.xxhash64("s"), F.lit(n_blocks)))
    roles = [(0, d, 0) for d in range(parts + 1)] + [(-d, d, 1) for d in range(1, parts + 1)]
    at = F.floor(F.col("pos") / width)
    dealt = cells.withColumn("__r", F.explode(F.array(*[F.struct((at + i).alias("bin"), F.lit(d).alias("apart"), F.lit(side).alias("side")) for i, d, side in roles])))
    dealt = dealt.select(key, "s", "gt", "contig", "pos", "block", "__r.bin", "__r.apart", "__r.side")
    names, kind = ("n", "sx", "sy", "sxx", "syy", "sxy"), dict(v.dtypes)[key]

    def products(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(who=np.unique(part["s"].to_numpy(), return_inverse=True)[1])
        left = part[part["side"] == 0].sort_values("who")
        right = left if keys[2] == 0 else part[part["side"] == 1].sort_values("who")
        found = [pair_products(left, right, key, window, int(part["who"].max()) + 1, strip)] if len(left) and len(right) else []
        return found[0] if found else pd.DataFrame({c: [] for c in ("v1", "v2", *names)}, dtype=object)

    sums = dealt.groupBy("contig", "bin", "apart", "block").applyInPandas(products, f"v1 {kind}, v2 {kind}, " + ", ".join(f"{c} long" for c in names))
    if n_blocks > 1:  # a pair's calls lie in several tasks; else they meet in one, and pairs, which are many in a wide window, needn't move
        sums = sums.groupBy("v1", "v2").agg(*[F.sum(c).alias(c) for c in names])
    n, x, y = F.col("n"), F.col("sx"), F.col("sy")
    dx, dy = n * F.col("sxx") - x * x, n * F.col("syy") - y * y
    cov = n * F.col("sxy") - x * y
    return sums.where((dx > 0) & (dy > 0)).select("v1", "v2", "n", (F.signum(cov.cast("double"))).alias("sign"), (cov.cast("double") * cov / (dx.cast("double") * dy)).alias("r2"))


def pair_products(left: pd.DataFrame, right: pd.DataFrame, key: str, window: int, n_people: int, strip: int) -> pd.DataFrame:
    """Sums over shared samples of each pair of variants, the first before the second by at most ``window``; both frames ordered by ``who``."""
    sides = []
    for f in (left, right):
        at, names = pd.factorize(f[key])
        pos = np.zeros(len(names), np.int64)
        pos[at] = f["pos"].to_numpy()
        order = np.argsort(pos, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        sides.append((pos[order], np.asarray(names)[order], place[at], f["who"].to_numpy(), f["gt"].to_numpy(np.int64)))
    (pos_l, key_l, at_l, who_l, gt_l), (pos_r, key_r, at_r, who_r, gt_r) = sides
    base = min(pos_l[0], pos_r[0])
    span = max(pos_l[-1], pos_r[-1]) - base + window + 2
    order = np.lexsort((pos_r[at_r], who_r))
    code, mine = (who_r * span + pos_r[at_r] - base)[order], who_l * span + pos_l[at_l] - base
    start = np.searchsorted(code, mine + 1)
    each = np.searchsorted(code, mine + window + 1) - start  # partners of each left cell: its sample's right ones within the window
    near = np.searchsorted(pos_r, pos_l + window, "right") - np.searchsorted(pos_r, pos_l, "right")
    none = [np.zeros(0)] * 8
    out = [none]
    if 50 * each.sum() < near.sum() * n_people:  # few cells: some million pairs of them at a time
        cuts = np.flatnonzero(np.diff(np.cumsum(each) // (1 << 22), prepend=0))
        for a, b in zip([0, *cuts], [*cuts, len(each)]):
            p = np.repeat(np.arange(a, b), each[a:b])
            q = order[np.repeat(start[a:b], each[a:b]) + np.arange(len(p)) - np.repeat(np.cumsum(each[a:b]) - each[a:b], each[a:b])]
            pairs, i = np.unique(at_l[p] * len(pos_r) + at_r[q], return_inverse=True)
            x, y = gt_l[p], gt_r[q]
            out.append([pairs // len(pos_r), pairs % len(pos_r), *[np.rint(np.bincount(i, weights=w, minlength=len(pairs))) for w in (np.ones(len(x)), x, y, x * x, y * y, x * y)]])
    else:
        for a in range(0, len(pos_l), strip):
            low, high = np.searchsorted(pos_r, pos_l[a], "right"), np.searchsorted(pos_r, pos_l[min(a + strip, len(pos_l)) - 1] + window, "right")
            in_l, in_r = (at_l >= a) & (at_l < a + strip), (at_r >= low) & (at_r < high)
            m, g = np.zeros((2, min(strip, len(pos_l) - a), n_people))
            mr, gr = np.zeros((2, high - low, n_people))
            m[at_l[in_l] - a, who_l[in_l]], g[at_l[in_l] - a, who_l[in_l]] = 1, gt_l[in_l]
            mr[at_r[in_r] - low, who_r[in_r]], gr[at_r[in_r] - low, who_r[in_r]] = 1, gt_r[in_r]
            gap = pos_r[None, low:high] - pos_l[a : a + strip, None]
            n = m @ mr.T
            i, j = np.nonzero((gap > 0) & (gap <= window) & (n > 0))
            out.append([i + a, j + low, *[np.rint(t[i, j]) for t in (n, g @ mr.T, m @ gr.T, (g * g) @ mr.T, m @ (gr * gr).T, g @ gr.T)]])
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
    pairs, i = np.unique(columns[0] * len(pos_r) + columns[1], return_inverse=True)
    sums = {c: np.rint(np.bincount(i, weights=w, minlength=len(pairs))).astype(np.int64) for c, w in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), columns[2:])}
    named = lambda names, at: pd.Series(names[at], dtype=names.dtype if names.dtype.kind in "iu" else object)
    return pd.DataFrame({"v1": named(key_l, pairs // len(pos_r)), "v2": named(key_r, pairs % len(pos_r)), **sums})


def concordance(a: DataFrame, b: DataFrame, key: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts over state of a x state of b: NoData, NoCall, HomRef, Het, HomVar; for each sample or variant with ``by``."""

    def state(gt: str, there: str) -> Column:
        return F.when(F.col(there).isNull(), "NoData").when(F.col(gt).isNull(), "NoCall").when(F.col(gt) == 0, "HomRef").when(F.col(gt) == 1, "Het").otherwise("HomVar")

    left = a.select(key, "s", F.col("gt").alias("ga"), F.lit(1).alias("in_a"))
    right = b.select(key, "s", F.col("gt").alias("gb"), F.lit(1).alias("in_b"))
    return left.join(right, [key, "s"], "full").groupBy(*by, state("ga", "in_a").alias("a"), state("gb", "in_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def judgement(a: Column, b: Column) -> Column:
    """A tested state against the truth's: true or false, positive or negative; DZ where the two carry different doses, null without data."""
    called = lambda x: x.isin("HomRef", "Het", "HomVar")
    carries = lambda x: x.isin("Het", "HomVar")
    both = called(a) & called(b)
    return F.when(both & carries(a) & carries(b), F.when(a == b, "TP").otherwise("DZ")).when(both & carries(a), "FP").when(both & carries(b), "FN").when(both, "TN")


def genotype_wide(gt: DataFrame, ids: list[int], key: str = "v") -> DataFrame:
    """One column per named sample."""
    out = gt.where(F.col("s").isin(ids)).groupBy(key).pivot("s", ids).agg(F.first("gt"))
    return out.select(key, *[F.col(str(i)).alias(f"s{i}") for i in ids])


def top1(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
