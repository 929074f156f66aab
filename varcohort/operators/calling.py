"""Somatic calling and allelic-imbalance operators over depth tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variant as V
from ..functions.variant import complement
from .blocked import BLOCK, scan
from .genotype import hwe_chisq, variant_qc
from .intervals import in_intervals
from .models import snr_thresholds
from .series import triplet_context
from .shared import keep
from .stats import log_choose, with_hwe


def powered(pile: DataFrame, cap: int = 100, **params: float) -> DataFrame:
    """Loci (contig, pos, ref, n_A .. n_T) that could be called: depth, reads, the commonest other base and its reads, thresholds.

    Depths above ``cap``, and those at which no threshold reaches the ratio, are skipped. Thresholds depend on the
    depth alone: one row a depth, at most ``cap`` of them.
    """
    limits = [(d, *t) for d, t in snr_thresholds(list(range(1, cap + 1)), **params).items() if t]
    table = pile.sparkSession.createDataFrame(limits or [(0, 1, 0, 0.0, 0.0)], "dp int, least int, most int, sens double, snr double")
    counts = F.array(*[F.struct((-F.col(f"n_{b}")).alias("n"), F.lit(b).alias("base")) for b in "ACGT"])
    best = F.array_min(F.filter(counts, lambda x: x["base"] != F.col("ref")))
    total = F.col("n_A") + F.col("n_C") + F.col("n_G") + F.col("n_T")
    own = F.coalesce(-F.filter(counts, lambda x: x["base"] == F.col("ref"))[0]["n"], F.lit(0))
    rows = pile.withColumns({"dp": total, "rd": own, "alt": best["base"], "ad": -best["n"]})
    return rows.join(F.broadcast(table), "dp")  # at most ``cap`` rows


def detected() -> Column:
    """Whether all other bases' reads together lie within the thresholds."""
    return (F.col("dp") - F.col("rd")).between(F.col("least"), F.col("most"))


def subclonal_calls(pile: DataFrame, cap: int = 100, **params: float) -> DataFrame:
    """Loci called, with the commonest other base (ties alphabetical), sensitivity and ratio."""
    return powered(pile, cap, **params).where(detected()).drop("least", "most")


def scan_pileup(pile: DataFrame, blacklist: DataFrame, cap: int = 100, key: str = "v", **params: float) -> tuple[DataFrame, DataFrame]:
    """(calls, opportunity) of a pileup with blacklisted intervals (contig, start0, end0).

    Calls carry the reference triplet, turned where its centre is A or G, and the alternate turned with it; the
    triplet needs the loci on both sides in the pileup, blacklisted or of any depth though they may be, and a call at
    the end of a stretch has none. Opportunity is the summed sensitivity of powered loci by triplet.
    """
    around = triplet_context(pile)
    tested = in_intervals(powered(around, cap, **params), blacklist, key).where("NOT inside")
    alt = F.when(F.col("flipped"), complement(F.col("alt"))).otherwise(F.col("alt"))
    calls = tested.where(detected()).select(key, "contig", "pos", "triplet", alt.alias("alt"), F.when(F.col("flipped"), -1).otherwise(1).alias("strand"), "dp", "rd", "ad", "sens", "snr")
    return calls, opportunity(tested)


def opportunity(tested: DataFrame) -> DataFrame:
    """Summed sensitivity by reference triplet of all loci that could be called."""
    return tested.where("triplet IS NOT NULL").groupBy("triplet").agg(F.sum("sens").alias("background"))


def mark_fixed(trace: DataFrame, eps: float = 0.01, alpha: float = 0.05) -> DataFrame:
    """Adds ``het``: neither allele's reads can be errors, by binomial tails at ``eps`` and a third of it.

    The least counts of both tails are found once for each depth that occurs, by the same exact tail at any depth,
    as Arrow batches, and joined back by depth.
    """

    def least(n: int, p: float) -> int:
        """Smallest k whose upper tail is below ``alpha``; mass further than forty deviations from the mean is nothing."""
        mean, wide = n * p, 40 * (n * p * (1 - p)) ** 0.5 + 40
        k = np.arange(max(0, int(mean - wide)), min(n, int(mean + wide)) + 1)
        pmf = np.exp(log_choose(np.full(len(k), n), k) + k * np.log(p) + (n - k) * np.log1p(-p))
        rare = np.flatnonzero(np.cumsum(pmf[::-1])[::-1] < alpha)
        return int(k[rare[0]]) if len(rare) else n + 1

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(k_alt=[least(n, eps / 3) for n in b["dp"]], k_ref=[least(n, eps) for n in b["dp"]])

    depths = trace.select(F.col("dp").cast("long").alias("dp")).distinct().where("dp IS NOT NULL")
    rows = trace.join(depths.mapInPandas(tails, "dp long, k_alt long, k_ref long"), "dp", "left")
    het = (F.col("ad") >= F.col("k_alt")) & (F.col("dp") - F.col("ad") >= F.col("k_ref"))
    return rows.withColumn("het", het).drop("k_alt", "k_ref")


def loh_runs(trace: DataFrame, by: str, pos: str, value: str, least: int = 3, spread: float = 3.0) -> DataFrame:
    """Runs of loci whose value is below the series' median less ``spread`` median absolute deviations."""
    m = trace.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    mad = trace.join(m, by).groupBy(by).agg(F.max("__m").alias("__m"), F.percentile(F.abs(F.col(value) - F.col("__m")), F.lit(0.5)).alias("__s"))
    block, one = F.floor(F.col(pos) / BLOCK), F.lit(1)
    rows = trace.join(mad, by).withColumn("__low", F.col(value) < F.col("__m") - spread * F.col("__s")).withColumn("__one", one)
    # low loci in a row have a constant difference of their rank among all and among the low ones
    low = scan(scan(rows, [by], pos, block, "__one", "__all").where("__low"), [by], pos, block, "__one", "__own")
    rows = low.withColumn("__g", F.col("__all") - F.col("__own"))
    out = rows.groupBy(by, "__g").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"))
    return out.where(F.col("n") >= least).drop("__g")


def loh_trace(trace: DataFrame, by: str, pos: str, width: int = 5, block: int = 1 << 16) -> DataFrame:
    """Folded allele shares, depth relative to the series' median, and a windowed median of the shares.

    Windows slide over blocks of ``block`` loci, which overlap by ``width`` at each end.
    """
    folded = F.least(F.col("ad") / F.col("dp"), 1 - F.col("ad") / F.col("dp"))
    rows = trace.where("dp > 0").withColumn("vaf", folded).withColumn("__one", F.lit(1))
    med = rows.groupBy(by).agg(F.percentile("dp", F.lit(0.5)).alias("__med"))
    ranked = scan(rows, [by], pos, F.floor(F.col(pos) / BLOCK), "__one", "__i")
    own = lambda d: F.floor((F.col("__i") + d) / block)
    near = Window.partitionBy(by, "__b").orderBy(pos).rowsBetween(-width, width)
    dealt = ranked.withColumn("__b", F.explode(F.array_distinct(F.array(own(-width), own(0), own(width)))))
    dealt = dealt.withColumn("__near", F.array_sort(F.collect_list("vaf").over(near))).where(F.col("__b") == own(0))
    out = dealt.join(med, by).withColumn("rel_depth", F.col("dp") / F.col("__med"))
    return out.withColumn("smooth", F.element_at("__near", ((F.size("__near") + 1) / 2).cast("int"))).drop("__one", "__i", "__b", "__near", "__med")


def calibrate_loci(a: DataFrame, b: DataFrame, gc: DataFrame, key: str = "v", delta: float = 0.05) -> DataFrame:
    """Loci whose affinity (v, affinity, variance) is steady in two cohorts: after each filter, rescaled to a mean of one."""

    def scaled(t: DataFrame) -> DataFrame:
        """Both affinities over their means; ``t`` is written, since it is read for the means and for the rows."""
        t = keep(t)
        mean = t.agg(F.avg("a").alias("__a"), F.avg("b").alias("__b"))
        return t.join(F.broadcast(mean)).withColumns({"a": F.col("a") / F.col("__a"), "b": F.col("b") / F.col("__b")}).drop("__a", "__b")  # one row

    rows = a.select(key, F.col("affinity").alias("a"), F.col("variance").alias("va")).join(b.select(key, F.col("affinity").alias("b"), F.col("variance").alias("vb")), key)
    rows = scaled(rows.join(gc.select(key, "gc"), key).where(F.col("gc").between(0.3, 0.55)))
    for c, v in (("a", "va"), ("b", "vb")):
        rows = scaled(rows.where(F.col(c).between(0.5, 1.5) & (F.col(v) <= 4 * F.col(c))))
    return rows.where(F.abs(F.col("a") - F.col("b")) < delta).select(key, ((F.col("a") + F.col("b")) / 2).alias("affinity"))


def gc_windows(loci: DataFrame, bases: DataFrame, widths: tuple[int, ...] = (100, 200, 400, 800), key: str = "v") -> DataFrame:
    """Share of G and C among known bases in windows around each locus; (contig, pos, base) is the reference."""
    most = max(widths)
    a = loci.select(key, "contig", F.col("pos").alias("p"), F.explode(F.array(*[F.floor(F.col("pos") / most) + d for d in (-1, 0, 1)])).alias("bin"))
    b = bases.where(F.col("base").isin("A", "C", "G", "T")).select("contig", "pos", "base", F.floor(F.col("pos") / most).alias("bin"))
    near = a.join(b, ["contig", "bin"]).withColumn("d", F.abs(F.col("pos") - F.col("p"))).where(F.col("d") <= most / 2)
    inside = lambda w: F.col("d") <= w / 2
    out = near.groupBy(key).agg(*[(F.count_if(inside(w) & F.col("base").isin("G", "C")) / F.nullif(F.count_if(inside(w)), F.lit(0))).alias(f"gc{w}") for w in widths])
    return loci.select(key).join(out, key, "left")


def signature_posterior(calls: DataFrame, weights: DataFrame, load: DataFrame) -> DataFrame:
    """Probability that a call (id, s, class) is of signature a rather than b, by class weights and the sample's loads."""
    rows = calls.join(weights, "class").join(load, "s")
    a, b = F.col("w_a") * F.col("load_a"), F.col("w_b") * F.col("load_b")
    return rows.withColumn("posterior", F.when(a + b > 0, a / (a + b)))


def rescue_with_tags(models: DataFrame, tags: DataFrame, inside: DataFrame, least: float = 0.9) -> DataFrame:
    """Models (id, v, coef) whose variant lies in trusted regions, or else its nearest tag there, the sign turned with the phase.

    ``tags`` is (v, tag, r2, sign, distance), those below ``least`` unused; ``inside`` lists trusted variants. What has no
    tag is dropped.
    """
    ok = models.join(inside.select("v"), "v", "left_semi")
    lost = models.join(inside.select("v"), "v", "left_anti")
    near = tags.join(inside.select(F.col("v").alias("tag")), "tag", "left_semi").where(F.col("r2") >= least)
    first = near.withColumn("__n", F.row_number().over(Window.partitionBy("v").orderBy("distance", "tag"))).where("__n = 1")
    new = lost.join(first, "v").select("id", F.col("tag").alias("v"), (F.col("coef") * F.when(F.col("sign") < 0, -1).otherwise(1)).alias("coef"))
    return ok.select("id", "v", "coef").union(new)


def gene_sample_counts(t: DataFrame) -> DataFrame:
    """Samples with a variant in each gene; genes of one sample are pooled as Other."""
    n = t.groupBy("gene").agg(F.countDistinct("s").alias("n"))
    return n.groupBy(F.when(F.col("n") <= 1, "Other").otherwise(F.col("gene")).alias("gene")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_genes"))


def deming(df: DataFrame, x: str, y: str) -> DataFrame:
    """First principal axis after scaling both columns by median and median absolute deviation."""
    m = df.agg(F.percentile(x, F.lit(0.5)).alias("mx"), F.percentile(y, F.lit(0.5)).alias("my"))
    rows = df.join(F.broadcast(m))  # one row
    s = rows.agg(F.percentile(F.abs(F.col(x) - F.col("mx")), F.lit(0.5)).alias("sx"), F.percentile(F.abs(F.col(y) - F.col("my")), F.lit(0.5)).alias("sy"))
    z = rows.join(F.broadcast(s)).select(((F.col(x) - F.col("mx")) / (1.4826 * F.col("sx"))).alias("u"), ((F.col(y) - F.col("my")) / (1.4826 * F.col("sy"))).alias("w"), "mx", "my", "sx", "sy")
    c = z.agg(F.var_samp("u").alias("a"), F.var_samp("w").alias("b"), F.covar_samp("u", "w").alias("c"), *[F.max(k).alias(k) for k in ("mx", "my", "sx", "sy")])
    slope = (F.col("b") - F.col("a") + F.sqrt((F.col("b") - F.col("a")) ** 2 + 4 * F.col("c") ** 2)) / (2 * F.col("c"))
    out = c.withColumn("slope", slope * F.col("sy") / F.col("sx"))
    return out.select("slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def scale_to_reference(df: DataFrame, by: str, low: str, high: str, group: str, reference: str) -> DataFrame:
    """Every group's interval in units where the reference's runs from -0.5 to 0.5."""
    ref = df.where(F.col(group) == reference).select(by, F.col(low).alias("__l"), F.col(high).alias("__h"))
    unit = lambda c: F.when(F.col("__h") > F.col("__l"), (F.col(c) - F.col("__l")) / (F.col("__h") - F.col("__l")) - 0.5)
    return df.join(ref, by, "left").withColumns({f"{low}_scaled": unit(low), f"{high}_scaled": unit(high)}).drop("__l", "__h")


def band_density(df: DataFrame, group: str, bands: Column, width: Column) -> DataFrame:
    """Share of each group's rows in each band, divided by the band's width."""
    n = df.where(bands.isNotNull()).groupBy(group, bands.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.first(width).alias("width"))
    total = F.sum("n").over(Window.partitionBy(group))
    return n.select(group, "band", "n", (F.col("n") / total / F.col("width")).alias("density"))


def group_counts(gt: DataFrame, by: DataFrame, group: str, key: str = "v") -> DataFrame:
    g = F.col("gt")
    return gt.join(by.select("s", group), "s").groupBy(key, group).agg(F.count_if(g == 0).alias("n_hom_ref"), F.count_if(g == 1).alias("n_het"), F.count_if(g == 2).alias("n_hom_var"))


def hwe_all_groups(gt: DataFrame, by: DataFrame, group: str, limit: float, key: str = "v") -> DataFrame:
    """Variants whose Hardy-Weinberg chi-square stays below ``limit`` in every group."""
    out = hwe_chisq(group_counts(gt, by, group, key)).groupBy(key).agg(F.max("hwe_chisq").alias("worst"))
    return out.where(F.coalesce(F.col("worst") < limit, F.lit(True)))


def common_snps(v: DataFrame, gt: DataFrame, by: DataFrame, group: str, alpha: float = 0.01, low: float = 0.05, key: str = "v") -> DataFrame:
    """A set of well-behaved common variants: (key, af, worst).

    Autosomal, unfiltered, named, biallelic substitutions that tell their strand, with a frequency from ``low`` to 1 - ``low``, whose
    exact Hardy-Weinberg p is above ``alpha`` over the number of groups in every group.
    """
    alt = F.col("alts")[0]
    fit = V.is_autosomal(F.col("contig")) & (F.size("filters") == 0) & F.col("rsid").isNotNull() & (F.size("alts") == 1) & V.is_snp(F.col("ref"), alt) & V.strand_specific(F.col("ref"), alt)
    n = group_counts(gt, by, group, key)
    groups = by.agg(F.countDistinct(group).alias("n_groups"))
    rows = with_hwe(n).groupBy(key).agg(F.sum(F.col("n_het") + 2 * F.col("n_hom_var")).alias("ac"), F.sum(2 * (F.col("n_hom_ref") + F.col("n_het") + F.col("n_hom_var"))).alias("an"), F.min("hwe_p").alias("worst"))
    rows = rows.withColumn("af", F.col("ac") / F.nullif("an", F.lit(0))).join(F.broadcast(groups))  # one row
    kept = rows.where(F.col("af").between(low, 1 - low) & (F.col("worst") > F.lit(alpha) / F.col("n_groups")))
    return kept.join(v.where(fit).select(key), key).select(key, "af", "worst")


def filter_geno_maf_hwe(gt: DataFrame, n_samples: int, geno: float, maf: float, p: float, drop: DataFrame | None = None, key: str = "v") -> DataFrame:
    """Variants with few missing calls, a common enough minor allele and a mid-p of Hardy-Weinberg's exact test of at least ``p``.

    Samples of ``drop`` (s) are left out first; ``n_samples`` counts the others.
    """
    rows = gt if drop is None else gt.join(drop.select("s"), "s", "left_anti")
    qc = with_hwe(variant_qc(rows, n_samples, key), mid=True)
    minor = F.least(F.col("af"), 1 - F.col("af"))
    return qc.where((1 - F.col("call_rate") <= geno) & (minor >= maf) & (F.col("hwe_p") >= p)).select(key, "call_rate", "af", "hwe_p")
