"""Polygenic scores: sums over a join of models with dosages, null scores by hash-seeded replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variant import af_bin
from .stats import fisher

#: Parts into which models are dealt to meet all samples.
CHUNKS = 64


def score(gt: DataFrame, models: DataFrame, samples: DataFrame, missing: float = 0.01, by: tuple[str, ...] = (), key: str = "v") -> DataFrame:
    """Score of every sample by each model (id, v, aaf, coef): dosage times coefficient, summed.

    A missing genotype counts as twice the data's frequency; a variant that the data lack, or have with more than
    ``missing`` of the samples missing, as twice the model's. Every row of ``samples`` (s) gets a score by every model,
    also without any call. ``by`` names further model keys, such as an iteration. Absent cells are missing genotypes.
    """
    n_samples = samples.count()
    called = gt.where("gt IS NOT NULL").select(key, "s", "gt")
    facts = called.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("gt").alias("ac")).withColumn("usable", F.col("n") >= n_samples * (1 - missing))
    m = models.join(facts, key, "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
    imputed = F.col("coef") * F.when(F.col("usable"), F.col("ac") / F.col("n")).otherwise(2 * F.coalesce("aaf", F.lit(0.0)))
    keys = ["id", *by]
    # every sample starts from all variants imputed; its own calls replace that variant's share
    whole = m.groupBy(*keys).agg(F.sum(imputed).alias("base"))
    own = m.where("usable").select(*keys, key, "coef", (F.col("ac") / F.col("n")).alias("mean")).join(called, key)
    own = own.groupBy(*keys, "s").agg(F.sum(F.col("coef") * (F.col("gt") - F.col("mean"))).alias("own"))
    # the answer has a row for each model and sample: models are dealt over chunks, and every sample visits each chunk
    chunk = F.pmod(F.xxhash64(*keys), F.lit(CHUNKS).cast("long"))
    dealt = whole.groupBy(chunk.alias("__chunk")).agg(F.collect_list(F.struct(*keys, "base")).alias("__m"))
    asked = samples.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHUNKS - 1).cast("long"))).alias("__chunk"))
    every = asked.join(dealt, "__chunk").select("s", F.inline("__m"))
    return every.join(own, [*keys, "s"], "left").select(*keys, "s", (F.col("base") + F.coalesce("own", F.lit(0.0))).alias("score"))


def null_models(models: DataFrame, freq: DataFrame, iters: int, bins: int = 50, seed: int = 1, key: str = "v") -> DataFrame:
    """Each model variant replaced, ``iters`` times, by a random variant of the same frequency bin (with replacement).

    ``freq`` is (v, af). The draw is a hash of seed, iteration and variant, so it doesn't depend on partitioning.
    """
    pool = freq.where("af IS NOT NULL").withColumn("bin", af_bin(F.col("af"), bins))
    w = Window.partitionBy("bin").orderBy(key)
    pool = pool.withColumn("i", F.row_number().over(w) - 1).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("bin")))
    sizes = pool.groupBy("bin").agg(F.max("size").alias("size"))
    m = models.join(freq, key, "left").withColumn("bin", af_bin(F.coalesce("af", "aaf"), bins)).join(sizes, "bin")
    m = m.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iters)))).withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "iter", "id", key), F.col("size")).cast("int"))
    drawn = m.drop(key, "size", "af").join(pool.select("bin", "i", F.col(key), "af"), ["bin", "i"])
    return drawn.select("id", "iter", key, F.col("af").alias("aaf"), "coef")


def moments(scores: DataFrame, *by: str) -> DataFrame:
    """Mean, population variance, skewness and kurtosis (three for a normal)."""
    return scores.groupBy(*by).agg(F.avg("score").alias("m1"), F.var_pop("score").alias("m2"), F.skewness("score").alias("m3"), (F.kurtosis("score") + 3).alias("m4"))


def permutation_p(stats: DataFrame, observed: str, null: str, *by: str) -> DataFrame:
    """(min(below, above) + 1) / (n + 1) and the z score of the observed value among its nulls."""
    s = stats.groupBy(*by, observed).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(null) < F.col(observed)).alias("below"), F.count_if(F.col(null) > F.col(observed)).alias("above"), F.avg(null).alias("m"), F.stddev_samp(null).alias("sd"))
    return s.withColumn("p", (F.least("below", "above") + 1) / (F.col("n") + 1)).withColumn("z", F.when(F.col("sd") > 0, (F.col(observed) - F.col("m")) / F.col("sd"))).drop("m", "sd")


def cohort_mean_score(af: DataFrame, models: DataFrame, key: str = "v") -> DataFrame:
    """Mean score of each cohort from its frequencies (v, cohort, af), the model's where unknown, divided by the model's size."""
    size = models.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sum(2 * F.col("aaf") * F.col("coef")).alias("base"))
    known = models.join(af.where("af IS NOT NULL"), key).groupBy("id", "cohort").agg(F.sum(2 * (F.col("af") - F.col("aaf")) * F.col("coef")).alias("shift"))
    return known.join(size, "id").select("id", "cohort", ((F.col("base") + F.col("shift")) / F.col("size")).alias("mean_score"))


def gwas_to_models(assoc: DataFrame, dbsnp: DataFrame, least_n: int = 5000, least_loci: int = 5) -> DataFrame:
    """Catalogue rows (trait, snp_allele, odds_ratio, n) to models: valid alleles and ratios, effect turned to the alternate.

    ``dbsnp`` is (rsid, v, ref, alt, af), biallelic and unambiguous. Where the risk allele is the reference, the sign
    turns and the intercept (variant null) takes up twice the effect. Small studies and models are dropped.
    """
    part = F.split("snp_allele", "-")
    rows = assoc.where(F.col("snp_allele").rlike("^rs[0-9]+-[ACGT]$") & (F.col("odds_ratio") > 0) & (F.col("n") >= least_n))
    rows = rows.select("trait", part[0].alias("rsid"), part[1].alias("risk"), F.log("odds_ratio").alias("beta"))
    j = rows.join(dbsnp, "rsid").where(F.col("risk").isin("A", "C", "G", "T") & ((F.col("risk") == F.col("ref")) | (F.col("risk") == F.col("alt"))))
    turned = F.col("risk") == F.col("ref")
    j = j.withColumn("coef", F.when(turned, -F.col("beta")).otherwise(F.col("beta"))).withColumn("offset", F.when(turned, 2 * F.col("beta")).otherwise(0.0))
    kept = j.groupBy("trait").agg(F.count(F.lit(1)).alias("n_loci"), F.sum("offset").alias("offset")).where(F.col("n_loci") >= least_loci)
    main = j.join(kept.select("trait"), "trait").select(F.col("trait").alias("id"), "v", F.col("af").alias("aaf"), "coef")
    return main.unionByName(kept.select(F.col("trait").alias("id"), F.lit(None).cast("int").alias("v"), F.lit(None).cast("double").alias("aaf"), F.col("offset").alias("coef")))


def depletion_counts(vids: DataFrame, af: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 counts over variants of one direction each: more frequent in a or b, coefficient positive or negative."""
    w = Window.partitionBy("v").orderBy(F.xxhash64("id", "v"), "id")
    one = vids.withColumn("__n", F.row_number().over(w)).where("__n = 1 AND coef <> 0").select("v", "coef").join(af, "v").where(F.col(a) != F.col(b))
    up, pos = F.col(a) > F.col(b), F.col("coef") > 0
    return one.agg(F.count_if(up & pos).alias("up_pos"), F.count_if(up & ~pos).alias("up_neg"), F.count_if(~up & pos).alias("down_pos"), F.count_if(~up & ~pos).alias("down_neg"))


def depletion_test(vids: DataFrame, af: DataFrame, a: str, b: str) -> DataFrame:
    """``depletion_counts`` with the two-sided Fisher p of direction against sign: one row."""
    return depletion_counts(vids, af, a, b).withColumn("p", fisher("up_pos", "up_neg", "down_pos", "down_neg"))
