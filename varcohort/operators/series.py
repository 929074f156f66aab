"""Ordered series of loci: runs, context, calibration, segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocked import BLOCK, neighbour, running_sum, scan
from .shared import keep


def coverage_runs(t: DataFrame, value: str, least: float, by: str = "contig", pos: str = "pos") -> DataFrame:
    """Gaps and islands: stretches of consecutive positions whose value reaches ``least``, half-open from pos - 1.

    Ranks are those inside a block of positions and the block's offset, so no contig is one task's work and a run may cross blocks.
    """
    kept = t.where(F.col(value) >= least).select(by, pos, F.lit(1).alias("__one"))
    # consecutive positions less their rank are constant, so no running flag is needed
    rows = scan(kept, [by], pos, F.floor(F.col(pos) / BLOCK), "__one", "__n").withColumn("__g", F.col(pos) - F.col("__n"))
    return rows.groupBy(by, "__g").agg((F.min(pos) - 1).alias("start0"), F.max(pos).alias("end0"), F.count(F.lit(1)).alias("n")).drop("__g")


def triplet_context(t: DataFrame, by: str = "contig", pos: str = "pos", base: str = "ref") -> DataFrame:
    """Previous and next base, null where either position is absent; turned to the reverse complement where the centre is A or G.

    A window over a block of positions finds the neighbours; blocks overlap by the position at each end.
    """
    block = 1 << 16
    at = F.col(pos)
    ends = F.array_distinct(F.array(F.floor((at - 1) / block), F.floor(at / block), F.floor((at + 1) / block)))
    w = Window.partitionBy(by, "__b").orderBy(pos)
    beside = lambda shift, d: F.when(shift(pos).over(w) == at + d, shift(base).over(w))
    rows = t.withColumn("__b", F.explode(ends)).withColumn("__t", F.concat(beside(F.lag, -1), F.col(base), beside(F.lead, 1)))
    rows = rows.where(F.col("__b") == F.floor(at / block)).drop("__b")
    flip = F.col(base).isin("A", "G")
    turned = F.translate(F.reverse(F.col("__t")), "ACGT", "TGCA")
    return rows.withColumn("triplet", F.when(flip, turned).otherwise(F.col("__t"))).withColumn("flipped", flip).drop("__t")


def signature_burden(calls: DataFrame, background: DataFrame) -> DataFrame:
    """Calls per million opportunities for every class of the background, zeros included."""
    n = calls.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    out = background.join(n, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("burden", F.when(F.col("background") > 0, F.col("n") * 1e6 / F.col("background")))


#: The 96 classes of substitutions: a triplet with a pyrimidine in its centre, and what the centre turns into.
CLASSES = [(left + ref + right, alt) for ref in "CT" for alt in "ACGT" if alt != ref for left in "ACGT" for right in "ACGT"]


def substitution(alt: Column) -> Column:
    """The alternate as it reads on the strand of ``triplet``, given ``flipped`` of ``triplet_context``."""
    return F.when(F.col("flipped"), F.translate(alt, "ACGT", "TGCA")).otherwise(alt)


def signature_spectrum(loci: DataFrame, by: str, alt: str) -> DataFrame:
    """(by, triplet, alt, n, background, burden): calls per million opportunities of every one of the 96 classes, for each of ``by``.

    ``loci`` is (by, triplet, alt), a row for each locus that was looked at, with its triplet turned to the pyrimidine's
    strand (null where unknown: left out) and, where a substitution was called, the alternate of that strand (else null).
    The opportunities of a class are the loci of its triplet. Classes without a call have n zero; without a locus, a null burden.
    """
    seen = loci.where(F.col("triplet").isNotNull()).groupBy(by, "triplet", F.col(alt).alias("alt")).agg(F.count(F.lit(1)).alias("n"))
    background = seen.groupBy(by, "triplet").agg(F.sum("n").alias("background"))
    pairs = F.array(*[F.struct(F.lit(t).alias("triplet"), F.lit(a).alias("alt")) for t, a in CLASSES])
    grid = background.select(by).distinct().select(by, F.inline(pairs))
    out = grid.join(background, [by, "triplet"], "left").join(seen.where("alt IS NOT NULL"), [by, "triplet", "alt"], "left")
    out = out.select(by, "triplet", "alt", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("background", F.lit(0)).alias("background"))
    return out.withColumn("burden", F.when(F.col("background") > 0, F.col("n") * 1e6 / F.col("background")))


def locus_windows(t: DataFrame, size: int, by: str, pos: str) -> DataFrame:
    """Window number of each locus in the order of the whole genome: ranks, divided.

    A locus's rank is its contig's offset and its rank there, so no task orders the genome.
    """
    ranked = running_sum(t.withColumn("__one", F.lit(1)), by, pos, ["__one"])
    sizes = t.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(by, F.coalesce(before, F.lit(0)).alias("__o"))  # a row a contig
    rows = ranked.join(offsets, by)
    return rows.withColumn("window", F.floor((F.col("__o") + F.col("run___one") - 1) / size).cast("long")).select(*t.columns, "window")


def merge_segments(w: DataFrame, by: str, order: str, state: str, total: str) -> DataFrame:
    """Neighbouring windows of one state joined, with their totals summed; ``order`` is a number, and blocks of it are one task's work."""
    was = neighbour(w, by, order, state, "__was", False)
    rows = was.withColumn("__new", F.coalesce((F.col("__was") != F.col(state)).cast("int"), F.lit(1)))
    rows = scan(rows, [by], order, F.floor(F.col(order) / BLOCK), "__new", "segment")
    return rows.groupBy(by, "segment", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(total).alias(total))


def depth_affinity(t: DataFrame, sample: str, locus: str, value: str) -> DataFrame:
    """Mean and variance over samples of each locus's depth relative to its sample's mean, scaled to a grand mean of one."""
    mean = t.groupBy(sample).agg(F.avg(value).alias("__m"))
    rel = t.join(mean, sample).withColumn("__r", F.col(value) / F.col("__m"))
    out = keep(rel.groupBy(locus).agg(F.avg("__r").alias("affinity"), F.var_pop("__r").alias("variance"), F.count(F.lit(1)).alias("n")))
    grand = out.agg(F.avg("affinity").alias("__g"))
    return out.join(F.broadcast(grand)).select(locus, (F.col("affinity") / F.col("__g")).alias("affinity"), (F.col("variance") / (F.col("__g") * F.col("__g"))).alias("variance"), "n")  # one row


def folded_vaf(dp: Column, ad: Column) -> Column:
    v = ad / F.when(dp > 0, dp)
    return F.least(v, 1 - v)


def local_quantile(df: DataFrame, key: str, x: str, z: str, width: int, group: str, least: int = 20) -> DataFrame:
    """Share of rows of the group with z in [z_i - width, z_i + width), the row itself left out, whose x is at most x_i."""
    a = df.select(key, group, F.col(x).alias("xi"), F.col(z).alias("zi")).withColumn("bin", F.explode(F.array(*[F.floor(F.col("zi") / width) + d for d in (-1, 0, 1)])))
    b = df.select(F.col(key).alias("other"), group, F.col(x).alias("xo"), F.col(z).alias("zo")).withColumn("bin", F.floor(F.col("zo") / width))
    near = a.join(b, [group, "bin"]).where((F.col("zo") >= F.col("zi") - width) & (F.col("zo") < F.col("zi") + width) & (F.col("other") != F.col(key)))
    n = near.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("xo") <= F.col("xi")).alias("below"))
    return df.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= least, F.col("below") / F.col("n")).alias("quantile"))


def mode_base(counts: DataFrame, key: str) -> DataFrame:
    """Most common base of (key, base, n), ties alphabetical."""
    return counts.groupBy(key).agg(F.min_by("base", F.struct(-F.col("n"), F.col("base"))).alias("base"), F.max("n").alias("n"))


def collapse_groups(t: DataFrame, cohort: str, order: list[str], size: int) -> DataFrame:
    """Numbers age-ordered groups of about ``size`` in each cohort."""
    w = Window.partitionBy(cohort)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    groups = F.greatest(F.round(n / size), F.lit(1))
    return t.withColumn("bucket", F.floor((i - 1) * groups / n).cast("long"))


def collapse_burden(burden: DataFrame, people: DataFrame, cohort: str, order: list[str], size: int, key: str = "s") -> DataFrame:
    """(cohort, bucket, class, value, share): summed burdens (key, class, value) of age-ordered groups of about ``size`` people.

    A group's shares of all classes add up to one; they are null in a group whose sum is zero. People without a burden
    count when the groups are made.
    """
    groups = collapse_groups(people, cohort, order, size).select(key, cohort, "bucket")
    sums = burden.join(groups, key).groupBy(cohort, "bucket", "class").agg(F.sum("value").alias("value"))
    whole = F.sum("value").over(Window.partitionBy(cohort, "bucket"))  # a row a class
    return sums.withColumn("share", F.col("value") / F.nullif(whole, F.lit(0)))
