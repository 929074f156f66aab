"""Interval algebra over half-open (contig, start0, end0) rows.

Overlaps are equi-joins on hierarchical bins: an interval lies in at most two bins of the smallest level that is
as long as it, and is looked up there by shorter ones only, so a very long interval costs no more than a
short one and short ones never meet in coarse bins. Set operations are sweeps over the intervals' edges in two levels of windows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocked import BLOCK, blocks, neighbour, running_sum, turns
from .shared import keep

#: Bin sizes of the levels, as powers of two; the last holds a contig.
LEVELS = (9, 13, 17, 21, 25, 62)


def _level(start: Column, end: Column) -> Column:
    out = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        out = F.when(end - start <= F.lit(1 << LEVELS[i]), F.lit(i)).otherwise(out)
    return out


def _own(df: DataFrame) -> Column:
    return _level(F.col("start0").cast("long"), F.col("end0").cast("long"))


def _levels(df: DataFrame) -> list[int]:
    """The levels that intervals of ``df`` have for their own: six at most."""
    return sorted(r["own"] for r in df.where("start0 IS NOT NULL AND end0 IS NOT NULL").select(_own(df).alias("own")).distinct().collect())


def _binned(df: DataFrame, prefix: str, wanted: Column) -> DataFrame:
    """A row for each bin of the (level, role) pairs of ``wanted``, an expression of the interval's own level ``__own``."""
    start, end = F.col("start0").cast("long"), F.col("end0").cast("long")
    last, power = F.greatest(end - 1, start), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("__l.at") + 1)
    rows = df.withColumn("__own", _own(df)).withColumn("__l", F.explode(wanted))
    rows = rows.withColumns({"__p": power, "__start": start, "__last": last})
    rows = rows.withColumns({"__a": F.expr("shiftright(__start, __p)"), "__b": F.expr("shiftright(__last, __p)")})
    rows = rows.withColumn("__bin", F.explode(F.sequence(F.col("__a"), F.col("__b"))))
    return rows.select(F.col("contig").alias("__contig"), F.col("__l.at").alias("__at"), F.col("__l.role").alias("__role"), "__bin", F.col("__a").alias(f"__first_{prefix}"), F.struct(*df.columns).alias(prefix))


def near(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of intervals that share a bin at the level of the longer one, where overlaps are looked for.

    A pair meets at the level of its longer interval only: as role 0 where that is a's (or both have one level), else as
    role 1. So short intervals never meet in the coarse bins that hold a whole contig's, and a level on which no
    interval of the other side lies is left out. Neither side is broadcast: both grow with the tables.
    """
    in_a, in_b = _levels(a), _levels(b)
    own = F.col("__own")
    entry = lambda at, role: F.struct(at.alias("at"), F.lit(role).alias("role"))
    at_levels = lambda levels, role, test: [F.when(test(i), entry(F.lit(i), role)) for i in levels]
    longer = lambda least: F.when(own > least, entry(own, 1))
    mine = F.array_compact(F.array(entry(own, 0), *at_levels(in_b, 1, lambda i: own < i)))
    theirs = F.array_compact(F.array(longer(min(in_a, default=len(LEVELS))), *at_levels(in_a, 0, lambda i: own <= i)))
    return _binned(a, "a", mine).join(_binned(b, "b", theirs).hint("merge"), ["__contig", "__at", "__role", "__bin"])


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): structs of every overlapping pair, once. Empty intervals count as one base long at their start."""
    once = F.col("__bin") == F.greatest("__first_a", "__first_b")
    meet = (F.col("a.start0") < F.greatest(F.col("b.end0"), F.col("b.start0"))) & (F.col("b.start0") < F.greatest(F.col("a.end0"), F.col("a.start0")))
    return near(a, b).where(once & meet).select("a", "b")


def as_intervals(v: DataFrame) -> DataFrame:
    """Variants with the half-open interval of their reference allele."""
    return v.withColumn("start0", F.col("pos") - 1).withColumn("end0", F.col("pos") - 1 + F.length("ref"))


def in_intervals(v: DataFrame, bed: DataFrame, key: str = "v") -> DataFrame:
    """Variants with ``inside``: whether their position lies in an interval."""
    points = v.select(key, "contig", (F.col("pos") - 1).alias("start0"), F.col("pos").alias("end0"))
    hit = overlaps(points, bed.select("contig", "start0", "end0")).select(F.col(f"a.{key}").alias(key)).distinct().withColumn("inside", F.lit(True))
    return v.join(hit, key, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def contained_in(v: DataFrame, bed: DataFrame, key: str = "v") -> DataFrame:
    """Keys of variants whose reference allele lies wholly inside one merged interval."""
    pairs = overlaps(as_intervals(v).select(key, "contig", "start0", "end0"), keep(merge(bed)))
    return pairs.where("b.start0 <= a.start0 AND a.end0 <= b.end0").select(F.col(f"a.{key}").alias(key)).distinct()


def depth(*tracks: DataFrame) -> DataFrame:
    """Edges of all tracks in order: (contig, pos, d0, ..., run_d0, ...): each track's change at pos, and its depth from there on."""
    n = len(tracks)
    edges = []
    for i, t in enumerate(tracks):
        for column, step in (("start0", 1), ("end0", -1)):
            edges.append(t.where("start0 < end0").select("contig", F.col(column).cast("long").alias("pos"), *[F.lit(step if j == i else 0).cast("long").alias(f"d{j}") for j in range(n)]))
    names = [f"d{j}" for j in range(n)]
    summed = reduce(DataFrame.unionByName, edges).groupBy("contig", "pos").agg(*[F.sum(c).alias(c) for c in names])
    return running_sum(summed, "contig", "pos", names)


def sweep(tracks: list[DataFrame], test: Callable[..., Column]) -> DataFrame:
    """Maximal stretches where ``test``, of the tracks' depths, holds: one pass over all edges, whatever the tracks' number.

    The depths before an edge are those after it less its changes, so no second look at the row before is needed.
    """
    n = range(len(tracks))
    now, before = [F.col(f"run_d{i}") for i in n], [F.col(f"run_d{i}") - F.col(f"d{i}") for i in n]
    return turns(depth(*tracks), "contig", "pos", test(*now), test(*before))


def merge(bed: DataFrame, gap: int = 0) -> DataFrame:
    """Union of overlapping or touching intervals, and of those at most ``gap`` apart."""
    wide = bed.select("contig", "start0", (F.col("end0") + gap).alias("end0"))
    return sweep([wide], lambda a: a > 0).select("contig", "start0", (F.col("end0") - gap).alias("end0"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common piece of every overlapping pair."""
    p = overlaps(a.select("contig", "start0", "end0"), b.select("contig", "start0", "end0"))
    return p.select("a.contig", F.greatest("a.start0", "b.start0").alias("start0"), F.least("a.end0", "b.end0").alias("end0"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bases in both sets, merged."""
    return sweep([a, b], lambda a, b: (a > 0) & (b > 0))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bases of ``a`` that are not in ``b``, merged."""
    return sweep([a, b], lambda a, b: (a > 0) & (b == 0))


def complement(bed: DataFrame, genome: DataFrame) -> DataFrame:
    return subtract(genome, bed)


def coverage(bed: DataFrame, genome: DataFrame | None = None) -> DataFrame:
    """(contig, start0, end0, depth) segments of constant positive depth; with ``genome``, of zero depth in it too."""
    tracks = (bed, genome) if genome is not None else (bed,)
    level, inside = F.col("run_d0"), F.col("run_d1") > 0 if genome is not None else F.lit(False)
    changed = (F.col("d0") != 0) | ((inside != (F.col("run_d1") - F.col("d1") > 0)) if genome is not None else F.lit(False))
    edges = depth(*tracks).where(changed).select("contig", F.col("pos").alias("start0"), level.alias("depth"), inside.alias("in_genome"))
    out = neighbour(edges, "contig", "start0", "start0", "end0", True).where(F.col("end0").isNotNull())
    return out.where((F.col("depth") > 0) | F.col("in_genome")).select("contig", "start0", "end0", "depth")


def total_bp(bed: DataFrame) -> DataFrame:
    return bed.agg(F.coalesce(F.sum(F.col("end0") - F.col("start0")), F.lit(0)).cast("long").alias("bp"), F.count(F.lit(1)).alias("n_intervals"))


def slop(bed: DataFrame, flank: int) -> DataFrame:
    """Every interval longer by ``flank`` on both sides (shorter, if negative); what vanishes is dropped."""
    out = bed.select("contig", F.greatest(F.col("start0") - flank, F.lit(0)).alias("start0"), (F.col("end0") + flank).alias("end0"))
    return out.where("start0 < end0")


def nearest_distance(v: DataFrame, bed: DataFrame, name: str = "distance", key: str = "v") -> DataFrame:
    """Adds each variant's distance to the nearest interval: 0 inside, gap + 1 outside, null if the contig has none.

    Points and interval starts share one order. Up to a point the furthest end, and after it the next start, come
    from a window over its block and from the blocks before and behind it; no pairs are made.
    """
    at = bed.where("start0 < end0").select("contig", F.col("start0").cast("long").alias("x"), F.lit(0).alias("k"), F.col("end0").cast("long").alias("high"), F.col("start0").cast("long").alias("low"), F.lit(None).cast(v.schema).alias("row"))
    points = v.select("contig", (F.col("pos") - 1).cast("long").alias("x"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("low"), F.struct(*v.columns).alias("row"))
    block = Window.partitionBy("contig", "__block")
    order = block.orderBy("x", "k")
    rows = blocks(at.unionByName(points), "x", BLOCK).select(
        "contig", "__block", "x", "k", "row", F.row_number().over(order).alias("__n"),
        F.max("high").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("high"), F.min("low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("low"),
        F.max("high").over(block).alias("most"), F.min("low").over(block).alias("least"),
    )
    along = Window.partitionBy("contig").orderBy("__block")
    far = rows.where("__n = 1").select(
        "contig", "__block", F.max("most").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("far_high"),
        F.min("least").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("far_low"),
    )
    found = rows.where("k = 1").join(far, ["contig", "__block"])
    high, low = F.greatest("high", "far_high"), F.coalesce("low", "far_low")
    left = F.when(high.isNotNull(), F.greatest(F.col("x") - high + 1, F.lit(0)))
    return found.select("row.*", F.least(left, low - F.col("x")).alias(name))


def qc_regions(genome: DataFrame, good: DataFrame, bads: list[DataFrame], least: int = 100, erode: int = 10) -> DataFrame:
    """Well-measured regions: genome and good track, less every bad track, long enough, then eroded. One sweep."""
    bad = reduce(DataFrame.unionByName, [b.select("contig", "start0", "end0") for b in bads])
    kept = sweep([genome, good, bad], lambda g, t, b: (g > 0) & (t > 0) & (b == 0))
    return slop(kept.where(F.col("end0") - F.col("start0") >= least), -erode)


def tier_beds(genome: DataFrame, good: DataFrame, bads: list[DataFrame], flank: int = 5) -> DataFrame:
    """The genome as (contig, start0, end0, tier): 3 in bad tracks and ``flank`` bases around them and on contigs that are no
    chromosome, else 2 on X and Y and outside the good track, else 1."""
    bad = reduce(DataFrame.unionByName, [slop(b.select("contig", "start0", "end0"), flank) for b in bads])
    odd, sex = ~F.col("contig").rlike("^([0-9]+|X|Y)$"), F.col("contig").isin("X", "Y")
    n = range(3)
    tier = lambda g, t, b: F.when(g > 0, F.when((b > 0) | odd, 3).when(sex | (t == 0), 2).otherwise(1))
    now, was = tier(*[F.col(f"run_d{i}") for i in n]), tier(*[F.col(f"run_d{i}") - F.col(f"d{i}") for i in n])
    turned = depth(genome, good, bad).where(~now.eqNullSafe(was)).select("contig", F.col("pos").alias("start0"), now.alias("tier"))
    closed = neighbour(turned, "contig", "start0", "start0", "end0", True)
    return closed.where(F.col("tier").isNotNull() & F.col("end0").isNotNull()).select("contig", "start0", "end0", "tier")


def common_bp(bed: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Bases of a set, and of what it has in common with each other one: (name, bp)."""
    out = [total_bp(merge(bed)).select(F.lit("all").alias("name"), "bp")]
    return reduce(DataFrame.unionByName, out + [total_bp(common(bed, b)).select(F.lit(n).alias("name"), "bp") for n, b in others.items()])


def rarely_covered(coverage_: DataFrame, n_samples: int, share: float = 0.5) -> DataFrame:
    """Segments (contig, start0, end0, depth) that fewer than ``share`` of the samples cover."""
    return coverage_.where(F.col("depth") < share * n_samples).select("contig", "start0", "end0")


def loh_regions(genome: DataFrame, good: DataFrame, bads: list[DataFrame], covered: DataFrame, n_samples: int, least: int = 100, erode: int = 10) -> tuple[DataFrame, DataFrame]:
    """Regions for loss of heterozygosity, and the rest of the genome as their blacklist.

    As ``qc_regions``, with places that fewer than half of the samples cover as one more bad track. What a sweep reads
    of another is written first, here as in ``cnv_regions`` and ``comparison_regions``, so that plans don't multiply.
    """
    kept = keep(qc_regions(genome, good, [*bads, rarely_covered(keep(covered), n_samples)], least, erode))
    return kept, complement(kept, genome)


def cnv_regions(genome: DataFrame, bads: list[DataFrame], covered: DataFrame, n_samples: int, width: int = 65, least: int = 450) -> DataFrame:
    """Regions for copy number: the genome less all bad tracks and rarely covered places, closed, and longer than ``least``."""
    bad = reduce(DataFrame.unionByName, [b.select("contig", "start0", "end0") for b in [*bads, rarely_covered(keep(covered), n_samples)]])
    return close_regions(keep(subtract(genome, bad)), width, least)


def comparison_regions(covs: list[tuple[DataFrame, int]], good: DataFrame, coding: DataFrame, flank: int = 2, least: int = 5) -> DataFrame:
    """Regions in which cohorts can be compared: each (coverage, least depth) reached, inside good and padded coding regions, ``least`` bases or more."""
    tracks = [keep(c).where(F.col("depth") >= n).select("contig", "start0", "end0") for c, n in covs]
    out = sweep([*tracks, good, slop(coding, flank)], lambda *d: reduce(lambda a, b: a & b, [x > 0 for x in d]))
    return out.where(F.col("end0") - F.col("start0") >= least)


def close_regions(bed: DataFrame, width: int, least: int) -> DataFrame:
    """Morphological closing: dilate, merge, erode, and keep what is longer than ``least``."""
    return slop(merge(slop_free(bed, width)), -width).where(F.col("end0") - F.col("start0") > least)


def bad_depth_regions(covered: DataFrame, n_samples: int, share: float = 0.95, width: int = 65, least: int = 10) -> DataFrame:
    """Regions that fewer than ``share`` of the samples cover, closed over gaps of up to twice ``width``, and longer than ``least``."""
    return close_regions(rarely_covered(keep(covered), n_samples, share), width, least)


def slop_free(bed: DataFrame, flank: int) -> DataFrame:
    """As ``slop``, but starts may fall below zero, so that eroding undoes it."""
    return bed.select("contig", (F.col("start0") - flank).alias("start0"), (F.col("end0") + flank).alias("end0"))
