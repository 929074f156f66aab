"""Predicates and keys of variants and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pseudo-autosomal regions of X and Y, 1-based closed, in build 37 coordinates.
PAR = {"X": ((60001, 2699520), (154931044, 155260560)), "Y": ((10001, 2649520), (59034050, 59363566))}


def vid(contig: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", contig, pos.cast("string"), ref, alt)


def parse_vid(v: Column) -> Column:
    part = F.split(v, ":")
    return F.struct(part[0].alias("contig"), part[1].cast("long").alias("pos"), part[2].alias("ref"), part[3].alias("alt"))


def is_snp(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1) & (alt != "*")


def is_star(alt: Column) -> Column:
    return alt == "*"


def is_insertion(ref: Column, alt: Column) -> Column:
    return (F.length(ref) < F.length(alt)) & alt.startswith(ref)


def is_deletion(ref: Column, alt: Column) -> Column:
    return (F.length(ref) > F.length(alt)) & ref.startswith(alt)


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def category(ref: Column, alt: Column) -> Column:
    return F.when(is_star(alt), "star").when(is_snp(ref, alt), "snp").when(is_insertion(ref, alt), "insertion").when(is_deletion(ref, alt), "deletion").otherwise("complex")


def size_class(ref: Column, alt: Column, small: int = 20) -> Column:
    """SNV, small or large insertion or deletion, or insdel, by allele lengths."""
    grown = F.length(alt) - F.length(ref)
    return (
        F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV")
        .when((F.length(ref) == 1) & (grown > 0), F.when(grown <= small, "ins_small").otherwise("ins_large"))
        .when((F.length(alt) == 1) & (grown < 0), F.when(-grown <= small, "del_small").otherwise("del_large"))
        .otherwise("insdel")
    )


def strand_specific(ref: Column, alt: Column) -> Column:
    """Whether the alleles differ from their own complements' pair."""
    return ~F.concat(ref, alt).isin("AT", "TA", "CG", "GC")


def is_autosomal(contig: Column) -> Column:
    return contig.rlike("^([1-9]|1[0-9]|2[0-2])$")


def in_par(contig: Column, pos: Column) -> Column:
    out = F.lit(False)
    for name, ranges in PAR.items():
        for a, b in ranges:
            out = out | ((contig == name) & pos.between(a, b))
    return out


def complement(base: Column) -> Column:
    return F.translate(base, "ACGTacgt", "TGCAtgca")


def is_het(gt: Column) -> Column:
    return gt == 1


def min_rep(pos: Column, ref: Column, alt: Column) -> Column:
    """(pos, ref, alt) with the common suffix, then the common prefix, trimmed; each allele keeps one base."""
    most = F.least(F.length(ref), F.length(alt)) - 1

    def common(a: Column, b: Column, most: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: (i <= most) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
        return F.coalesce(F.array_max(at), F.lit(0))

    tail = common(F.reverse(ref), F.reverse(alt), most)
    r, a = F.substring(ref, F.lit(1), F.length(ref) - tail), F.substring(alt, F.lit(1), F.length(alt) - tail)
    head = common(r, a, F.least(F.length(r), F.length(a)) - 1)
    cut = lambda x: F.substring(x, head + 1, F.length(x))
    return F.struct((pos + head).alias("pos"), cut(r).alias("ref"), cut(a).alias("alt"))


def dnds_class(csq: Column) -> Column:
    """Nonsense, missense or synonymous, first match wins; null where unclassified."""
    return (
        F.when(csq.rlike("stop_gained|frameshift_variant|splice_acceptor|splice_donor|stop_lost|start_lost"), "nonsense")
        .when(csq.rlike("missense_variant|inframe_insertion|inframe_deletion|protein_altering"), "missense")
        .when(csq.rlike("synonymous_variant|stop_retained"), "synonymous")
    )


def kin_degree(kin: Column) -> Column:
    """Degree d where 2^-(d + 1.5) <= kin < 2^-(d + 0.5), 0 for the same person, 5 beyond."""
    out = F.when(kin >= 2.0**-1.5, 0)
    for d in range(1, 5):
        out = out.when(kin >= 2.0 ** -(d + 1.5), d)
    return out.otherwise(5)


def presence_class(a: Column, b: Column, name_a: str = "A", name_b: str = "B") -> Column:
    has_a, has_b = F.coalesce(a, F.lit(0)) > 0, F.coalesce(b, F.lit(0)) > 0
    return F.when(has_a & has_b, "Both").when(has_a, f"{name_a} only").when(has_b, f"{name_b} only").otherwise("Neither")


def af_bin(af: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(af * bins)).cast("int")


def band(value: Column, edges: list[int]) -> Column:
    """Half-open bands [a, b); null outside."""
    out = None
    for a, b in zip(edges, edges[1:], strict=False):
        hit = (value >= a) & (value < b)
        out = F.when(hit, f"{a}-{b - 1}") if out is None else out.when(hit, f"{a}-{b - 1}")
    return out
