"""Classes of consequences, predictors and callers, as chains where the first match wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NONSYN = "stop_gained|stop_lost|start_lost|frameshift_variant|splice_acceptor_variant|splice_donor_variant|missense_variant|inframe_insertion|inframe_deletion|protein_altering_variant"
TRUNC = "stop_gained|frameshift_variant"
SPLICE = "splice_acceptor_variant|splice_donor_variant"
SYN = "synonymous_variant|stop_retained_variant"


def residue(position: Column) -> Column:
    """First residue of '12', '12-15' or '?-12'."""
    return F.regexp_extract(position, r"(\d+)", 1).try_cast("int")


def effect(csq: Column, position: Column, length: Column) -> Column:
    """Truncation (terminal in the last twentieth of the protein), splice, missense, synonymous."""
    terminal = residue(position) > 0.95 * length
    return (
        F.when(csq.rlike(TRUNC), F.when(F.coalesce(terminal, F.lit(False)), "trunc_terminal").otherwise("trunc"))
        .when(csq.rlike(SPLICE), "splice")
        .when(csq.rlike("missense_variant"), "missense")
        .when(csq.rlike(NONSYN), "other_nonsyn")
        .when(csq.rlike(SYN), "synonymous")
    )


def collapsed(effect_: Column) -> Column:
    """Truncating, non-synonymous or synonymous."""
    return F.when(effect_.isin("trunc", "splice"), "trunc").when(effect_.isin("missense", "other_nonsyn", "trunc_terminal"), "nonsyn").when(effect_ == "synonymous", "syn")


def coding_flags(csq: Column) -> tuple[Column, Column]:
    """(synonymous, non-synonymous) flags of a consequence text."""
    return csq.rlike(SYN), csq.rlike(NONSYN)


def predictor_bin(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.6, "raised").when(score >= 0.4, "middle").when(score >= 0.3, "low").when(score.isNotNull(), "none")


def clinical_call(significance: Column, stars: Column) -> Column:
    """Pathogenic or benign where the review has at least one star, conflicting reports left out."""
    clear = ~significance.rlike("(?i)conflict") & (stars >= 1)
    return F.when(clear & significance.rlike("(?i)pathogenic"), "pathogenic").when(clear & significance.rlike("(?i)benign"), "benign")


def vep_canonical(canonical: Column, source: Column, biotype: Column) -> Column:
    return (canonical == "YES") & (source == "HGNC") & (biotype == "protein_coding")


def drop_tokens(csq: Column, tokens: list[str]) -> Column:
    """A comma or ampersand list of consequences without some of them."""
    return F.array_join(F.array_except(F.split(csq, "[,&]"), F.array(*map(F.lit, tokens))), ",")


def caller_filter() -> Column:
    """The thresholds of a targeted caller's table: reads, pairing, mapping and base qualities, and six bias scores.

    Terms of the reference's pairing and base quality count only where it has reads.
    """
    c = F.col
    bias = [c(n) <= 20 for n in ("epp", "eppr", "sap", "srp", "rpp", "rppr")]
    ok = (c("ad") >= 2) & (c("paired") >= 0.9) & (c("mqm") >= 50) & (c("mqmr") >= 50) & (c("qa") / F.nullif("ad", F.lit(0)) >= 30)
    ref = (c("rd") == 0) | ((c("pairedr") >= 0.9) & (c("qr") / F.nullif("rd", F.lit(0)) >= 30))
    return F.coalesce(reduce(lambda a, b: a & b, bias, ok & ref), F.lit(False))


def sv_tranche(filters: Column, qual: Column, asm: Column, ras: Column) -> Column:
    """HIGH, INTERMEDIATE or LOW by quality and assembly support on both sides; null for filtered calls."""
    return F.when(F.coalesce(F.size(filters) > 0, F.lit(False)), None).when((qual >= 1000) & (asm > 0) & (ras > 0), "HIGH").when((qual >= 500) & ((asm > 0) | (ras > 0)), "INTERMEDIATE").otherwise("LOW")


def good_depth(h1: Column, h2: Column, median: Column, most: Column) -> Column:
    return (h2 - h1 <= 10) & (median >= 20) & (most <= 100) & (2 * median + 15 >= most)
