"""Annotation of variants from tables, split databases included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate(df: DataFrame, t: DataFrame, key: list[str], root: str | None = None) -> DataFrame:
    """Left join by key; the table's other columns come as they are, or as one struct ``root``."""
    rest = [c for c in t.columns if c not in key]
    side = t.select(*key, F.struct(*rest).alias(root)) if root else t
    return df.join(side, key, "left")


def annotate_nonsplit_from_split(v: DataFrame, db: DataFrame, fields: list[str], key: str = "v") -> DataFrame:
    """Multi-allelic sites annotated from a database of split alleles (contig, pos, ref, alt, fields).

    ``found`` has one entry for each alternate of the site, null where the database has none.
    """
    alleles = v.select(key, "contig", "pos", "ref", F.posexplode("alts").alias("i", "alt"))
    hit = alleles.join(db, ["contig", "pos", "ref", "alt"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*fields)))).alias("__m"))
    filled = F.transform(F.sequence(F.lit(0), F.size("alts") - 1), lambda i: F.try_element_at(F.col("__m"), i))
    return v.join(hit, key, "left").withColumn("found", filled).drop("__m")


def lookup_first(df: DataFrame, dim: DataFrame, key: str, order: str) -> DataFrame:
    """Left join to the first row of the dimension for each key, in the order of a column."""
    first = dim.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n", order)
    return df.join(first, key, "left")


def membership_flags(df: DataFrame, lists: DataFrame, names: list[str], key: str = "symbol") -> DataFrame:
    """A true/false column for each named list (list, symbol)."""
    flags = lists.groupBy(key).agg(*[F.max(F.col("list") == n).alias(f"in_{n}") for n in names])
    out = df.join(flags, key, "left")
    return out.withColumns({f"in_{n}": F.coalesce(f"in_{n}", F.lit(False)) for n in names})


def explode_pairs(df: DataFrame, a: str, b: str, sep: str = ",") -> DataFrame:
    """Parallel separated lists as rows."""
    parts = F.arrays_zip(F.filter(F.split(a, sep), lambda x: x != "").alias(a), F.filter(F.split(b, sep), lambda x: x != "").alias(b))
    return df.withColumn("__p", F.explode(parts)).withColumn(a, F.col(f"__p.{a}")).withColumn(b, F.col(f"__p.{b}")).drop("__p")


def rare_deleterious(df: DataFrame, evidence: list[Column], afs: list[str], cap: float) -> DataFrame:
    """Any evidence, and no frequency above the cap; an unknown frequency counts as zero, unknown evidence as none."""
    some = F.greatest(*[F.coalesce(e, F.lit(False)) for e in evidence], F.lit(False))
    rare = F.greatest(*[F.coalesce(F.col(a), F.lit(0.0)) for a in afs], F.lit(0.0)) < cap
    return df.where(some & rare)


def consistent_direction(df: DataFrame, by: list[str], direction: str, order: str) -> DataFrame:
    """One row for each key whose rows all point one way; all rows where they don't."""
    w = Window.partitionBy(*by)
    n = F.row_number().over(w.orderBy(order))
    return df.withColumns({"__a": F.min(direction).over(w), "__b": F.max(direction).over(w), "__n": n}).where("__a <> __b OR __n = 1").drop("__a", "__b", "__n")


def locus_tier(df: DataFrame, bad: str = "d_bad", good: str = "d_good", near: int = 5) -> Column:
    """3 within ``near`` of a bad region, 2 outside good regions or on X or Y, else 1; no bad region on the contig is no hit."""
    close = F.coalesce(F.col(bad) <= near, F.lit(False))
    return F.when(close, 3).when(F.col("contig").isin("X", "Y") | F.coalesce(F.col(good) > 0, F.lit(True)), 2).otherwise(1)


def any_symbol_in(v: DataFrame, alleles: DataFrame, wanted: DataFrame, key: str = "v", symbol: str = "symbol") -> DataFrame:
    """Variants of which any allele (key, symbol) has a symbol of the list ``wanted`` (symbol); null symbols match none."""
    hits = alleles.join(wanted.select(symbol).distinct(), symbol, "left_semi").select(key).distinct()
    return v.join(hits, key, "left_semi")


def annotate_from_dataset(v: DataFrame, other: DataFrame, fields: dict[str, Column], root: str, on: tuple[str, ...] = ("contig", "pos", "ref", "alt")) -> DataFrame:
    """Split variants with a struct ``root`` of expressions over the same variants of another dataset; null where it lacks them.

    Of several rows of the other dataset for one variant the one with the smallest values, in the order of ``fields``, counts.
    """
    side = other.select(*on, F.struct(*[c.alias(n) for n, c in fields.items()]).alias(root)).groupBy(*on).agg(F.min(root).alias(root))
    return v.join(side, list(on), "left")
