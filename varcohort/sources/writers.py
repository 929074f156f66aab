"""Writers of datasets and text tables. Every one writes in parallel; none gathers rows in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import texts


def write_ds(df: DataFrame, path: str, by: str = "contig") -> None:
    """Parquet, partitioned by contig."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def export(df: DataFrame, exprs: list[str], path: str) -> None:
    """Tab-separated columns; an entry may be 'struct.*'."""
    df.select(*exprs).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def export_genotypes(gt: DataFrame, exprs: list[str], path: str, ref: bool = False, missing: bool = False) -> None:
    keep = F.lit(True) if missing else F.col("gt").isNotNull()
    if not ref:
        keep = keep & (F.col("gt").isNull() | (F.col("gt") > 0))
    export(gt.where(keep), exprs, path)


def write_by_sample(df: DataFrame, path: str) -> None:
    """A folder for each sample, with the loci where both alleles have reads."""
    df.where("dp <> ad AND ad > 0").write.mode("overwrite").partitionBy("s").csv(path, sep="\t", header=True)


def bed_lines(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("contig", "start0").sortWithinPartitions("contig", "start0").select(F.concat_ws("\t", "contig", F.col("start0").cast("string"), F.col("end0").cast("string")).alias("value"))


def write_bed(df: DataFrame, path: str) -> None:
    """Sorted half-open intervals."""
    bed_lines(df).write.mode("overwrite").text(path)


def write_af(df: DataFrame, path: str, key: tuple[str, ...] = ("contig", "pos", "ref", "alt")) -> None:
    """A frequency table whose key must be unique."""
    again = df.groupBy(*key).count().where("count > 1")
    if not again.isEmpty():
        raise ValueError(f"{key} is not a key of the table")
    df.write.mode("overwrite").parquet(path)


def vcf_lines(v: DataFrame, info: list[str], gt: DataFrame | None = None, samples: tuple[str, ...] = (), key: str = "v") -> DataFrame:
    """Lines in the genome's order; with genotypes (key, s, gt, ad, dp) a call for each of ``samples``, absent ones as no call."""
    fields = F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.upper()}="), F.col(c).cast("string"))) for c in info])
    cells = [F.col("contig"), F.col("pos").cast("string"), F.lit("."), F.col("ref"), F.array_join("alts", ","), F.lit("."), F.lit("PASS"), F.when(fields == "", ".").otherwise(fields)]
    if gt is not None:
        g = F.col("gt")
        call = F.concat_ws(":", F.when(g.isNull(), "./.").when(g == 0, "0/0").when(g == 1, "0/1").otherwise("1/1"), F.concat_ws(",", (F.col("dp") - F.col("ad")).cast("string"), F.col("ad").cast("string")), F.col("dp").cast("string"))
        calls = gt.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("s").cast("string"), call))).alias("__c"))
        v = v.join(calls, key, "left")
        cells += [F.lit("GT:AD:DP"), F.array_join(F.transform(texts(list(samples)), lambda s: F.coalesce(F.try_element_at("__c", s), F.lit("./."))), "\t")]
    return v.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos").select(F.concat_ws("\t", *cells).alias("value"))


def write_vcf(v: DataFrame, info: list[str], path: str, gt: DataFrame | None = None, samples: tuple[str, ...] = (), key: str = "v") -> None:
    """A folder of VCF files, each of which begins with the whole header and holds a stretch of the genome."""
    head = ["##fileformat=VCFv4.2", *[f'##INFO=<ID={c.upper()},Number=1,Type=String,Description="{c}">' for c in info]]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
    if gt is not None:
        head += [f'##FORMAT=<ID={k},Number={n},Type={t},Description="{d}">' for k, n, t, d in (("GT", 1, "String", "Genotype"), ("AD", "R", "Integer", "Reads of each allele"), ("DP", 1, "Integer", "Depth"))]
        columns += ["FORMAT", *samples]
    head.append("\t".join(columns))

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": head})
        yield from batches

    vcf_lines(v, info, gt, samples, key).mapInPandas(headed, "value string").write.mode("overwrite").text(path)


def dosage_lines(gt: DataFrame, samples: list[str], key: str = "vid") -> DataFrame:
    """'vid<TAB>0120.' for the named samples in their order; an absent cell is '.'."""
    place = gt.withColumn("i", F.array_position(texts(samples), F.col("s"))).where("i > 0")
    cells = place.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", F.coalesce(F.col("gt").cast("string"), F.lit("."))))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(len(samples))), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit("."))), "")
    return cells.select(F.concat_ws("\t", F.col(key).cast("string"), text).alias("value"))


def write_dosages(gt: DataFrame, samples: list[str], path: str, key: str = "vid") -> None:
    dosage_lines(gt, samples, key).write.mode("overwrite").text(path)


def export_dosage_set(gt: DataFrame, v: DataFrame, s: DataFrame, path: str) -> None:
    """Dosages, variants and samples as three tables."""
    gt.write.mode("overwrite").parquet(f"{path}/dosages")
    v.write.mode("overwrite").parquet(f"{path}/variants")
    s.write.mode("overwrite").parquet(f"{path}/samples")
