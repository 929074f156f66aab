"""Readers of variant, interval, table, dosage, model and pileup text, as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def contig_name(c: Column) -> Column:
    """Contigs without their prefix, the mitochondrion as MT."""
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def texts(values: list[str]) -> Column:
    """An array of texts as one literal, however many there are."""
    return F.split(F.lit("\n".join(values)), "\n") if values else F.array().cast("array<string>")


def parse_vcf(lines: DataFrame, samples: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Variants and long genotypes from a column ``value`` of VCF lines; headers are skipped. Without ``samples`` each line has its own ``names``.

    Genotypes are (contig, pos, ref, s, a1, a2, ads, dp, gq), with null alleles where a call is missing.
    """
    part = F.split("value", "\t")
    names = texts(samples) if samples is not None else F.col("names")
    rows = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(part.alias("f"), names.alias("names"))
    info = F.when(F.col("f")[7] != ".", F.str_to_map(F.col("f")[7], F.lit(";"), F.lit("=")))
    filters = F.when(F.col("f")[6].isin("PASS", "."), F.array().cast("array<string>")).otherwise(F.split(F.col("f")[6], ";"))
    null = lambda c: F.when(c != ".", c)
    v = rows.select(
        F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("pos"), null(F.col("f")[2]).alias("rsid"), F.col("f")[3].alias("ref"),
        F.split(F.col("f")[4], ",").alias("alts"), null(F.col("f")[5]).cast("double").alias("qual"), filters.alias("filters"), info.alias("info"),
    )
    cells = F.arrays_zip(F.col("names").alias("s"), F.slice("f", F.lit(10), F.greatest(F.size("names"), F.lit(1))).alias("call"))
    g = rows.select(F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.split(F.col("f")[8], ":").alias("fmt"), F.explode(cells).alias("c"))
    call = F.split("c.call", ":")
    value = lambda name: F.try_element_at(F.map_from_arrays(F.slice("fmt", F.lit(1), F.least(F.size("fmt"), F.size(call))), F.slice(call, F.lit(1), F.least(F.size("fmt"), F.size(call)))), F.lit(name))
    alleles = F.split(value("GT"), "[/|]")
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.cast("int"))
    ads = F.transform(F.split(value("AD"), ","), lambda x: F.when(x.rlike("^[0-9]+$"), x.cast("long")))
    gt = g.select("contig", "pos", "ref", F.col("c.s").alias("s"), number(F.get(alleles, F.lit(0))).alias("a1"), number(F.get(alleles, F.lit(1))).alias("a2"), ads.alias("ads"), number(value("DP")).alias("dp"), number(value("GQ")).alias("gq"))
    return v, gt


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All files of a glob or folder. Where their headers name different samples, each file's lines get their own file's names."""
    lines = spark.read.text(path)
    heads = lines.where(F.col("value").startswith("#CHROM")).select(F.input_file_name().alias("file"), F.slice(F.split("value", "\t"), 10, 1 << 30).alias("names"))
    kinds = heads.select("names").distinct().limit(2).collect()
    if len(kinds) < 2:
        return parse_vcf(lines, list(kinds[0]["names"]) if kinds else [])
    return parse_vcf(lines.withColumn("file", F.input_file_name()).join(heads.dropDuplicates(["file"]), "file"), None)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", comment: str | None = None, null: str = "NA", header: bool = True) -> DataFrame:
    """Typed delimited text; ``comment`` may be longer than one character."""
    if comment is None or len(comment) == 1:
        return spark.read.csv(path, schema=schema, sep=sep, comment=comment, nullValue=null, header=header)
    names = [f.split()[0] for f in schema.split(",")]
    lines = spark.read.text(path).where(~F.col("value").startswith(comment))
    part = F.split("value", re.escape(sep))
    kinds = [f.split()[1] for f in schema.split(",")]
    cells = lines.select(*[F.when(F.get(part, F.lit(i)) != null, F.get(part, F.lit(i))).alias(n) for i, n in enumerate(names)])
    if header:
        cells = cells.where(F.coalesce(F.col(names[0]).isNull() | (F.col(names[0]) != names[0]), F.lit(True)))
    return cells.select(*[F.col(n).try_cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])


def read_bed(spark: SparkSession, path: str, strip_chr: bool = True) -> DataFrame:
    """(contig, start0, end0) of the first three columns."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0))
    contig = contig_name(part[0]) if strip_chr else part[0]
    return rows.select(contig.alias("contig"), part[1].cast("long").alias("start0"), part[2].cast("long").alias("end0"))


def read_bedgraph(spark: SparkSession, path: str, strip_chr: bool = True) -> DataFrame:
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0))
    contig = contig_name(part[0]) if strip_chr else part[0]
    return rows.select(contig.alias("contig"), part[1].cast("long").alias("start0"), part[2].cast("long").alias("end0"), part[3].cast("double").alias("score"))


def read_sorted_union(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per-sample interval files as one table (contig, start0, end0, sample) in the order of contig, start and end.

    ``sample`` is the file's (or folder's) name without its endings. Ranges of (contig, start0, end0) are dealt to tasks
    and sorted there, so no task merges all files; what is read back in partition order is in order.
    """
    part = F.split("value", "\t")
    rows = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("__at"))
    rows = rows.where(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0))
    steps = F.split("__at", "/")
    last = F.element_at(steps, -1)
    name = F.substring_index(F.when(last.startswith("part-"), F.element_at(steps, -2)).otherwise(last), ".", 1)
    out = rows.select(contig_name(part[0]).alias("contig"), part[1].cast("long").alias("start0"), part[2].cast("long").alias("end0"), name.alias("sample"))
    return out.repartitionByRange("contig", "start0", "end0").sortWithinPartitions("contig", "start0", "end0", "sample")


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("s")).where("s <> ''").distinct()


def read_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Datasets of one schema, read apart and united by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def read_many_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-sample tables of one header, with the file that each row came from."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def parse_dosages(lines: DataFrame, samples: list[str]) -> DataFrame:
    """(vid, s, dosage) from 'vid<TAB>0120.' lines; a wrong alphabet or length fails the query, '.' is null."""
    part = F.split("value", "\t")
    n = len(samples)
    ok = part[1].rlike(f"^[012.]{{{n}}}$")
    rows = lines.where(~F.col("value").startswith("vid\t")).select(part[0].alias("vid"), F.when(F.assert_true(ok, "bad dosage row").isNull(), part[1]).alias("d"))
    out = rows.select("vid", F.posexplode(F.split(F.col("d"), "(?<=.)(?=.)")).alias("i", "c"))
    names = texts(samples)
    return out.select("vid", F.get(names, F.col("i")).alias("s"), F.when(F.col("c") != ".", F.col("c").cast("tinyint")).alias("dosage"))


def read_dosages(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("vid\t")).first()
    return parse_dosages(lines, head["value"].split("\t")[1:] if head else [])


def parse_models(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants (id, vid, aaf, coef) and intercepts (id, offset) of tab-separated models; NA coefficients are zero."""
    part = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("id\t") & (F.length("value") > 0)).select(part[0].alias("id"), part[1].alias("vid"), part[2].try_cast("double").alias("aaf"), F.coalesce(F.element_at(part, -1).try_cast("double"), F.lit(0.0)).alias("coef"))
    rows = rows.where(F.assert_true(F.length("vid") > 0, "a model row without a variant").isNull())
    offset = rows.where("vid = 'OFFSET'").groupBy("id").agg(F.sum("coef").alias("offset"))
    return rows.where("vid <> 'OFFSET'"), offset


def strand_specific_snvs(v: DataFrame) -> DataFrame:
    """Biallelic autosomal substitutions of a dbSNP table whose alleles don't complement each other; RV turns the strand."""
    alt = F.col("alts")[0]
    snv = (F.size("alts") == 1) & F.col("ref").rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & F.col("contig").rlike("^([1-9]|1[0-9]|2[0-2])$")
    rows = v.where(snv & ~F.concat("ref", alt).isin("AT", "TA", "CG", "GC"))
    return rows.select("contig", "pos", F.col("rsid"), "ref", alt.alias("alt"), F.map_contains_key(F.coalesce("info", F.create_map().cast("map<string,string>")), F.lit("RV")).alias("reverse"))


CALLER_INFO = ("split", "mqm", "mqmr", "paired", "pairedr", "epp", "eppr", "saf", "sar", "sap", "srf", "srr", "srp", "rpl", "rpr", "rpp", "rppr")


def caller_vcf_to_table(v: DataFrame, gt: DataFrame) -> DataFrame:
    """A targeted caller's calls, one alternate a site, as a table: depths, shares, summed base qualities and its bias scores.

    ``gt`` is (contig, pos, ref, alt, s, dp, rd, ad, qr, qa). ``vaf`` is of all reads, ``vafo`` of reference and alternate reads;
    ``ado`` are reads of neither. Sites with more alternates are left out.
    """
    site = v.where(F.size("alts") == 1).select("contig", "pos", "ref", F.col("alts")[0].alias("alt"), *[F.col("info")[n.upper()].try_cast("double").alias(n) for n in CALLER_INFO])
    share = lambda of: F.col("ad") / F.nullif(of, F.lit(0))
    rows = gt.join(site, ["contig", "pos", "ref", "alt"]).withColumns({"ado": F.col("dp") - F.col("rd") - F.col("ad"), "vaf": share(F.col("dp")), "vafo": share(F.col("rd") + F.col("ad"))})
    return rows.select("s", "contig", "pos", "ref", "alt", "dp", "rd", "ad", "ado", "vaf", "vafo", "qr", "qa", *CALLER_INFO)


def af_vcf_to_counts(v: DataFrame, n: int = 1000) -> DataFrame:
    """Genotype counts of a frequency table with AN, AC_Het and AC_Hom, for ``n`` people; multi-allelics go."""
    num = lambda k: F.col("info")[k].cast("double")
    rows = v.where(F.size("alts") == 1).select("contig", "pos", "ref", F.col("alts")[0].alias("alt"), F.floor(n - num("AN") / 2).alias("n_missing"), num("AC_Het").cast("long").alias("n_ra"), F.floor(num("AC_Hom") / 2).alias("n_aa"))
    return rows.withColumn("n_rr", F.lit(n) - F.col("n_missing") - F.col("n_ra") - F.col("n_aa"))


def frqx_to_counts(df: DataFrame) -> DataFrame:
    """Genotype counts from frequency reports (vid, a1, hom_a1, het, hom_a2, missing): a1 may be either allele of contig:pos:ref:alt."""
    part = F.split("vid", ":")
    flipped = F.col("a1") == part[3]
    turn = lambda x, y: F.when(flipped, F.col(x)).otherwise(F.col(y)).cast("long")
    return df.select(
        part[0].alias("contig"), part[1].cast("long").alias("pos"), part[2].alias("ref"), part[3].alias("alt"),
        turn("hom_a2", "hom_a1").alias("n_rr"), F.col("het").cast("long").alias("n_ra"), turn("hom_a1", "hom_a2").alias("n_aa"), F.col("missing").cast("long").alias("n_missing"),
    )


def ac_an(lines: DataFrame) -> DataFrame:
    """Allele counts from lines of a contig:pos:ref:alt, a tab and a digit or dot for each sample."""
    part, calls = F.split(F.split("value", "\t")[0], ":"), F.split("value", "\t")[1]
    n = lambda c: F.length(calls) - F.length(F.replace(calls, F.lit(c), F.lit("")))
    ac, an = n("1") + 2 * n("2"), 2 * (F.length(calls) - n("."))
    return lines.select(part[0].alias("contig"), part[1].cast("long").alias("pos"), part[2].alias("ref"), part[3].alias("alt"), ac.cast("long").alias("ac"), an.cast("long").alias("an"))


def titled(text: Column) -> Column:
    """Every run of letters with a capital first and small letters after, blanks taken out."""
    return F.replace(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda w: F.initcap(w)), ""), F.lit(" "), F.lit(""))


def clinvar_to_variants(t: DataFrame, bases: DataFrame, assembly: str = "GRCh37") -> DataFrame:
    """Variant rows from a ClinVar table, with upstream bases from (contig, pos, ref): a row a base.

    ``t`` is (assembly, contig, start, stop, ref, alt, significance, review) and further columns, which are kept. Rows of
    other assemblies, with equal or unknown alleles or without a significance are left out; so are alleles other than
    plain bases, and rows whose reference allele isn't the reference's, or has another length than their span. ``-`` is an empty
    allele: an insertion lies between ``start`` and ``stop``, a deletion covers them, and both take the base before.
    """
    plain = lambda c: F.col(c).rlike("^[ACGT]+$")
    r, a, size = F.col("ref"), F.col("alt"), F.col("stop") - F.col("start") + 1
    kind = F.when(plain("ref") & plain("alt") & (size == F.length(r)), "var").when((r == "-") & plain("alt") & (size == 2), "ins").when(plain("ref") & (a == "-") & (size == F.length(r)), "del")
    rows = t.where((F.col("assembly") == assembly) & (r != a) & (r != "na") & (a != "na") & (F.col("significance") != "-")).withColumn("__kind", kind).where("__kind IS NOT NULL")
    rows = rows.withColumn("__from", F.when(F.col("__kind") == "del", F.col("start") - 1).otherwise(F.col("start")))
    rows = rows.withColumn("__to", F.when(F.col("__kind") == "ins", F.col("start")).otherwise(F.col("stop")))
    spans = rows.select("contig", "__from", "__to").distinct()
    spelled = spans.withColumn("pos", F.explode(F.sequence("__from", "__to"))).join(bases.select("contig", "pos", F.col("ref").alias("__b")), ["contig", "pos"])
    spelled = spelled.groupBy("contig", "__from", "__to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__b"))), lambda x: x["__b"]), "").alias("__seq"))
    rows = rows.join(spelled, ["contig", "__from", "__to"])
    seq = F.col("__seq")
    ok = (F.length(seq) == F.col("__to") - F.col("__from") + 1) & F.when(F.col("__kind") == "var", seq == r).when(F.col("__kind") == "del", F.substring(seq, 2, 1 << 30) == r).otherwise(True)
    rest = [c for c in t.columns if c not in ("assembly", "contig", "start", "stop", "ref", "alt", "significance", "review")]
    new_alt = F.when(F.col("__kind") == "var", a).when(F.col("__kind") == "ins", F.concat(seq, a)).otherwise(F.substring(seq, 1, 1))
    return rows.where(ok).select(
        "contig", F.col("__from").alias("pos"), seq.alias("ref"), new_alt.alias("alt"), titled(F.col("significance")).alias("significance"),
        titled(F.replace("review", F.lit(","), F.lit(""))).alias("review"), *rest,
    )


#: Columns of the score tables, from one: name, number and type.
SCORES = {
    "cadd": (("contig", 1, "string"), ("pos", 2, "long"), ("ref", 3, "string"), ("alt", 4, "string"), ("raw", 5, "double"), ("phred", 6, "double")),
    "cato": (("contig", 1, "string"), ("pos", 3, "long"), ("id", 4, "string"), ("ref", 9, "string"), ("alt", 10, "string"), ("score", 5, "double"), ("strand", 6, "string"), ("motif", 7, "string"), ("motif_pos", 8, "long"), ("cell_types", 11, "string")),
    "eigen": (("contig", 1, "string"), ("pos", 2, "long"), ("ref", 3, "string"), ("alt", 4, "string"), ("raw", 18, "double"), ("phred", 19, "double"), ("pc_raw", 20, "double"), ("pc_phred", 21, "double")),
}


def scores_to_variants(lines: DataFrame, kind: str) -> DataFrame:
    """Variant rows from the tab-separated lines (value) of a score table: ``cadd``, ``cato`` or ``eigen``.

    Comments and headers, whose position is no number, are left out, and ``chr`` is taken off contigs. CATO's strand is
    1, -1 or 0, and its cell types a list.
    """
    cell = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(*[F.get(cell, F.lit(i - 1)).try_cast(of).alias(n) for n, i, of in SCORES[kind]]).where("pos IS NOT NULL")
    rows = rows.withColumn("contig", F.regexp_replace("contig", "^chr", ""))
    if kind == "cato":
        rows = rows.withColumns({"strand": F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", -1).otherwise(0), "cell_types": F.split("cell_types", ";")})
    return rows


BASES = "ACGT"


def tally(ref: str, bases: str, quals: str, maps: str, min_bq: int, min_mq: int) -> dict[str, int]:
    """Counts of A, C, G, T in one pileup line, indel text, read ends, gaps and low qualities skipped."""
    n, i, read = dict.fromkeys(BASES, 0), 0, 0
    while i < len(bases):
        c = bases[i]
        if c == "^":
            i += 2
            continue
        if c == "$":
            i += 1
            continue
        if c in "+-":
            m = re.match(r"\d+", bases[i + 1 :])
            i += 1 + len(m[0]) + int(m[0]) if m else 1
            continue
        base = ref.upper() if c in ".," else c.upper()
        if base in n and ord(quals[read]) - 33 >= min_bq and ord(maps[read]) - 33 >= min_mq:
            n[base] += 1
        read += 1
        i += 1
    return n


def parse_pileup(lines: DataFrame, min_bq: int = 20, min_mq: int = 20) -> DataFrame:
    """(contig, pos, ref, n_A, n_C, n_G, n_T) from pileup lines; indels' lengths make this no regular language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for line in b["value"]:
                f = line.split("\t")
                if len(f) >= 7:
                    rows.append((f[0], int(f[1]), f[2].upper(), *tally(f[2], f[4], f[5], f[6], min_bq, min_mq).values()))
            if rows:
                yield pd.DataFrame(rows, columns=["contig", "pos", "ref", *[f"n_{x}" for x in BASES]])

    return lines.select("value").mapInPandas(run, "contig string, pos long, ref string, n_A int, n_C int, n_G int, n_T int")
