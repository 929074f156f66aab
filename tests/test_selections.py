"""Chosen rows, other ways of counting, merge counts and sorted unions on small fixtures."""

import itertools
import random

from pyspark.sql import functions as F

from varcohort.operators import af as AF
from varcohort.operators import alleles as L
from varcohort.operators import annotate as A
from varcohort.operators import series as S
from varcohort.operators import stats as T
from varcohort.sources import readers as R


def test_tau_against_all_pairs(spark):
    rng = random.Random(3)
    for n, top in ((1, 5), (2, 1), (60, 1), (150, 4), (150, 10_000)):
        rows = [(rng.randrange(top), rng.randrange(top)) for _ in range(n)]
        got = T.kendall_tau(spark.createDataFrame([*rows, (None, 1), (1, None)], "x int, y int"), "x", "y").first()
        signs = [(a[0] - b[0]) * (a[1] - b[1]) for a, b in itertools.combinations(rows, 2)]
        assert (got["concordant"], got["discordant"]) == (sum(s > 0 for s in signs), sum(s < 0 for s in signs)), (n, top)
        assert got["n"] == n and (got["tau"] is not None or top == 1 or n == 1)


def test_rows_chosen_with_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, "a", 8), (3, None, 9), (4, None, 9), (5, "a", 9), (6, "b", 9)], "i int, k string, x int")
    assert [r["i"] for r in L.drop_repeats(rows, "i", ["k"]).orderBy("i").collect()] == [1, 3, 5, 6]
    assert {r["k"]: (r["i"], r["x"]) for r in L.first_rows(rows, ["k"], ["i"]).collect()} == {"a": (1, 7), None: (3, 9), "b": (6, 9)}
    assert L.drop_repeats(rows.limit(0), "i", ["k"]).count() == 0 and L.first_rows(rows.limit(0), ["k"], ["i"]).count() == 0


def test_gene_lists_and_datasets(spark):
    v = spark.createDataFrame([(1, "1", 5, "A", "C"), (2, "1", 6, "A", "C"), (3, "1", 7, "A", "C")], "v int, contig string, pos int, ref string, alt string")
    alleles = spark.createDataFrame([(1, "g"), (1, "g"), (2, None), (3, "h"), (3, "g")], "v int, symbol string")
    wanted = spark.createDataFrame([("g",), ("g",), (None,)], "symbol string")
    assert sorted(r["v"] for r in A.any_symbol_in(v, alleles, wanted).collect()) == [1, 3]
    other = spark.createDataFrame([("1", 5, "A", "C", 9), ("1", 5, "A", "C", 4), ("1", 6, "A", "G", 1)], "contig string, pos int, ref string, alt string, n int")
    got = {r["v"]: r["o"] and r["o"]["twice"] for r in A.annotate_from_dataset(v, other, {"twice": 2 * F.col("n")}, "o").collect()}
    assert got == {1: 8, 2: None, 3: None}


def test_every_class_is_there(spark):
    loci = spark.createDataFrame([("s", "ACA", "T"), ("s", "ACA", None), ("s", "ACA", None), ("s", None, "T"), ("t", "GTG", None)], "sample string, triplet string, alt string")
    got = {(r["sample"], r["triplet"], r["alt"]): (r["n"], r["background"], r["burden"]) for r in S.signature_spectrum(loci, "sample", "alt").collect()}
    assert len(got) == 2 * 96 and len(set(S.CLASSES)) == 96
    assert got["s", "ACA", "T"] == (1, 3, 1e6 / 3) and got["s", "ACA", "G"] == (0, 3, 0.0) and got["s", "GTG", "A"] == (0, 0, None) and got["t", "GTG", "C"] == (0, 1, 0.0)


def test_shares_of_a_group(spark):
    people = spark.createDataFrame([("A", i, 90 - i) for i in range(36)], "cohort string, s int, age int")
    burden = spark.createDataFrame([(i, c, n) for i in range(36) for c, n in (("x", i % 3), ("y", 1 if i < 30 else 0))], "s int, class string, value int")
    rows = S.collapse_burden(burden, people, "cohort", ["age"], 16).collect()
    assert {r["bucket"] for r in rows} == {0, 1} and sum(r["value"] for r in rows) == sum(i % 3 for i in range(36)) + 30
    for b in (0, 1):
        assert abs(sum(r["share"] for r in rows if r["bucket"] == b) - 1) < 1e-12
    none = S.collapse_burden(burden.withColumn("value", F.lit(0)), people, "cohort", ["age"], 16)
    assert none.where("share IS NULL").count() == none.count() == 4


def test_counting_by_zygosity(spark):
    counts = spark.createDataFrame([(1, "p", 4, 1), (1, "q", 2, 3), (2, "q", 5, 0)], "v int, cohort string, n_ra int, n_aa int")
    got = {(r["v"], r["counted"]): (r["ac_a"], r["ac_b"]) for r in AF.by_zygosity(counts, F.col("cohort") == "p").collect()}
    assert got == {(1, "alleles"): (6, 8), (1, "het"): (4, 2), (1, "hom"): (1, 3), (2, "alleles"): (0, 5), (2, "het"): (0, 5), (2, "hom"): (0, 0)}


def test_files_of_samples_in_one_order(spark, tmp_path):
    rng = random.Random(5)
    want = []
    for name in ("one", "two.x", "three"):
        rows = [(rng.choice("12X"), s := rng.randrange(1000), s + 1 + rng.randrange(50)) for _ in range(200)]
        (tmp_path / f"{name}.bed").write_text("track name=x\n" + "".join(f"chr{c}\t{a}\t{b}\n" for c, a, b in rows))
        want += [(*r, name.split(".")[0]) for r in rows]
    got = [tuple(r) for r in R.read_sorted_union(spark, [f"{tmp_path}/{n}.bed" for n in ("one", "two.x", "three")]).collect()]
    assert got == sorted(want)
