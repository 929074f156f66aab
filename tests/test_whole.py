"""The views hold every part and customer, and no query is empty or constant for want of cases."""

import duckdb
import pytest

from varcohort.operators import calling as K
from varcohort.plans import fixtures as X
from varcohort.plans import registry

SF = "/root/testdata/sf0.01"


def run(spark, name):
    return registry.QUERIES[name](spark, SF)


def test_every_part_is_a_variant(spark):
    got = {r["v"] for r in run(spark, "split_multi").select("v").distinct().collect()}
    assert got == {r[0] for r in duckdb.sql(f"SELECT p_partkey FROM '{SF}/part.parquet'").fetchall()}


def test_rows_grow_with_the_tables(spark, small):
    for name in ("variant_qc", "variant_predicates", "het_trace"):
        assert registry.QUERIES[name](spark, SF).count() > 2 * registry.QUERIES[name](spark, small).count()


def test_every_customer_is_a_sample(spark):
    got = run(spark, "het_trace").agg({"s": "max", "v": "max"}).first()
    assert got["max(s)"] > 119 and got["max(v)"] > 299


@pytest.mark.parametrize("name", ["het_balance", "hwe_exact", "mark_fixed"])
def test_queries_without_a_twin_are_whole(spark, name):
    assert run(spark, name).agg({"v": "max"}).first()["max(v)"] > 299


def test_indels_and_multiallelic_sites(spark):
    v = X.spanned(X.variants)(spark, SF)
    assert v.where("length(ref) > 1").count() and v.where("length(alt) > 1").count() and v.where("size(alts) > 1").count()
    assert v.where("exists(alts, a -> a = ref)").count() == 0


def test_groups_without_calls(spark):
    gt = spark.createDataFrame([(1, 1, None), (1, 2, 0), (1, 3, 2)], "v int, s int, gt int")
    by = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "s int, pop int")
    assert [(r["v"], r["worst"]) for r in K.hwe_all_groups(gt, by, "pop", 12.5).collect()] == [(1, 2.0)]


@pytest.mark.parametrize("name", ["loh_trace"])
def test_all_samples_reach_the_operator(spark, name):
    got = {int(r["s"]) for r in run(spark, name).select("s").distinct().collect()}
    assert got == {r[0] for r in duckdb.sql(f"SELECT DISTINCT o_custkey FROM '{SF}/lineitem.parquet' JOIN '{SF}/orders.parquet' ON l_orderkey = o_orderkey").fetchall()}


def test_depth_cap_drops_outliers_only(spark):
    gt = X.spanned(X.genotypes)(spark, SF)
    assert gt.where("dp > 100").count() < 0.01 * gt.count()
