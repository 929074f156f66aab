"""Ratios of burden and their permutation test, against plain arithmetic and the moments of the draw."""

import numpy as np
import pytest

from varcohort.operators import burden as B

SCHEMA = "v int, class string, set string, ac_a long, an_a long, aa_a long, ac_b long, an_b long, aa_b long"
ROWS = [(1, "nonsyn", "test", 30, 100, 5, 10, 60, 1), (2, "syn", "test", 20, 100, 0, 12, 60, 2), (3, "nonsyn", "control", 50, 100, 10, 30, 60, 5), (4, "syn", "control", 5, 100, 1, 7, 60, 0), (5, "nonsyn", "test", 4, 80, 0, None, None, None), (6, "other", "test", 9, 10, 4, 9, 10, 4), (7, "syn", None, 9, 10, 4, 9, 10, 4)]


def test_sums_and_ratios(spark):
    r = B.burden_ratios(spark.createDataFrame(ROWS, SCHEMA)).first()
    nt_a, st_a, nc_a, sc_a, nt_b, st_b, nc_b, sc_b = 0.3 + 0.05, 0.2, 0.5, 0.05, 1 / 6, 0.2, 0.5, 7 / 60
    assert (r["nt_a"], r["sc_b"]) == pytest.approx((nt_a, sc_b))
    assert (r["rt_a"], r["rc_b"], r["r_a"]) == pytest.approx((nt_a / st_a, nc_b / sc_b, nt_a / st_a / (nc_a / sc_a)))
    assert (r["rt"], r["rc"]) == pytest.approx((nt_a / st_a / (nt_b / st_b), nc_a / sc_a / (nc_b / sc_b))) and r["r"] == pytest.approx(r["rt"] / r["rc"])


def test_nothing_to_divide_by(spark):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    r = B.burden_ratios(df).first()
    assert r["st_a"] == 0 and r["rt_a"] is None and r["r"] is None
    got = B.burden_perm_test(df, 20, 1).collect()
    assert {(x["statistic"], x["observed"], x["reps"], x["p"]) for x in got} == {(n, None, 0, 1.0) for n in ("r", "rt", "rc")}
    assert B.burden_ratios(df.limit(0)).first()["nt_a"] == 0 and {x["p"] for x in B.burden_perm_test(df.limit(0), 5, 1).collect()} <= {1.0}


def test_permuted_sums_have_the_moments_of_the_draw(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = B.permuted_sums(df, 4000, 3).orderBy("rep").toPandas()
    assert len(got) == 4000
    for a, b, ac, aa in (("st_a", "st_b", 32, 2), ("nc_a", "nc_b", 80, 15), ("sc_a", "sc_b", 12, 1)):
        assert (100 * got[a] + 60 * got[b]).to_numpy() == pytest.approx(np.full(4000, ac))  # no allele comes or goes
        assert got[a].mean() == pytest.approx(ac / 160, abs=4 * got[a].std() / np.sqrt(4000))
        dose = np.array([2] * aa + [1] * (ac - 2 * aa) + [0] * (80 - ac + aa))
        assert got[a].var() == pytest.approx(dose.var() / 4 / 50 * 30 / 79, rel=0.12)  # fifty of eighty people, without replacement
    # the variant that b doesn't have takes b's only known number, 30 people
    assert got["nt_b"].mean() == pytest.approx(40 / 160 + 4 / 140, abs=4 * got["nt_b"].std() / np.sqrt(4000))
    again = B.permuted_sums(df.repartition(5), 4000, 3).orderBy("rep").toPandas()
    assert np.allclose(again.to_numpy(), got.to_numpy())


def test_p_is_that_of_the_replicates(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    null, seen = B.with_ratios(B.permuted_sums(df, 300, 8)).toPandas(), B.burden_ratios(df).first()
    for r in B.burden_perm_test(df, 300, 8).collect():
        x = null[r["statistic"]].dropna()
        below, above = (x <= seen[r["statistic"]]).sum(), (x >= seen[r["statistic"]]).sum()
        assert (r["reps"], r["below"], r["above"]) == (len(x), below, above) and r["p"] == pytest.approx(min(1, 2 * (min(below, above) + 1) / (len(x) + 1)))
