"""Windows, likelihoods and copies against plain sums and planted changes."""

import math

import numpy as np
import pandas as pd
import pytest

from varcohort.operators import copynumber as C


def planted(rng, sample, f, depth=60, n=1200, lost=(400, 800), contigs=("1", "2")):
    """Het loci of two contigs; a share ``f`` of cells has lost one allele on a stretch of the first."""
    rows = []
    for c in contigs:
        for i in range(n):
            k1, k2 = (1, 0) if c == contigs[0] and lost[0] <= i < lost[1] else (1, 1)
            a, b = rng.permutation([(k * f + 1 - f) / 2 * depth for k in (k1, k2)])
            rd, ad = rng.poisson(a), rng.poisson(b)
            rows.append((sample, c, 1000 * (i + 1), int(rd + ad), int(ad), float(depth)))
    return rows


SCHEMA = "s string, contig string, pos long, dp int, ad int, lambda double"


def test_kolmogorov_tail():
    assert np.allclose(C.kolmogorov([0.5, 1.0, 1.3580986, 2.0]), [0.9639452, 0.2699997, 0.05, 0.0006709], atol=1e-6)
    assert C.kolmogorov([0.0])[0] == 1
    a, b = np.array([1, 2, 3]), np.array([2, 3, 4])
    assert np.isclose(C.tables_differ(a, np.array([40, 10, 50]), b, np.array([5, 5, 190])), C.kolmogorov([0.95 * np.sqrt(100 * 200 / 300)])[0])


def test_log_gamma():
    x = np.array([1e-3, 0.5, 1, 2.5, 40, 1000.25])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("isize", [0.0, 0.01])
def test_likelihood_against_plain_densities(isize):
    def density(d, m):
        if not isize:
            return math.exp(d * math.log(m) - m - math.lgamma(d + 1))
        size = 0.5 / isize
        return math.exp(math.lgamma(d + size) - math.lgamma(size) - math.lgamma(d + 1) + size * math.log(size / (size + m)) + d * math.log(m / (size + m)))

    rng = np.random.default_rng(0)
    d1, d2, mu = rng.poisson(20, 50), rng.poisson(30, 50), rng.uniform(40, 60, 50)
    for k1, k2, f in ((1, 1, 0.0), (2, 0, 0.7), (1, 0, 0.99)):
        a, b = ((k * f + 1 - f) / 2 for k in (k1, k2))
        want = sum(math.log(0.5 * density(x, a * m) * density(y, b * m) + 0.5 * density(x, b * m) * density(y, a * m)) for x, y, m in zip(d1, d2, mu))
        assert np.isclose(C.log_likelihood(d1, d2, mu, k1, k2, f, isize), want)


def test_windows_merge_until_none_should(spark):
    rng = np.random.default_rng(4)
    rows = planted(rng, "a", 0.7) + planted(rng, "b", 0.0)
    df = C.first_windows(spark.createDataFrame(rows, SCHEMA), "s", 50)
    own = df.toPandas()
    assert own.groupby(["s", "contig", "window"]).size().max() <= 50
    got = C.merge_windows(df, "s", 50, 0.01).toPandas().sort_values(["s", "contig", "first"])
    cell = lambda d, m: np.where(d > 0, np.floor(np.log(np.maximum(d, 0.5) / m) * C.GRAIN), C.EMPTY)
    for (s, c), chain in got.groupby(["s", "contig"]):
        part = own[(own["s"] == s) & (own["contig"] == c)]
        assert chain["first"].tolist()[1:] == (chain["last"] + 1).tolist()[:-1] and chain["n_values"].sum() == 2 * len(part)
        tables = []
        for first, last in zip(chain["first"], chain["last"]):
            w = part[part["window"].between(first, last)]
            tables.append(np.unique(np.r_[cell(w["dp"] - w["ad"], w["lambda"]), cell(w["ad"], w["lambda"])], return_counts=True))
        for i in range(len(tables) - 1):
            p = C.tables_differ(*tables[i], *tables[i + 1])
            assert np.isclose(p, chain["p_next"].iloc[i]) and p * chain["n_tests"].iloc[i] < 0.01
        assert chain["p_next"].isna().sum() == 1
    sizes = got.groupby(["s", "contig"]).size()
    assert sizes["a", "1"] == 3 and sizes["a", "2"] == 1 and sizes["b", "1"] == 1


def test_copies_and_share_are_found(spark):
    rng = np.random.default_rng(5)
    rows = planted(rng, "loss", 0.6) + planted(rng, "none", 0.0)
    segments, models = C.segment_copy_number(spark.createDataFrame(rows, SCHEMA), "s", 50)
    best = {r["s"]: r for r in models.where("best").collect()}
    assert best["none"]["mink"] == 1 and best["none"]["f"] == 0 and best["none"]["p"] == 0
    assert best["loss"]["maxk"] == 1 and abs(best["loss"]["f"] - 0.6) < 0.03 and best["loss"]["p"] == 3
    seg = segments.toPandas().sort_values(["s", "contig", "start"])
    lost = seg[(seg["s"] == "loss") & (seg["contig"] == "1")]
    assert list(zip(lost["k1"], lost["k2"])) == [(1, 1), (1, 0), (1, 1)]
    assert abs(lost["start"].iloc[1] - 400_000) <= 50_000 and abs(lost["end"].iloc[1] - 800_000) <= 50_000
    assert seg.groupby("s")["n"].sum().tolist() == [2400, 2400] and len(seg[seg["s"] == "none"]) == 2
    # the likelihood and BIC of the chosen model, and that no cell share of a fine list is better
    f = pd.DataFrame(rows, columns=["s", "contig", "pos", "dp", "ad", "lambda"])
    own = f[f["s"] == "loss"].reset_index(drop=True)
    windows = lost[["start", "end"]].to_numpy().tolist()

    def whole(share):
        parts = [own[(own["contig"] == "1") & own["pos"].between(a, b)] for a, b in windows] + [own[own["contig"] == "2"]]
        return sum(max(C.log_likelihood((p["dp"] - p["ad"]).to_numpy(), p["ad"].to_numpy(), p["lambda"].to_numpy(), k1, k2, share, 0.0) for k1, k2 in C.pairs(1)) for p in parts)

    row = best["loss"]
    assert np.isclose(whole(row["f"]), row["ll"]) and np.isclose(row["bic"], -2 * row["ll"] + 3 * math.log(2400))
    assert row["ll"] >= max(whole(x) for x in np.linspace(0.05, 0.99, 95)) - 0.05
    assert np.isclose(seg[seg["s"] == "loss"]["ll"].sum(), row["ll"])


def test_negative_binomial_and_empty(spark):
    rng = np.random.default_rng(6)
    rows = [("a", "1", i, int(d + e), int(e), 80.0) for i, (d, e) in enumerate(zip(rng.negative_binomial(20, 20 / 60, 800), rng.negative_binomial(20, 20 / 60, 800)))]
    segments, models = C.segment_copy_number(spark.createDataFrame(rows, SCHEMA), "s", 100, max_copies=1, family="nb", rounds=3)
    null = models.where("mink = 1").first()
    assert models.where("best").first()["mink"] == 1 and abs(0.5 / null["isize"] - 20) < 6 and null["p"] == 1
    assert segments.agg({"n": "sum"}).first()[0] == 800
    assert C.segment_copy_number(spark.createDataFrame([], SCHEMA))[0].count() == 0
