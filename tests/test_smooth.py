"""Penalised splines, depth anomalies and permutation tests against dense algebra."""

import numpy as np
import pandas as pd
import pytest

from varcohort.operators import smooth as S


def dense(frame, y, terms, pieces):
    x = np.column_stack([np.ones(len(frame)), *[S.spline(frame[t].to_numpy(float), frame[t].min(), frame[t].max(), pieces) for t in terms]])
    target = frame[y].to_numpy(float)
    beta, rss, strength, df = S.penalised(x.T @ x, x.T @ target, target @ target, len(frame), S.roughness(len(terms), pieces))
    return x, beta, rss, strength


def test_splines_sum_to_one_and_bend_little():
    x = np.r_[np.linspace(-3, 5, 200), -9, 12]
    b = S.spline(x, -3.0, 5.0, 7)
    assert b.shape == (202, 10) and np.allclose(b.sum(1), 1) and (b >= -1e-15).all() and ((b > 0).sum(1) <= 4).all()
    assert np.allclose(S.spline(np.full(3, 2.0), 2.0, 2.0, 4).sum(1), 1)
    line = np.linspace(0, 1, 10)  # coefficients on a line cost nothing
    assert np.isclose(np.r_[0, line] @ S.roughness(1, 7) @ np.r_[0, line], 0)


def test_penalised_residuals_are_those_of_the_fit():
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"a": rng.uniform(0, 6, 400), "b": rng.normal(size=400)})
    f["y"] = np.sin(f["a"]) + 0.1 * rng.normal(size=400)
    x, beta, rss, strength = dense(f, "y", ["a", "b"], 8)
    assert np.isclose(((f["y"] - x @ beta) ** 2).sum(), rss) and rss < 0.02 * 400
    p = np.linalg.solve(x.T @ x + strength * S.roughness(2, 8) + 1e-9 * np.trace(x.T @ x) / len(beta) * np.eye(len(beta)), x.T @ f["y"])
    assert np.allclose(p, beta)


def test_depth_anomaly_against_dense_algebra(spark):
    rng = np.random.default_rng(2)
    n, cols = 600, ["gc1", "gc2", "gc3"]
    gc = np.clip(0.45 + 0.1 * rng.normal(size=(n, 1)) + 0.03 * rng.normal(size=(n, 3)), 0, 1)
    affinity = np.exp(0.2 * rng.normal(size=n))
    frames = []
    for s, (depth, slope) in enumerate([(40, 3.0), (90, -2.0), (15, 0.0)]):
        mean = depth * affinity * np.exp(slope * (gc[:, 0] - 0.45) - 4 * (gc[:, 0] - 0.45) ** 2)
        frames.append(pd.DataFrame({"s": s, "v": np.arange(n), "dp": rng.poisson(mean), "ad": 0}))
    trace = pd.concat(frames)[lambda f: ~((f["s"] == 1) & (f["v"] % 7 == 0))]
    a = pd.DataFrame({"v": np.arange(n), "affinity": affinity})
    g = pd.DataFrame({"v": np.arange(n), **{c: gc[:, i] for i, c in enumerate(cols)}})
    g.loc[5, "gc2"] = None
    fits, out = S.depth_anomaly(spark.createDataFrame(trace), spark.createDataFrame(a), spark.createDataFrame(g), cols, pieces=5)
    got = out.toPandas().set_index(["s", "v"])["lambda"]
    for s, own in trace[trace["dp"] > 0].merge(a, on="v").merge(g.dropna(), on="v").groupby("s"):
        z = (own[cols] - own[cols].mean()) / own[cols].std()
        _, vectors = np.linalg.eigh(np.corrcoef(z.T))
        vectors = vectors[:, ::-1]
        vectors *= np.sign(vectors[np.abs(vectors).argmax(0), range(3)])
        own = own.assign(log_a=np.log(own["affinity"]), **{f"pc{i + 1}": z.to_numpy() @ vectors[:, i] for i in range(3)})
        own["y"] = np.log(own["dp"]) - np.log(own["dp"].mean()) - own["log_a"]
        x, beta, *_ = dense(own, "y", ["log_a", "pc1", "pc2", "pc3"], 5)
        want = np.exp(np.log(own["dp"].mean()) + own["log_a"] + x @ beta)
        want *= (own["dp"] / want).mean()
        assert np.allclose(got[s].loc[own["v"]].to_numpy(), want, rtol=1e-6) and len(got[s]) == len(own)
        assert np.corrcoef(got[s].loc[own["v"]], own["dp"])[0, 1] > (0.9 if s < 2 else 0.5)
    assert fits.count() == 3


def test_depth_anomaly_of_nothing_and_of_constants(spark):
    one = spark.createDataFrame([("a", i, 10) for i in range(5)], "s string, v int, dp int")
    flat = spark.createDataFrame([(i, 1.0, 0.4) for i in range(5)], "v int, affinity double, gc double")
    out = S.depth_anomaly(one, flat.select("v", "affinity"), flat.select("v", "gc"), ["gc"])[1].collect()
    assert [round(r["lambda"], 6) for r in out] == [10.0] * 5
    assert S.depth_anomaly(one.limit(0), flat.select("v", "affinity"), flat.select("v", "gc"), ["gc"])[1].count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_places_are_permuted(n):
    at = np.arange(n)
    for rep in range(6):
        to = S.shuffled(at, n, 7, rep)
        assert sorted(to) == at.tolist() and (rep or (to == at).all())
    if n == 1000:
        assert (S.shuffled(at, n, 7, 1) != S.shuffled(at, n, 7, 2)).mean() > 0.9
        first = np.array([S.shuffled(np.array([0]), n, 7, r)[0] for r in range(1, 2001)])
        assert abs(first.mean() - 499.5) < 30 and len(set(first)) > 800


@pytest.mark.parametrize("block", [37, 1 << 16])
def test_permutations_against_dense_algebra(spark, block):
    rng = np.random.default_rng(3)
    f = pd.DataFrame({"g": ["x"] * 130 + ["y"] * 90, "k": np.arange(220), "age": rng.uniform(40, 90, 220), "bmi": rng.normal(27, 4, 220), "m": rng.normal(size=220)})
    f["grip"] = 50 - 0.3 * f["age"] + np.where(f["g"] == "x", 4 * np.tanh(f["m"]), 0) + rng.normal(size=220)
    f.loc[3, "bmi"] = None
    df = spark.createDataFrame(f)
    reps, seed = 40, 5
    got = {r["g"]: r for r in S.smooth_perm_test(df, "g", "k", "grip", ["age", "bmi"], ["m"], reps, seed, pieces=4, block=block, chunk=7).collect()}
    places = {r["k"]: r["i"] for r in S.numbered(df.na.drop(), "g", "k", seed).collect()}
    for g, own in f.dropna().groupby("g"):
        own = own.assign(i=own["k"].map(places)).sort_values("i").reset_index(drop=True)
        assert own["i"].tolist() == list(range(len(own)))
        deviance = [dense(own.assign(m=own["m"].to_numpy()[S.shuffled(np.arange(len(own)), len(own), seed, rep)]), "grip", ["age", "bmi", "m"], 4)[2] for rep in range(reps + 1)]
        below = sum(d <= deviance[0] * (1 + 1e-12) for d in deviance[1:])
        assert np.isclose(got[g]["deviance"], deviance[0]) and got[g]["below"] == below and got[g]["n"] == len(own)
        assert np.isclose(got[g]["p"], (below + 0.5) / (reps + 1))
    assert got["x"]["p"] < 0.02 < got["y"]["p"]


def test_split_is_exact(spark):
    df = spark.range(1001).selectExpr("id", "id % 2 AS g")
    n = {(r["g"], r["split"]): r["count"] for r in S.split_rows(df, "g", "id", 3).groupBy("g", "split").count().collect()}
    assert n == {(0, "training"): 125, (0, "validation"): 376, (1, "training"): 125, (1, "validation"): 375}
