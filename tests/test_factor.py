"""All ranks and restarts at once against the same steps on the whole matrix."""

import numpy as np
import pandas as pd
import pytest

from varcohort.operators import factor as N


def test_against_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    w, h = rng.gamma(0.4, 1, (24, 3)), rng.gamma(1, 30, (3, 300))
    v = rng.poisson(w @ h).astype(float)
    f = pd.DataFrame([(f"f{i:02d}", j, v[i, j]) for i in range(24) for j in range(300) if v[i, j]], columns=["kind", "s", "n"])
    fit = N.Factors(spark.createDataFrame(f), "kind", "s", "n", [1, 2, 3, 4], 3, rounds=8, block=64)
    got = {(k, r): rss for k, r, rss, _ in fit.fits}
    keep = v[:, v.sum(0) > 0]
    for k in (1, 3):
        for r in (1, 2, 3):
            own = np.random.default_rng([1, k, r]).uniform(0.1, 1.0, (24, k))
            trail = []
            for _ in range(8):
                x = np.hstack([N.weights(b, own, 20) for b in [keep]])
                trail.append(((keep - own @ x) ** 2).sum())
                own = N.renewed(own, keep @ x.T, x @ x.T, 20)
            assert all(b <= a * (1 + 1e-6) for a, b in zip(trail, trail[1:]))
            assert got[k, r] == pytest.approx(trail[-1], rel=0.02) or got[k, r] in [pytest.approx(t, rel=1e-4) for t in trail]
    best = {k: max(e for q, _, _, e in fit.fits if q == k) for k in (1, 2, 3, 4)}
    assert best[1] < best[2] < best[3] > 0.97 and best[4] - best[3] < 0.02
    shares = fit.signatures(3).toPandas().pivot(index="feature", columns="component", values="share").to_numpy()
    assert np.allclose(shares.sum(0), 1)
    true = w / w.sum(0)
    match = [max(np.corrcoef(true[:, i], shares[:, j])[0, 1] for j in range(3)) for i in range(3)]
    assert min(match) > 0.9
    e = fit.exposures(3).toPandas()
    assert len(e) == 3 * len(set(f["s"])) and (e["exposure"] >= 0).all() and e["exposure"].sum() == pytest.approx(v.sum(), rel=0.03)


def test_empty_and_too_many(spark, monkeypatch):
    assert N.Factors(spark.createDataFrame([], "kind string, s int, n int"), "kind", "s", "n", [2], 1).fits == []
    monkeypatch.setattr(N, "MOST_FEATURES", 2)
    with pytest.raises(ValueError):
        N.Factors(spark.createDataFrame([(str(i), 1, 1) for i in range(3)], "kind string, s int, n int"), "kind", "s", "n", [2], 1)
