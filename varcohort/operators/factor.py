"""Non-negative factors of a matrix of few features and many samples: all ranks and restarts in one job a round.

Samples lie in blocks. Given a fit's features, its samples' weights are solved block by block, so only products of
features with weights, and of weights with each other, add up over blocks; from these the features are renewed. What is
kept between rounds is every fit's feature matrix, which doesn't grow with the samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep

TINY = 1e-12
MOST_FEATURES = 4096


def weights(v: np.ndarray, w: np.ndarray, times: int) -> np.ndarray:
    """Non-negative weights of the columns of ``v``: multiplicative updates from the clipped least-squares solution."""
    wv, ww = w.T @ v, w.T @ w
    h = np.maximum(np.linalg.lstsq(ww + TINY * np.eye(len(ww)), wv, rcond=None)[0], 1e-6 * max(v.mean(), TINY))
    for _ in range(times):
        h *= wv / (ww @ h + TINY)
    return h


def renewed(w: np.ndarray, vh: np.ndarray, hh: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        w = w * (vh / (w @ hh + TINY))
    return w


class Factors:
    """The best restart of each rank: ``features[k]`` (features x k), and ``fits``, rows (k, restart, rss, explained) of all."""

    def __init__(self, matrix: DataFrame, feature: str, sample: str, value: str, ranks: list[int], restarts: int, rounds: int = 30, inner: int = 20, block: int = 1024, parts: int = 8, seed: int = 1):
        self.names = [r[0] for r in matrix.select(feature).distinct().orderBy(feature).limit(MOST_FEATURES + 1).collect()]
        if len(self.names) > MOST_FEATURES:
            raise ValueError(f"more than {MOST_FEATURES} features: turn the matrix")
        self.feature, self.sample, self.value, self.inner = feature, sample, value, inner
        self.kind = dict(matrix.dtypes)[sample]
        self.spark, place, size = matrix.sparkSession, {n: i for i, n in enumerate(self.names)}, len(self.names)
        n = matrix.agg(F.approx_count_distinct(sample).alias("n")).first()["n"]

        def dense(part: pd.DataFrame) -> pd.DataFrame:
            own, at = np.unique(part[sample].to_numpy(), return_inverse=True)
            v = np.zeros((size, len(own)))
            np.add.at(v, (part[feature].map(place).to_numpy(), at), part[value].to_numpy(float))
            return pd.DataFrame({"samples": [own.tolist()], "v": [v.tobytes()]})

        rows = matrix.where(F.col(value).isNotNull() & F.col(sample).isNotNull() & F.col(feature).isNotNull()).select(feature, sample, F.col(value).cast("double").alias(value))
        self.blocks = keep(rows.groupBy(F.pmod(F.xxhash64(sample), F.lit(max(1, -(-n // block)))).alias("__b")).applyInPandas(dense, f"samples array<{self.kind}>, v binary"))
        fits = [(k, r) for k in ranks for r in range(1, restarts + 1)]
        w = {(k, r): np.random.default_rng([seed, k, r]).uniform(0.1, 1.0, (size, k)) for k, r in fits}
        total, rss = 0.0, {}
        for _ in range(rounds):
            before, total, sums = dict(rss), *self.products(w, parts)
            for (k, r), own in sums.items():
                vh, hh = own[: size * k].reshape(size, k), own[size * k :].reshape(k, k)
                rss[k, r] = max(total - 2 * float((w[k, r] * vh).sum()) + float((w[k, r].T @ w[k, r] * hh).sum()), 0.0)
            if before and all(before[f] - rss[f] <= 1e-6 * total for f in rss):
                break
            self.known = dict(w)
            w = {(k, r): renewed(w[k, r], own[: size * k].reshape(size, k), own[size * k :].reshape(k, k), inner) for (k, r), own in sums.items()}
        self.fits = [(k, r, rss[k, r], 1 - rss[k, r] / total if total else 0.0) for k, r in fits if (k, r) in rss]
        best = {k: min((x for x in self.fits if x[0] == k), key=lambda x: (x[2], x[1]))[:2] for k in ranks if any(x[0] == k for x in self.fits)}
        self.features = {k: w[f] for k, f in best.items()}

    def products(self, w: dict, parts: int) -> tuple[float, dict]:
        """(sum of squares, {fit: features x weights and weights x weights}); fits are dealt over ``parts`` tasks a block."""
        inner, size, names = self.inner, len(self.names), sorted(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for part, raw in zip(b["part"], b["v"]):
                    v = np.frombuffer(raw).reshape(size, -1)
                    if part == 0:
                        out[-1] = out.get(-1, 0) + np.array([(v * v).sum()])
                    for i in range(part, len(names), parts):
                        h = weights(v, w[names[i]], inner)
                        out[i] = out.get(i, 0) + np.concatenate([(v @ h.T).ravel(), (h @ h.T).ravel()])
            if out:
                yield pd.DataFrame({"fit": list(out), "sums": list(out.values())})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"fit": rows["fit"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"]), axis=0)]})

        schema = "fit int, sums array<double>"
        dealt = self.blocks.select("v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(F.xxhash64("v"), "part")
        rows = dealt.mapInPandas(run, schema).groupBy("fit").applyInPandas(add, schema).collect()  # a matrix a fit, which doesn't grow with the samples
        found = {r["fit"]: np.array(r["sums"]) for r in rows}
        return float(found.pop(-1, np.zeros(1))[0]), {names[i]: s for i, s in found.items()}

    def signatures(self, k: int) -> DataFrame:
        """(component, feature, share): the best fit's features, each component summing to one, the heaviest first."""
        w = self.ordered(k)
        rows = [(j + 1, n, float(w[i, j] / max(w[:, j].sum(), TINY))) for j in range(w.shape[1]) for i, n in enumerate(self.names)]
        return self.spark.createDataFrame(rows, "component int, feature string, share double" if isinstance(self.names[0], str) else "component int, feature long, share double")

    def ordered(self, k: int) -> np.ndarray:
        w = self.features[k]
        return w[:, np.argsort(-w.sum(0), kind="stable")]

    def exposures(self, k: int) -> DataFrame:
        """(sample, component, exposure) of every sample, in units of the signatures' shares."""
        w, inner, size, sample = self.ordered(k), self.inner, len(self.names), self.sample
        scale = np.maximum(w.sum(0), TINY)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for own, raw in zip(b["samples"], b["v"]):
                    h = weights(np.frombuffer(raw).reshape(size, -1), w, 10 * inner) * scale[:, None]
                    yield pd.DataFrame({sample: np.repeat(np.asarray(own), w.shape[1]), "component": np.tile(np.arange(1, w.shape[1] + 1, dtype=np.int32), len(own)), "exposure": h.T.ravel()})

        return self.blocks.mapInPandas(run, f"{sample} {self.kind}, component int, exposure double")
