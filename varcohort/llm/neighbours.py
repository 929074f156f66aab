"""Operator 10: approximate nearest neighbours by vantage-point trees, one tree a shard.

Largest inner product becomes smallest distance when every vector gets one more component that lifts it to the
largest norm M: |q - x'|^2 = |q|^2 + M^2 - 2 q.x. Each shard of at most about ``shard_rows`` vectors gets a tree of
vantage points with the range of distances on either side. Queries, in blocks, descend all trees: a side is left
out when ``factor`` times its lower bound, from the triangle inequality, exceeds the k-th distance so far.
Factor one leaves nothing out wrongly and so is exact; larger factors search less.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 512


def build(ids: np.ndarray, x: np.ndarray, longest: float, seed: int = 11) -> dict:
    """A vantage-point tree: points in leaf order, and nodes (vantage, radius and ranges, children or leaf slice)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    lifted = np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0.0))])
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    leaves: list[np.ndarray] = []
    filled = 0

    def grow(part: np.ndarray) -> int:
        nonlocal filled
        at = len(nodes)
        nodes.append(())
        if len(part) > LEAF:
            vantage = lifted[part[rng.integers(len(part))]]
            far = np.sqrt(((lifted[part] - vantage) ** 2).sum(axis=1))
            radius = float(np.median(far))
            near = far <= radius
            if near.all():
                near = far < radius
            if near.any() and not near.all():
                spans = (float(far[near].min()), float(far[near].max()), float(far[~near].min()), float(far[~near].max()))
                left, right = grow(part[near]), grow(part[~near])
                nodes[at] = (vantage, radius, spans, left, right)
                return at
        nodes[at] = (filled, filled + len(part))
        leaves.append(part)
        filled += len(part)
        return at

    grow(np.arange(len(ids)))
    order = np.concatenate(leaves)
    return {"ids": ids[order], "x": x[order], "nodes": nodes, "longest": longest}


def search(tree: dict, qids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of each query's k nearest in the tree (id -1: none), nearest first, ties to smaller ids."""
    ids, x, nodes = tree["ids"], tree["x"], tree["nodes"]
    best = np.full((len(q), k), -np.inf)
    names = np.full((len(q), k), np.iinfo(np.int64).max)
    norms = (q**2).sum(axis=1) + tree["longest"] ** 2
    lifted = np.column_stack([q, np.zeros(len(q))])

    def scan(a: int, b: int, who: np.ndarray) -> None:
        for lo in range(a, b, LEAF):
            hi = min(b, lo + LEAF)
            rough = q[who] @ x[lo:hi].T
            slack = 1e-9 * (1 + np.abs(norms[who]))[:, None]
            near = (rough >= best[who, k - 1][:, None] - slack) & (qids[who][:, None] != ids[None, lo:hi])
            rows = np.flatnonzero(near.any(axis=1))
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                w, (i, j) = who[part], np.nonzero(near[part])
                score = np.full((len(part), hi - lo), -np.inf)
                score[i, j] = (q[w[i]] * x[lo + j]).sum(axis=1)  # the same sum for the same pair, whatever the batch
                all_s = np.concatenate([best[w], score], axis=1)
                all_n = np.concatenate([names[w], np.broadcast_to(ids[lo:hi], score.shape)], axis=1)
                all_n[np.isneginf(all_s)] = np.iinfo(np.int64).max
                if all_s.shape[1] > 2 * k:  # what is below the k-th largest can't stay
                    floor = -np.partition(-all_s, k - 1, axis=1)[:, k - 1 : k]
                    width = int((all_s >= floor).sum(axis=1).max())
                    keep = np.argsort(all_s < floor, axis=1, kind="stable")[:, : max(width, k)]
                    all_s, all_n = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_n, keep, 1)
                top = np.lexsort((all_n, -all_s), axis=1)[:, :k]
                best[w], names[w] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_n, top, 1)

    def within(bound: np.ndarray, who: np.ndarray) -> np.ndarray:
        kth = best[who, k - 1]
        limit = np.sqrt(np.maximum(norms[who] - 2 * np.where(np.isneginf(kth), 0, kth), 0.0))
        return who[np.isneginf(kth) | (factor * bound <= limit * (1 + 1e-12) + 1e-9)]

    def visit(node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        n = nodes[node]
        if len(n) == 2:
            scan(n[0], n[1], who)
            return
        vantage, radius, (a, b, c, d), left, right = n
        far = np.sqrt(((lifted[who] - vantage) ** 2).sum(axis=1))
        to_left, to_right = np.maximum(0, np.maximum(far - b, a - far)), np.maximum(0, np.maximum(far - d, c - far))
        inner = far <= radius
        visit(left, within(to_left[inner], who[inner]))
        visit(right, within(to_right[~inner], who[~inner]))
        visit(right, within(to_right[inner], who[inner]))
        visit(left, within(to_left[~inner], who[~inner]))

    visit(0, np.arange(len(q)))
    return np.where(np.isneginf(best), -1, names), best


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, shard_rows: int = 16384, block_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the k largest inner products.

    Rows with a null id, a null or empty vector, a zero vector, or a null or non-finite component take no part;
    a query's own id is no candidate, ties go to smaller ids, and vectors are compared with those of their own
    length only. Equal vectors under several ids are all found; a repeated (id, vector) row counts once. Of several
    vectors under one id each asks for itself, with ranks from 1, and each can be found. An empty table gives no row;
    further columns are ignored.

    Every tree meets every block of queries, so trees are copied once a block and queries once a shard; with N vectors
    of d bytes and Q queries that moves N Q d (1 / block_rows + 1 / shard_rows), in the type that the vectors came in.
    """
    v, shuffles = F.col("embedding"), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size(v) > 0)).where(sound)
    rows = cut(rows.select("vec_id", v.alias("x")).groupBy("vec_id", "x").agg(F.size("x").alias("n")), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("queries"), F.sqrt(F.max(square)).alias("longest")).first()
    blocks = max(1, -(-facts["queries"] // block_rows))
    shards = max(-(-facts["rows"] // shard_rows), min(-(-shuffles // blocks), facts["rows"] // (4 * LEAF)), 1)
    longest = float(facts["longest"] or 0.0)

    def plant(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = build(part["vec_id"].to_numpy(np.int64), np.array(part["x"].tolist(), dtype=float), longest)
        tree["x"] = np.ascontiguousarray(tree["x"], dtype=part["x"].iloc[0].dtype)  # exact: they came in this type
        return pd.DataFrame({"shard": [key[0]], "n": [key[1]], "tree": [pickle.dumps(tree, protocol=5)]})

    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int"))
    trees = placed.groupBy("shard", "n").applyInPandas(plant, "shard int, n int, tree binary")
    trees = cut(trees, "trees").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("key", F.xxhash64("vec_id", "x")).withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def find(tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if tree.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "key": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "key": "int64", "vec_id": "int64"})
        grown = pickle.loads(tree["tree"][0])
        grown["x"] = grown["x"].astype(float)
        qids = queries["vec_id"].to_numpy(np.int64)
        names, scores = search(grown, qids, np.array(queries["x"].tolist(), dtype=float), k, factor)
        out = pd.DataFrame({"query_id": np.repeat(qids, k), "key": np.repeat(queries["key"].to_numpy(np.int64), k), "vec_id": names.ravel(), "score": scores.ravel()})
        return out[out["vec_id"] != -1]

    keys = ["shard", "n", "block"]
    found = trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(find, "query_id long, key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
