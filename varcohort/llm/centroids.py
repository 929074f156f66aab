"""Exact centroid clustering by a vector-approximation file.

Every vector is kept twice: whole, in a table bucketed by row, and as cells of a few bits a component. A round reads
the cells alone. Distances are told less the vector's own squared norm, which all centroids share: what is left,
|c|^2 - 2 c x, is a sum over components in which lookup tables, one for each centroid, give the least and the greatest
value of a cell. So each distance has an interval, about half as wide as without that; where one lies below all others
the vector is assigned, and only where intervals overlap, or where its centroid changes, is the whole vector fetched,
by a join on the row that doesn't move the table. Sums of clusters change by the vectors that change cluster.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_path, shared_dir

WIDTH, SCALE = 64, 1024
#: Components beyond this would carry squared distances out of 64 bits.
LARGEST = 1 << 27


def integers(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def usable(embedding: Column) -> Column:
    """Whether a vector has exactly 64 components, none of them null or not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(embedding) == WIDTH) & F.forall(embedding, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False))), F.lit(False))


def matrix(batch: pa.RecordBatch, column: str = "q") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, WIDTH)


class Cells:
    """Bounds of the cells of each component: a component's values fall into 2^bits ranges that hold about equally many."""

    def __init__(self, edges: list[list[int]]):
        self.inner = [np.array(e[1:-1], dtype=np.int64) for e in edges]
        self.low = np.array([e[:-1] for e in edges], dtype=np.int64)
        self.high = np.array([[max(b - 1, a) for a, b in zip(e[:-1], e[1:-1])] + [e[-1]] for e in edges], dtype=np.int64)

    def of(self, q: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(inner, q[:, d], side="right") for d, inner in enumerate(self.inner)], 1).astype(np.uint8)

    def intervals(self, cells: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest of each vector's squared distances, less its squared norm, summed from lookup tables."""
        across, least, most = np.arange(WIDTH), [], []
        for c in centroids:
            own = c[:, None]
            one, two = own * own - 2 * own * self.low, own * own - 2 * own * self.high
            least.append(np.minimum(one, two)[across, cells].sum(1))
            most.append(np.maximum(one, two)[across, cells].sum(1))
        return np.stack(least, 1), np.stack(most, 1)

    def judge(self, cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Each vector's nearest centroid where the cells tell it, else -1."""
        numbers = distinct(centroids)
        least, most = self.intervals(cells, centroids[numbers])
        open_ = least <= most.min(1)[:, None]
        return np.where(open_.sum(1) == 1, np.array(numbers)[open_.argmax(1)], -1)


def distinct(centroids: np.ndarray) -> list[int]:
    """Numbers of the centroids without those that equal an earlier one, which wins every tie."""
    return sorted({c.tobytes(): i for i, c in reversed(list(enumerate(centroids)))}.values())


def assign(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance), exactly; the first of equally near ones."""
    far = np.stack([((q - c) ** 2).sum(1) for c in centroids], 1)
    best = far.argmin(1)
    return best.astype(np.int32), far[np.arange(len(q)), best]


def sums(parts: dict[int, np.ndarray], fetched: int) -> pa.RecordBatch:
    """A row (cluster, s) for each cluster: the change of its count and of its sums; under cluster -1 how many vectors were fetched."""
    keys = sorted(parts)
    return pa.RecordBatch.from_arrays([pa.array([-1, *keys], pa.int32()), pa.array([[fetched], *[parts[k].tolist() for k in keys]], pa.list_(pa.int64()))], names=["cluster", "s"])


def total(rows: pd.DataFrame) -> pd.DataFrame:
    """One cluster's rows, one from each task, summed."""
    return pd.DataFrame({"cluster": rows["cluster"].iloc[:1], "s": [np.sum(np.stack(rows["s"]), axis=0)]})


def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, n, low, high): how many vectors a task has, and the ends of each component."""
    n, low, high = 0, np.full(WIDTH, np.iinfo(np.int64).max), np.full(WIDTH, np.iinfo(np.int64).min)
    for b in batches:
        q = matrix(b)
        if len(q):
            n, low, high = n + len(q), np.minimum(low, q.min(0)), np.maximum(high, q.max(0))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH, dtype=np.int32)), pa.array([n] * WIDTH, pa.int64()), pa.array(low), pa.array(high)], names=["d", "n", "low", "high"])


def add(parts: dict[int, np.ndarray], q: np.ndarray, to: np.ndarray, sign: int) -> None:
    for k in np.unique(to):
        own = q[to == k]
        parts[int(k)] = parts.get(int(k), np.zeros(WIDTH + 1, np.int64)) + sign * np.concatenate([[len(own)], own.sum(0)])


class Clusters:
    """``centroids`` and how many whole vectors each round fetched (``fetched``), after ``fit``; ``rows`` are the whole vectors."""

    def __init__(self, vectors: DataFrame, k: int = 8, rounds: int = 10, bits: int = 8, seed: int = 3, sample: int = 4096):
        self.spark, self.fetched = vectors.sparkSession, []
        kept = vectors.where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("q"))
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        ends = kept.select("q").mapInArrow(extremes, "d int, n long, low long, high long").groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
        self.n = ends[0]["n"] if ends else 0
        if not self.n:
            self.centroids = np.zeros((0, WIDTH), np.int64)
            return
        if max(max(-r["low"], r["high"]) for r in ends) > LARGEST:
            raise ValueError(f"components beyond {LARGEST // SCALE} aren't supported: squared distances would leave 64 bits")
        first = np.array([r["q"] for r in kept.orderBy(order, "q").limit(max(k, sample)).collect()], dtype=np.int64)  # at most ``sample`` vectors
        self.centroids = first[:k]
        edges = np.quantile(first, np.arange(1, 2**bits) / 2**bits, axis=0).astype(np.int64)
        cells = Cells([[r["low"], *np.clip(edges[:, d], r["low"], r["high"]).tolist(), r["high"]] for d, r in enumerate(ends)])
        self.name, self.at = f"varcohort_vectors_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/vectors-{uuid.uuid4().hex}"
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(self.n // 500_000, 50_000))
        rows = kept.withColumn("q", F.col("q").cast("array<int>")).withColumn("row", F.monotonically_increasing_id())
        rows.repartition(buckets, "row").write.format("parquet").option("path", self.at).bucketBy(buckets, "row").sortBy("row").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        try:
            self.fit(cells, rounds)
        except BaseException:
            self.drop()
            raise

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        drop_path(self.spark, self.at)

    def fit(self, cells: Cells, rounds: int) -> None:
        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(cells.of(matrix(b))).tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("row"), packed.cast(pa.binary())], names=["row", "cells"])

        at = f"{shared_dir(self.spark)}/cells-{uuid.uuid4().hex}"
        self.rows.select("row", "q").mapInArrow(approximate, "row long, cells binary").write.parquet(at)
        approximations = self.spark.read.schema("row long, cells binary").parquet(at)
        before, sums_of = None, {k: np.zeros(WIDTH + 1, dtype=object) for k in range(len(self.centroids))}
        for _ in range(rounds):
            rows = self.rows.select("row", "q") if before is None else self.rows.select("row", "q").join(self.open(approximations, cells, before), "row")
            self.fetched.append(0)
            for k, change in self.change(rows, before):
                if k < 0:
                    self.fetched[-1] = change[0]
                else:
                    sums_of[k] = sums_of[k] + np.array(change, dtype=object)
            after = np.array([[int(x) // int(sums_of[k][0]) for x in sums_of[k][1:]] if sums_of[k][0] else c for k, c in enumerate(self.centroids)], dtype=np.int64)
            before, self.centroids = self.centroids, after
            if (before == after).all():  # later rounds would change nothing
                break
        drop_path(self.spark, at)

    def open(self, approximations: DataFrame, cells: Cells, before: np.ndarray) -> DataFrame:
        """Rows whose whole vector is needed: intervals overlap under the centroids of this round or the last, or the nearest one has changed."""
        now = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.frombuffer(b"".join(b.column("cells").to_pylist()), np.uint8).reshape(-1, WIDTH)
                was, is_ = cells.judge(own, before), cells.judge(own, now)
                yield pa.RecordBatch.from_arrays([b.column("row").filter(pa.array((was < 0) | (is_ < 0) | (was != is_)))], names=["row"])

        return approximations.mapInArrow(run, "row long")

    def change(self, rows: DataFrame, before: np.ndarray | None) -> list:
        """What a round changes in the counts and sums of each cluster, as ``sums`` has it."""
        now = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, n = {}, 0
            for b in batches:
                q = matrix(b)
                n += len(q)
                to = assign(q, now)[0]
                was = None if before is None else assign(q, before)[0]
                moved = np.ones(len(q), bool) if was is None else was != to
                add(parts, q[moved], to[moved], 1)
                if was is not None:
                    add(parts, q[moved], was[moved], -1)
            yield sums(parts, n)

        return rows.select("q").mapInArrow(run, "cluster int, s array<long>").groupBy("cluster").applyInPandas(total, "cluster int, s array<long>").collect()

    def assigned(self) -> DataFrame:
        """(vec_id, cluster, distance) of every vector, written; the table of vectors is dropped."""
        now, kind = self.centroids, self.rows.schema["vec_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                to, far = assign(matrix(b), now)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(to), pa.array(far)], names=["vec_id", "cluster", "distance"])

        try:
            return cut(self.rows.select("vec_id", "q").mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "assigned")
        finally:
            self.drop()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, bits: int = 8, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with 64 finite components.

    The centroids start as the ``k`` vectors with the smallest hashes of ``seed`` and id (of equal ids: the smaller
    vector); with fewer vectors there are fewer. Null vectors and those of another length or with a null or non-finite
    component have no row; a null id counts as an empty one and is carried; repeated rows count each; equal centroids
    leave the later ones empty, as ties do; an empty table gives none; further columns are ignored. Components beyond
    131,072 raise an error. ``bits`` (1 to 8) trades the cells' size for vectors fetched; the
    cells' bounds are quantiles of at most ``sample`` = 4,096 vectors, those with the smallest hashes, with the true ends
    of all; neither ever changes a result.
    """
    found = Clusters(vectors, k, rounds, bits, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not found.n:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = found.assigned()
    by = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each cluster
    facts = [(i, by.get(i, 0), sum(by.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # ``k`` rows
