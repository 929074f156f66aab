"""Operator 9: SimHash near-duplicates with pivot distance tables.

Each text gets a 64-bit fingerprint. Equal fingerprints are merged first, so a group of copies, however
large, is one row from there on. Two fingerprints at most ``bits`` bits apart agree on one of ``bits + 1``
blocks of bits (on three of six, where there are very many fingerprints), which brings candidates together.
Inside such a bucket every fingerprint has its row of a pivot table, the Hamming distances to many reference
fingerprints; a pair whose largest coordinate difference is above ``bits`` is discarded, by the triangle
inequality, and the survivors are verified. A bucket above ``GROUP`` rows is dealt out as pairs of sub-blocks.
Only links that join two parts leave a task, and connected components follow by large-star and small-star
rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

GROUP = 2048
#: Above so many fingerprints, buckets agree on three of six blocks of bits.
MANY = 1 << 23
PIVOTS = 24


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, unsigned: bits set in over half of its word shingles' hashes."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    ends, joined = np.cumsum([len(p) + 1 for p in parts]), b" ".join(parts)
    starts = [0, *ends[: len(parts) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=len(starts))
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a bounded block of bits at a time
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and whatever else is there) with fp, the fingerprint as a signed long, for their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in b["text"]], dtype=np.uint64)
            yield b.drop(columns="text").assign(fp=fps.view(np.int64))

    rows = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "text")
    return rows.mapInPandas(run, f"{kinds}, fp long")


def block_masks(bits: int, many: bool) -> list[int]:
    """Masks of which two words at most ``bits`` bits apart agree on at least one."""
    n, take = (bits + 3, 3) if many else (bits + 1, 1)
    edges = np.linspace(0, 64, n + 1).round().astype(int)
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, take)]


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot, a row a pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots]).astype(np.int8)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked positions the smallest label of their part, in place."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def links_of(group: np.ndarray, fps: np.ndarray, pivots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within ``bits`` inside each group; ``group`` is in runs. At most a link a row."""
    label, n = np.arange(len(fps)), len(fps)
    table = pivot_table(fps, pivots)
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    last = ends[np.searchsorted(ends, np.arange(n))]
    alive = np.arange(n)
    for shift in range(1, n):
        alive = alive[alive + shift <= last[alive]]
        if not len(alive):
            break
        a = alive[label[alive] != label[alive + shift]]
        for row in table:
            if not len(a):
                break
            a = a[np.abs(row[a] - row[a + shift]) <= bits]
        a = a[np.bitwise_count(fps[a] ^ fps[a + shift]) <= bits]
        merge(label, a, a + shift)
    joined = np.flatnonzero(label != np.arange(n))
    return fps[joined], fps[label[joined]]


def links(distinct: DataFrame, bits: int = 3, seed: int = 7, total: int | None = None) -> DataFrame:
    """(a, b): links of different fingerprints whose components are those of all pairs within ``bits``."""
    many = (distinct.count() if total is None else total) > MANY
    masks = block_masks(bits, many)
    pivots = np.random.default_rng(seed).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
    signed = lambda x: F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(m)) for m in masks])).alias("k", "key"))
    sizes = keyed.groupBy("k", "key").count().where("count > 1")
    parts = F.ceil(F.col("count") / F.lit(GROUP)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    sided = keyed.join(sizes, ["k", "key"]).select("k", "key", "fp", parts.alias("parts"))
    dealt = sided.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("fp", F.xxhash64("k", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(bucket: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            a, b = links_of(bucket, fp.view(np.uint64), pivots, bits)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            held_b = np.concatenate([held_b, batch["bucket"].to_numpy()])
            held_f = np.concatenate([held_f, batch["fp"].to_numpy()])
            full = np.searchsorted(held_b, held_b[-1]) if len(held_b) else 0  # the last bucket may go on
            if full:
                yield found(held_b[:full], held_f[:full])
                held_b, held_f = held_b[full:], held_f[full:]
        if len(held_b):
            yield found(held_b, held_f)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by large-star and small-star rounds.

    Rounds go on until nothing changes; their number grows as the logarithm of the longest path.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")

    def star(rows: DataFrame) -> DataFrame:
        """Each node's neighbours, linked to the smallest of it and them."""
        least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        return rows.join(least, "u")

    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = star(down).select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        edges = cut(small, "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    A null text is empty; texts without words have fingerprint zero and link like any other. A null doc_id
    keeps its row and never names a component unless all of its component's ids are null. Repeated rows give
    repeated results. An empty table gives none. Further columns are ignored.
    """
    fps = cut(fingerprints(docs.select("doc_id", "text"), words, seed), "fingerprints")
    named = cut(component_of(fps, bits), "components")
    joined = join_hot(fps, named.select("fp", "component_id"), "fp", named.select("fp", "n"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def placed(fps: DataFrame, least: Column, bits: int) -> DataFrame:
    """(fp, n, least, root) of every distinct fingerprint of ``fps``: its number of rows, the smallest ``least`` of them, and its group's root."""
    distinct = cut(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(least).alias("least")), "distinct")
    roots = components(links(distinct, bits))
    return cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "placed")


def component_of(fps: DataFrame, bits: int) -> DataFrame:
    """(fp, n, component_id) of every distinct fingerprint of (doc_id, fp); groups of very many fingerprints meet their id in parts."""
    rows = placed(fps, F.col("doc_id"), bits)
    groups = rows.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return join_hot(rows, groups.select("root", "component_id"), "root", groups.select("root", "n")).select("fp", "n", "component_id")


def deduplicate(docs: DataFrame, bits: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component of near-duplicates: the one with the smallest doc_id (null last), then text hash.

    Rows decide, not ids: two texts under one id that are not alike both stay, and null ids are no exception. Of rows
    with one id and one text the smallest, by all columns, stays. A text that is null is empty.
    """
    columns, key = docs.columns, ["doc_id", "__sha"]
    keyed = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    fps = cut(fingerprints(keyed.select("doc_id", "__sha", "text"), words, seed), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__sha")
    firsts = placed(fps, place, bits).groupBy("root").agg(F.min("least").alias("first")).select("first.doc_id", "first.__sha")  # sums only: no row meets its group
    rows = fps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    here = rows["doc_id"].eqNullSafe(firsts["doc_id"]) & (rows["__sha"] == firsts["__sha"])
    judged = cut(rows.join(firsts, here, "left").select(rows["doc_id"], rows["__sha"], "n", firsts["__sha"].isNotNull().alias("stays")), "judged")
    losers, again = judged.where("NOT stays").select(*key), judged.where("stays AND n > 1").select(*key)
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed["__sha"] == other["__sha"])
    kept = keyed.join(losers, same(losers), "left_anti")
    once = kept.join(again, same(again), "left_semi").groupBy(*key).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return kept.join(again, same(again), "left_anti").select(*columns).union(once.select(*columns))
