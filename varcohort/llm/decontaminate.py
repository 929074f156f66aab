"""Operator 1: benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark items are cut into overlapping segments. A segment of m characters within k edits of a stretch of text
shares at least m + 1 - q - k q of its q-grams with it, on diagonals (text position less segment position) that
lie within k of each other. Shared q-grams are counted in diagonal bands that overlap by half, bands that reach
the bound are kept, and a banded alignment verifies each of them. Documents are read where they lie, once: nothing is
shuffled, and the benchmark is sent in blocks of bounded size. Where it has several, one pass with a bitmap of all their
q-grams writes down the few documents that can share a passage, and the blocks run over these only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

GAPS = re.compile(r"[\W_]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Slots of a bitmap for each q-gram, as a power of two, and the most slots that are sent.
SPARSE, MOST_BITS = 5, 27


def fold(text: str) -> str:
    """Lower case, with each run of characters other than letters and digits as one space."""
    return GAPS.sub(" ", text.lower()).strip()


def symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = code.astype(np.uint64)
    out = wide[:n].copy()
    for j in range(1, q):
        out *= FACTOR
        out += wide[j : j + n]
    out ^= out >> np.uint64(29)
    out *= FACTOR
    return out


def distance(pattern: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int]:
    """Fewest edits of ``pattern`` against a stretch of ``text``, by an alignment on diagonals low .. low + width - 1.

    Returns (edits, start, end); edits is budget + 1 when there is no such stretch. Row i of the band holds text
    ends j = i + low + 0 .. width - 1.
    """
    far = budget + 1
    shift = np.arange(width)
    ends = low + shift
    cost = np.where((ends >= 0) & (ends <= len(text)), 0, far).astype(np.int64)
    start = ends.copy()
    for i in range(1, len(pattern) + 1):
        ends = i + low + shift
        inside = (ends >= 1) & (ends <= len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[ends[inside] - 1] == pattern[i - 1]
        diag = np.where(inside, cost + ~same, far)
        up, up_start = np.append(cost[1:], far) + 1, np.append(start[1:], 0)
        new = np.where(up < diag, up, diag)
        begun = np.where(up < diag, up_start, start)
        new[(ends < 0) | (ends > len(text))] = far
        # gaps in the pattern: new[t] may be new[s] + (t - s), s < t
        base = new - shift
        least = np.minimum.accumulate(base)
        source = np.maximum.accumulate(np.where(base == least, shift, 0))
        cost = np.minimum(least + shift, far)
        start = begun[source]
        cost[(ends < 0) | (ends > len(text))] = far
        if cost.min() > budget:
            return far, 0, 0
    best = int(cost.argmin())
    return int(cost[best]), int(start[best]), int(len(pattern) + low + best)


def slots(n: int) -> int:
    """Bits of a slot's number, for n q-grams."""
    return min(max(16, n.bit_length() + SPARSE), MOST_BITS)


def dense(hit: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Starts of the windows of ``reach`` positions with at least ``least`` hits."""
    if int(hit.sum()) < least:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(hit)])
    ends = np.minimum(np.arange(reach, len(hit) + reach), len(hit))
    return np.flatnonzero(total[ends] - total[:-1] >= least)


class Index:
    """Q-grams of a block of benchmark segments."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, segment: int, stride: int, least: int):
        self.q, self.segments, self.texts, self.owner, self.budget, self.need = q, [], [], [], [], []
        hashes, seg, off = [], [], []
        for item, text in items:
            folded = fold(text or "")
            starts = range(0, len(folded) - segment + stride, stride) if len(folded) > segment else (0,)
            for s in starts:
                own = folded[s : s + segment] if s + segment <= len(folded) else folded[-segment:]
                part = symbols(own)
                count = len(part) - q + 1
                if count < 1:
                    continue
                k = max(0, min(int(rate * len(part)), (count - least) // q))
                h = grams(part, q)
                hashes.append(h)
                seg.append(np.full(count, len(self.segments)))
                off.append(np.arange(count))
                self.segments.append(part)
                self.texts.append(own)
                self.owner.append(item)
                self.budget.append(k)
                self.need.append(count - k * q)
        self.some = bool(hashes)
        if not self.some:
            return
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.seg, self.off = np.concatenate(seg)[order], np.concatenate(off)[order]
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - slots(len(self.hash)))
        self.bitmap = np.zeros(1 << slots(len(self.hash)), dtype=bool)
        self.bitmap[self.hash >> self.shift] = True
        self.need, self.budget = np.array(self.need), np.array(self.budget)
        self.band = int(max(1, self.budget.max()))
        self.reach = max(len(s) for s in self.segments) + self.band
        self.least = int(self.need.min())

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(segment, start, end, edits) of every verified region; positions in the folded text."""
        code = symbols(text)
        h = grams(code, self.q)
        if len(h) < self.least:
            return []
        hit = self.bitmap[h >> self.shift]
        # the q-grams of a region lie in one window of ``reach``: only windows with enough of them are looked at
        starts = dense(hit, self.reach, self.least)
        if not len(starts):
            return []
        ends = np.minimum(starts + self.reach, len(h))
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        cover[starts] += 1
        cover += -np.bincount(ends, minlength=len(h) + 1)
        at = np.flatnonzero(hit & (np.cumsum(cover)[:-1] > 0))
        if not len(at):
            return []
        place = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        real = self.hash[place] == h[at]
        at, place = at[real], place[real]
        count = self.count[place]
        if not len(at):
            return []
        row = np.repeat(self.first[place] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        seg, diag = self.seg[row], np.repeat(at, count) - self.off[row] + (1 << 20)
        width = self.band
        key = np.concatenate([(seg << 40) + diag // width, (seg << 40) + diag // width - 1])  # a band spans two widths
        # a q-gram that occurs twice in a segment may meet one text position twice: count text positions
        pos = np.concatenate([np.repeat(at, count)] * 2)
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])])
        keys, n = np.unique(key[new], return_counts=True)
        keys = keys[n >= self.need[keys >> 40]]
        found: set[tuple[int, int, int, int]] = set()
        for band in keys.tolist():
            s, low = band >> 40, (band & ((1 << 40) - 1)) * width - (1 << 20)
            pattern, k = self.segments[s], int(self.budget[s])
            a = max(0, low - k)
            same = text.find(self.texts[s], a, low + 2 * width + len(pattern) + k)
            if same >= 0:  # an alignment without edits
                found.add((s, same, same + len(pattern), 0))
                continue
            edits, start, end = distance(pattern, code[a : low + 2 * width + len(pattern) + k], low - a - k, 2 * width + 2 * k, k)
            if edits <= k:
                found.add((s, a + start, a + end, edits))
        return sorted(found)


def contamination(
    docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.067, segment: int = 80, stride: int = 20, least: int = 25, block_chars: int = 4_000_000
) -> DataFrame:
    """(doc_id, item_id, n_segments, n_edits, start, end) of every document and benchmark item that share a passage.

    ``n_segments`` counts the item's segments found, ``n_edits`` their fewest edits; start and end are the outermost
    positions of any region in the folded text. Segments of ``segment`` characters start every ``stride``, and the last
    one at the item's end, so a verbatim quote of ``segment`` + ``stride`` - 1 folded characters is always found. An
    item no longer than a segment is one segment. ``rate`` is the edit budget as a share of a segment's characters,
    less where fewer than ``least`` shared q-grams would be asked for.
    Null or empty texts share nothing, neither do items shorter than ``q`` folded characters; a null doc_id or item_id
    is carried; repeated rows give repeated results; an empty table on either side gives none; further columns are
    ignored. One benchmark item must fit a block of ``block_chars`` characters.
    """
    spark = docs.sparkSession
    ids = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // block_chars)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, n_segments int, n_edits int, start int, end int"
    if not blocks:
        return spark.createDataFrame([], schema)

    def block(i: int) -> Index:
        """About ``block_chars`` characters of the benchmark."""
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        return Index([(r["item_id"], r["text"]) for r in own.collect()], q, rate, segment, stride, least)

    def search(texts: DataFrame, index: Index) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = sent.value
            for b in batches:
                rows = []
                for doc, text in zip(b["doc_id"].array, b["text"], strict=True):
                    by: dict = {}
                    for s, start, end, edits in index.find(fold(text)) if index.some else ():
                        own, lo, hi = by.get(index.owner[s], ({}, start, end))
                        own[s] = min(edits, own.get(s, edits))
                        by[index.owner[s]] = (own, min(lo, start), max(hi, end))
                    rows += [(doc, item, len(own), sum(own.values()), lo, hi) for item, (own, lo, hi) in by.items()]
                if not rows:
                    continue
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "n_segments", "n_edits", "start", "end"])
                yield out.astype({c: "Int64" for c, t in zip(("doc_id", "item_id"), ids, strict=True) if t != "string"})

        return texts.mapInPandas(run, schema), sent

    if blocks == 1:
        return search(texts, block(0))[0]

    bits, found = slots(total), []
    bitmap, reach, fewest = np.zeros(1 << bits, dtype=bool), 1, 1 << 30
    for i in range(blocks):
        index = block(i)
        if index.some:
            bitmap[index.hash >> np.uint64(64 - bits)] = True
            reach, fewest = max(reach, index.reach), min(fewest, index.least)
    sieve = spark.sparkContext.broadcast(np.packbits(bitmap))  # at most 2 ** MOST_BITS bits

    @F.pandas_udf("boolean")
    def may_share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bitmap = np.unpackbits(sieve.value).view(bool)
        for texts in batches:
            hits = (bitmap[grams(symbols(fold(t)), q) >> np.uint64(64 - bits)] for t in texts)
            yield pd.Series([len(dense(h, reach, fewest)) > 0 for h in hits], dtype=bool)

    few = cut(texts.where(may_share("text")), "may-share")
    for i in range(blocks):  # one block at a time is held and sent
        out, sent = search(few, block(i))
        found.append(cut(out, "shared"))
        sent.destroy()
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """``docs`` without those that share a passage with the benchmark. Texts decide, whatever their ids, null ones too."""
    keyed = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    bad = cut(contamination(keyed.select(F.col("__sha").alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias("__sha")).distinct(), "leaks")
    return keyed.join(bad, "__sha", "left_anti").select(*docs.columns)
