"""Operator 6: packing token sequences into windows by non-negative least squares.

Every document gives whole windows and at most one shorter rest. The histogram of the rests' lengths (at
most ``window`` numbers) goes to the driver, which enumerates shallow combinations of lengths that fill a
window exactly, solves for repeat counts by non-negative least squares against the histogram, rounds them
and takes what the histogram allows. What is left is packed greedily: longest rests first, whole, into combinations
of any depth that fill a window exactly; only what fits none of these is laid end to end and cut where a window ends.
Which rests take which place follows from each rest's rank among those of its length: its rank in its task, which is
written down with it, and the tasks' running counts. So no length, however common, is one task's work.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import Text, byte_symbols, default_path

MEMO = 800_000


class Encoder:
    """Ids of whole texts as little-endian bytes; the tokenizer's model gives the ids of each new pretoken."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        with open(path, encoding="utf-8") as f:
            self.text = Text(json.load(f))
        self.names = {b: ord(name) for b, name in enumerate(byte_symbols())}
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            name = piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1").translate(self.names)
            ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(name)]).tobytes()
        return ids

    def part(self, text: str) -> bytes:
        """The ids of normalised text without special strings, four bytes each."""
        memo, chunks = self.memo, self.text.chunks(text)
        try:
            return b"".join([memo[w] for w in chunks])
        except KeyError:
            pass
        for w in chunks:
            if w not in memo:
                memo[w] = self.piece(w) if w.isalpha() else b"".join(map(self.piece, self.text.pieces.findall(w)))
        return b"".join([memo[w] for w in chunks])

    def encode(self, text: str) -> bytes:
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.pieces.clear()
        return b"".join(array("I", [self.text.special_ids[p]]).tobytes() if special else self.part(p) for p, special in self.text.parts(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def combinations(present: np.ndarray, window: int, third: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill a window; ``third``: how many common lengths may be a third part."""
    have = set(np.flatnonzero(present).tolist()) - {0}
    found = {(a, window - a) for a in have if a <= window - a and window - a in have}
    common = [x for x in np.argsort(-present, kind="stable")[:third].tolist() if x in have]
    for c in common:
        for a in have:
            b = window - a - c
            if a <= b and b in have:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def nonnegative_least_squares(combos: list[tuple[int, ...]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings the combinations' summed parts near ``target``, by accelerated projected gradient."""
    if not combos:
        return np.zeros(0)
    rows = np.concatenate([np.array(c) for c in combos])
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    use = np.bincount(rows, minlength=len(target))
    step = 1.0 / max(1.0, 3.0 * use.max())  # the norm of A'A is at most longest column sum x largest row sum
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        residual = np.bincount(rows, weights=y[cols], minlength=len(target)) - target
        nxt = np.maximum(0.0, y - step * np.bincount(cols, weights=residual[rows], minlength=len(combos)))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def greedy(left: np.ndarray, window: int) -> Iterator[tuple[list[int], int]]:
    """(lengths, repeats) of combinations that fill a window exactly, longest length first; ``left`` is used up."""
    lengths = np.flatnonzero(left[:window])
    lengths = lengths[lengths > 0]
    for first in lengths[::-1].tolist():
        while left[first] > 0:
            parts, room, have = [first], window - first, left.copy()
            have[first] -= 1
            while room:
                if have[room] > 0:
                    nxt = room
                else:  # two that end the window, or else the longest that fits
                    a = np.flatnonzero(have[1 : room // 2 + 1]) + 1
                    b = room - a
                    a = a[(have[b] > 0) & ((a != b) | (have[a] > 1))]
                    nxt = room - int(a[0]) if len(a) else int(np.flatnonzero(have[:room])[-1]) if have[1:room].any() else 0
                if not nxt:
                    break
                parts.append(nxt)
                have[nxt] -= 1
                room -= nxt
            if room:
                break
            kinds, counts = np.unique(parts, return_counts=True)
            n = int((left[kinds] // counts).min())
            left[kinds] -= n * counts
            yield parts, n


def plan(histogram: np.ndarray, window: int, third: int = 24) -> dict[str, np.ndarray]:
    """Where each (length, rank) goes: places of the combinations, then the remainder's running offsets.

    ``key`` (length * 2**40 + first rank), ``sequence`` (of that first rank), ``offset``: sorted places.
    ``used``: ranks below it are in combinations. ``base``: offset of each length's first remaining token.
    """
    rest = histogram.copy()
    rest[0] = rest[window] = 0
    used = np.zeros_like(rest)
    combos = combinations(rest, window, third)
    repeats = nonnegative_least_squares(combos, rest.astype(float))
    places, sequence = [], int(histogram[window])

    def place(parts: list[int], n: int) -> None:
        nonlocal sequence
        offset = 0
        for length in parts:
            places.append((length * (1 << 40) + int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n

    for k in np.argsort(-repeats, kind="stable").tolist():
        parts, counts = np.unique(combos[k], return_counts=True)
        n = min(int(round(repeats[k])), int((rest[parts] // counts).min()))
        if n > 0:
            rest[parts] -= n * counts
            place(list(combos[k]), n)
    for parts, n in greedy(rest, window):
        place(parts, n)
    places.append((window * (1 << 40), 0, 0))
    places.sort()
    key, first, offset = (np.array(x, dtype=np.int64) for x in zip(*places, strict=True))
    tokens = rest * np.arange(len(rest))
    return {"key": key, "sequence": first, "offset": offset, "used": used, "base": np.cumsum(tokens) - tokens, "start": np.array([sequence])}


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = 4096, end_id: int = 2, third: int = 24) -> DataFrame:
    """Pieces of all documents, packed: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is one token (the end id). A null doc_id is carried; repeated rows are packed as often as
    they occur; an empty table gives no piece; further columns are ignored. Every id lies in exactly one piece,
    sequences are filled without gaps, and only the last one may need padding. ``third`` is how many common lengths
    may be the third part of a combination in the least squares; whatever they leave is packed all the same.
    """
    spark, path = docs.sparkSession, vocabulary or default_path()
    kind = dict(docs.dtypes)["doc_id"]

    def typed(out: pd.DataFrame) -> pd.DataFrame:
        """A null id makes pandas turn longs into doubles; not here."""
        return out if kind == "string" else out.assign(doc_id=out["doc_id"].astype("Int64"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, last = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        part, ranks = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].array, b["text"], strict=True):
                ids = enc.encode(text) + last
                total = len(ids) // 4
                for start in range(0, total, window):
                    own = ids[start * 4 : (start + window) * 4]
                    n = len(own) // 4
                    rows.append((doc, start, n, zlib.crc32(own), total, own if n < window else b"", part, int(ranks[n])))
                    ranks[n] += 1
            yield typed(pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "n"]))

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces_kind = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part int, n long"
    table = cut(rows.mapInPandas(pieces, pieces_kind), "pieces", compression="zstd")  # ranks are written with the rows: a retry changes none

    by = table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))  # a row a task and length
    counts = by.groupBy("length").agg(F.sum("count").alias("count")).toPandas()  # at most ``window`` rows, whatever the input's size
    histogram = np.zeros(window + 1, dtype=np.int64)
    histogram[counts["length"]] = counts["count"]
    todo = spark.sparkContext.broadcast(plan(histogram, window, third))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = todo.value
        for b in batches:
            length = b["length"].to_numpy(np.int64)
            rank = b["rank"].to_numpy(np.int64)
            place = np.searchsorted(p["key"], length * (1 << 40) + rank, side="right") - 1
            place = np.maximum(place, 0)
            placed = (rank < p["used"][length]) | (length == window)
            at = p["base"][length] + (rank - p["used"][length]) * length
            b["sequence_id"] = np.where(placed, p["sequence"][place] + rank - (p["key"][place] & ((1 << 40) - 1)), p["start"][0] + at // window)
            b["offset"] = np.where(placed, p["offset"][place], at % window)
            over = b["offset"].to_numpy() + length > window
            ids = b.pop("ids")
            whole = b[~over]
            if over.any():
                extra = []
                for row, own in zip(b[over].to_dict("records"), ids[over], strict=True):
                    room = int(window - row["offset"])
                    left, right = own[: room * 4], own[room * 4 :]
                    extra.append(row | {"length": room, "ids_crc32": zlib.crc32(left)})
                    extra.append(row | {"start": row["start"] + room, "length": len(right) // 4, "ids_crc32": zlib.crc32(right), "sequence_id": row["sequence_id"] + 1, "offset": 0})
                yield typed(pd.DataFrame(extra))[whole.columns].drop(columns="rank")
            yield whole.drop(columns="rank")

    ranked = table.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("n"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank").mapInPandas(
        assign, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
