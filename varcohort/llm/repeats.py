"""Operator 2: removal of long repeated strings by blockwise sorting over a difference-cover sample.

Any two positions of texts have an offset below ``COVER`` at which both lie in the sample of positions whose
remainder is in ``SAMPLE`` (a difference cover). So a repeated string of ``length`` bytes begins, at one such
offset, the same shorter anchor at two sampled positions. Rounds follow, each of which sorts one bucket of suffixes
at a time, whatever its texts:

1. sieve: sampled suffixes whose anchors' hashes occur once are dropped, nine of ten in prose;
2. order: the rest are sorted by their bytes. Long ties, suffixes equal in the whole anchor, are resolved by the ranks
   of the sample, precomputed where the texts lie: a rank is the digest of all that windows over the anchor can
   hold. Equal ranks settle every window over the anchor at once. Others go on, with one holder of each settled rank;
3. windows: of what is left open, window hashes that occur once are dropped;
4. proof: the remaining windows are sorted by the digests of their bytes, and those that no other equals are taken out.

A hash only ever sends something on to the next round: nothing is removed but by equal digests (BLAKE2b, 128 bits) of
the bytes themselves. Texts lie in one bucketed table of blocks, written once, and each round reads them where they
are; only keys, anchors and digests travel. Exact copies are found beforehand, by SHA-256, and one of each group takes
part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_path, shared_dir

#: A perfect difference set, whose differences are each remainder but 0 once.
COVER, SAMPLE = 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
LENGTH = 200
KEY_BYTES = 6
DIGEST = 16
#: Anchors that so many blocks share are dealt out by rank in round 2, over so many parts.
HOT, PARTS = 1000, 251
#: Blocks in one partition of the bucketed table, whose buckets Spark bounds.
VOLUME = 50_000
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: What a block is told: rows that are copies, repeated anchors, hot ones, settled ranks and open ones (by the block's own
#: numbers), repeated window hashes, windows that share a hash with others but no bytes, anchor positions.
COPY, ANCHOR, HOT_ANCHOR, SETTLED, OPEN, WINDOW, APART, PLACES = range(8)


class Hashes:
    """Hashes of substrings of one text after another, from prefix sums of byte values times powers, modulo 2**64."""

    def __init__(self, bits: int = 64):
        self.bits = bits  # fewer make more chance hits, and more work, but no other result
        self.values = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, text: bytes) -> Hashes:
        n = len(text)
        if n > len(self.up):
            size = max(2 * len(self.up), n)
            self.up, self.down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[np.frombuffer(text, np.uint8)] * self.up[:n], out=self.sums[1:])
        return self

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mixed((self.sums[end] - self.sums[start]) * self.down[start])
        return h if self.bits == 64 else mixed(h >> np.uint64(64 - self.bits))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


class Shape:
    """Which lengths follow from the repeat's length."""

    def __init__(self, length: int = LENGTH, hash_bits: int = 64, hot: int = HOT):
        self.hash_bits, self.hot = hash_bits, hot
        if length < COVER:
            raise ValueError(f"repeats must have {COVER} bytes at least")
        self.length, self.anchor = length, length - COVER + 1
        wanted = np.zeros(COVER, bool)
        wanted[list(SAMPLE)] = True
        self.wanted = wanted

    def sampled(self, n: int) -> np.ndarray:
        """Sampled positions of a text of n bytes that begin an anchor."""
        last = n - self.anchor + 1
        return np.flatnonzero(np.resize(self.wanted, last)) if last > 0 else np.zeros(0, np.int64)

    def keys(self, h: Hashes, n: int) -> np.ndarray:
        at = self.sampled(n)
        return h.of(at, at + self.anchor)

    def suffixes(self, text: bytes, at: np.ndarray) -> np.ndarray:
        """The anchors' bytes, a row each."""
        return np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), self.anchor)[at]

    def ranks(self, text: bytes, at: np.ndarray) -> bytes:
        """Digests of all that windows over the anchors can hold, with where the text's ends cut it, joined."""
        n, back, ahead = len(text), COVER - 1, self.length
        inner, whole = b"%d:%d:" % (back, ahead), (at >= back) & (at + ahead <= n)
        out = []
        for p, fits in zip(at.tolist(), whole.tolist(), strict=True):
            a, e = (p - back, p + ahead) if fits else (max(p - back, 0), min(p + ahead, n))
            out.append(digest((inner if fits else b"%d:%d:" % (p - a, e - p)) + text[a:e]))
        return b"".join(out)

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        """Starts of all windows over the anchors, each once."""
        low, high = np.maximum(at - COVER + 1, 0), np.minimum(at, n - self.length)
        ok = low <= high  # the text's ends may leave an anchor no window
        mark = np.bincount(low[ok], minlength=n + 2) - np.bincount(high[ok] + 1, minlength=n + 2)
        return np.flatnonzero(np.cumsum(mark)[:-1] > 0)


def packed(keys: np.ndarray) -> bytes:
    """The low KEY_BYTES bytes of each key; a bucket's number holds its high bits."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


LOW = np.uint64((1 << (8 * KEY_BYTES)) - 1)


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """What bucket and packed key keep of a key: its high ``bits`` and its low bytes."""
    high = (keys >> np.uint64(64 - bits)) << np.uint64(64 - bits) if bits else np.zeros_like(keys)
    return high | (keys & LOW)


def buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def runs(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of an array in runs."""
    if len(of):
        cuts = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            yield int(of[a]), a, b


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def doubled(keys: np.ndarray) -> np.ndarray:
    """Keys that occur twice or more, sorted, each once."""
    keys = np.sort(keys)
    return np.unique(keys[1:][keys[1:] == keys[:-1]])


NONE = np.zeros(0, np.uint64)


class Block:
    """The texts of a block that take part, and what the rounds so far have told it."""

    def __init__(self, texts: pd.DataFrame, told: pd.DataFrame, shape: Shape, bits: int):
        self.shape, self.bits, self.hashes = shape, bits, Hashes(shape.hash_bits)
        self.copy, self.places, self.told = {}, {}, {k: [] for k in range(8)}
        for kind, rid, payload in zip(told["kind"].tolist(), told["rid"].tolist(), told["payload"].tolist(), strict=True):
            if kind == COPY:
                rids = np.frombuffer(payload, "<i8").tolist()
                self.copy.update((r, r == rid) for r in rids)  # whether it takes part for all of them
            elif kind == PLACES:
                self.places = self.unpack(payload)
            else:
                self.told[kind].append(payload)
        self.rows = texts.sort_values("rid")

    @staticmethod
    def unpack(payload: bytes) -> dict[int, np.ndarray]:
        """Rows (text, position, rank number) by text."""
        table = np.frombuffer(payload, "<i8").reshape(3, -1)
        cuts = np.flatnonzero(np.diff(table[0])) + 1
        return {int(part[0, 0]): part[1:] for part in np.split(table, cuts, axis=1) if part.size}

    def numbers(self, kind: int, of: str = "<u8") -> np.ndarray:
        return np.sort(np.concatenate([np.zeros(0, of), *[np.frombuffer(d, of) for d in self.told[kind]]]))

    def texts(self) -> Iterator[tuple[int, bytes]]:
        for rid, text in zip(self.rows["rid"].tolist(), self.rows["text"].tolist(), strict=True):
            if self.copy.get(rid, True) and len(text) >= self.shape.length:
                yield rid, text

    def emit(self, stage: int) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, part of a hot bucket, payload); a negative bucket is told to the block as it is."""
        if stage == 2:
            yield from self.suffixes()
        elif stage == 4:
            yield from self.proofs()
        else:
            if stage == 1:
                found = [short(self.shape.keys(self.hashes.load(t), len(t)), self.bits) for _, t in self.texts()]
            else:
                found = [k for *_, k in self.open_windows()]
            keys, counts = np.unique(np.concatenate([NONE, *found]), return_counts=True)
            for bucket, a, b in runs(buckets(keys, self.bits)):
                yield bucket, 0, (packed(keys[a:b]) if stage == 1 else keys[a:b].tobytes()) + (counts[a:b] > 1).tobytes()

    def suffixes(self) -> Iterator[tuple[int, int, bytes]]:
        repeated, hot = self.numbers(ANCHOR), self.numbers(HOT_ANCHOR)
        rids, places, keys, suffixes, ranks = [], [], [NONE], [], []
        for rid, text in self.texts():
            key = short(self.shape.keys(self.hashes.load(text), len(text)), self.bits)
            own = member(repeated, key)
            if own.any():
                at = self.shape.sampled(len(text))[own]
                rids.append(np.full(len(at), rid))
                places.append(at)
                keys.append(key[own])
                suffixes.append(self.shape.suffixes(text, at))
                ranks.append(self.shape.ranks(text, at))
        if not rids:
            return
        key, suffix = np.concatenate(keys), np.concatenate(suffixes)
        rank = np.frombuffer(b"".join(ranks), np.uint8).reshape(-1, DIGEST)
        part = np.where(member(hot, key), 1 + rank[:, 0].astype(np.int64) % PARTS, 0)
        bucket = buckets(key, self.bits)
        words = rank.view(">u8")
        order = np.lexsort((words[:, 1], words[:, 0], key, part, bucket))
        cols = np.stack([bucket.astype(np.uint64), part.astype(np.uint64), key, words[:, 0], words[:, 1]])[:, order]
        new = np.concatenate([[True], (cols[:, 1:] != cols[:, :-1]).any(axis=0)])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        many = np.bincount(number) > 1
        yield -1, 0, np.stack([np.concatenate(rids), np.concatenate(places), number]).astype("<i8").tobytes()
        for case, a, b in runs(bucket[first] * (PARTS + 1) + part[first]):
            own = first[a:b]
            yield *divmod(case, PARTS + 1), (b - a).to_bytes(4, "little") + suffix[own].tobytes() + rank[own].tobytes() + np.arange(a, b, dtype="<i4").tobytes() + many[a:b].tobytes()

    def open_windows(self) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        """(row, text, starts, hashes) of the windows over anchors whose ranks are open."""
        wanted = self.numbers(OPEN, "<i4")
        for rid, text in self.texts() if len(wanted) else ():
            if rid in self.places:
                at, number = self.places[rid]
                own = member(wanted, number)
                start = self.shape.windows(at[own], len(text)) if own.any() else at[:0]
                if len(start):
                    yield rid, text, start, self.hashes.load(text).of(start, start + self.shape.length)

    def candidates(self) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        """(row, text, starts, hashes) of open windows whose hash is repeated."""
        again = self.numbers(WINDOW)
        for rid, text, start, key in self.open_windows() if len(again) else ():
            own = member(again, key)
            if own.any():
                yield rid, text, start[own], key[own]

    def digests(self, text: bytes, start: np.ndarray) -> bytes:
        make, length = hashlib.blake2b, self.shape.length
        return b"".join([make(text[s : s + length], digest_size=DIGEST).digest() for s in start.tolist()])

    def proofs(self) -> Iterator[tuple[int, int, bytes]]:
        """Distinct windows as (hash, digest), in order of their hashes."""
        found = [(key, self.digests(text, start)) for _, text, start, key in self.candidates()]
        if not found:
            return
        key, own = np.concatenate([k for k, _ in found]), np.frombuffer(b"".join(d for _, d in found), "<u8").reshape(-1, 2)
        order = np.lexsort((own[:, 1], own[:, 0], key))
        table = np.column_stack([key, own])[order]
        new = np.concatenate([[True], (table[1:] != table[:-1]).any(axis=1)])
        many, table = np.bincount(np.cumsum(new) - 1) > 1, table[new]
        for bucket, a, b in runs(buckets(table[:, 0], self.bits)):
            yield bucket, 0, table[a:b].tobytes() + many[a:b].tobytes()

    def finish(self) -> pd.DataFrame:
        covered: dict[int, list[np.ndarray]] = {}
        apart = np.frombuffer(b"".join(self.told[APART]), "<u8").reshape(-1, 3)
        doubtful, alone = np.unique(apart[:, 0]), {row.tobytes() for row in apart}
        for rid, text, start, key in self.candidates():
            ask = np.flatnonzero(member(doubtful, key))
            if len(ask):
                own = np.frombuffer(self.digests(text, start[ask]), "<u8").reshape(-1, 2)
                start = np.delete(start, ask[[row.tobytes() in alone for row in np.column_stack([key[ask], own])]])
            covered[rid] = [start]
        settled = self.numbers(SETTLED, "<i4")
        for rid, text in self.texts() if len(settled) else ():
            if rid in self.places:
                at, number = self.places[rid]
                own = member(settled, number)
                if own.any():
                    covered.setdefault(rid, []).append(self.shape.windows(at[own], len(text)))
        out, length = [], self.shape.length
        for doc, rid, text in zip(self.rows["doc_id"].array, self.rows["rid"].tolist(), self.rows["text"].tolist(), strict=True):
            n = len(text)
            if rid in self.copy and n >= length:
                out.append((doc, n, n, 1, hashlib.sha256(b"").hexdigest()))
                continue
            if not sum(map(len, covered.get(rid, ()))):
                out.append((doc, n, 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            mark = np.zeros(n + 1, np.int64)
            for start in covered[rid]:
                mark += np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
            gone = np.cumsum(mark)[:-1] > 0
            spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
            out.append((doc, n, int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def decide(stage: int, bits: int, shape: Shape, bucket: int, part: int, rows: pd.DataFrame) -> Iterator[tuple[int, int, bytes]]:
    """(block, kind, keys) that a bucket, sorted, tells its blocks."""
    blocks, high = rows["block"].to_numpy(), np.uint64((bucket << (64 - bits)) if bits else 0)
    if stage == 2:
        yield from order(shape.anchor, part > 0, blocks, rows["payload"].tolist())
        return
    size = {1: KEY_BYTES, 3: 8, 4: 8 + DIGEST}[stage]
    keys, many, owner = [], [], []
    for block, data in zip(blocks, rows["payload"], strict=True):
        n = len(data) // (size + 1)
        keys.append(data[: n * size])
        many.append(np.frombuffer(data[n * size :], bool))
        owner.append(np.full(n, block))
    many, owner = np.concatenate(many), np.concatenate(owner)
    if stage == 4:
        own = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 3)
        at = np.lexsort(own.T[::-1])
        new = np.concatenate([[True], (own[at[1:]] != own[at[:-1]]).any(axis=1)])
        group = np.empty(len(at), np.int64)
        group[at] = np.cumsum(new) - 1
    else:
        own = np.concatenate([unpacked(d) | high if stage == 1 else np.frombuffer(d, "<u8") for d in keys])
        _, group = np.unique(own, return_inverse=True)
    held = np.bincount(group)
    twice = ((held > 1) | (np.bincount(group, weights=many) > 0))[group]
    if stage == 4:
        yield from told(owner[~twice], own[~twice], APART)
        return
    yield from told(owner[twice], own[twice], ANCHOR if stage == 1 else WINDOW)
    if stage == 1:
        hot = held[group] >= shape.hot
        yield from told(owner[hot], own[hot], HOT_ANCHOR)


def order(anchor: int, hot: bool, blocks: np.ndarray, payloads: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Suffixes of a bucket sorted by their bytes, ties by rank: settled ranks, and those that stay open."""
    suffix, rank, number, many, owner = [], [], [], [], []
    wide = -(-anchor // 8) * 8
    for block, data in zip(blocks, payloads, strict=True):
        n = int.from_bytes(data[:4], "little")
        a = 4 + n * anchor
        b, c = a + n * DIGEST, a + n * (DIGEST + 4)
        row = np.zeros((n, wide), np.uint8)
        row[:, :anchor] = np.frombuffer(data[4:a], np.uint8).reshape(n, anchor)
        suffix.append(row)
        rank.append(np.frombuffer(data[a:b], np.uint8).reshape(n, DIGEST))
        number.append(np.frombuffer(data[b:c], "<i4"))
        many.append(np.frombuffer(data[c:], bool))
        owner.append(np.full(n, block))
    suffix, rank = np.concatenate(suffix).view(">u8"), np.concatenate(rank).view(">u8")
    number, many, owner = np.concatenate(number), np.concatenate(many), np.concatenate(owner)
    at = np.lexsort((owner, *rank.T[::-1], *suffix.T[::-1]))
    suffix, rank, number, many, owner = suffix[at], rank[at], number[at], many[at], owner[at]
    new = np.concatenate([[True], (suffix[1:] != suffix[:-1]).any(axis=1)])
    new_rank = new | np.concatenate([[True], (rank[1:] != rank[:-1]).any(axis=1)])
    group = np.cumsum(new_rank) - 1
    settled = ((np.bincount(group) > 1) | (np.bincount(group, weights=many) > 0))[group]
    yield from told(owner[settled], number[settled], SETTLED)
    of = np.cumsum(new) - 1
    on = new_rank & ((np.bincount(of, weights=new_rank)[of] > 1) | hot)  # one holder; a hot anchor's other ranks may be in other parts
    yield from told(owner[on], number[on], OPEN)


def told(owner: np.ndarray, keys: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    at = np.argsort(owner, kind="stable")
    owner, keys = owner[at], keys[at]
    for block, a, b in runs(owner):
        yield block, kind, np.ascontiguousarray(keys[a:b]).tobytes()


TOLD = "block long, kind int, rid long, payload binary"


def copies(table: DataFrame, salts: int = 16) -> DataFrame:
    """Rows that have exact copies, as told to their blocks: each block's rows of a group, and the row that stands for all.

    A block's rows of one group are one row from the start, and the groups' answers are dealt over ``salts``, so that
    the commonest text costs a task no more than one row for every ``salts`` blocks.
    """
    own = table.groupBy("volume", "block", "sha").agg(F.collect_list("rid").alias("rids"), F.min("rid").alias("least"), F.count(F.lit(1)).alias("n"))
    own = cut(own, "hashes")
    part = own.groupBy("sha", F.pmod("block", F.lit(salts)).alias("salt")).agg(F.sum("n").alias("n"), F.min("least").alias("first"))
    groups = part.groupBy("sha").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    groups = groups.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = own.withColumn("salt", F.pmod("block", F.lit(salts)).cast("int")).join(groups, ["sha", "salt"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"block": b["block"], "kind": COPY, "rid": b["first"], "payload": [np.asarray(r, "<i8").tobytes() for r in b["rids"]]})

    return joined.select("block", "first", "rids").mapInPandas(pack, TOLD)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None, bucket_bytes: int = 4 << 20, volume: int = VOLUME, hash_bits: int = 64, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    A byte goes if a string of ``length`` bytes over it also begins anywhere else. A null text is empty; texts
    under ``length`` bytes keep everything; a null doc_id is carried; repeated rows are copies of each other and
    lose everything, if long enough; an empty table gives none; further columns are ignored.

    Blocks have 4 MB of text, up to 64 MB where there are very many (or ``block_bytes``); a task holds one block or one
    bucket of about ``bucket_bytes`` of keys. A single text must fit a task, at about 32 bytes of memory a byte.
    """
    spark, shape = docs.sparkSession, Shape(length, hash_bits, hot)
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_bytes = block_bytes or min(max(4 << 20, total // 20_000), 64 << 20)
    blocks = max(shuffles, -(-total // block_bytes))
    volumes = -(-blocks // volume)
    bits = (total * len(SAMPLE) // COVER * 8 // bucket_bytes).bit_length()
    name, at = f"varcohort_blocks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", text.cast("binary").alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks))).withColumn("volume", F.floor(F.col("block") / F.lit(volume)).cast("int"))
    files = min(blocks, 100 * shuffles, 100_000) if volumes > 1 else blocks
    rows.repartition(files, "block").write.format("parquet").partitionBy("volume").option("compression", "zstd").option("path", at).bucketBy(min(blocks, volume), "block").saveAsTable(name)
    table = spark.table(name)

    def beside(known: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over each block's texts and what it was told, where the texts lie: a bucketed read of each volume."""
        known = known.withColumn("volume", F.floor(F.col("block") / F.lit(volume)).cast("int"))
        one = lambda df, v: df.where(F.col("volume") == v).drop("volume").groupBy("block")
        return reduce(DataFrame.union, [one(table.select("volume", "block", "doc_id", "rid", "text"), v).cogroup(one(known, v)).applyInPandas(run, schema) for v in range(volumes)])

    def answers(stage: int, known: DataFrame) -> DataFrame:
        def emit(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            if texts.empty:
                return pd.DataFrame({c: [] for c in ("bucket", "part", "block", "payload")})
            block = int(texts["block"].iloc[0])
            out = [(-1 - block if b < 0 else b, p, block, d) for b, p, d in Block(texts, told, shape, bits).emit(stage)]
            return pd.DataFrame(out, columns=["bucket", "part", "block", "payload"])

        def sort(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            if key[0] < 0:  # anchor positions, for the block itself
                return pd.DataFrame({"block": rows["block"], "kind": PLACES, "rid": None, "payload": rows["payload"]}).astype({"rid": "Int64"})
            out = list(decide(stage, bits, shape, int(key[0]), int(key[1]), rows))
            return pd.DataFrame({"block": [o[0] for o in out], "kind": [o[1] for o in out], "rid": None, "payload": [o[2] for o in out]}).astype({"rid": "Int64"})

        sent = beside(known, emit, "bucket long, part int, block long, payload binary")
        return cut(sent.groupBy("bucket", "part").applyInPandas(sort, TOLD), f"round{stage}")

    known = cut(copies(table), "copies")
    for stage in (1, 2, 3, 4):
        known = known.unionByName(answers(stage, known))
        if stage == 2:  # the sieve's keys have done their work
            known = known.where(~F.col("kind").isin(ANCHOR, HOT_ANCHOR))
    kind = dict(docs.dtypes)["doc_id"]

    def finish(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if texts.empty:
            return pd.DataFrame({c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")})
        out = Block(texts, told, shape, bits).finish()
        return out if kind == "string" else out.astype({"doc_id": "Int64"})

    out = cut(beside(known, finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "kept")
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, at)
    return out
