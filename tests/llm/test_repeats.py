"""Repeated strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from varcohort.llm import repeats


def brute(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_cover():
    assert {(a - b) % repeats.COVER for a in repeats.SAMPLE for b in repeats.SAMPLE} == set(range(repeats.COVER))


@pytest.mark.parametrize("blocks,volume,bits,hot", [(400, 50, 64, 1000), (4 << 20, 50_000, 64, 1000), (3000, 7, 8, 1000), (2000, 50_000, 64, 2)])
def test_against_all_windows(spark, small, blocks, volume, bits, hot):
    """Whatever the blocks, volumes and hot anchors, and with hashes of eight bits, of which most are chance hits."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [word(n) for n in (150, 198, 199, 200, 201, 260, 333, 700, 1500)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 900, shared[3], shared[3], word(500)]
    for s in shared:
        for _ in range(3):
            texts.append(word(rng.randint(0, 300)) + s + word(rng.randint(0, 300)))
            cut = rng.randint(0, max(0, len(s) - 220))
            texts.append(word(rng.randint(0, 90)) + s[cut : cut + rng.randint(190, 260)] + word(rng.randint(0, 90)))
    texts += [texts[-1]] * 4 + [word(100) + shared[-1] + word(50) + shared[-1]]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(df, block_bytes=blocks, bucket_bytes=blocks, volume=volume, hash_bits=bits, hot=hot).collect()}
    want = brute([(t or "").encode() for t in texts])
    assert len(got) == len(texts)
    bad = [(i, got[i if i else None], want[i]) for i in range(len(texts)) if got[i if i else None] != want[i]]
    assert not bad, bad[:3]


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_and_binary_bytes(spark):
    """A very long text that repeats itself, and texts of zero bytes."""
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    texts = [part + "|" + part[1000:90_000], part[50_000:50_400], "\0" * 150, "\0" * 199 + "a", "a" + "\0" * 199 + "b", "\0" * 199 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(df).collect()}
    want = brute([t.encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_the_table_is_dropped(spark):
    before = {t.name for t in spark.catalog.listTables()}
    repeats.remove_repeats(spark.createDataFrame([(1, "x" * 300)], "doc_id long, text string")).count()
    assert {t.name for t in spark.catalog.listTables()} == before
