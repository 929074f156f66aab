"""The packing query against the tokenizer's own ids, and its plan against the histogram."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from varcohort.llm import packing, queries, tokens


def check(texts, pieces, window=4096):
    """Every id of every text in one piece, offsets without gaps."""
    tokenizer = Tokenizer.from_file(tokens.default_path())
    want = Counter()
    for doc, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
        own = pieces[pieces.doc_id == doc].sort_values("start")
        if want[doc, len(ids), zlib.crc32(ids.tobytes())] == 1 and len({d for d, _ in texts}) == len(texts):
            at = 0
            for r in own.itertuples():
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    assert pieces.length.sum() == sum(n * k for (_, n, _), k in want.items())
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= window
    assert pieces.sequence_id.nunique() == -(-pieces.length.sum() // window)


def test_the_query_against_the_tokenizer(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], queries.op6_packing(spark, small).toPandas())


def test_most_rests_are_packed_whole(spark):
    d = "/root/testdata/sf0.01"
    pieces = queries.op6_packing(spark, d).toPandas()
    cut = pieces.groupby("doc_id").agg(n=("length", "size"), tokens=("doc_tokens", "first"))
    rests = (cut.n > -(-cut.tokens // 4096)).mean()
    assert rests < 0.05, rests


def test_a_hot_length(spark):
    """All rows of one text: ranks come from the tasks' counts, no key holds them all."""
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', 700) as text").repartition(16)
    got = packing.pack(docs).toPandas()
    assert got.sequence_id.nunique() == -(-3000 * 701 // 4096) and got.length.sum() == 3000 * 701
    assert got.groupby("doc_id").length.sum().eq(701).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.integers(0, 5))
def test_plan_places_every_rank_once(lengths, whole):
    window = 64
    histogram = np.bincount(lengths, minlength=window + 1)
    histogram[window] += whole
    p = packing.plan(histogram, window, third=4)
    assert (p["used"] <= histogram).all()
    filled = Counter()
    key, used = p["key"][:-1].tolist(), p["used"]
    for i, k in enumerate(key):
        length, first = k >> 40, k & ((1 << 40) - 1)
        last = key[i + 1] & ((1 << 40) - 1) if i + 1 < len(key) and key[i + 1] >> 40 == length else int(used[length])
        for rank in range(first, last):
            filled[int(p["sequence"][i]) + rank - first] += length
    assert set(filled.values()) <= {window} and set(filled) == set(range(int(histogram[window]), int(p["start"][0])))
