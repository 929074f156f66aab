"""The lexicon, its choice among the training rows, and scores against brute force."""

import math
from collections import Counter

import pytest

from varcohort.llm import toxicity as T


def table(spark, n=160):
    common = " ".join(f"{a}{b}common" for a in "abcdefgh" for b in "aeiou")
    docs = [(i, f"{common} {'zorkle' if i % 2 and i % 8 != 1 else 'pleasant'} end") for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


def test_a_rarer_toxic_entry_outlives_many_common_ones(spark):
    docs, labels = table(spark)
    lexicon = T.train(docs, labels).lexicon
    assert len(lexicon) == 1 and "zorkle".startswith(next(iter(lexicon)).strip())


def test_counts_handed_on_in_parts_are_the_same(spark, monkeypatch):
    docs, labels = table(spark)
    whole = T.train(docs, labels)
    monkeypatch.setattr(T, "PART", 3)
    again = T.train(docs, labels)
    assert again.lexicon == whole.lexicon and again.exceptions == whole.exceptions


def test_held_out_labels_change_nothing(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    held = T.in_fold(labels["doc_id"])
    other = labels.where(held).withColumn("toxic", 1 - labels["toxic"]).unionByName(labels.where(~held))
    a, b = T.train(docs, labels), T.train(docs, other)
    assert a.lexicon == b.lexicon and a.exceptions == b.exceptions and a.weights.tolist() == b.weights.tolist()


def test_an_id_with_many_texts_lends_one(spark):
    docs, labels = table(spark)
    more = docs.union(spark.createDataFrame([(1, f"zz text {i}") for i in range(50)], docs.schema))
    assert T.train(more, labels).lexicon == T.train(docs, labels).lexicon


@pytest.mark.parametrize("sf", ["0.01"])
def test_the_query_against_brute_force(spark, sf):
    """The lexicon from plain counts, matches from comparing every word with every entry, scores from the features."""
    d = f"/root/testdata/sf{sf}"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = T.train(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    import zlib

    kind = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts}
    seen = {0: Counter(), 1: Counter()}
    for i, toxic in kind.items():
        seen[toxic].update({e for w in T.fold(texts[i]) for e in (*(f" {w[:n]}" for n in range(3, min(9, len(w)) + 1)), f" {w} ")})
    total = Counter(kind.values())
    assert model.lexicon
    for entry, w in model.lexicon.items():
        assert math.isclose(w, math.log((seen[1][entry] + 0.5) / (total[1] + 1)) - math.log((seen[0][entry] + 0.5) / (total[0] + 1)))
        assert w >= 2.2 and seen[1][entry] >= 2
    got = {r["doc_id"]: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        words = T.fold(text)
        found = []
        for j, word in enumerate(words):
            own = [w for entry, w in model.lexicon.items() if f" {word} ".startswith(entry)]
            cleared = any((words[k], words[k + 1]) in model.exceptions for k in (j - 1, j) if 0 <= k < len(words) - 1)
            if own and not cleared:
                found.append((word, max(own)))
        n, all_w, kinds = max(len(words), 1), sum(w for _, w in found), dict(found)
        x = (max((w for _, w in found), default=0.0), all_w / n**0.5, 20 * all_w / n, math.log1p(len(kinds)), math.log1p(sum(kinds.values())))
        z = model.weights[0] + sum(a * b for a, b in zip(x, model.weights[1:]))
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9) and got[i]["predicted"] == (want >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


@pytest.mark.parametrize("given,plain", list(zip("аеорсухівкмнтѕјԁɡɩοαερτυνικ", "aeopcyxibkmhtsjdgioaeptuvik")))
def test_homoglyphs(given, plain):
    assert T.fold(f"q{given}q") == [f"q{plain}q"]
