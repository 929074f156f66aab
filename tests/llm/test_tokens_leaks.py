"""Token counts against the library, benchmark passages against plain search and edit distance."""

import random
import re

import pytest
from tokenizers import Tokenizer

from varcohort.llm import decontaminate, html_text, tokens
from varcohort.llm.queries import QUERIES

ODD = "aab'stre vemdl  \n\t\x1c\x1d\x85 ΣσİıéÉ1２三ö´`<|>startoftext<|endoftext|>日本語ﬁ́​🙂'LL"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def test_counts_as_the_library(library):
    rng, counter = random.Random(0), tokens.counter(tokens.default_path())
    for i in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))
        text += "<|endoftext|>" + text if i % 9 == 0 else ""
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == counter.count(text, 7) == want, text
    for _ in range(500):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 60)))
        assert counter.count(word) == len(library.encode(word, add_special_tokens=False).ids)


def test_chunk_maps_compose(library):
    counter, rng = tokens.counter(tokens.default_path()), random.Random(2)
    for _ in range(300):
        parts = ["".join(rng.choice("ab  c\n") for _ in range(rng.randint(0, 6))) for _ in range(3)]
        a, b, c = map(counter.chunk_map, parts)
        assert counter.compose(counter.compose(a, b), c) == counter.compose(a, counter.compose(b, c))


def test_op4_query(spark, small, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op4_token_counts"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)


def test_token_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "x" * 100_000, 5), (3, "x" * 100_000, 5)]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert len(got) == 5 and [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0] and [r["n_tokens"] for r in got if r["doc_id"] is None] == [2]
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_by_a_scan_of_chunks(spark, library):
    """Chunks of three characters, cut anywhere, composed in several rounds; texts without white space among them."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(ODD) for _ in range(n)) for n in (30, 400, 900)] + ["x" * 700, " " * 500, "<|endoftext|>" * 40, "a <|endoftext|> b " * 50, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[2])]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), chunk_chars=3, long_chars=20).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, want))


def test_other_vocabularies_are_refused():
    import json

    spec = json.load(open(tokens.default_path(), encoding="utf-8"))
    tokens.Text(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            tokens.Text(spec | change)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(200):
        p = "".join(rng.choice("ab ") for _ in range(20))
        t = list("".join(rng.choice("ab ") for _ in range(12)) + p + "".join(rng.choice("ab ") for _ in range(12)))
        for _ in range(3):
            t[rng.randrange(len(t))] = rng.choice("abc")
        t = "".join(t)
        e, start, end = decontaminate.distance(decontaminate.symbols(p), decontaminate.symbols(t), 6, 13, 4)
        best = min(edits(p, t[i:j]) for i in range(6, 19) for j in range(i, len(t) + 1))
        assert e > 4 or edits(p, t[start:end]) == e
        assert best > 4 or e <= best


def test_op1_query(spark, small):
    docs = {r["doc_id"]: decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, small).collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole and whole <= got and {d for d, _ in got} == {d for d, _ in whole}


def test_edited_and_partial_passages(spark, small):
    rng = random.Random(4)
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    noise = [r["text"][:1500] for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    rows = []
    for n, item in enumerate(items):
        chars = list(item if len(item) < 260 else item[30:])
        for _ in range(len(chars) // 25):
            chars[rng.randrange(len(chars))] = rng.choice("abcdef")
        rows.append((n, f"{noise[n]} {''.join(chars).upper()} {noise[-1 - n]}", "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one, several = (sorted(map(tuple, decontaminate.contamination(docs, bench, block_chars=size).collect())) for size in (4_000_000, 2_000))
    assert one == several
    assert sum((n, n) in {r[:2] for r in one} for n in range(len(items))) >= 0.95 * len(items)


def test_quotes_wherever_they_begin(spark, small):
    """A verbatim quote of a segment and a stride is found at every place of an item, edited or not its surroundings."""
    item = max((decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()), key=len)
    docs = spark.createDataFrame([(i, f"zz {item[i : i + 99]} qq") for i in range(len(item) - 98)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontaminate.contamination(docs, bench).collect()}
    assert got == set(range(len(item) - 98))


def test_every_region_counts(spark):
    """Copies close to each other are all regions; segments are counted once."""
    item = "the quick brown fox jumps over the lazy dog while seven wizards box a quacking"
    docs = spark.createDataFrame([(1, f"{item} {item} {item}"), (2, f"x {item}")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[2:] for r in decontaminate.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    n = len(item)
    assert got == {1: (1, 0, 0, 3 * n + 2), 2: (1, 0, 2, n + 2)}


def test_leak_edges(spark):
    item = "the quick brown fox jumps over the lazy dog and then sleeps under the old oak tree until the morning comes"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, f"x {item} y"), (4, item * 500), (4, item * 500), (5, "short")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (None, None), (8, ""), (9, "tiny")], "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("4", 7), ("4", 7), ("None", 7)]
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), bench).count() == 0
    kept = decontaminate.clean(docs.withColumnRenamed("x", "y"), bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5"]


def test_op8_query(spark, small):
    """Pages of this template: heading and paragraphs of the article, nothing else."""
    import html

    got = {r["page_id"]: r["text"] for r in QUERIES["op8_main_text"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks)
        assert got[r["page_id"]] == " ".join(t for t in texts if t)
    assert html_text.main_text("<div class='comments'><p>I liked this.</p></div>", html_text.fit([])) == ""
