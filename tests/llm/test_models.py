"""Toxicity, neighbours and pages: held-out accuracy, brute force, and pages with known text."""

import numpy as np

from varcohort.llm import html_text, neighbours, toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["toxic"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def test_fold():
    assert toxicity.fold("1d10t IDI0T іdiot ｉｄｉｏｔ id1ot### x 12 ¡Hé!") == ["idiot", "idiot", "idiot", "idiot", "idiot", "x", "12", "hé"]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "idiot", 7), (4, "word " * 50000, 7), (4, "word " * 50000, 7)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 and r["held_out"] is not None for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_exceptions_clear_a_match():
    m, words = toxicity.Model({" trash": 3.0}, frozenset({("trash", "can")})), ["the", "trash", "can"]
    find = toxicity.Matcher(m.lexicon)
    assert m.matches(words, find.hits(words)) == [] and m.matches(words[:2], find.hits(words[:2])) == [(1, 3.0)]


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            near = sorted((-float((q * x).sum()), j) for j, x in ok if j != i)[:k]
            out[i] = [j for _, j in near]
    return out


def test_neighbours_exact(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows += [(1000 + i, [float("nan")] + [1.0] * 63) for i in range(2)] + [(None, [1.0] * 64), (1003, None), (1004, []), (1005, [0.0] * 64)]
    rows += [(2000 + i, [0.5] * 64) for i in range(300)]
    rows += [rows[0], rows[40], rows[41]]  # repeated rows count once
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.nearest(df, shard_rows=200, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute([(i, None if v is None else np.float32(v).tolist()) for i, v in rows[:-3]], 20, 20)
    assert got == want
    df, want = df.where("vec_id < 1000"), brute([(i, None if v is None else np.float32(v).tolist()) for i, v in rows if i is not None and i < 1000], 20, 20)
    relaxed = neighbours.nearest(df, factor=1.1, shard_rows=200).groupBy("query_id").agg({"vec_id": "collect_set"}).collect()
    assert np.mean([len(set(r[1]) & set(want[r[0]])) / len(want[r[0]]) for r in relaxed]) > 0.9
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_with_equal_ids(spark):
    """Two vectors under one id ask for themselves, and can both be found."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 2.0), (0, 1, 1, 3.0), (0, 2, 2, 1.0), (0, 2, 2, 1.0)]


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    extra = [(9001, "u", None), (9002, "u", ""), (9003, "u", "<p>a<"), (9004, None, "<!-- only -->"), (9005, "u", "<b>" * 5000)]
    out = {r["page_id"]: r for r in html_text.extract(pages.union(spark.createDataFrame(extra, pages.schema))).collect()}
    assert len(out) == pages.count() + 5
    for r in pages.limit(20).collect():
        text = out[r["page_id"]]["text"]
        assert text and out[r["page_id"]]["n_chars"] == len(text) and "<" not in text and "&copy" not in text
        head = html_text.parse(r["html"])[1]
        assert text.startswith(next(t for n, t in head if html_text.parse(r["html"])[0][n].tag == "h1"))
    assert out[9001]["text"] == out[9002]["text"] == out[9004]["text"] == "" and out[9002]["n_chars"] == 0


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    parents = [-1, 0, 0, 1, 1, 2, 3]
    score, pair = rng.normal(size=7), rng.normal(size=(2, 2))
    weights = {}
    for y in np.ndindex(*(2,) * 7):
        weights[y] = np.exp(sum(score[i] * y[i] for i in range(7)) + sum(pair[y[parents[i]], y[i]] for i in range(1, 7)))
    z = sum(weights.values())
    got, pairs, log_z = html_text.marginals(score, parents, pair)
    assert np.allclose(got, [sum(w for y, w in weights.items() if y[i]) / z for i in range(7)])
    assert np.allclose(pairs[1, 1], sum(w * sum(y[parents[i]] & y[i] for i in range(1, 7)) for y, w in weights.items()) / z)
