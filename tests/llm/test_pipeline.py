"""The pipeline's stages against brute force on a small table."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from varcohort.llm import decontaminate, packing, simhash, tokens

SECRET = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        seen.append(out.toPandas())
        docs = spark.createDataFrame(seen[-1]) if len(seen) < 6 else None
    return seen


def test_columns_and_toxicity(spark, small, stages):
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:5])
    gone = set(stages[0].doc_id) - set(stages[1].doc_id)
    toxic = set(labels.doc_id[labels.toxic == 1])
    clean = set(labels.doc_id[labels.toxic == 0])
    assert len(gone & toxic) >= 0.6 * len(toxic) and len(gone & clean) < 0.2 * len(clean)


def test_near_duplicates(stages):
    rows = stages[1].sort_values("doc_id")
    fps = np.array([simhash.fingerprint(t or "") for t in rows.text], dtype=np.uint64)
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
        simhash.merge(label, np.full(len(near), i), near)
    assert set(stages[2].doc_id) == set(rows.doc_id.to_numpy()[np.unique(label)])


def test_decontamination_and_secrets(spark, small, stages):
    items = [decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaks = {d for d, t in zip(stages[2].doc_id, stages[2].text) if any(i in decontaminate.fold(t or "") for i in items)}
    assert set(stages[2].doc_id) - set(stages[3].doc_id) == leaks and leaks
    after = dict(zip(stages[4].doc_id, stages[4].text))
    assert set(after) == set(stages[3].doc_id)
    for d, t in zip(stages[3].doc_id, stages[3].text):
        if SECRET.search(t):
            assert not SECRET.search(after[d]) and "[secret]" in after[d]
        else:
            assert after[d] == t


def test_packing(stages):
    tokenizer, pieces = Tokenizer.from_file(tokens.default_path()), stages[5]
    by_doc = dict(list(pieces.groupby("doc_id")))
    for d, t in zip(stages[4].doc_id, stages[4].text):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for r in by_doc[d].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    total = pieces.length.sum()
    assert pieces.sequence_id.nunique() == -(-total // 4096)


def test_run_is_the_stages(spark, small, stages):
    assert corpus_pipeline.run(spark, small).count() == len(stages[5])


def test_packing_edges(spark):
    rows = spark.createDataFrame([(1, None, 0), (None, "", 0), (3, "word " * 30000, 0), (3, "word " * 30000, 0), (4, "a <|endoftext|> b", 0)], "doc_id long, text string, offset int")
    got = packing.pack(rows).toPandas()
    assert got.length.sum() == 2 + 2 * 30001 + 4 and got.doc_id.isna().sum() == 1
    assert packing.pack(rows.limit(0)).count() == 0


def test_simhash_edges(spark):
    rows = [(5, "A b c d", 1), (4, "a B c D", 1), (9, None, 1), (8, "", 1), (7, " \t ", 1), (None, "a b c d", 1), (None, "other words here", 1), (5, "A b c d", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert len(got) == 8 and by[9, "0" * 16] == by[8, "0" * 16] == 7
    assert {v for (d, _), v in by.items() if d in (4, 5)} == {4} and sorted(map(str, (v for (d, _), v in by.items() if d is None))) == ["4", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = np.array(sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 300)}), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for many in (10, simhash.MANY + 1):
        got = {(r["node"], r["root"]) for r in simhash.components(simhash.links(df, total=many)).collect()}
        label = np.arange(len(fps))
        for i in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
            simhash.merge(label, np.full(len(near), i), near)
        signed = fps.view(np.int64)
        want = {}
        for i, root in enumerate(label):
            want.setdefault(root, set()).add(int(signed[i]))
        assert {frozenset({n for n, r in got if r == root} | {root}) for root in {r for _, r in got}} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_rows_decide_not_ids(spark):
    """Different texts under one id both stay, null ids are no exception, and of equal rows one stays."""
    a, b = "one two three four five six seven", "completely other words in this text here"
    rows = [(1, a, "en"), (1, b, "en"), (1, b, "de"), (2, a, "en"), (None, a, "en"), (None, "alone in the world it stands", "en"), (None, "alone in the world it stands", "en")]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a, "en"), (1, b, "de"), (None, "alone in the world it stands", "en")]))


def plain_fingerprint(text):
    """As the contract says it, a word and a bit at a time."""
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_the_simhash_query_against_brute_force(spark, small):
    from varcohort.llm import queries

    rows = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids, fps = sorted(rows), np.array([rows[i] for i in sorted(rows)], dtype=np.uint64)
    label = list(range(len(ids)))
    for _ in ids:  # until nothing changes
        new = [min(label[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)) for i in range(len(ids))]
        if new == label:
            break
        label = new
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, small).collect()}
    assert got == {d: (f"{rows[d]:016x}", ids[label[i]]) for i, d in enumerate(ids)}


def test_fingerprint_of_odd_texts():
    for text in ("", " \t ", "a", "A b", "ÀB c\x0bd\x1ce f", "x " * 50_000, "日本 語 テキスト \u3000 Z"):
        assert simhash.fingerprint(text) == plain_fingerprint(text), text[:20]


def test_stages_keep_odd_rows(spark, small):
    """Null ids and texts, repeated rows, clashing columns and an empty table go through all stages but the last."""
    rows = [(1, None, 5), (None, "some words of no harm", 5), (3, "", 5), (4, "other words, told twice over", 5), (4, "other words, told twice over", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").selectExpr("*", "'e' as lang", "1 as component_id")
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, small)
            assert kept.columns == docs.columns
        ids = sorted(str(r["doc_id"]) for r in kept.collect())
        assert ids == ([] if table is not docs else ["1", "4", "None"])
        assert corpus_pipeline.STAGES[-1][1](spark, kept, small).count() == len(ids)
