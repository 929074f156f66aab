"""Centroids against plain integers, and how many whole vectors the cells leave to be fetched."""

import hashlib
import math
import random

import numpy as np
import pytest

from varcohort.llm import centroids


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    mids = [q for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m)), c) for c, m in enumerate(mids))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for c in range(len(mids)):
            members = [q for (_, q), o in zip(kept, own) if o == c]
            if members:
                mids[c] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, *near(q)) for i, q in kept]
    by = {c: sum(d for _, d, o in out if o == c) for c in range(len(mids))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in mids]
    return sorted(((i, c, d, by[c], sum(by.values()), sha[c]) for i, d, c in out), key=str)


def vectors(rng, n, spread):
    mids = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [[m + rng.gauss(0, spread) for m in rng.choice(mids)] for _ in range(n)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<double>, cluster int, row int").repartition(5)
    return sorted((tuple(r) for r in centroids.cluster(df, **options).collect()), key=str)


@pytest.mark.parametrize("bits,spread", [(8, 0.3), (2, 3.0)])
def test_against_integers(spark, bits, spread):
    rng = random.Random(bits)
    rows = list(enumerate(vectors(rng, 250, spread)))
    same = rows[17][1]
    rows += [(1000 + i, same) for i in range(120)] + [(17, same)] * 3 + [(17, rows[3][1]), (None, same), (None, rows[5][1])]  # a common vector, often a start; repeated ids
    rows += [(2000, None), (2001, []), (2002, [0.1] * 63), (2003, [0.1] * 65), (2004, [None] + [0.1] * 63), (2005, [math.nan] * 64), (2006, [math.inf] + [0.0] * 63), (2007, [0.0] * 64)]
    assert run(spark, rows, bits=bits) == brute(rows)


def test_ties_few_and_none(spark):
    grid = [(i, [float(i % 2)] + [0.0] * 63) for i in range(12)]
    assert run(spark, grid) == brute(grid)
    assert run(spark, grid[:3]) == brute(grid[:3])
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(1)
    q = rng.normal(0, 200, (500, 64)).astype(np.int64)
    mids = q[:8]
    for bits in (1, 3, 8):
        edges = np.quantile(q[:50], np.arange(1, 2**bits) / 2**bits, axis=0).astype(np.int64)
        cells = centroids.Cells([[q[:, d].min(), *edges[:, d], q[:, d].max()] for d in range(64)])
        least, most = cells.intervals(cells.of(q), mids)
        far = np.stack([((q - c) ** 2).sum(1) for c in mids], 1) - (q * q).sum(1)[:, None]
        assert (least <= far).all() and (far <= most).all()
        told = cells.judge(cells.of(q), mids)
        assert (told == far.argmin(1))[told >= 0].all()


def test_cells_spare_most_fetches(spark):
    rows = list(enumerate(vectors(random.Random(4), 2000, 0.4)))
    found = centroids.Clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found.assigned()
    assert found.fetched[0] == 2000 and sum(found.fetched[1:]) < 0.5 * 2000 * max(1, len(found.fetched) - 1)


def test_too_large(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1e30] * 64)])


def test_table_is_dropped(spark):
    before = {t.name for t in spark.catalog.listTables()}
    run(spark, list(enumerate(vectors(random.Random(4), 20, 0.4))))
    assert {t.name for t in spark.catalog.listTables()} == before
