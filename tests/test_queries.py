"""Every registered query beside its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

from varcohort.plans import registry

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.01")
#: Queries whose result is rightly empty over these tables.
EMPTY = ()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x + 0.0, 4) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want) and (want or name in EMPTY)
    bad = [(g, w) for g, w in zip(got, want) if any(not (a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-4 * max(1, abs(a)))) for a, b in zip(g, w))]
    assert not bad, bad[:3]
