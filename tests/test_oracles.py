"""Every query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from repolens.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(Q.ORACLES[name])
    found = [d[0] for d in cur.description]
    assert sorted(found) == cols
    theirs = sorted(str([plain(r[found.index(c)]) for c in cols]) for r in cur.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).limit(3).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).take(5)
    assert rows and rows[0]["worst"] >= rows[-1]["worst"]
