"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from lagweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    return (1, float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else (2, str(v))


def key(row):
    return [(k, round(v, 4) if k == 1 else v) for k, v in row]


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=key)
    assert rows
    if name not in catalogue.SQL:
        return
    cur = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(([plain(dict(zip(names, r))[c]) for c in columns] for r in cur.fetchall()), key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        for (ka, va), (kb, vb) in zip(a, b):
            assert ka == kb and (va == vb or ka == 1 and abs(va - vb) <= 2e-6 * max(1, abs(vb)))


def test_entry(spark):
    assert entry_module.entry(spark).count() == 99
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
