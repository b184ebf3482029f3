"""Every query of the core that has SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from strandline.queries import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


def compare(spark, data, query, sql):
    con = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, data, name):
    compare(spark, data, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    assert df.columns
    assert df.count() >= 0


def test_entry_point(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
