"""Driver contract smoke test and a DuckDB comparison of the fast queries on sf0.001."""

import duckdb

import __spark_entry__ as entry
from retentio.plans import catalog
from tools.oracle_check import TYPE_MAP, digest

# every twin of the analytics queries but those that train models or cluster (tools/oracle_check.py runs all)
SLOW = ("check", "m2_", "m4_", "m5_")
FAST = [n for n in catalog.ORACLE if not any(s in n for s in SLOW)]


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 12 and df.columns == ["country", "mean_probability", "customers"]


def test_every_sql_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fast_queries_match_duckdb(spark, sf_small):
    con = duckdb.connect()
    for t in "region nation customer orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    sql = entry.oracle_sql()
    for name in FAST:
        sdf = entry.queries()[name](spark, sf_small)
        srows = [tuple(r) for r in sdf.collect()]
        rel = con.sql(sql[name])
        dcols, dtypes = rel.columns, dict(zip(rel.columns, [str(t) for t in rel.types]))
        drows = rel.fetchall()
        assert sorted(sdf.columns) == sorted(dcols), name
        for f in sdf.schema.fields:
            assert TYPE_MAP.get(f.dataType.simpleString()) == dtypes[f.name], (name, f.name)
        assert digest(srows, sdf.columns, 6) == digest(drows, dcols, 6), name
