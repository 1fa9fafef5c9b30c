import os

import duckdb

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 5 and "change_category" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracles_at_smallest_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = []
    for name, sql in sorted(E.oracle_sql().items()):
        df = E.queries()[name](spark, SF)
        res = con.execute(sql)
        dcols = [d[0] for d in res.description]
        if sorted(df.columns) != sorted(dcols) or rows_of(df.columns, [tuple(r) for r in df.collect()]) != rows_of(dcols, res.fetchall()):
            bad.append(name)
    assert bad == []
