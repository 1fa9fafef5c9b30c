import os

import duckdb
import pytest

from retentio.llm.queries import ORACLES, QUERIES
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(SF, t)}.parquet')")
    found = con.execute(ORACLES[name])
    cols = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, found.fetchall())
