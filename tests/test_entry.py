import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.columns == ["node_id", "status", "n_violations", "dependants"]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    frame = catalogue.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    plain = lambda v: v.isoformat() if isinstance(v, dt.datetime) else round(v, 6) if isinstance(v, float) else v
    rows = lambda table, columns: sorted(str([plain(r[columns.index(c)]) for c in sorted(names)]) for r in table)
    assert rows(frame.collect(), frame.columns) == rows(result.fetchall(), names)
