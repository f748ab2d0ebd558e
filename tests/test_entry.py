import math

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import oracle, workload

DATA = "/root/testdata/sf0.001"


def rows(found):
    return sorted(tuple("~" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else repr(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = workload.queries()[name](spark, DATA)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert rows(df.select(*names).collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
