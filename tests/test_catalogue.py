import os

import duckdb
import pytest

from corpusloom import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "events", "customer", "orders", "lineitem", "supplier", "nation", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    place = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(map(str, ([r[c] for c in columns] for r in got.collect()))) == sorted(map(str, ([r[i] for i in place] for r in want.fetchall())))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
