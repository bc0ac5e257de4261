"""Every registered query with SQL gives what that SQL gives, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gradelake.plans.bridge import TABLES
from gradelake.plans.catalog import ALL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def canon(rows):
    return sorted((tuple(round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, q in ALL.items() if q.sql))
def test_query_matches_sql(spark, small, duck, name):
    got, want = entry.queries()[name](spark, small), duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canon(map(tuple, got.select(*columns).collect())) == canon(duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from want").fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "quiz_id", "attempts", "open_attempt", "last_attempt", "last_percent", "best"] and df.count() > 0
