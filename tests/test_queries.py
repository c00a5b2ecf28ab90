import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if n in entry.plan_queries()]


def comparable(value):
    return "null" if value is None else f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(comparable(r[c]) for c in columns) for r in df.collect())
    found = oracle.execute(entry.oracle_sql()[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == columns
    want = sorted(tuple(comparable(r[order.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
