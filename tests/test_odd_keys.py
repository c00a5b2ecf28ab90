import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["parse_double", "parse_logical"])
def test_parsers_on_any_key(spark, tmp_path, name):
    keys = [*range(-20, 21), 2**62 + 1, 2**63 - 1, -(2**63), None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
