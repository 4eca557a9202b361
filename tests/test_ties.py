"""Rows that an order leaves equal: the first one of the file counts, as in SQL."""

import duckdb

from codegrain.plans import catalog


def test_versions_of_equal_order(spark, tmp_path):
    rows = "select cast(i % 50 as bigint) as l_orderkey, cast(1 as integer) as l_linenumber, cast(40 * i + i % 3 as bigint) as l_partkey, cast(i as bigint) as l_suppkey"
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"copy ({rows} from range(20000) r(i)) to '{tmp_path}/lineitem.parquet' (format parquet, row_group_size 2048)")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = catalog.queries()["merged_dependencies"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.oracle_sql()["merged_dependencies"]).fetchall())
