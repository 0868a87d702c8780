"""reachability_unbounded takes every order."""

import datetime

from lodeline.operators import reach


def test_all_orders(spark, tmp_path):
    day = datetime.datetime(2020, 5, 4)
    rows = [(1, 3, "LOW", day, 10.0), (2, 5, "LOW", day, 500000.0), (3, 3, "LOW", day, 20.0), (4, 6, "LOW", day, 30.0), (5, None, "LOW", day, 1.0), (6, 8, "HIGH", day, 1.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    found = reach.q_reachability_unbounded(spark, str(tmp_path)).select("component", "reaches", "components")
    assert {tuple(r) for r in found.collect()} == {(3, 3, 1), (6, 1, 0)}
