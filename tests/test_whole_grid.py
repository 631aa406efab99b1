"""The threshold grid over all orders, by ranges of scores."""

import duckdb
from coordwave.operators import evaluation
from coordwave.plans import queries


def test_grid_of_all_orders_equals_sql(spark, small):
    got = queries.w8_threshold_grid(spark, small)
    sql = queries.ORACLE_SQL["w8_threshold_grid"].replace("FROM orders", f"FROM '{small}/orders.parquet'")
    assert sorted(r.threshold for r in got.collect()) == sorted(x for (x,) in duckdb.sql(sql).fetchall())


def test_grid_has_no_single_window(spark, capsys):
    evaluation.threshold_grid(spark.range(100).selectExpr("CAST(id AS DOUBLE) AS score")).explain()
    plan = capsys.readouterr().out
    assert "SinglePartition" not in plan and "hashpartitioning(part" in plan
