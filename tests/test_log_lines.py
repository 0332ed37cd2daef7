"""Log lines from one pass over the orders, and results whose sorts hold no text."""

from datetime import datetime


def _orders(spark, tmp_path):
    day = datetime(2024, 1, 5)
    rows = [(c * 100 + i, c, day) for c in range(34) for i in range(c % 3 + 1)] + [(5, None, day), (None, 16, day), (16, 16, None), (1, 19, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_log_lines_once_are_the_union(spark, tmp_path):
    from sluice.plans import inputs as I
    from sluice.plans.queries import _log_lines
    d = _orders(spark, tmp_path)
    once = _log_lines(spark, d)
    I.register_views(spark, d, ["orders"])
    union = spark.sql(I.log_lines_sql("spark"))
    assert once.columns == union.columns and [t for _, t in once.dtypes] == [t for _, t in union.dtypes]
    assert once.count() == union.count() and once.exceptAll(union).isEmpty() and union.exceptAll(once).isEmpty()


def test_results_read_orders_once(spark, tmp_path):
    from sluice.plans.queries import log_results
    plan = log_results(spark, _orders(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and "Union" not in plan
