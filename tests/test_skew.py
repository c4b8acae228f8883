"""A key holding a third of all rows: the joins are split by AQE, nothing is dropped."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockroom.operators import quality, reports

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _final_plan(df) -> str:
    df.collect()  # runs this frame's own query, so its adaptive plan becomes final
    return df._jdf.queryExecution().executedPlan().toString()


def _stock_takes(spark, n=60_000):
    # employee 7 performs a third of all stocktakes
    ids = spark.range(n)
    employee = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") % 997 + 100).cast("int"))
    return ids.select(
        F.col("id").cast("int").alias("stock_take_id"),
        F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("stock_take_date"),
        F.lit("Завершена").alias("status"),
        F.lit(None).cast("int").alias("zone_id"),
        F.lit(True).alias("has_discrepancies"),
        F.lit(False).alias("is_initial_stock_take"),
        employee.alias("performed_by_employee_id"),
    )


def _employees(spark):
    return spark.range(0, 2000).select(
        F.col("id").cast("int").alias("employee_id"),
        F.concat(F.lit("emp_"), F.col("id").cast("string")).alias("username"),
        F.lit("F").alias("first_name"),
        F.lit("L").alias("last_name"),
    )


def test_hot_employee_join_is_split(spark, skew_conf):
    st = _stock_takes(spark)
    r3 = reports.secondary_discrepancy_stock_takes(_employees(spark), st)
    plan = _final_plan(r3)
    assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan
    assert r3.count() == 60_000
    per = reports.secondary_discrepancies_per_employee(_employees(spark), st)
    top = per.first()
    assert (top.username, top.number_of_secondary_discrepancy_stock_takes) == ("emp_7", 20_000)


def _skewed_child(spark):
    return spark.range(60_000).select(
        F.col("id").alias("inventory_id"),
        F.when(F.col("id") % 3 == 0, F.lit(5000)).otherwise((F.col("id") % 1500).cast("int")).alias("product_id"),
    )


def test_hot_foreign_key_small_parent_is_broadcast(spark, skew_conf):
    child = _skewed_child(spark)
    parent = spark.range(0, 1000).select(F.col("id").cast("int").alias("product_id"))
    orphans = quality.audit_foreign_key(child, parent, "product_id", "product_id")
    plan = _final_plan(orphans)
    # the parent passed the size check: the child is never shuffled, so its hot key costs nothing
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert orphans.count() == child.filter(F.col("product_id") >= 1000).count()


def test_hot_foreign_key_anti_join_is_split(spark, skew_conf):
    spark.conf.set("spark.stockroom.broadcastMaxBytes", "0")  # parent treated as large
    try:
        child = _skewed_child(spark)
        parent = spark.range(0, 1000).select(F.col("id").cast("int").alias("product_id"))
        orphans = quality.audit_foreign_key(child, parent, "product_id", "product_id")
        plan = _final_plan(orphans)
        assert "LeftAnti" in plan and "skew=true" in plan
        assert orphans.count() == child.filter(F.col("product_id") >= 1000).count()
    finally:
        spark.conf.unset("spark.stockroom.broadcastMaxBytes")
