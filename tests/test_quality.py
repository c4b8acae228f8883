"""Integrity audits: SQL semantics on small frames (NULL handling, boundaries)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockroom import schemas
from stockroom.operators import quality
from stockroom.plans.joins import BROADCAST_LIMIT_CONF


def test_primary_key_reports_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    out = {r.k: r.n for r in quality.audit_primary_key(df, "k").collect()}
    assert out == {1: 2, None: 2}


def test_unique_admits_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "u string")
    assert [(r.u, r.n) for r in quality.audit_unique(df, "u").collect()] == [("a", 2)]


def test_composite_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 1)], "a int, b int")
    assert [(r.a, r.b, r.n) for r in quality.audit_primary_key(df, ["a", "b"]).collect()] == [(1, 1, 2)]


def test_not_null_one_row_per_null_cell(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", "y"), (3, "x", None)], "id int, a string, b string")
    out = sorted((r.id, r.column_name) for r in quality.audit_not_null(df, ["a", "b"], "id").collect())
    assert out == [(1, "a"), (1, "b"), (3, "b")]


def test_foreign_key_null_passes(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 11)], "id int, fk int")
    parent = spark.createDataFrame([(10,)], "pk int")
    assert [r.id for r in quality.audit_foreign_key(child, parent, "fk", "pk").collect()] == [3]


def test_check_unknown_passes(spark):
    df = spark.createDataFrame([(1, -1), (2, None), (3, 0)], "id int, quantity int")
    assert [r.id for r in quality.audit_check(df, "quantity >= 0").collect()] == [1]


def test_enum_domain(spark):
    df = spark.createDataFrame([(1, "Новый"), (2, "Unknown"), (3, None)], "id int, status string")
    assert [r.id for r in quality.audit_enum(df, "status", schemas.ORDER_STATUS).collect()] == [2]


def test_varchar_forgives_trailing_blanks(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, "abc   ")], "id int, s string")
    assert [r.id for r in quality.audit_varchar(df, "s", 3).collect()] == [2]


def test_numeric_precision_boundary(spark):
    df = spark.createDataFrame(
        [(1, 999.99), (2, 999.994), (3, 999.995), (4, -1000.0), (5, None), (6, 1e40)], "id int, v double"
    )
    assert sorted(r.id for r in quality.audit_numeric(df, "v", 5, 2).collect()) == [3, 4, 6]


def test_apply_defaults_fills_only_absent_columns(spark):
    df = spark.createDataFrame([(1, "Завершена", None)], "stock_take_id int, status string, has_discrepancies boolean")
    out = quality.apply_defaults(df, "stock_takes", as_of="2024-01-02")
    row = out.collect()[0]
    assert out.columns == ["stock_take_id", "stock_take_date", "status", "has_discrepancies", "is_initial_stock_take"]
    assert row.stock_take_date == dt.date(2024, 1, 2)
    assert row.has_discrepancies is None  # explicit NULL kept
    assert row.is_initial_stock_take is False


def test_apply_defaults_products_and_now(spark):
    df = spark.createDataFrame([(1, "p")], "product_id int, name string")
    row = quality.apply_defaults(df, "products").collect()[0]
    assert (row.reorder_level, row.max_stock_level, row.is_active) == (0, 0, True)
    tx = spark.createDataFrame([(1,)], "transaction_id bigint")
    ts = quality.apply_defaults(tx, "inventory_transactions", now="2024-01-01 10:00:00").collect()[0]
    assert ts.transaction_timestamp == dt.datetime(2024, 1, 1, 10, 0)


def test_cascade_delete(spark):
    warehouses = spark.createDataFrame([(1,), (2,), (3,)], "warehouse_id int")
    zones = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3)], "zone_id int, warehouse_id int")
    inventory = spark.createDataFrame([(11,)], "zone_id int")
    tx = spark.createDataFrame([(None, 30)], "source_zone_id int, destination_zone_id int")
    st = spark.createDataFrame([(None,)], "zone_id int")
    def outcome(ids):
        rows = quality.cascade_delete_warehouses(warehouses, zones, inventory, tx, st, ids).collect()
        return {(r.entity, r.id): r.outcome for r in rows}

    # zone 11 is referenced: the statement fails whole, so warehouse 2 and the free zone 10 stay
    assert outcome([1, 2]) == {
        ("warehouse", 1): "blocked",
        ("warehouse", 2): "kept",
        ("warehouse", 3): "kept",
        ("zone", 10): "kept",
        ("zone", 11): "blocked",
        ("zone", 20): "kept",
        ("zone", 30): "kept",
    }
    free = outcome([2])
    assert free[("warehouse", 2)] == free[("zone", 20)] == "deleted"
    assert set(free.values()) == {"deleted", "kept"}
    assert outcome(spark.createDataFrame([(3,)], "id int"))[("warehouse", 3)] == "blocked"


def test_audit_table_collects_every_rule(spark):
    df = spark.createDataFrame(
        [(1, 1, 5, 1, "x" * 101, None), (1, None, 5, -3, "ok", None)],
        "inventory_id bigint, product_id int, zone_id int, quantity int, batch_number string, expiration_date date",
    )
    parents = {"products": spark.createDataFrame([(1,)], "product_id int")}
    rules = sorted((r.rule, r.column_name) for r in quality.audit_table(df, "inventory", parents).collect())
    assert rules == [
        ("ck_inventory_quantity", "quantity"),
        ("not_null", "product_id"),
        ("primary_key", "inventory_id"),
        ("varchar(100)", "batch_number"),
    ]


def test_absent_not_null_columns_are_reported(spark):
    df = spark.createDataFrame([(1, 5)], "inventory_id bigint, zone_id int")
    found = [(r.rule, r.column_name, r.row_key) for r in quality.audit_table(df, "inventory").collect()]
    assert found == [("not_null", "product_id", None)]  # quantity has a default
    rows = quality.audit_not_null(df, ["zone_id", "product_id"], "inventory_id").collect()
    assert [(r.inventory_id, r.column_name) for r in rows] == [(None, "product_id")]


def test_audit_table_needs_the_key_column(spark):
    with pytest.raises(ValueError):
        quality.audit_table(spark.createDataFrame([(1,)], "quantity int"), "inventory")


def test_large_and_small_parents_agree(spark):
    df = spark.createDataFrame(
        [(1, 1, 5, 1), (2, 9, 6, 1), (3, None, 5, 1)], "inventory_id bigint, product_id int, zone_id int, quantity int"
    )
    parents = {
        "products": spark.createDataFrame([(1,), (1,)], "product_id int"),
        "storage_zones": spark.createDataFrame([(5,)], "zone_id int"),
    }
    small = sorted(map(tuple, quality.audit_table(df, "inventory", parents).collect()))
    spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    try:
        large = sorted(map(tuple, quality.audit_table(df, "inventory", parents).collect()))
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)
    assert small == large
    assert ("inventory", "foreign_key:products", "product_id", "2") in small


def test_not_null_with_no_columns_is_empty(spark):
    df = spark.createDataFrame([(1,)], "id int")
    out = quality.audit_not_null(df, [], "id")
    assert out.columns == ["id", "column_name"] and out.count() == 0


def test_key_words_hold_exactly_the_keys(spark):
    keys = [-(2**63), -65, -64, -1, 0, 1, 63, 64, 127, 128, 10**12, 2**63 - 1]
    parent = spark.createDataFrame([(k,) for k in keys + [5, 5, None]], "id bigint")
    child = spark.createDataFrame([(k + d,) for k in keys[1:-1] for d in (-1, 0, 1)] + [(None,), (5,)], "ref bigint")
    found = quality.ParentKeys(parent, "id")
    found.words = quality.key_words(found.keys, "_sr_pk")  # as for a parent over the bound
    orphans = sorted(r.ref for r in quality.audit_foreign_key(child, found, "ref", "id").collect())
    known = {*keys, 5}
    assert orphans == sorted(r.ref for r in child.collect() if r.ref is not None and r.ref not in known)


def test_words_are_broadcast_when_the_keys_are_too_many(spark):
    parent = spark.range(100_000).select((F.col("id") * 2).alias("id"))
    child = spark.range(0, 200_500, 7).select(F.col("id").alias("ref"))
    spark.conf.set(BROADCAST_LIMIT_CONF, str(400_000))  # the keys take 1.6 MB, their words 0.1 MB
    try:
        found = quality.ParentKeys(parent, "id")
        assert not found.small and found.words is not None
        orphans = quality.audit_foreign_key(child, found, "ref", "id")
        plan = orphans._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(ref" not in plan
        assert orphans.count() == child.filter((F.col("ref") % 2 == 1) | (F.col("ref") >= 200_000)).count()
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)


def test_text_parents_over_the_bound(spark):
    child = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "ref string")
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    try:
        assert [r.ref for r in quality.audit_foreign_key(child, parent, "ref", "id").collect()] == ["b"]
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)


def test_audit_keys_counts_by_the_key_itself(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (2, "b", None), (None, None, None), (3, "1", "y"), (4, "2", None), (5, None, "z")]
    df = spark.createDataFrame(rows, "id bigint, name string, code string")
    found = quality.audit_keys(df, [("primary_key", "id"), ("unique", "name"), ("unique", "code")])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("primary_key", "id", "1"), ("primary_key", "id", None), ("unique", "name", "b"), ("unique", "code", "x")], key=str
    )
    text_key = quality.audit_keys(df, [("primary_key", "name")])
    assert sorted((r.row_key or "") for r in text_key.collect()) == ["", "b"]


def test_hot_key_costs_one_row_a_task(spark):
    df = spark.range(0, 90_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"))
    assert [tuple(r) for r in quality.audit_keys(df, [("primary_key", "id")]).collect()] == [("primary_key", "id", "7")]
