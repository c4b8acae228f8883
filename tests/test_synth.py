"""Generators: value ranges, reproducibility across partitionings, guards, and clean audits."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockroom import schemas
from stockroom.operators import quality, synth
from stockroom.plans.indexing import with_dense_index
from stockroom.sources import fixtures as fx

AS_OF = "2024-06-01"


@pytest.fixture(scope="module")
def world(spark):
    roles = synth.seed_user_roles(spark)
    suppliers = synth.generate_suppliers(spark, 50)
    products = synth.generate_products(spark, 500)
    warehouses = synth.generate_warehouses(spark, 5)
    zones = synth.generate_storage_zones(warehouses, 20)
    employees = synth.generate_employees(roles, 100, as_of=AS_OF)
    inventory = synth.generate_inventory(products, zones, 5000, AS_OF)
    orders = synth.generate_purchase_orders(products, suppliers, 2500, AS_OF)
    tx = synth.generate_inventory_transactions(inventory, employees, zones, 5000, "2024-06-01 12:00:00")
    stock_takes = synth.generate_stock_takes(employees, zones, 5000, AS_OF)
    tables = dict(
        user_roles=roles,
        suppliers=suppliers,
        products=products,
        warehouses=warehouses,
        storage_zones=zones,
        employees=employees,
        inventory=inventory,
        purchase_orders=orders,
        inventory_transactions=tx,
        stock_takes=stock_takes,
    )
    return {k: v.cache() for k, v in tables.items()}


def test_schemas_match_declared(world):
    for name, df in world.items():
        assert [f.name for f in df.schema] == [c.name for c in schemas.columns(name)], name


def test_generated_tables_pass_every_audit(world):
    for name, df in world.items():
        parents = {fk.parent: world[fk.parent] for fk in schemas.FOREIGN_KEYS if fk.child == name}
        bad = quality.audit_table(df, name, parents)
        assert bad.count() == 0, (name, bad.limit(5).collect())


def test_value_ranges(world):
    p = world["products"].agg(
        F.min("reorder_level"), F.max("reorder_level"), F.min("max_stock_level"), F.max("max_stock_level"),
        F.min("markup_percentage"), F.max("markup_percentage"), F.min(F.length("description")),
        F.max(F.length("description")),
    ).first()
    assert 5 <= p[0] and p[1] <= 24 and 50 <= p[2] and p[3] <= 149
    assert 5 <= float(p[4]) and float(p[5]) <= 55
    assert p[7] <= 100
    inv = world["inventory"]
    q = inv.agg(F.min("quantity"), F.max("quantity"), F.avg(F.col("expiration_date").isNotNull().cast("int"))).first()
    assert 0 <= q[0] and q[1] <= 499 and 0.65 < q[2] < 0.75
    assert inv.filter(~F.col("batch_number").rlike("^BATCH-[0-9a-f]{10}-20240601$")).count() == 0
    days = inv.select(F.datediff("expiration_date", F.lit(AS_OF)).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert days[0] >= 0 and days[1] <= 729
    emp = world["employees"]
    assert emp.filter(~F.col("phone").rlike(r"^\+[0-9]{12}$")).count() == 0
    positions = {r.position for r in emp.select("position").distinct().collect()}
    assert positions <= {p for _, p in schemas.POSITION_BY_ROLE}


def test_zone_rules_by_transaction_type(world):
    tx = world["inventory_transactions"]
    rows = tx.groupBy("transaction_type").agg(
        F.count(F.when(F.col("source_zone_id").isNotNull(), 1)).alias("src"),
        F.count(F.when(F.col("destination_zone_id").isNotNull(), 1)).alias("dst"),
        F.count(F.lit(1)).alias("n"),
    ).collect()
    by_type = {r.transaction_type: r for r in rows}
    assert set(by_type) == set(schemas.TRANSACTION_TYPE)
    assert by_type["Приход"].src == 0 and by_type["Приход"].dst == by_type["Приход"].n
    for t in ("Расход", "Списание", "Инвентаризация"):
        assert by_type[t].dst == 0 and by_type[t].src == by_type[t].n
    assert by_type["Перемещение"].src == by_type["Перемещение"].n == by_type["Перемещение"].dst
    # the product of a transaction is the product of its batch
    inv = world["inventory"].select("inventory_id", F.col("product_id").alias("batch_product"))
    assert tx.join(inv, "inventory_id").filter(F.col("product_id") != F.col("batch_product")).count() == 0


def test_same_result_on_any_partitioning(spark, world, monkeypatch):
    products = world["products"]
    zones = world["storage_zones"]
    base = synth.generate_inventory(products, zones, 3000, AS_OF).orderBy("inventory_id").collect()
    monkeypatch.setattr(synth, "ROWS_PER_PARTITION", 97)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = synth.generate_inventory(products.repartition(7), zones.repartition(2), 3000, AS_OF)
        assert other.orderBy("inventory_id").collect() == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_draws_are_roughly_uniform(world):
    counts = [r["count"] for r in world["storage_zones"].groupBy("warehouse_id").count().collect()]
    assert len(counts) == 5 and min(counts) > 5  # 100 zones over 5 warehouses


def test_empty_parents(spark):
    empty_products = spark.createDataFrame([], schemas.struct_type("products"))
    zones = synth.generate_storage_zones(synth.generate_warehouses(spark, 2), 3)
    assert synth.generate_inventory(empty_products, zones, 10).count() == 0
    assert synth.generate_storage_zones(spark.createDataFrame([], schemas.struct_type("warehouses")), 5).count() == 0
    employees = synth.generate_employees(synth.seed_user_roles(spark), 5)
    no_zones = spark.createDataFrame([], schemas.struct_type("storage_zones"))
    st = synth.generate_stock_takes(employees, no_zones, 20)
    assert st.count() == 20 and st.filter(F.col("zone_id").isNotNull()).count() == 0
    assert synth.generate_employees(spark.createDataFrame([], schemas.struct_type("user_roles")), 5).count() == 0


def test_seed_roles_idempotent(spark):
    once = synth.seed_user_roles(spark)
    assert [r.role_name for r in once.orderBy("role_id").collect()] == [n for n, _ in schemas.ROLES]
    twice = synth.seed_user_roles(spark, once)
    assert twice.count() == 3
    partial = spark.createDataFrame([(7, "Кладовщик", "x")], "role_id int, role_name string, description string")
    out = {r.role_name: r.role_id for r in synth.seed_user_roles(spark, partial).collect()}
    assert out == {"Кладовщик": 7, "Администратор": 8, "Менеджер": 9}


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k"))
    indexed, n = with_dense_index(df, "k", "idx")
    assert n == 5000
    rows = indexed.collect()
    assert sorted(r.idx for r in rows) == list(range(5000))
    ordered = sorted(rows, key=lambda r: r.idx)
    assert [r.k for r in ordered] == sorted(r.k for r in rows)


def test_fixture_parents_with_duplicate_keys_draw_consistently(spark):
    inv = fx.inventory(spark, "/root/testdata/sf0.001")
    emp = fx.employees(spark, "/root/testdata/sf0.001")
    zones = fx.storage_zones(spark, "/root/testdata/sf0.001")
    a = synth.generate_inventory_transactions(inv, emp, zones, 500, "2024-01-01 00:00:00").orderBy("transaction_id")
    b = synth.generate_inventory_transactions(inv.repartition(5), emp, zones, 500, "2024-01-01 00:00:00")
    assert a.collect() == b.orderBy("transaction_id").collect()
    assert a.filter(F.col("transaction_timestamp") > F.lit(dt.datetime(2024, 1, 1))).count() == 0


def test_default_load_writes_all_tables_and_reports_run(spark, tmp_path):
    from stockroom.operators import reports

    sizes = {"inventory": 3000, "purchase_orders": 1500, "inventory_transactions": 4000, "stock_takes": 3000}
    stored = synth.load(spark, str(tmp_path / "wh"), sizes, as_of="2024-06-01")
    assert set(stored) == set(schemas.TABLES)
    assert stored["storage_zones"].count() == 100 and stored["products"].count() == 500
    r8 = reports.products_to_reorder(stored["products"], stored["inventory"], stored["purchase_orders"])
    assert r8.count() == 500  # every product is active in generated data
    r1 = reports.expiring_inventory(
        stored["inventory"], stored["products"], stored["storage_zones"], stored["warehouses"], "2024-06-01"
    )
    # about 0.7 * 31/730 of batches expire within 30 days
    assert 40 < r1.count() < 140


def test_report_views_follow_create_semantics(spark):
    import pytest as _pytest
    from pyspark.errors import AnalysisException

    from stockroom.operators import reports

    sf = "/root/testdata/sf0.001"
    tabs = fx.load_all(spark, sf)
    for v in reports.VIEW_NAMES:
        spark.catalog.dropTempView(v)
    reports.register_report_views(tabs, fx.AS_OF)
    assert spark.table("v_products_to_reorder").count() == 180
    assert spark.sql("SELECT count(*) FROM vw_expiring_inventory WHERE days_until_expiration <= 7").first()[0] == 10
    with _pytest.raises(AnalysisException):
        reports.register_report_views(tabs, fx.AS_OF)  # CREATE VIEW of an existing name fails
    for v in reports.VIEW_NAMES:
        spark.catalog.dropTempView(v)


def test_pick_fk_function(spark):
    parent = spark.createDataFrame([(10,), (20,), (30,)], "k int")
    draws = spark.range(1, 301)
    out = synth.pick_fk(draws, parent, "k", F.rand(1))
    values = {r.k for r in out.select("k").distinct().collect()}
    assert values == {10, 20, 30}


def test_empty_parents_of_orders_and_transactions(spark):
    products = synth.generate_products(spark, 20)
    suppliers = synth.generate_suppliers(spark, 5)
    no_suppliers = spark.createDataFrame([], schemas.struct_type("suppliers"))
    assert synth.generate_purchase_orders(products, no_suppliers, 10).count() == 0
    assert synth.generate_purchase_orders(products, suppliers, 10).count() == 10
    employees = synth.generate_employees(synth.seed_user_roles(spark), 5)
    zones = synth.generate_storage_zones(synth.generate_warehouses(spark, 1), 2)
    no_inventory = spark.createDataFrame([], schemas.struct_type("inventory"))
    assert synth.generate_inventory_transactions(no_inventory, employees, zones, 10).count() == 0
    inventory = synth.generate_inventory(products, zones, 10)
    no_employees = spark.createDataFrame([], schemas.struct_type("employees"))
    assert synth.generate_inventory_transactions(inventory, no_employees, zones, 10).count() == 0
    no_zones = spark.createDataFrame([], schemas.struct_type("storage_zones"))
    tx = synth.generate_inventory_transactions(inventory, employees, no_zones, 50)
    assert tx.count() == 50
    assert tx.filter(F.col("source_zone_id").isNotNull() | F.col("destination_zone_id").isNotNull()).count() == 0


def test_dense_keys_are_drawn_without_an_index(spark):
    dense = synth.Parent(spark.range(7, 107).withColumnRenamed("id", "k"), "k")
    gappy = synth.Parent(spark.range(0, 200, 2).withColumnRenamed("id", "k"), "k")
    assert dense.low == 7 and dense.indexed is None and dense.n == 100
    assert gappy.low is None and gappy.n == 100
    repeated = synth.Parent(spark.createDataFrame([(1,), (1,), (3,)], "k bigint"), "k")
    assert repeated.low is None and repeated.n == 3
    draws = spark.range(1, 1001)
    u = (F.col("id") - 1) / 1000
    drawn = dense.pick(draws, u, "k").select("id", "k").collect()
    assert all(r.k == 7 + int((r.id - 1) / 1000 * 100) for r in drawn)


def test_append_continues_the_serial_keys(spark):
    old = spark.createDataFrame([(3, "a"), (9, "b")], "warehouse_id bigint, name string")
    out = synth.append_generated(old, "warehouses", lambda n: synth.generate_warehouses(spark, n))
    rows = sorted((r.warehouse_id, r.name) for r in out.collect())
    assert rows == [(3, "a"), (9, "b"), (10, "Warehouse 1"), (11, "Warehouse 2")]


def test_dense_index_with_hot_values_ties_and_nulls(spark, monkeypatch):
    from stockroom.plans import indexing

    monkeypatch.setattr(indexing, "ROWS_PER_RANGE", 100)
    monkeypatch.setattr(indexing, "SMALL", 0)
    monkeypatch.setattr(indexing, "CHUNK", 64)  # the equal rows are made in many chunks
    rows = [(i * 37 % 1009, f"c{i % 3}", i % 2) for i in range(3000)]
    rows += [(500, "hot", 1)] * 1500 + [(500, None, 1)] * 40 + [(None, "x", 1), (None, None, None), (2**62, "far", 0)]
    df = spark.createDataFrame(rows, "v bigint, k string, w int").repartition(6)
    indexed, n = with_dense_index(df, ["v", "k"], "idx")
    got = indexed.collect()
    assert n == len(rows) == len(got) and indexed.columns == ["v", "k", "w", "idx"]

    def nulls_first(row):
        return tuple((x is not None, x if x is not None else 0) for x in row)

    in_order = [tuple(r)[:3] for r in sorted(got, key=lambda r: r.idx)]
    assert [r.idx for r in sorted(got, key=lambda r: r.idx)] == list(range(n))
    assert in_order == sorted(rows, key=nulls_first)


@pytest.mark.parametrize("small", [0, 4096])
def test_dense_index_of_one_row_and_of_none(spark, monkeypatch, small):
    from stockroom.plans import indexing

    monkeypatch.setattr(indexing, "SMALL", small)
    one, n = with_dense_index(spark.createDataFrame([(5, "a")], "k bigint, v string"), "k", "idx")
    assert n == 1 and [tuple(r) for r in one.collect()] == [(5, "a", 0)]
    none, n = with_dense_index(spark.createDataFrame([], "k bigint"), "k", "idx")
    assert n == 0 and none.count() == 0 and none.columns == ["k", "idx"]


def test_binary_search_counts_values_not_above(spark):
    from stockroom.plans.indexing import binary_search

    values = [3, 3, 7, 20, 21]
    df = spark.createDataFrame([(x,) for x in range(-1, 25)], "x bigint")
    found = df.select("x", binary_search(F.array(*[F.lit(v) for v in values]), len(values), F.col("x")).alias("n"))
    assert all(r.n == sum(v <= r.x for v in values) for r in found.collect())
