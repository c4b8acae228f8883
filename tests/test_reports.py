
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockroom.operators import contacts, replenish, reports

D = dt.date
AS_OF = "2024-03-01"


def _dims(spark):
    products = spark.createDataFrame(
        [(1, "bolt", 10, 100, True), (2, "nut", 5, 50, True), (3, "gear", 0, 10, False), (4, "cog", 20, 30, True)],
        "product_id int, name string, reorder_level int, max_stock_level int, is_active boolean",
    )
    zones = spark.createDataFrame([(1, 1, "Z1"), (2, 2, "Z2")], "zone_id int, warehouse_id int, code string")
    warehouses = spark.createDataFrame([(1, "North"), (2, "South")], "warehouse_id int, name string")
    return products, zones, warehouses


def _inventory(spark, rows):
    return spark.createDataFrame(
        rows, "inventory_id bigint, product_id int, zone_id int, quantity int, batch_number string, expiration_date date"
    )


def test_expiry_window_bounds(spark):
    products, zones, warehouses = _dims(spark)
    inv = _inventory(
        spark,
        [
            (1, 1, 1, 5, "b1", D(2024, 3, 1)),  # as_of itself: 0 days, included
            (2, 1, 2, 5, "b2", D(2024, 3, 31)),  # +30: included
            (3, 2, 1, 5, "b3", D(2024, 4, 1)),  # +31: excluded
            (4, 2, 1, 5, "b4", D(2024, 2, 29)),  # already expired: excluded
            (5, 2, 2, 5, "b5", None),  # no expiry: excluded
            (6, 2, 2, 7, "b6", D(2024, 3, 8)),  # +7
        ],
    )
    r1 = reports.expiring_inventory(inv, products, zones, warehouses, AS_OF)
    rows = r1.collect()
    assert [r.inventory_id for r in rows] == [1, 6, 2]  # ordered by days, then id
    assert [r.days_until_expiration for r in rows] == [0, 7, 30]
    assert rows[2].warehouse_name == "South" and rows[2].zone_code == "Z2"
    assert dict(r1.dtypes)["days_until_expiration"] == "int"

    r2 = reports.expiring_within(r1, 7).collect()
    assert sorted(r.batch_number for r in r2) == ["b1", "b6"]
    assert len(r2[0]) == 7


def test_expiry_horizon_parameter(spark):
    products, zones, warehouses = _dims(spark)
    inv = _inventory(spark, [(1, 1, 1, 5, "b1", D(2024, 3, 11)), (2, 1, 1, 5, "b2", D(2024, 3, 12))])
    out = reports.expiring_inventory(inv, products, zones, warehouses, AS_OF, horizon_days=10).collect()
    assert [r.inventory_id for r in out] == [1]


def _stock_takes(spark, rows):
    return spark.createDataFrame(
        rows,
        "stock_take_id int, stock_take_date date, status string, zone_id int, has_discrepancies boolean, "
        "is_initial_stock_take boolean, performed_by_employee_id int",
    )


def _employees(spark):
    return spark.createDataFrame(
        [(1, "emp_1", "Ann", "Zed"), (2, "emp_2", "Bob", None), (3, "emp_3", "Cid", "Abe")],
        "employee_id int, username string, first_name string, last_name string",
    )


DONE = "Завершена"


def test_secondary_discrepancy_filters_and_null_employee(spark):
    st = _stock_takes(
        spark,
        [
            (10, D(2024, 1, 5), DONE, 1, True, False, 1),  # kept
            (11, D(2024, 1, 5), DONE, 1, True, True, 1),  # initial: dropped
            (12, D(2024, 1, 5), DONE, 1, False, False, 1),  # no discrepancy: dropped
            (13, D(2024, 1, 5), "В процессе", 1, True, False, 1),  # not completed: dropped
            (14, D(2024, 1, 5), DONE, None, True, False, None),  # no employee: dropped by inner join
            (15, D(2024, 1, 6), DONE, 2, True, False, 2),
            (16, D(2024, 1, 5), DONE, 2, True, False, 3),
            (17, D(2024, 1, 5), DONE, 2, True, False, 1),
        ],
    )
    r3 = reports.secondary_discrepancy_stock_takes(_employees(spark), st)
    assert sorted(r.stock_take_id for r in r3.collect()) == [10, 15, 16, 17]

    listing = reports.secondary_discrepancy_listing(r3).collect()
    # newest first; same day by last name ascending with NULL last names last
    assert [r.stock_take_id for r in listing] == [15, 16, 10, 17]
    assert "has_discrepancies" not in reports.secondary_discrepancy_listing(r3).columns

    per = reports.secondary_discrepancies_per_employee(_employees(spark), st).collect()
    assert [(r.username, r.number_of_secondary_discrepancy_stock_takes) for r in per] == [
        ("emp_1", 2),
        ("emp_2", 1),
        ("emp_3", 1),
    ]


def test_null_last_name_sorts_last(spark):
    st = _stock_takes(spark, [(1, D(2024, 1, 1), DONE, 1, True, False, 2), (2, D(2024, 1, 1), DONE, 1, True, False, 3)])
    listing = reports.secondary_discrepancy_listing(reports.secondary_discrepancy_stock_takes(_employees(spark), st))
    assert [r.last_name for r in listing.collect()] == ["Abe", None]


def _orders(spark, rows):
    return spark.createDataFrame(
        rows, "purchase_order_id int, product_id int, supplier_id int, order_date date, status string, quantity_ordered int"
    )


def test_reorder_flag_rules(spark):
    products, _, _ = _dims(spark)
    inv = _inventory(
        spark,
        [
            (1, 1, 1, 6, "a", None),
            (2, 1, 1, 4, "b", D(2000, 1, 1)),  # expired batches still count: stock 10 == level 10
            (3, 2, 1, 100, "c", None),  # product 2 well stocked
            (4, 4, 1, 1, "d", None),  # product 4 low but has an open order
        ],
    )
    orders = _orders(
        spark,
        [
            (1, 4, 7, D(2024, 1, 1), "Отправлен", 3),
            (2, 1, 8, D(2024, 1, 1), "Получен", 50),  # received: not on order
            (3, 1, 9, D(2024, 1, 2), "Отменен", 50),  # cancelled: not on order
        ],
    )
    rows = {r.product_id: r for r in reports.products_to_reorder(products, inv, orders).collect()}
    assert set(rows) == {1, 2, 4}  # inactive product 3 is not reported
    assert rows[1].current_stock == 10 and rows[1].needs_reorder is True  # <= is inclusive
    assert rows[2].needs_reorder is False
    assert rows[4].quantity_on_order == 3 and rows[4].needs_reorder is False


def test_reorder_product_without_batches_or_orders(spark):
    products = spark.createDataFrame(
        [(9, "x", 0, 5, True)], "product_id int, name string, reorder_level int, max_stock_level int, is_active boolean"
    )
    inv = _inventory(spark, [])
    orders = _orders(spark, [])
    (row,) = reports.products_to_reorder(products, inv, orders).collect()
    assert (row.current_stock, row.quantity_on_order, row.needs_reorder) == (0, 0, True)


def test_replenishment_supplier_choice(spark):
    products, _, _ = _dims(spark)
    inv = _inventory(spark, [(1, 1, 1, 2, "a", None), (2, 2, 1, 1, "b", None), (3, 4, 1, 1, "c", None)])
    orders = _orders(
        spark,
        [
            (10, 1, 3, D(2024, 1, 1), "Получен", 5),
            (11, 1, 4, D(2024, 1, 1), "Получен", 5),  # same day, higher id: chosen
            (12, 1, 5, D(2024, 2, 1), "Отменен", 5),  # later but cancelled: ignored
            (13, 2, 6, D(2023, 1, 1), "Получен", 5),
        ],
    )
    r8 = reports.products_to_reorder(products, inv, orders)
    out = {r.product_id: r for r in replenish.replenishment_proposals(r8, orders, AS_OF).collect()}
    assert out[1].supplier_id == 4 and out[1].quantity_ordered == 98
    assert out[2].supplier_id == 6 and out[2].quantity_ordered == 49
    assert out[4].supplier_id is None  # never ordered: left for a manual choice
    assert all(r.status == "Новый" and r.order_date == D(2024, 3, 1) for r in out.values())


def test_replenishment_skips_non_positive_quantity(spark):
    products = spark.createDataFrame(
        [(1, "p", 10, 5, True)], "product_id int, name string, reorder_level int, max_stock_level int, is_active boolean"
    )
    inv = _inventory(spark, [(1, 1, 1, 7, "a", None)])
    orders = _orders(spark, [])
    r8 = reports.products_to_reorder(products, inv, orders)
    assert r8.collect()[0].needs_reorder is True
    assert replenish.replenishment_proposals(r8, orders, AS_OF).count() == 0


def test_supplier_contacts_tolerates_bad_json(spark):
    sup = spark.createDataFrame(
        [
            (1, '{"phone": "+1", "email": "a@b", "website": "w", "notes": "n"}'),
            (2, '{"phone": "+2"}'),
            (3, "not json"),
            (4, None),
        ],
        "supplier_id int, contact_info string",
    )
    rows = {r.supplier_id: r for r in contacts.supplier_contacts(sup).collect()}
    assert rows[1].website == "w" and rows[1].notes == "n"
    assert rows[2].phone == "+2" and rows[2].email is None
    assert rows[3].phone is None and rows[4].phone is None


def test_fused_replenishment_equals_composed(spark):
    products, _, _ = _dims(spark)
    inv = _inventory(spark, [(1, 1, 1, 2, "a", None), (2, 2, 1, 1, "b", None), (3, 4, 1, 1, "c", None)])
    orders = _orders(
        spark,
        [
            (10, 1, 3, D(2024, 1, 1), "Получен", 5),
            (11, 1, 4, D(2024, 1, 1), "Получен", 5),
            (12, 1, 5, D(2024, 2, 1), "Отменен", 5),
            (13, 2, 6, D(2023, 1, 1), "Получен", 5),
            (14, 4, 7, D(2023, 1, 1), "Новый", 1),  # open order: product 4 not proposed
        ],
    )
    composed = replenish.replenishment_proposals(reports.products_to_reorder(products, inv, orders), orders, AS_OF)
    fused = replenish.replenishment_from_tables(products, inv, orders, AS_OF)
    assert sorted(composed.collect()) == sorted(fused.collect())
    assert {r.product_id for r in fused.collect()} == {1, 2}


def test_latest_supplier_with_ids_above_32_bits(spark):
    """The later date wins whatever the size of the order id; ids break ties on one day."""
    orders = spark.createDataFrame(
        [
            (5_000_000_000_000, 1, 10, "2024-01-01", "Новый"),
            (7, 1, 20, "2024-06-01", "Новый"),
            (1 << 40, 2, 30, "2024-06-01", "Новый"),
            ((1 << 40) + 1, 2, 40, "2024-06-01", "Новый"),
            (1 << 62, 2, 50, "2024-06-02", "Отменен"),
        ],
        "purchase_order_id bigint, product_id bigint, supplier_id bigint, order_date string, status string",
    ).withColumn("order_date", F.col("order_date").cast("date"))
    found = {r.product_id: r.supplier_id for r in replenish.latest_supplier(orders).collect()}
    assert found == {1: 20, 2: 40}
