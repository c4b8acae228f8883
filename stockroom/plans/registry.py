"""Registered queries: one per job, each ``(spark, sf_dir) -> DataFrame``, with oracle SQL.

Inputs are the fixture tables of :mod:`stockroom.sources.fixtures`: every row of the source
table is mapped to a row (audit Q4 alone has a parent table from which rows are missing, and
R1 and R2 hand their date bound to the scan).  Every computed column is aliased to the name
its oracle uses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom import schemas
from stockroom.operators import contacts, quality, replenish, reports, synth
from stockroom.plans import oracle, oracle_synth
from stockroom.plans.session import ensure_checkpoint_dir
from stockroom.sources import catalog, tables
from stockroom.sources import fixtures as fx

AS_OF = fx.AS_OF
NOW = "1998-06-01 12:00:00"

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------------------
# Reports R1-R8
# ---------------------------------------------------------------------------
HORIZON_DAYS = 30
SPARE_WAREHOUSE = fx.SPARE_WAREHOUSE


def _expiring(spark: SparkSession, sf: str, ordered: bool) -> DataFrame:
    return reports.expiring_inventory(
        fx.inventory(spark, sf, shipped=fx.shipped_between(AS_OF, HORIZON_DAYS)),
        fx.products(spark, sf),
        fx.storage_zones(spark, sf),
        fx.warehouses(spark, sf),
        AS_OF,
        HORIZON_DAYS,
        ordered=ordered,
    )


def r1_expiring_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _expiring(spark, sf, ordered=True)


def r2_expiring_within_7_days(spark: SparkSession, sf: str) -> DataFrame:
    return reports.expiring_within(_expiring(spark, sf, ordered=False), 7)


def r3_secondary_discrepancy_stock_takes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.secondary_discrepancy_stock_takes(fx.employees(spark, sf), fx.stock_takes(spark, sf))


def r4_secondary_discrepancy_listing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.secondary_discrepancy_listing(r3_secondary_discrepancy_stock_takes(spark, sf))


def r5_discrepancies_per_employee(spark: SparkSession, sf: str) -> DataFrame:
    return reports.secondary_discrepancies_per_employee(fx.employees(spark, sf), fx.stock_takes(spark, sf))


def r6_product_stock(spark: SparkSession, sf: str) -> DataFrame:
    return reports.product_stock(fx.inventory(spark, sf))


def r7_product_on_order(spark: SparkSession, sf: str) -> DataFrame:
    return reports.product_on_order(fx.purchase_orders(spark, sf))


def r8_products_to_reorder(spark: SparkSession, sf: str) -> DataFrame:
    return reports.products_to_reorder(fx.products(spark, sf), fx.inventory(spark, sf), fx.purchase_orders(spark, sf))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for stored tables, beside the checkpoints that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def r1_expiring_inventory_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """R1 on an inventory stored by expiry month: every batch is written, the months of the horizon are read."""
    root = _folder(spark, "monthly")
    tables.write_inventory_by_month(fx.inventory(spark, sf), root)
    return reports.expiring_inventory(
        tables.read_inventory_by_month(spark, root),
        fx.products(spark, sf),
        fx.storage_zones(spark, sf),
        fx.warehouses(spark, sf),
        AS_OF,
        HORIZON_DAYS,
    )


# ---------------------------------------------------------------------------
# The report statements as written for the original database, under its names
# ---------------------------------------------------------------------------
# The statements over the three views.
EXPIRING_VIEW, TAKES_VIEW, REORDER_VIEW = catalog.VIEW_SQL_NAMES.values()
REPORT_SQL = {
    "sql_expiring_within_7_days": f"""
SELECT ProductName, BatchNumber, Quantity, ExpirationDate, DaysUntilExpiration, WarehouseName, ZoneCode
FROM {EXPIRING_VIEW} WHERE DaysUntilExpiration <= 7""",
    "sql_secondary_discrepancy_listing": f"""
SELECT EmployeeID, Username, FirstName, LastName, StockTakeID, StockTakeDate, ZoneID
FROM {TAKES_VIEW} ORDER BY StockTakeDate DESC, LastName""",
    "sql_discrepancies_per_employee": f"""
SELECT Username, FirstName, LastName, COUNT(StockTakeID) AS NumberOfSecondaryDiscrepancyStockTakes
FROM {TAKES_VIEW} GROUP BY Username, FirstName, LastName ORDER BY NumberOfSecondaryDiscrepancyStockTakes DESC""",
    "sql_products_to_reorder": f"SELECT * FROM {REORDER_VIEW}",
}


def _report_sql(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        catalog.register_sql_names(fx.load_all(spark, sf), AS_OF)
        return spark.sql(REPORT_SQL[name])

    query.__doc__ = f"The original report statement: {' '.join(REPORT_SQL[name].split())}."
    return query


# ---------------------------------------------------------------------------
# D1, D2
# ---------------------------------------------------------------------------
def d1_replenishment_proposals(spark: SparkSession, sf: str) -> DataFrame:
    # one pass over the orders serves both the on-order quantity and the supplier choice
    return replenish.replenishment_from_tables(
        fx.products(spark, sf), fx.inventory(spark, sf), fx.purchase_orders(spark, sf), AS_OF
    )


def d2_supplier_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.supplier_contacts(fx.suppliers(spark, sf))


def d2_contacts_from_variant(spark: SparkSession, sf: str) -> DataFrame:
    """D2 with the documents stored as VARIANT in Parquet and read back."""
    path = _folder(spark, "contact-variants")
    contacts.contact_variants(fx.suppliers(spark, sf)).write.parquet(path)
    return contacts.variant_contacts(spark.read.parquet(path))


# ---------------------------------------------------------------------------
# Integrity audits Q1-Q10 (dirty fixtures where clean data would find nothing)
# ---------------------------------------------------------------------------
def q1_duplicate_inventory_ids(spark: SparkSession, sf: str) -> DataFrame:
    return quality.audit_primary_key(fx.inventory(spark, sf), "inventory_id")


def q2_duplicate_usernames(spark: SparkSession, sf: str) -> DataFrame:
    return quality.audit_unique(fx.dirty_employees(spark, sf), "username")


def q3_null_product_columns(spark: SparkSession, sf: str) -> DataFrame:
    products = fx.dirty_products(spark, sf)
    required = [c for c in schemas.not_null_columns("products") if c not in schemas.defaults("products")]
    return quality.audit_not_null(products, required, "product_id")


def q4_foreign_key_orphans(spark: SparkSession, sf: str) -> DataFrame:
    parents = quality.ParentKeys(fx.partial_products(spark, sf), "product_id")  # measured once for both children
    parts = []
    for child_table, child, child_key in (
        ("inventory", fx.inventory(spark, sf), "inventory_id"),
        ("purchase_orders", fx.purchase_orders(spark, sf), "purchase_order_id"),
    ):
        orphans = quality.audit_foreign_key(child, parents, "product_id", "product_id")
        parts.append(
            orphans.select(
                F.lit(child_table).alias("child_table"),
                F.lit("product_id").alias("fk_column"),
                F.col(child_key).cast("bigint").alias("child_id"),
                F.col("product_id").cast("bigint").alias("fk_value"),
            )
        )
    return parts[0].unionByName(parts[1])


def q5_check_violations(spark: SparkSession, sf: str) -> DataFrame:
    checks = {name: pred for name, _table, pred, _cols in schemas.CHECKS}
    inv_pred, po_pred = checks["ck_inventory_quantity"], checks["ck_quantity_ordered"]
    inv = quality.audit_check(fx.dirty_inventory(spark, sf), inv_pred).select(
        F.lit("ck_inventory_quantity").alias("constraint_name"), F.col("inventory_id").cast("bigint").alias("row_id")
    )
    po = quality.audit_check(fx.dirty_purchase_orders(spark, sf), po_pred).select(
        F.lit("ck_quantity_ordered").alias("constraint_name"), F.col("purchase_order_id").cast("bigint").alias("row_id")
    )
    return inv.unionByName(po)


def q6_unknown_order_status(spark: SparkSession, sf: str) -> DataFrame:
    return quality.audit_enum(fx.dirty_purchase_orders(spark, sf), "status", schemas.ORDER_STATUS).select(
        "purchase_order_id", "status"
    )


def q7_product_name_too_long(spark: SparkSession, sf: str) -> DataFrame:
    limit = schemas.column("products", "name").max_length
    return quality.audit_varchar(fx.dirty_products(spark, sf), "name", limit).select(
        "product_id", F.length("name").alias("name_length")
    )


def q8_markup_overflow(spark: SparkSession, sf: str) -> DataFrame:
    p, s = schemas.column("products", "markup_percentage").numeric
    return quality.audit_numeric(fx.dirty_products(spark, sf), "markup_percentage", p, s).select(
        "product_id", "markup_percentage"
    )


def q9_stock_take_defaults(spark: SparkSession, sf: str) -> DataFrame:
    bare = fx.stock_takes(spark, sf).select("stock_take_id", "status", "zone_id", "performed_by_employee_id")
    return quality.apply_defaults(bare, "stock_takes", as_of=AS_OF)


def _defaults(table: str, frame: Query) -> Query:
    """Q9 on one table: its rows without their defaulted columns, filled in again."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        bare = frame(spark, sf).drop(*schemas.defaults(table))
        return quality.apply_defaults(bare, table, as_of=AS_OF, now=NOW)

    query.__doc__ = f"Q9: the declared defaults of {table}."
    return query


def _delete(ids: list[int]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return quality.cascade_delete_warehouses(
            fx.warehouses(spark, sf),
            fx.storage_zones_with_spare(spark, sf),
            fx.inventory(spark, sf),
            fx.inventory_transactions(spark, sf),
            fx.stock_takes(spark, sf),
            ids,
        )

    query.__doc__ = f"Q10: the outcome of deleting warehouses {ids}."
    return query


# ---------------------------------------------------------------------------
# Every declared rule of a table in one audit, with all its parents
# ---------------------------------------------------------------------------
AUDITED: dict[str, Query] = {
    "inventory": fx.dirty_inventory,
    "purchase_orders": fx.dirty_purchase_orders,
    "stock_takes": fx.dirty_stock_takes,
    "inventory_transactions": fx.dirty_transactions,
    "employees": fx.dirty_employees,
    "products": fx.dirty_products,
    "suppliers": fx.dirty_suppliers,
    "warehouses": fx.dirty_warehouses,
    "storage_zones": fx.dirty_storage_zones,
    "user_roles": fx.dirty_user_roles,
}


def _audit(table: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        wanted = {fk.parent for fk in schemas.FOREIGN_KEYS if fk.child == table}
        tables = {**fx.CLEAN_TABLES, "products": fx.partial_products, "user_roles": lambda s, _: fx.user_roles(s)}
        return quality.audit_table(AUDITED[table](spark, sf), table, {t: tables[t](spark, sf) for t in sorted(wanted)})

    query.__doc__ = f"All declared rules of {table} at once."
    return query


# ---------------------------------------------------------------------------
# Generators G1-G10: sizes follow the source tables, parents are the fixtures
# ---------------------------------------------------------------------------
SEED = synth.DEFAULT_SEED


def _rows(spark: SparkSession, sf: str, table: str) -> int:
    return fx.read(spark, sf, table).count()


def g1_seed_user_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Seed roles on top of an existing role table: one role per customer market segment."""
    existing = (
        fx.read(spark, sf, "customer")
        .groupBy(F.col("c_mktsegment").alias("role_name"))
        .agg(F.min("c_custkey").cast("bigint").alias("role_id"))
        .select("role_id", "role_name", F.lit(None).cast("string").alias("description"))
    )
    return synth.seed_user_roles(spark, existing)


def g2_generate_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """As many generated suppliers as there are, appended to the supplier table."""
    existing = fx.suppliers(spark, sf)
    return synth.append_generated(existing, "suppliers", lambda n: synth.generate_suppliers(spark, n, SEED))


def g3_generate_products(spark: SparkSession, sf: str) -> DataFrame:
    """As many generated products as there are, appended to the product table."""
    existing = fx.products(spark, sf)
    return synth.append_generated(existing, "products", lambda n: synth.generate_products(spark, n, SEED))


def g4_generate_warehouses(spark: SparkSession, sf: str) -> DataFrame:
    """As many generated warehouses as there are, appended to the warehouse table."""
    existing = fx.warehouses(spark, sf)
    return synth.append_generated(existing, "warehouses", lambda n: synth.generate_warehouses(spark, n, SEED))


def g5_generate_storage_zones(spark: SparkSession, sf: str) -> DataFrame:
    """20 zones per warehouse of the warehouse table."""
    return synth.generate_storage_zones(fx.warehouses(spark, sf), 20, SEED)


def g6_generate_employees(spark: SparkSession, sf: str) -> DataFrame:
    """Employees with roles drawn from the role table that G1 leaves behind."""
    return synth.generate_employees(g1_seed_user_roles(spark, sf), _rows(spark, sf, "customer"), SEED, AS_OF)


def g7_generate_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return synth.generate_inventory(
        fx.products(spark, sf), fx.storage_zones(spark, sf), _rows(spark, sf, "lineitem"), AS_OF, SEED
    )


def g8_generate_purchase_orders(spark: SparkSession, sf: str) -> DataFrame:
    return synth.generate_purchase_orders(
        fx.products(spark, sf), fx.suppliers(spark, sf), _rows(spark, sf, "orders"), AS_OF, SEED
    )


def g9_generate_inventory_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return synth.generate_inventory_transactions(
        fx.inventory(spark, sf),
        fx.employees(spark, sf),
        fx.storage_zones(spark, sf),
        _rows(spark, sf, "events"),
        NOW,
        SEED,
    )


def g10_generate_stock_takes(spark: SparkSession, sf: str) -> DataFrame:
    return synth.generate_stock_takes(
        fx.employees(spark, sf), fx.storage_zones(spark, sf), _rows(spark, sf, "orders"), AS_OF, SEED
    )


# ---------------------------------------------------------------------------
# G5-G10 as INSERTs into filled tables
# ---------------------------------------------------------------------------
def a5_append_storage_zones(spark: SparkSession, sf: str) -> DataFrame:
    """20 more zones per warehouse, after the zones there are."""
    houses = fx.warehouses(spark, sf)
    return synth.append_generated(
        fx.storage_zones(spark, sf), "storage_zones", lambda n: synth.generate_storage_zones(houses, 20, SEED)
    )


def a6_append_employees(spark: SparkSession, sf: str) -> DataFrame:
    """As many generated employees as there are, after the employees there are."""
    roles = g1_seed_user_roles(spark, sf)
    return synth.append_generated(
        fx.employees(spark, sf), "employees", lambda n: synth.generate_employees(roles, n, SEED, AS_OF)
    )


def a7_append_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """As many generated batches as there are, after the largest key of the inventory."""
    parents = fx.products(spark, sf), fx.storage_zones(spark, sf)
    return synth.append_generated(
        fx.inventory(spark, sf), "inventory", lambda n: synth.generate_inventory(*parents, n, AS_OF, SEED)
    )


def a8_append_purchase_orders(spark: SparkSession, sf: str) -> DataFrame:
    """As many generated orders as there are, after the largest key of the orders."""
    parents = fx.products(spark, sf), fx.suppliers(spark, sf)
    return synth.append_generated(
        fx.purchase_orders(spark, sf), "purchase_orders", lambda n: synth.generate_purchase_orders(*parents, n, AS_OF, SEED)
    )


def a9_append_inventory_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """As many generated transactions as there are, after the transactions there are."""
    parents = fx.inventory(spark, sf), fx.employees(spark, sf), fx.storage_zones(spark, sf)
    return synth.append_generated(
        fx.inventory_transactions(spark, sf),
        "inventory_transactions",
        lambda n: synth.generate_inventory_transactions(*parents, n, NOW, SEED),
    )


def a10_append_stock_takes(spark: SparkSession, sf: str) -> DataFrame:
    """As many generated stocktakes as there are, after the largest key of the stocktakes."""
    parents = fx.employees(spark, sf), fx.storage_zones(spark, sf)
    return synth.append_generated(
        fx.stock_takes(spark, sf), "stock_takes", lambda n: synth.generate_stock_takes(*parents, n, AS_OF, SEED)
    )


QUERIES: dict[str, Query] = {
    "r1_expiring_inventory": r1_expiring_inventory,
    "r2_expiring_within_7_days": r2_expiring_within_7_days,
    "r3_secondary_discrepancy_stock_takes": r3_secondary_discrepancy_stock_takes,
    "r4_secondary_discrepancy_listing": r4_secondary_discrepancy_listing,
    "r5_discrepancies_per_employee": r5_discrepancies_per_employee,
    "r6_product_stock": r6_product_stock,
    "r7_product_on_order": r7_product_on_order,
    "r8_products_to_reorder": r8_products_to_reorder,
    "r1_expiring_inventory_by_month": r1_expiring_inventory_by_month,
    **{name: _report_sql(name) for name in REPORT_SQL},
    "d1_replenishment_proposals": d1_replenishment_proposals,
    "d2_supplier_contacts": d2_supplier_contacts,
    "d2_contacts_from_variant": d2_contacts_from_variant,
    "q1_duplicate_inventory_ids": q1_duplicate_inventory_ids,
    "q2_duplicate_usernames": q2_duplicate_usernames,
    "q3_null_product_columns": q3_null_product_columns,
    "q4_foreign_key_orphans": q4_foreign_key_orphans,
    "q5_check_violations": q5_check_violations,
    "q6_unknown_order_status": q6_unknown_order_status,
    "q7_product_name_too_long": q7_product_name_too_long,
    "q8_markup_overflow": q8_markup_overflow,
    "q9_stock_take_defaults": q9_stock_take_defaults,
    "q9_product_defaults": _defaults("products", fx.products),
    "q9_purchase_order_defaults": _defaults("purchase_orders", fx.purchase_orders),
    "q9_inventory_defaults": _defaults("inventory", fx.inventory),
    "q9_employee_defaults": _defaults("employees", fx.employees),
    "q9_transaction_defaults": _defaults("inventory_transactions", fx.inventory_transactions),
    "q10_delete_warehouse_1": _delete([1]),
    "q10_delete_warehouses_1_and_2": _delete([1, 2]),
    "q10_delete_spare_warehouse": _delete([SPARE_WAREHOUSE]),
    **{f"audit_{table}": _audit(table) for table in AUDITED},
    "g1_seed_user_roles": g1_seed_user_roles,
    "g2_generate_suppliers": g2_generate_suppliers,
    "g3_generate_products": g3_generate_products,
    "g4_generate_warehouses": g4_generate_warehouses,
    "g5_generate_storage_zones": g5_generate_storage_zones,
    "g6_generate_employees": g6_generate_employees,
    "g7_generate_inventory": g7_generate_inventory,
    "g8_generate_purchase_orders": g8_generate_purchase_orders,
    "g9_generate_inventory_transactions": g9_generate_inventory_transactions,
    "g10_generate_stock_takes": g10_generate_stock_takes,
    "a5_append_storage_zones": a5_append_storage_zones,
    "a6_append_employees": a6_append_employees,
    "a7_append_inventory": a7_append_inventory,
    "a8_append_purchase_orders": a8_append_purchase_orders,
    "a9_append_inventory_transactions": a9_append_inventory_transactions,
    "a10_append_stock_takes": a10_append_stock_takes,
}

ORACLE_SQL: dict[str, str] = {
    "r1_expiring_inventory": oracle.R1,
    "r2_expiring_within_7_days": oracle.R2,
    "r3_secondary_discrepancy_stock_takes": oracle.R3,
    "r4_secondary_discrepancy_listing": oracle.R4,
    "r5_discrepancies_per_employee": oracle.R5,
    "r6_product_stock": oracle.R6,
    "r7_product_on_order": oracle.R7,
    "r8_products_to_reorder": oracle.R8,
    "r1_expiring_inventory_by_month": oracle.R1,
    **oracle.REPORT_SQL,
    "d1_replenishment_proposals": oracle.D1,
    "d2_supplier_contacts": oracle.D2,
    "d2_contacts_from_variant": oracle.D2,
    "q1_duplicate_inventory_ids": oracle.Q1,
    "q2_duplicate_usernames": oracle.Q2,
    "q3_null_product_columns": oracle.Q3,
    "q4_foreign_key_orphans": oracle.Q4,
    "q5_check_violations": oracle.Q5,
    "q6_unknown_order_status": oracle.Q6,
    "q7_product_name_too_long": oracle.Q7,
    "q8_markup_overflow": oracle.Q8,
    "q9_stock_take_defaults": oracle.Q9,
    "q9_product_defaults": oracle.Q9_PRODUCTS,
    "q9_purchase_order_defaults": oracle.Q9_PURCHASE_ORDERS,
    "q9_inventory_defaults": oracle.Q9_INVENTORY,
    "q9_employee_defaults": oracle.Q9_EMPLOYEES,
    "q9_transaction_defaults": oracle.Q9_TRANSACTIONS,
    "q10_delete_warehouse_1": oracle.delete_warehouses(1),
    "q10_delete_warehouses_1_and_2": oracle.delete_warehouses(1, 2),
    "q10_delete_spare_warehouse": oracle.delete_warehouses(SPARE_WAREHOUSE),
    **{f"audit_{table}": oracle.AUDITS[table] for table in AUDITED},
    "g1_seed_user_roles": oracle_synth.G1,
    "g2_generate_suppliers": oracle_synth.G2,
    "g3_generate_products": oracle_synth.G3,
    "g4_generate_warehouses": oracle_synth.G4,
    "g5_generate_storage_zones": oracle_synth.G5,
    "g6_generate_employees": oracle_synth.G6,
    "g7_generate_inventory": oracle_synth.G7,
    "g8_generate_purchase_orders": oracle_synth.G8,
    "g9_generate_inventory_transactions": oracle_synth.G9,
    "g10_generate_stock_takes": oracle_synth.G10,
    "a5_append_storage_zones": oracle_synth.A5,
    "a6_append_employees": oracle_synth.A6,
    "a7_append_inventory": oracle_synth.A7,
    "a8_append_purchase_orders": oracle_synth.A8,
    "a9_append_inventory_transactions": oracle_synth.A9,
    "a10_append_stock_takes": oracle_synth.A10,
}
