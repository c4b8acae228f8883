"""The three report views and their report queries.

Every report is a function from DataFrames to a DataFrame.  Report dates are a
parameter (``as_of``) so a report is reproducible; ``None`` means today.

Plan notes (checked with ``explain("formatted")``):

* R1/R2 bound the expiry date with literal dates (``expiration_date BETWEEN as_of
  AND as_of + h``), which Catalyst pushes into the Parquet scan; the equivalent
  ``datediff(...) <= h`` would stay a row filter.
* Zones and warehouses are joined to each other first and broadcast only behind a
  size check; products are joined by whatever strategy the planner (and AQE, with
  run-time sizes) chooses, since the product table grows with the data.
* Sorted reports add a unique tie-breaker, so the range partitioner of the global
  sort can split a day (or a count) that holds a large share of the rows.  NULLs
  sort as in the original database: last when ascending, first when descending.
* R5 and R8 aggregate the large tables before any join (partial aggregation on the
  map side), so a product or employee owning a third of all rows costs one row per
  map task in the shuffle, and no join fans out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.plans.joins import broadcast_if_small
from stockroom.schemas import COMPLETED_STOCKTAKE_STATUS, OPEN_ORDER_STATUSES
from stockroom.sources.tables import MONTH_COLUMN


def date_lit(as_of: str | dt.date | None) -> Column:
    """A date literal for ``as_of``; ``None`` is today's date (fixed per query)."""
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")


def _expiry_bounds(as_of, horizon_days: int) -> tuple[Column, Column]:
    start = date_lit(as_of)
    if as_of is None:
        return start, F.date_add(start, horizon_days)
    end = dt.date.fromisoformat(str(as_of)) + dt.timedelta(days=horizon_days)
    return start, F.lit(end.isoformat()).cast("date")


# ---------------------------------------------------------------------------
# Batches near expiry
# ---------------------------------------------------------------------------
def expiring_inventory(
    inventory: DataFrame,
    products: DataFrame,
    zones: DataFrame,
    warehouses: DataFrame,
    as_of=None,
    horizon_days: int = 30,
    ordered: bool = True,
) -> DataFrame:
    """Batches expiring within ``[as_of, as_of + horizon_days]``, both ends included.

    Columns: inventory_id, product_id, product_name, batch_number, quantity,
    expiration_date, warehouse_name, zone_code, days_until_expiration (INT).
    Ordered by days until expiration (then inventory_id) unless ``ordered=False``.

    An inventory stored by expiry month (``tables.write_inventory_by_month``) is pruned to the months
    of the horizon before any file is opened.
    """
    start, end = _expiry_bounds(as_of, horizon_days)
    if MONTH_COLUMN in inventory.columns:
        inventory = inventory.filter(F.col(MONTH_COLUMN).between(F.trunc(start, "month"), F.trunc(end, "month")))
    batches = inventory.select(
        "inventory_id", "product_id", "zone_id", "batch_number", "quantity", "expiration_date"
    ).filter(F.col("expiration_date").between(start, end))

    places = zones.select("zone_id", "warehouse_id", F.col("code").alias("zone_code")).join(
        warehouses.select("warehouse_id", F.col("name").alias("warehouse_name")), "warehouse_id"
    )
    names = products.select("product_id", F.col("name").alias("product_name"))

    out = (
        batches.join(broadcast_if_small(places), "zone_id")
        .join(names, "product_id")
        .select(
            "inventory_id",
            "product_id",
            "product_name",
            "batch_number",
            "quantity",
            "expiration_date",
            "warehouse_name",
            "zone_code",
            F.datediff(F.col("expiration_date"), start).alias("days_until_expiration"),
        )
    )
    return out.orderBy(*expiring_order()) if ordered else out


def expiring_order() -> list[Column]:
    """The order of R1, with the batch id to break ties."""
    return [F.asc_nulls_last("days_until_expiration"), F.asc_nulls_last("inventory_id")]


def expiring_within(r1: DataFrame, days: int = 7) -> DataFrame:
    """R2: the R1 rows with at most ``days`` left, as a 7-column projection (no order)."""
    return r1.filter(F.col("days_until_expiration") <= days).select(
        "product_name",
        "batch_number",
        "quantity",
        "expiration_date",
        "days_until_expiration",
        "warehouse_name",
        "zone_code",
    )


# ---------------------------------------------------------------------------
# Completed secondary stocktakes that found discrepancies
# ---------------------------------------------------------------------------
def _secondary_discrepancies(stock_takes: DataFrame) -> DataFrame:
    return stock_takes.filter(
        (F.col("status") == COMPLETED_STOCKTAKE_STATUS)
        & (F.col("has_discrepancies") == F.lit(True))
        & (F.col("is_initial_stock_take") == F.lit(False))
    )


def secondary_discrepancy_stock_takes(employees: DataFrame, stock_takes: DataFrame) -> DataFrame:
    """Completed, non-initial stocktakes with discrepancies, with their employee.

    Inner join: stocktakes without an employee are dropped.
    """
    st = _secondary_discrepancies(stock_takes).select(
        "stock_take_id",
        "stock_take_date",
        "zone_id",
        "has_discrepancies",
        F.col("performed_by_employee_id").alias("employee_id"),
    )
    emp = employees.select("employee_id", "username", "first_name", "last_name")
    return emp.join(st, "employee_id").select(
        "employee_id",
        "username",
        "first_name",
        "last_name",
        "stock_take_id",
        "stock_take_date",
        "zone_id",
        "has_discrepancies",
    )


def secondary_discrepancy_listing(r3: DataFrame) -> DataFrame:
    """R3 without the flag, newest first, then by last name with NULLs last."""
    return r3.select(
        "employee_id", "username", "first_name", "last_name", "stock_take_id", "stock_take_date", "zone_id"
    ).orderBy(*listing_order())


def listing_order() -> list[Column]:
    """The order of R4, with the stocktake id to break ties."""
    return [F.desc_nulls_first("stock_take_date"), F.asc_nulls_last("last_name"), F.asc_nulls_last("stock_take_id")]


def secondary_discrepancies_per_employee(employees: DataFrame, stock_takes: DataFrame) -> DataFrame:
    """Number of R3 stocktakes per (username, first_name, last_name), most first.

    Counts per employee id first (map-side combined), then joins the counts — one
    row per employee — to the names, so a very busy employee never becomes one
    oversized join or sort group.  Employees with none do not appear.
    """
    per_employee = (
        _secondary_discrepancies(stock_takes)
        .filter(F.col("performed_by_employee_id").isNotNull())
        .groupBy(F.col("performed_by_employee_id").alias("employee_id"))
        .agg(F.count("stock_take_id").alias("n"))
    )
    named = employees.select("employee_id", "username", "first_name", "last_name").join(per_employee, "employee_id")
    return (
        named.groupBy("username", "first_name", "last_name")
        .agg(F.sum("n").cast("bigint").alias("number_of_secondary_discrepancy_stock_takes"))
        .orderBy(F.desc_nulls_first("number_of_secondary_discrepancy_stock_takes"), F.asc_nulls_last("username"))
    )


# ---------------------------------------------------------------------------
# Products to reorder
# ---------------------------------------------------------------------------
def product_stock(inventory: DataFrame) -> DataFrame:
    """Total quantity per product over all batches (expired ones included)."""
    return inventory.groupBy("product_id").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("current_stock")
    )


def product_on_order(purchase_orders: DataFrame, open_statuses: tuple[str, ...] = OPEN_ORDER_STATUSES) -> DataFrame:
    """Quantity ordered and not yet received or cancelled, per product."""
    return (
        purchase_orders.filter(F.col("status").isin(*open_statuses))
        .groupBy("product_id")
        .agg(F.coalesce(F.sum("quantity_ordered"), F.lit(0)).cast("bigint").alias("quantity_on_order"))
    )


def products_to_reorder(products: DataFrame, inventory: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    """Every active product with stock, stock on order and a reorder flag.

    ``needs_reorder`` is TRUE when stock <= reorder level and nothing is on order;
    missing stock or orders count as 0.  Both sides are aggregated per product
    before the two left joins, so the joins are one-to-one and co-partitioned on
    ``product_id``.
    """
    active = products.filter(F.col("is_active").eqNullSafe(True)).select(
        "product_id", F.col("name").alias("product_name"), "reorder_level", "max_stock_level"
    )
    stock = F.coalesce(F.col("current_stock"), F.lit(0).cast("bigint"))
    on_order = F.coalesce(F.col("quantity_on_order"), F.lit(0).cast("bigint"))
    return (
        active.join(product_stock(inventory), "product_id", "left")
        .join(product_on_order(purchase_orders), "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "reorder_level",
            "max_stock_level",
            stock.alias("current_stock"),
            on_order.alias("quantity_on_order"),
            F.coalesce((stock <= F.col("reorder_level")) & (on_order == 0), F.lit(False)).alias("needs_reorder"),
        )
    )


# ---------------------------------------------------------------------------
# Optional registration of the three views under their original names
# ---------------------------------------------------------------------------
VIEW_NAMES = (
    "vw_expiring_inventory",
    "vw_employees_with_completed_secondary_discrepancy_stock_takes",
    "v_products_to_reorder",
)


def register_report_views(tables: dict[str, DataFrame], as_of=None) -> None:
    """Register R1, R3 and R8 as temporary views.

    The first two are created with ``createTempView``, which fails if the name is
    taken (as ``CREATE VIEW`` does); the reorder view replaces an existing one
    (``CREATE OR REPLACE VIEW``).
    """
    expiring_inventory(
        tables["inventory"], tables["products"], tables["storage_zones"], tables["warehouses"], as_of
    ).createTempView(VIEW_NAMES[0])
    secondary_discrepancy_stock_takes(tables["employees"], tables["stock_takes"]).createTempView(VIEW_NAMES[1])
    products_to_reorder(tables["products"], tables["inventory"], tables["purchase_orders"]).createOrReplaceTempView(
        VIEW_NAMES[2]
    )
