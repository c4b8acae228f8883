"""Replenishment proposals — orders the reorder report asks for.

Rule (ours; the original only asks for "automatic creation of replenishment
orders"): for every product flagged ``needs_reorder``, order up to the maximum
stock level, ``max_stock_level - current_stock``, when that is positive (orders must
have a positive quantity).  The supplier is the one of the product's latest order
that was not cancelled (latest by order date, then by order id); a product never
ordered gets a NULL supplier and is left for a manual choice.  Status is "new" and
the order date is ``as_of``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators.reports import date_lit, product_stock
from stockroom.schemas import CANCELLED_ORDER_STATUS, NEW_ORDER_STATUS, OPEN_ORDER_STATUSES


def _recency():
    """The order "date, then id" as one exact number: days * 10^20 + (id + 2^63), at most 33 digits.

    A wide decimal keeps ``max_by`` in a hash aggregation (its buffer is of fixed width), where a
    (date, id) struct would fall back to a sort, and it holds any 64-bit order id.
    """
    days = F.unix_date(F.col("order_date")).cast("decimal(10,0)")
    order = F.col("purchase_order_id").cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    return days * F.lit(Decimal(10**20)) + order


def latest_supplier(purchase_orders: DataFrame) -> DataFrame:
    """Supplier of each product's latest non-cancelled order: product_id, supplier_id.

    ``max_by`` over one recency number keeps the aggregation hash-based and combined on
    the map side, so a product with a third of all orders still sends one row per map
    task through the shuffle.  A window with ``row_number`` would sort each product's
    orders in one task instead.
    """
    return (
        purchase_orders.filter(F.col("status") != CANCELLED_ORDER_STATUS)
        .select("product_id", "supplier_id", _recency().alias("recency"))
        .groupBy("product_id")
        .agg(F.max_by("supplier_id", "recency").alias("supplier_id"))
    )


def replenishment_proposals(r8: DataFrame, purchase_orders: DataFrame, as_of=None) -> DataFrame:
    """product_id, supplier_id, order_date, status, quantity_ordered."""
    wanted = (
        r8.filter(F.col("needs_reorder"))
        .select("product_id", (F.col("max_stock_level") - F.col("current_stock")).alias("quantity"))
        .filter(F.col("quantity") > 0)
    )
    return wanted.join(latest_supplier(purchase_orders), "product_id", "left").select(
        "product_id",
        "supplier_id",
        date_lit(as_of).alias("order_date"),
        F.lit(NEW_ORDER_STATUS).alias("status"),
        F.col("quantity").cast("int").alias("quantity_ordered"),
    )


def order_summary(purchase_orders: DataFrame, open_statuses: tuple[str, ...] = OPEN_ORDER_STATUSES) -> DataFrame:
    """One pass over the orders: product_id, quantity_on_order (NULL if none open), supplier_id.

    The open quantity (R7) and the latest non-cancelled supplier are two aggregates
    of the same grouping, so they share one scan and one shuffle.  ``max_by``
    skips rows whose recency is NULL, which is how cancelled orders are left out.
    """
    is_open = F.col("status").isin(*open_statuses)
    live = F.col("status") != CANCELLED_ORDER_STATUS
    return purchase_orders.groupBy("product_id").agg(
        F.sum(F.when(is_open, F.col("quantity_ordered"))).cast("bigint").alias("quantity_on_order"),
        F.max_by(F.col("supplier_id"), F.when(live, _recency())).alias("supplier_id"),
    )


def replenishment_from_tables(
    products: DataFrame, inventory: DataFrame, purchase_orders: DataFrame, as_of=None
) -> DataFrame:
    """D1 straight from the tables, with R8's rule inlined: three shuffles instead of four.

    Same result as ``replenishment_proposals(products_to_reorder(...), purchase_orders)``:
    active products whose stock (all batches) is at most the reorder level and that
    have nothing on order get ``max_stock_level - current_stock`` from the latest
    non-cancelled supplier, when that quantity is positive.
    """
    stock = F.coalesce(F.col("current_stock"), F.lit(0).cast("bigint"))
    on_order = F.coalesce(F.col("quantity_on_order"), F.lit(0).cast("bigint"))
    active = products.filter(F.col("is_active").eqNullSafe(True)).select(
        "product_id", "reorder_level", "max_stock_level"
    )
    joined = active.join(product_stock(inventory), "product_id", "left").join(
        order_summary(purchase_orders), "product_id", "left"
    )
    wanted = joined.filter((stock <= F.col("reorder_level")) & (on_order == 0)).withColumn(
        "quantity", F.col("max_stock_level") - stock
    )
    return wanted.filter(F.col("quantity") > 0).select(
        "product_id",
        "supplier_id",
        date_lit(as_of).alias("order_date"),
        F.lit(NEW_ORDER_STATUS).alias("status"),
        F.col("quantity").cast("int").alias("quantity_ordered"),
    )
