"""Reproducible synthetic warehouse data.

The original fills each table with a row-at-a-time loop and picks every foreign
key by sorting the whole parent table per generated row.  Here each table is one
plan over ``spark.range(1, n + 1)``: every column is a built-in expression of the
row id and a seed (see :mod:`stockroom.functions.random`), and every foreign key is
drawn by one equi-join against a densely indexed parent (H3, :class:`Parent`).
Cost drops from O(n · m log m) to ranking the parent once, range by range, plus one
join, O(m log m + n), and the output is the same on any cluster size, after any
task retry, and in the SQL oracle.

Generation rules (ranges, probabilities, texts) are those of the original
procedures; only values, not the unseeded original draws, can be compared, so
the distributions match, not the rows.

An empty parent gives an empty result (no error) where the original guards on
it; a parent that is not guarded (zones for transactions and stocktakes) gives
NULL keys instead.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom import schemas
from stockroom.functions.random import (
    bernoulli,
    contact_json,
    hex_token,
    null_with_probability,
    pick_enum,
    random_text,
    rounded_decimal,
    uniform,
    uniform_int,
)
from stockroom.operators.reports import date_lit
from stockroom.plans.indexing import with_dense_index
from stockroom.plans.joins import broadcast_if_rows_fit

DEFAULT_SEED = 42
ROWS_PER_PARTITION = 2_000_000


def _id() -> Column:
    """The generated row number, 1..n."""
    return F.col("id")


def _ids(spark: SparkSession, n: int) -> DataFrame:
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / ROWS_PER_PARTITION))
    return spark.range(1, n + 1, numPartitions=parts)


def _empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schemas.struct_type(table))


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table`` in declared order, cast to declared types."""
    return df.select(*[F.col(c.name).cast(c.dtype).alias(c.name) for c in schemas.columns(table)])


# ---------------------------------------------------------------------------
# H3: uniform foreign-key draw
# ---------------------------------------------------------------------------
def _measure_keys(parents: list[tuple[DataFrame, str]]) -> list:
    """Per parent: n, low, high and distinct of its non-NULL integer keys, all in one aggregation."""
    keys = [df.select(F.lit(i).alias("parent"), F.col(key).cast("bigint").alias("key")) for i, (df, key) in enumerate(parents)]
    measured = (
        reduce(DataFrame.unionByName, keys)
        .filter(F.col("key").isNotNull())
        .groupBy("parent")
        .agg(
            F.count("key").alias("n"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
            F.count_distinct("key").alias("distinct"),
        )
    )
    found = {r["parent"]: r for r in measured.collect()}  # one row per parent
    none = {"n": 0, "low": None, "high": None, "distinct": 0}
    return [found.get(i, none) for i in range(len(parents))]


def plain_parents(*parents: tuple[DataFrame, str]) -> list[Parent]:
    """Several parents without carried columns, measured together."""
    return [Parent(df, key, seen=seen) for (df, key), seen in zip(parents, _measure_keys(list(parents)), strict=True)]


class Parent:
    """A parent table for uniform draws: row ``floor(u * n)`` in ``ORDER BY key, carry...``.

    One aggregation shows whether the keys are contiguous (as many distinct keys as rows and
    as values between the smallest and the largest).  Then the drawn key is ``min + floor(u * n)``
    and no index or join is needed.  Other keys, and draws that carry further columns, use
    the ranks of a rank directory (``plans/indexing.py``).
    """

    def __init__(self, df: DataFrame, key: str, carry: tuple[str, ...] = (), seen=None):
        self.key = key
        self.carry = carry
        cols = [key, *carry]
        keys = df.select(*cols).filter(F.col(key).isNotNull())
        self.low: int | None = None
        self.indexed: DataFrame | None = None
        if not carry:
            seen = seen or _measure_keys([(df, key)])[0]
            self.n = seen["n"]
            if self.n and seen["n"] == seen["distinct"] == seen["high"] - seen["low"] + 1:
                self.low = seen["low"]
        if self.low is None and (carry or self.n):
            self.indexed, self.n = with_dense_index(keys, cols, "_pick_idx")
        self._sides: dict[tuple, DataFrame] = {}

    @property
    def empty(self) -> bool:
        return self.n == 0

    def pick(self, draws: DataFrame, u: Column, out: str, carry_as: dict[str, str] | None = None) -> DataFrame:
        """Add column ``out``: the key of parent row ``floor(u * n)`` (NULL for an empty parent).

        ``carry_as`` maps carried parent columns to output names (a lookup by the
        drawn key, such as the product of a drawn batch).
        """
        carry_as = carry_as or {}
        if self.empty:
            extra = [F.lit(None).alias(a) for a in carry_as.values()]
            return draws.select("*", F.lit(None).alias(out), *extra)
        drawn = F.floor(u * F.lit(self.n)).cast("bigint")
        if self.low is not None:
            return draws.withColumn(out, drawn + F.lit(self.low))
        # a small parent is broadcast on a measured bound (decided once per output shape);
        # a large one is joined by shuffle (draws are uniform over the index: no hot key)
        keyed = draws.withColumn("_pick_idx", drawn)
        return keyed.join(self._side(out, carry_as), "_pick_idx", "left").drop("_pick_idx")

    def _side(self, out: str, carry_as: dict[str, str]) -> DataFrame:
        shape = (out, tuple(carry_as.items()))
        if shape not in self._sides:
            right = self.indexed.select(
                "_pick_idx", F.col(self.key).alias(out), *[F.col(c).alias(a) for c, a in carry_as.items()]
            )
            self._sides[shape] = broadcast_if_rows_fit(right, self.n)
        return self._sides[shape]


def pick_fk(draws: DataFrame, parent: DataFrame, key: str, u: Column, out: str | None = None) -> DataFrame:
    """H3: add ``out`` (default ``key``), a key drawn uniformly with replacement from ``parent``.

    NULL when the parent is empty.  Build a :class:`Parent` once instead when
    several draws use the same parent.
    """
    return Parent(parent, key).pick(draws, u, out or key)


# ---------------------------------------------------------------------------
# G1: roles (idempotent)
# ---------------------------------------------------------------------------
def seed_user_roles(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """G1: ``existing`` plus each of the three fixed roles whose name is absent.

    Added roles take ids after the largest existing id, in the fixed order.
    Running it twice adds nothing the second time.  Concurrent writers are not
    protected against each other.
    """
    if existing is None:
        existing = _empty(spark, "user_roles")
    seeds = spark.createDataFrame(
        [(i, name, desc) for i, (name, desc) in enumerate(schemas.ROLES)], "_ord int, role_name string, description string"
    )
    missing = seeds.join(existing.select("role_name"), "role_name", "left_anti")
    top = existing.agg(F.coalesce(F.max("role_id"), F.lit(0)).alias("m")).first()["m"]
    # at most three rows: the single-partition window is bounded by the seed list
    added = missing.select(
        (F.lit(top) + F.row_number().over(Window.orderBy("_ord"))).cast("bigint").alias("role_id"),
        "role_name",
        "description",
    )
    return _conform(existing, "user_roles").unionByName(_conform(added, "user_roles"))


# ---------------------------------------------------------------------------
# Tables without parents
# ---------------------------------------------------------------------------
# The texts and ranges of G2-G10 (``Supplier i``, ``ZONE-i-r``, 730 days and so on) are fixed values
# of the original load.
def append_generated(existing: DataFrame, table: str, generate, n: int | None = None) -> DataFrame:
    """``existing`` plus ``n`` generated rows (default: as many again), as an INSERT into a filled table.

    Serial keys go on after the largest existing one; ``generate(n)`` gives keys 1..n.
    Columns that ``existing`` lacks are NULL in its rows.
    """
    key = schemas.PRIMARY_KEYS[table]
    seen = existing.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(key), F.lit(0)).alias("top")).first()
    added = generate(seen["n"] if n is None else n).withColumn(key, F.col(key) + F.lit(seen["top"]))
    present = set(existing.columns)
    filled = existing.select(
        *[
            (F.col(c.name) if c.name in present else F.lit(None)).cast(c.dtype).alias(c.name)
            for c in schemas.columns(table)
        ]
    )
    return filled.unionByName(_conform(added, table))


def generate_suppliers(spark: SparkSession, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``Supplier i``, ``Address i, City c`` (c in 1..100) and contact JSON (H2)."""
    i = _id().cast("string")
    city = uniform_int(seed, "suppliers.city", _id(), 1, 100).cast("string")
    out = _ids(spark, n).select(
        _id().alias("supplier_id"),
        F.concat(F.lit("Supplier "), i).alias("name"),
        F.concat(F.lit("Address "), i, F.lit(", City "), city).alias("address"),
        contact_json(seed, "suppliers.contact", _id()).alias("contact_info"),
    )
    return _conform(out, "suppliers")


def generate_products(spark: SparkSession, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``Product i`` with random text, category, unit, markup, reorder and max levels."""
    out = _ids(spark, n).select(
        _id().alias("product_id"),
        F.concat(F.lit("Product "), _id().cast("string")).alias("name"),
        random_text(seed, "products.description", _id(), 20, 100).alias("description"),
        pick_enum(seed, "products.category", _id(), schemas.PRODUCT_CATEGORY).alias("category"),
        pick_enum(seed, "products.unit", _id(), schemas.UNIT_OF_MEASURE).alias("unit_of_measure"),
        rounded_decimal(uniform(seed, "products.markup", _id()), 50, 5, 5).alias("markup_percentage"),
        uniform_int(seed, "products.reorder", _id(), 5, 20).alias("reorder_level"),
        uniform_int(seed, "products.max_stock", _id(), 50, 100).alias("max_stock_level"),
        F.lit(True).alias("is_active"),
    )
    return _conform(out, "products")


def generate_warehouses(spark: SparkSession, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``Warehouse i`` at ``Warehouse Address i, City c`` (c in 1..100)."""
    i = _id().cast("string")
    city = uniform_int(seed, "warehouses.city", _id(), 1, 100).cast("string")
    out = _ids(spark, n).select(
        _id().alias("warehouse_id"),
        F.concat(F.lit("Warehouse "), i).alias("name"),
        F.concat(F.lit("Warehouse Address "), i, F.lit(", City "), city).alias("location"),
    )
    return _conform(out, "warehouses")


# ---------------------------------------------------------------------------
# Tables with parents
# ---------------------------------------------------------------------------
def generate_storage_zones(warehouses: DataFrame, zones_per_warehouse: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """count(warehouses) * zones_per_warehouse zones, each in a uniformly drawn warehouse.

    So "per warehouse" is only an average.  Code ``ZONE-i-r`` with r in 0..999;
    capacity ``round(u * 500 + 100, 2)``.
    """
    spark = warehouses.sparkSession
    parent = Parent(warehouses, "warehouse_id")
    if parent.empty:
        return _empty(spark, "storage_zones")
    draws = _ids(spark, parent.n * zones_per_warehouse)
    out = parent.pick(draws, uniform(seed, "zones.warehouse", _id()), "warehouse_id").select(
        _id().alias("zone_id"),
        "warehouse_id",
        F.concat(
            F.lit("ZONE-"), _id().cast("string"), F.lit("-"), uniform_int(seed, "zones.code", _id(), 0, 1000).cast("string")
        ).alias("code"),
        rounded_decimal(uniform(seed, "zones.capacity", _id()), 500, 100, 18).alias("storage_capacity"),
    )
    return _conform(out, "storage_zones")


def _position(role_name: Column) -> Column:
    (first_role, first_position), *rest = schemas.POSITION_BY_ROLE
    out = F.when(role_name == first_role, F.lit(first_position))
    for name, position in rest:
        out = out.when(role_name == name, F.lit(position))
    return out.otherwise(F.lit(schemas.DEFAULT_POSITION))


def generate_employees(roles: DataFrame, n: int, seed: int = DEFAULT_SEED, as_of=None) -> DataFrame:
    """``emp_i`` with an md5 password hash, names, a drawn role and the position of that role.

    Phone is ``+`` and 12 digits, e-mail ``emp<i>@company.com``, hire date ``as_of``
    (the column default).
    """
    spark = roles.sparkSession
    parent = Parent(roles, "role_id", ("role_name",))
    if parent.empty:
        return _empty(spark, "employees")
    i = _id().cast("string")
    phone_digits = F.floor(uniform(seed, "employees.phone", _id()) * 1e10).cast("bigint").cast("string")
    drawn = parent.pick(_ids(spark, n), uniform(seed, "employees.role", _id()), "role_id", {"role_name": "_role_name"})
    out = drawn.select(
        _id().alias("employee_id"),
        F.concat(F.lit("emp_"), i).alias("username"),
        F.md5(F.concat(F.lit("password"), i)).alias("password_hash"),
        F.concat(F.lit("FirstName"), i).alias("first_name"),
        F.concat(F.lit("LastName"), i).alias("last_name"),
        "role_id",
        date_lit(as_of).alias("hire_date"),
        F.concat(F.lit("+"), F.lpad(phone_digits, 12, "0")).alias("phone"),
        F.concat(F.lit("emp"), i, F.lit("@company.com")).alias("email"),
        _position(F.col("_role_name")).alias("position"),
    )
    return _conform(out, "employees")


def generate_inventory(
    products: DataFrame, zones: DataFrame, n: int, as_of=None, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Batches of a drawn product in a drawn zone.

    Quantity 0..499; batch ``BATCH-`` + 10 hex digits + ``-yyyyMMdd`` of ``as_of``;
    expiry ``as_of + 0..729`` days with probability 0.7, else NULL.
    """
    spark = products.sparkSession
    prod, zone = plain_parents((products, "product_id"), (zones, "zone_id"))
    if prod.empty or zone.empty:
        return _empty(spark, "inventory")
    day = date_lit(as_of)
    draws = prod.pick(_ids(spark, n), uniform(seed, "inventory.product", _id()), "product_id")
    draws = zone.pick(draws, uniform(seed, "inventory.zone", _id()), "zone_id")
    expiry = F.date_add(day, uniform_int(seed, "inventory.expiry_days", _id(), 0, 730))
    out = draws.select(
        _id().alias("inventory_id"),
        "product_id",
        "zone_id",
        uniform_int(seed, "inventory.quantity", _id(), 0, 500).alias("quantity"),
        F.concat(
            F.lit("BATCH-"), hex_token(seed, "inventory.batch", _id(), 10), F.lit("-"), F.date_format(day, "yyyyMMdd")
        ).alias("batch_number"),
        null_with_probability(seed, "inventory.has_expiry", _id(), expiry, 0.7).alias("expiration_date"),
    )
    return _conform(out, "inventory")


def generate_purchase_orders(
    products: DataFrame, suppliers: DataFrame, n: int, as_of=None, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Orders of a drawn product from a drawn supplier.

    Order date 0..179 days back; expected delivery 0..29 days ahead (80 %); actual
    delivery 0..89 days back (60 %); any of the five statuses; price
    ``round(u * 1000 + 50, 2)``; quantity 1..50.  Draws are independent, so a
    cancelled order may carry a delivery date, as in the original.
    """
    spark = products.sparkSession
    prod, supp = plain_parents((products, "product_id"), (suppliers, "supplier_id"))
    if prod.empty or supp.empty:
        return _empty(spark, "purchase_orders")
    day = date_lit(as_of)
    draws = prod.pick(_ids(spark, n), uniform(seed, "orders.product", _id()), "product_id")
    draws = supp.pick(draws, uniform(seed, "orders.supplier", _id()), "supplier_id")
    expected = F.date_add(day, uniform_int(seed, "orders.expected_days", _id(), 0, 30))
    actual = F.date_sub(day, uniform_int(seed, "orders.actual_days", _id(), 0, 90))
    out = draws.select(
        _id().alias("purchase_order_id"),
        "product_id",
        "supplier_id",
        F.date_sub(day, uniform_int(seed, "orders.order_days", _id(), 0, 180)).alias("order_date"),
        null_with_probability(seed, "orders.has_expected", _id(), expected, 0.8).alias("expected_delivery_date"),
        null_with_probability(seed, "orders.has_actual", _id(), actual, 0.6).alias("actual_delivery_date"),
        pick_enum(seed, "orders.status", _id(), schemas.ORDER_STATUS).alias("status"),
        rounded_decimal(uniform(seed, "orders.price", _id()), 1000, 50, 18).alias("purchase_price"),
        uniform_int(seed, "orders.quantity", _id(), 1, 50).alias("quantity_ordered"),
    )
    return _conform(out, "purchase_orders")


# Zones by transaction type: which types draw a source zone, which a destination.
SOURCE_ZONE_TYPES = ("Перемещение", "Расход", "Списание", "Инвентаризация")
DESTINATION_ZONE_TYPES = ("Перемещение", "Приход")


def generate_inventory_transactions(
    inventory: DataFrame,
    employees: DataFrame,
    zones: DataFrame,
    n: int,
    now="1998-06-01 12:00:00",
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Movements of a drawn batch (and its product), by a drawn employee (80 %).

    Type is any of the five; a move draws a source and a destination zone (they may
    be equal), an issue or write-off a source, a receipt a destination, a stocktake a
    source.  Timestamp is ``now`` minus 0..364 whole days.  Transactions have no
    quantity column, as in the original model.
    """
    spark = inventory.sparkSession
    inv = Parent(inventory, "inventory_id", ("product_id",))
    emp, zone = plain_parents((employees, "employee_id"), (zones, "zone_id"))
    if inv.empty or emp.empty:
        return _empty(spark, "inventory_transactions")
    draws = inv.pick(_ids(spark, n), uniform(seed, "tx.inventory", _id()), "inventory_id", {"product_id": "product_id"})
    draws = emp.pick(draws, uniform(seed, "tx.employee", _id()), "_employee")
    draws = zone.pick(draws, uniform(seed, "tx.source_zone", _id()), "_source")
    draws = zone.pick(draws, uniform(seed, "tx.destination_zone", _id()), "_destination")
    kind = pick_enum(seed, "tx.type", _id(), schemas.TRANSACTION_TYPE)
    typed = draws.withColumn("transaction_type", kind)
    ts = F.lit(str(now)).cast("timestamp") - F.make_dt_interval(days=uniform_int(seed, "tx.days_back", _id(), 0, 365))
    out = typed.select(
        _id().alias("transaction_id"),
        ts.alias("transaction_timestamp"),
        null_with_probability(seed, "tx.has_employee", _id(), F.col("_employee"), 0.8).alias("employee_id"),
        "product_id",
        F.when(F.col("transaction_type").isin(*SOURCE_ZONE_TYPES), F.col("_source")).alias("source_zone_id"),
        F.when(F.col("transaction_type").isin(*DESTINATION_ZONE_TYPES), F.col("_destination")).alias(
            "destination_zone_id"
        ),
        "transaction_type",
        "inventory_id",
    )
    return _conform(out, "inventory_transactions")


def generate_stock_takes(
    employees: DataFrame, zones: DataFrame, n: int, as_of=None, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Stocktakes 0..364 days back, any status, a drawn zone (50 %), discrepancies
    (30 %), initial (10 %) and a drawn employee (80 %)."""
    spark = employees.sparkSession
    emp, zone = plain_parents((employees, "employee_id"), (zones, "zone_id"))
    if emp.empty:
        return _empty(spark, "stock_takes")
    day = date_lit(as_of)
    draws = zone.pick(_ids(spark, n), uniform(seed, "st.zone", _id()), "_zone")
    draws = emp.pick(draws, uniform(seed, "st.employee", _id()), "_employee")
    out = draws.select(
        _id().alias("stock_take_id"),
        F.date_sub(day, uniform_int(seed, "st.days_back", _id(), 0, 365)).alias("stock_take_date"),
        pick_enum(seed, "st.status", _id(), schemas.STOCKTAKE_STATUS).alias("status"),
        null_with_probability(seed, "st.has_zone", _id(), F.col("_zone"), 0.5).alias("zone_id"),
        bernoulli(seed, "st.discrepancy", _id(), 0.3).alias("has_discrepancies"),
        bernoulli(seed, "st.initial", _id(), 0.1).alias("is_initial_stock_take"),
        null_with_probability(seed, "st.has_employee", _id(), F.col("_employee"), 0.8).alias(
            "performed_by_employee_id"
        ),
    )
    return _conform(out, "stock_takes")


# ---------------------------------------------------------------------------
# The default load: all ten tables in dependency order
# ---------------------------------------------------------------------------
# Row counts of the original default load.
DEFAULT_LOAD = {
    "suppliers": 50,
    "products": 500,
    "warehouses": 5,
    "zones_per_warehouse": 20,
    "employees": 100,
    "inventory": 50_000,
    "purchase_orders": 25_000,
    "inventory_transactions": 200_000,
    "stock_takes": 50_000,
}


def load(
    spark: SparkSession,
    root: str,
    sizes: dict[str, int] | None = None,
    seed: int = DEFAULT_SEED,
    as_of=None,
    now="1998-06-01 12:00:00",
) -> dict[str, DataFrame]:
    """Generate and write all ten tables under ``root``, parents first.

    Each table is written, then read back before its children index it, so a
    child never recomputes its parent's plan and a lost executor re-reads stored
    files.  Returns the stored tables.
    """
    from stockroom.sources import tables as store  # local import: sources depend on schemas only

    n = {**DEFAULT_LOAD, **(sizes or {})}
    stored: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        store.write_table(df, root, name, mode="overwrite")
        stored[name] = store.read_table(spark, root, name)
        return stored[name]

    roles = put("user_roles", seed_user_roles(spark))
    suppliers = put("suppliers", generate_suppliers(spark, n["suppliers"], seed))
    products = put("products", generate_products(spark, n["products"], seed))
    warehouses = put("warehouses", generate_warehouses(spark, n["warehouses"], seed))
    zones = put("storage_zones", generate_storage_zones(warehouses, n["zones_per_warehouse"], seed))
    employees = put("employees", generate_employees(roles, n["employees"], seed, as_of))
    inventory = put("inventory", generate_inventory(products, zones, n["inventory"], as_of, seed))
    put("purchase_orders", generate_purchase_orders(products, suppliers, n["purchase_orders"], as_of, seed))
    put(
        "inventory_transactions",
        generate_inventory_transactions(inventory, employees, zones, n["inventory_transactions"], now, seed),
    )
    put("stock_takes", generate_stock_takes(employees, zones, n["stock_takes"], as_of, seed))
    return stored
