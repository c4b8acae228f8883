"""Warehouse tables derived from the driver's TPC-H-like Parquet files.

The test data has no warehouse tables, so each one is mapped from a source table
by plain column expressions (``FIXTURES.md`` §2 and §3).  The mapping only shapes
rows into the warehouse schema; every report, audit and generator then does its
own work on these frames, and would do the same on real warehouse tables.

Each function reads only the columns it needs, so the Parquet scan is pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.schemas import ROLES

AS_OF = "1998-06-01"  # report date used for every fixture query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: Column, mapping: list[tuple[str, str]], default: str) -> Column:
    out = None
    for key, value in mapping:
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default)


def _id(expr: str | Column) -> Column:
    """A key column: 64-bit, so that keys above 2^31 pass through."""
    return (F.col(expr) if isinstance(expr, str) else expr).cast("bigint")


# Fixed values of the fixture mapping (FIXTURES.md §2).
CATEGORY_BY_PART_TYPE = [
    ("ECONOMY", "Электроника"),
    ("LARGE", "Одежда"),
    ("MEDIUM", "Продукты питания"),
    ("PROMO", "Стройматериалы"),
]
CATEGORY_DEFAULT = "Канцтовары"
ORDER_STATUS_BY_PRIORITY = [
    ("1-URGENT", "Новый"),
    ("2-HIGH", "В обработке"),
    ("3-MEDIUM", "Отправлен"),
    ("4-NOT SPECIFIED", "Получен"),
]
ORDER_STATUS_DEFAULT = "Отменен"
STOCKTAKE_STATUS_BY_PRIORITY = [
    ("1-URGENT", "Планируется"),
    ("2-HIGH", "В процессе"),
    ("5-LOW", "Отменена"),
]
STOCKTAKE_STATUS_DEFAULT = "Завершена"
TRANSACTION_TYPE_BY_EVENT = [
    ("purchase", "Приход"),
    ("click", "Расход"),
    ("view", "Перемещение"),
    ("error", "Списание"),
]
TRANSACTION_TYPE_DEFAULT = "Инвентаризация"


def user_roles(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, name, desc) for i, (name, desc) in enumerate(ROLES)]
    return spark.createDataFrame(rows, "role_id bigint, role_name string, description string")


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(
        _id(F.col("r_regionkey") + 1).alias("warehouse_id"),
        F.col("r_name").alias("name"),
        F.concat(F.lit("Region "), F.col("r_name")).alias("location"),
    )


def storage_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(
        _id(F.col("n_nationkey") + 1).alias("zone_id"),
        _id(F.col("n_regionkey") + 1).alias("warehouse_id"),
        F.col("n_name").alias("code"),
        (F.lit(100) + F.lit(20) * F.col("n_nationkey")).cast("decimal(18,2)").alias("storage_capacity"),
    )


# Zones that no batch, transaction or stocktake refers to (their ids lie above all drawn ones):
# every warehouse but the last has one beside its used zones, the last has nothing else.
SPARE_WAREHOUSE = 5


def storage_zones_with_spare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones plus one unused zone per warehouse; the zones of the last warehouse move to the one before."""
    zones = storage_zones(spark, sf_dir)
    used = F.when(F.col("warehouse_id") == SPARE_WAREHOUSE, SPARE_WAREHOUSE - 1).otherwise(F.col("warehouse_id"))
    spare = warehouses(spark, sf_dir).select(
        _id(F.col("warehouse_id") + 100).alias("zone_id"),
        "warehouse_id",
        F.concat(F.lit("SPARE "), F.col("name")).alias("code"),
        F.lit(1).cast("decimal(18,2)").alias("storage_capacity"),
    )
    return zones.withColumn("warehouse_id", _id(used)).unionByName(spare)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    phone = F.concat(F.lit("+"), F.lpad(key.cast("string"), 12, "0"))
    contact = F.struct(
        phone.alias("phone"),
        F.concat(F.lit("contact_"), F.substring(F.md5(F.col("s_name")), 1, 8), F.lit("@supplier.com")).alias("email"),
        F.when(key % 3 == 0, F.concat(F.lit("http://supplier_"), key.cast("string"), F.lit(".com"))).alias("website"),
        F.when(key % 4 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("notes"),
    )
    written = (
        F.when(key % 7 == 3, F.concat(F.lit('{"phone":"'), phone, F.lit('","email":null,"website":null}')))
        .when(key % 7 == 5, F.concat(F.lit("phone "), phone))  # not JSON
        .otherwise(F.to_json(contact))  # null keys are left out
    )
    return read(spark, sf_dir, "supplier").select(
        _id("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), written.alias("contact_info")
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        _id("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        _case(F.col("p_type"), CATEGORY_BY_PART_TYPE, CATEGORY_DEFAULT).alias("category"),
        (F.col("p_size") * 10).cast("int").alias("reorder_level"),
        (F.col("p_size") * 10 + 250).cast("int").alias("max_stock_level"),
        (F.col("p_partkey") % 10 != 0).alias("is_active"),
    )


def shipped_between(as_of: str, days: int) -> Column:
    """The range of ``l_shipdate`` that an expiry date in [as_of, as_of + days] implies, as a scan predicate."""
    first = F.lit(as_of).cast("timestamp_ntz")
    after = F.date_add(F.lit(as_of).cast("date"), days + 1).cast("timestamp_ntz")
    return (F.col("l_shipdate") >= first) & (F.col("l_shipdate") < after)


def inventory(spark: SparkSession, sf_dir: str, shipped: Column | None = None) -> DataFrame:
    """Every line item as a batch; products divisible by 11 lend theirs to the one before and so have no stock.

    ``shipped`` lets a report that bounds the expiry date hand its bound to the scan: the
    expiry date is a CASE over ``l_shipdate``, through which Catalyst pushes nothing.
    """
    li = read(spark, sf_dir, "lineitem")
    li = li if shipped is None else li.filter(shipped)
    part = F.col("l_partkey")
    batch_key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("inventory_id"),
        _id(F.when((part % 11 == 0) & (part > 0), part - 1).otherwise(part)).alias("product_id"),
        _id(F.col("l_suppkey") % 25 + 1).alias("zone_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.concat(F.lit("BATCH-"), F.substring(F.md5(batch_key), 1, 10)).alias("batch_number"),
        F.when(F.col("l_returnflag") != "R", F.to_date(F.col("l_shipdate"))).alias("expiration_date"),
    )


def purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        _id("o_orderkey").alias("purchase_order_id"),
        _id("o_custkey").alias("product_id"),
        _id(F.col("o_orderkey") % 10).alias("supplier_id"),
        F.to_date(F.col("o_orderdate")).alias("order_date"),
        _case(F.col("o_orderpriority"), ORDER_STATUS_BY_PRIORITY, ORDER_STATUS_DEFAULT).alias("status"),
        (F.col("o_orderkey") % 50 + 1).cast("int").alias("quantity_ordered"),
    )


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        _id("c_custkey").alias("employee_id"),
        F.concat(F.lit("emp_"), key.cast("string")).alias("username"),
        F.when(key % 13 != 0, F.concat(F.lit("FirstName"), key.cast("string"))).alias("first_name"),
        F.when(key % 17 != 0, F.concat(F.lit("LastName"), key.cast("string"))).alias("last_name"),
        _id(F.col("c_nationkey") % 3 + 1).alias("role_id"),
    )


def stock_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        _id("o_orderkey").alias("stock_take_id"),
        F.to_date(F.col("o_orderdate")).alias("stock_take_date"),
        _case(F.col("o_orderpriority"), STOCKTAKE_STATUS_BY_PRIORITY, STOCKTAKE_STATUS_DEFAULT).alias("status"),
        F.when(key % 2 == 0, _id(key % 25 + 1)).alias("zone_id"),
        (key % 10 < 3).alias("has_discrepancies"),
        (key % 7 == 0).alias("is_initial_stock_take"),
        F.when(key % 5 != 0, _id("o_custkey")).alias("performed_by_employee_id"),
    )


def inventory_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    key = F.col("event_id")
    etype = F.col("event_type")
    return e.select(
        key.cast("bigint").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("transaction_timestamp"),
        F.when(key % 5 != 0, _id("user_id")).alias("employee_id"),
        _id(key % 200).alias("product_id"),
        F.when(etype != "purchase", _id(key % 25 + 1)).alias("source_zone_id"),
        F.when(etype.isin("purchase", "view"), _id(key % 24 + 1)).alias("destination_zone_id"),
        _case(etype, TRANSACTION_TYPE_BY_EVENT, TRANSACTION_TYPE_DEFAULT).alias("transaction_type"),
        _id(F.lit(None)).alias("inventory_id"),
    )


# ---------------------------------------------------------------------------
# Dirty variants (FIXTURES.md §3): rows that break the declared rules, so the
# audits have something to find.
# ---------------------------------------------------------------------------
def dirty_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    user_key = F.when(key % 100 == 99, key - 1).otherwise(key)
    return read(spark, sf_dir, "customer").select(
        _id("c_custkey").alias("employee_id"),
        F.when(key % 37 != 0, F.concat(F.lit("emp_"), user_key.cast("string"))).alias("username"),
        _id(F.col("c_nationkey") % 4 + 1).alias("role_id"),
        F.when(key % 41 == 0, F.repeat(F.lit("7"), 25)).alias("phone"),
    )


def dirty_stock_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("stock_take_id")
    status = F.when(key % 89 == 0, "Неизвестно").when(key % 83 != 0, F.col("status"))
    zone = F.when(key % 71 == 0, F.lit(99)).otherwise(F.col("zone_id"))
    return stock_takes(spark, sf_dir).withColumn("status", status).withColumn("zone_id", _id(zone))


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("transaction_id")
    kind = F.when(key % 101 == 0, "Возврат").otherwise(F.col("transaction_type"))
    when = F.when(key % 103 != 0, F.col("transaction_timestamp"))
    zone = F.when(key % 97 == 0, F.lit(77)).otherwise(F.col("destination_zone_id"))
    return (
        inventory_transactions(spark, sf_dir)
        .withColumn("transaction_type", kind)
        .withColumn("transaction_timestamp", when)
        .withColumn("destination_zone_id", _id(zone))
        .withColumn("inventory_id", F.when(key % 2 == 0, key))
    )


def dirty_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        _id("p_partkey").alias("product_id"),
        F.when(key % 40 == 0, F.repeat(F.col("p_name"), 20)).otherwise(F.col("p_name")).alias("name"),
        F.when(key % 60 != 0, F.col("p_type")).alias("category"),
        (F.col("p_retailprice") + 4 * F.col("p_size")).alias("markup_percentage"),
    )


def partial_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent table from which every fiftieth product is missing (audit Q4 looks for its orphans)."""
    return read(spark, sf_dir, "part").filter(F.col("p_partkey") % 50 != 0).select(_id("p_partkey").alias("product_id"))


def dirty_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).withColumn("quantity", F.col("quantity") - 2)


def dirty_purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        _id("o_orderkey").alias("purchase_order_id"),
        _id("o_custkey").alias("product_id"),
        (key % 50).cast("int").alias("quantity_ordered"),
        F.when(key % 97 == 0, F.lit("Неизвестно")).otherwise(F.lit("Новый")).alias("status"),
    )


def dirty_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = F.when(key % 5 == 0, F.repeat(F.col("s_name"), 20)).when(key % 7 != 1, F.col("s_name"))
    return read(spark, sf_dir, "supplier").select(
        _id(F.when(key % 9 == 8, key - 1).otherwise(key)).alias("supplier_id"), name.alias("name")
    )


def dirty_warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    return read(spark, sf_dir, "region").select(
        _id(F.when(key == 4, F.lit(None)).otherwise(key + 1)).alias("warehouse_id"),
        F.when(key % 4 != 1, F.col("r_name")).alias("name"),
        F.when(key % 2 == 0, F.repeat(F.col("r_name"), 60)).alias("location"),
    )


def dirty_storage_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    code = F.when(key < 10, F.concat(F.lit("Z"), F.floor(key / 2).cast("string"))).when(key % 11 != 10, F.col("n_name"))
    capacity = F.when(key % 7 == 3, F.lit("20000000000000000.00")).otherwise(F.lit("100.00"))
    return read(spark, sf_dir, "nation").select(
        _id(key + 1).alias("zone_id"),
        _id(F.when(key % 6 == 0, F.lit(9)).otherwise(F.col("n_regionkey") + 1)).alias("warehouse_id"),
        code.alias("code"),
        capacity.cast("decimal(38,2)").alias("storage_capacity"),
    )


def dirty_user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        _id(key).alias("role_id"),
        F.when(key % 9 != 8, F.concat(F.lit("role "), (key % 20).cast("string"))).alias("role_name"),
        F.when(key % 4 == 0, F.repeat(F.col("n_name"), 60)).alias("description"),
    )


CLEAN_TABLES = {
    "warehouses": warehouses,
    "storage_zones": storage_zones,
    "suppliers": suppliers,
    "products": products,
    "inventory": inventory,
    "purchase_orders": purchase_orders,
    "employees": employees,
    "stock_takes": stock_takes,
    "inventory_transactions": inventory_transactions,
}


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {name: fn(spark, sf_dir) for name, fn in CLEAN_TABLES.items()}
    tables["user_roles"] = user_roles(spark)
    return tables
