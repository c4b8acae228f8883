"""Data model of the warehouse: table schemas, enum domains and integrity rules.

Everything here is data.  The audits in :mod:`stockroom.operators.quality` and the
generators in :mod:`stockroom.operators.synth` are driven by these tables, so a new
rule is a new line here, not new code.

Names are snake_case versions of the original mixed-case identifiers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Enum domains, in declaration order.  These literals are data
# and must stay byte-for-byte equal to the original data model.
# ---------------------------------------------------------------------------
UNIT_OF_MEASURE = ("шт.", "кг", "л", "м", "упак.")
TRANSACTION_TYPE = ("Приход", "Расход", "Перемещение", "Списание", "Инвентаризация")
ORDER_STATUS = ("Новый", "В обработке", "Отправлен", "Получен", "Отменен")
PRODUCT_CATEGORY = ("Электроника", "Одежда", "Продукты питания", "Стройматериалы", "Канцтовары")
STOCKTAKE_STATUS = ("Планируется", "В процессе", "Завершена", "Отменена")

# The three seeded roles (name, description) and the position
# each role gives an employee; any other role gets DEFAULT_POSITION.
ROLES = (
    ("Администратор", "Полный доступ"),
    ("Кладовщик", "Управление запасами"),
    ("Менеджер", "Управление заказами и отчеты"),
)
POSITION_BY_ROLE = (
    ("Администратор", "Системный администратор"),
    ("Кладовщик", "Кладовщик"),
    ("Менеджер", "Менеджер по закупкам"),
)
DEFAULT_POSITION = "Сотрудник"

# Order statuses that count as "on order" in the reorder report, and the one
# status that makes an order irrelevant for choosing a supplier.
OPEN_ORDER_STATUSES = ("Новый", "В обработке", "Отправлен")
CANCELLED_ORDER_STATUS = "Отменен"
NEW_ORDER_STATUS = "Новый"
COMPLETED_STOCKTAKE_STATUS = "Завершена"

ENUMS = {
    "unit_of_measure_enum": UNIT_OF_MEASURE,
    "transaction_type_enum": TRANSACTION_TYPE,
    "order_status_enum": ORDER_STATUS,
    "product_category_enum": PRODUCT_CATEGORY,
    "stocktake_status_enum": STOCKTAKE_STATUS,
}


# ---------------------------------------------------------------------------
# Column model
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Column:
    name: str
    dtype: T.DataType
    nullable: bool = True
    max_length: int | None = None  # VARCHAR(n)
    enum: str | None = None  # key of ENUMS
    default: str | None = None  # "today", "now" or a SQL literal
    numeric: tuple[int, int] | None = None  # NUMERIC(p, s)


def _int(name, **kw):
    return Column(name, T.IntegerType(), **kw)


def _id(name, **kw):
    """A key column: int4 in the original, 64-bit here because keys at scale pass 2^31."""
    return Column(name, T.LongType(), **kw)


def _str(name, n=None, **kw):
    return Column(name, T.StringType(), max_length=n, **kw)


def _dec(name, p, s, **kw):
    return Column(name, T.DecimalType(p, s), numeric=(p, s), **kw)


TABLES: dict[str, tuple[Column, ...]] = {
    "user_roles": (
        _id("role_id", nullable=False),
        _str("role_name", 50, nullable=False),
        _str("description", 255),
    ),
    "suppliers": (
        _id("supplier_id", nullable=False),
        _str("name", 150, nullable=False),
        _str("address", 255),
        _str("contact_info"),  # JSON text {phone, email, website, notes}
    ),
    "products": (
        _id("product_id", nullable=False),
        _str("name", 150, nullable=False),
        _str("description"),
        _str("category", nullable=False, enum="product_category_enum"),
        _str("unit_of_measure", nullable=False, enum="unit_of_measure_enum"),
        _dec("markup_percentage", 5, 2),
        _int("reorder_level", nullable=False, default="0"),
        _int("max_stock_level", nullable=False, default="0"),
        Column("is_active", T.BooleanType(), nullable=False, default="true"),
    ),
    "purchase_orders": (
        _id("purchase_order_id", nullable=False),
        _id("product_id", nullable=False),
        _id("supplier_id", nullable=False),
        Column("order_date", T.DateType(), nullable=False, default="today"),
        Column("expected_delivery_date", T.DateType()),
        Column("actual_delivery_date", T.DateType()),
        _str("status", nullable=False, enum="order_status_enum"),
        _dec("purchase_price", 18, 2, nullable=False),
        _int("quantity_ordered", nullable=False),
    ),
    "warehouses": (
        _id("warehouse_id", nullable=False),
        _str("name", 100, nullable=False),
        _str("location", 255),
    ),
    "storage_zones": (
        _id("zone_id", nullable=False),
        _id("warehouse_id", nullable=False),
        _str("code", 50, nullable=False),
        _dec("storage_capacity", 18, 2, nullable=False),
    ),
    "inventory": (
        _id("inventory_id", nullable=False),
        _id("product_id", nullable=False),
        _id("zone_id", nullable=False),
        _int("quantity", nullable=False, default="0"),
        _str("batch_number", 100),
        Column("expiration_date", T.DateType()),
    ),
    "employees": (
        _id("employee_id", nullable=False),
        _str("username", 50, nullable=False),
        _str("password_hash", 255, nullable=False),
        _str("first_name", 50),
        _str("last_name", 50),
        _id("role_id", nullable=False),
        Column("hire_date", T.DateType(), default="today"),
        _str("phone", 20),
        _str("email", 100),
        _str("position", 100),
    ),
    "inventory_transactions": (
        _id("transaction_id", nullable=False),
        Column("transaction_timestamp", T.TimestampType(), nullable=False, default="now"),
        _id("employee_id"),
        _id("product_id", nullable=False),
        _id("source_zone_id"),
        _id("destination_zone_id"),
        _str("transaction_type", nullable=False, enum="transaction_type_enum"),
        _id("inventory_id"),
    ),
    "stock_takes": (
        _id("stock_take_id", nullable=False),
        Column("stock_take_date", T.DateType(), nullable=False, default="today"),
        _str("status", nullable=False, enum="stocktake_status_enum"),
        _id("zone_id"),
        Column("has_discrepancies", T.BooleanType(), nullable=False, default="false"),
        Column("is_initial_stock_take", T.BooleanType(), nullable=False, default="false"),
        _id("performed_by_employee_id"),
    ),
}

PRIMARY_KEYS: dict[str, str] = {
    "user_roles": "role_id",
    "suppliers": "supplier_id",
    "products": "product_id",
    "purchase_orders": "purchase_order_id",
    "warehouses": "warehouse_id",
    "storage_zones": "zone_id",
    "inventory": "inventory_id",
    "employees": "employee_id",
    "inventory_transactions": "transaction_id",
    "stock_takes": "stock_take_id",
}

UNIQUE_KEYS: tuple[tuple[str, str], ...] = (
    ("user_roles", "role_name"),
    ("storage_zones", "code"),
    ("employees", "username"),
)


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_key: str
    on_delete: str = "no action"  # or "cascade"


FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("purchase_orders", "product_id", "products", "product_id"),
    ForeignKey("purchase_orders", "supplier_id", "suppliers", "supplier_id"),
    ForeignKey("storage_zones", "warehouse_id", "warehouses", "warehouse_id", "cascade"),
    ForeignKey("inventory", "product_id", "products", "product_id"),
    ForeignKey("inventory", "zone_id", "storage_zones", "zone_id"),
    ForeignKey("employees", "role_id", "user_roles", "role_id"),
    ForeignKey("inventory_transactions", "employee_id", "employees", "employee_id"),
    ForeignKey("inventory_transactions", "product_id", "products", "product_id"),
    ForeignKey("inventory_transactions", "source_zone_id", "storage_zones", "zone_id"),
    ForeignKey("inventory_transactions", "destination_zone_id", "storage_zones", "zone_id"),
    ForeignKey("inventory_transactions", "inventory_id", "inventory", "inventory_id"),
    ForeignKey("stock_takes", "zone_id", "storage_zones", "zone_id"),
    ForeignKey("stock_takes", "performed_by_employee_id", "employees", "employee_id"),
)

# CHECK constraints as Spark SQL predicates (name, table, predicate, columns read).
CHECKS: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("ck_quantity_ordered", "purchase_orders", "quantity_ordered > 0", ("quantity_ordered",)),
    ("ck_inventory_quantity", "inventory", "quantity >= 0", ("quantity",)),
)


def columns(table: str) -> tuple[Column, ...]:
    return TABLES[table]


def column(table: str, name: str) -> Column:
    for c in TABLES[table]:
        if c.name == name:
            return c
    raise KeyError(f"{table}.{name}")


def struct_type(table: str) -> T.StructType:
    """The declared schema of ``table`` as a Spark ``StructType``."""
    return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in TABLES[table]])


def not_null_columns(table: str) -> list[str]:
    return [c.name for c in TABLES[table] if not c.nullable]


def varchar_columns(table: str) -> list[tuple[str, int]]:
    return [(c.name, c.max_length) for c in TABLES[table] if c.max_length]


def enum_columns(table: str) -> list[tuple[str, tuple[str, ...]]]:
    return [(c.name, ENUMS[c.enum]) for c in TABLES[table] if c.enum]


def numeric_columns(table: str) -> list[tuple[str, int, int]]:
    return [(c.name, *c.numeric) for c in TABLES[table] if c.numeric]


def defaults(table: str) -> dict[str, str]:
    return {c.name: c.default for c in TABLES[table] if c.default is not None}
