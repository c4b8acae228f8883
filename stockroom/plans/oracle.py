"""Oracle SQL: each job restated in plain SQL that DuckDB runs on the raw Parquet views.

The oracle sees only the driver's tables, so every statement carries the fixture
mapping of ``FIXTURES.md`` as CTEs, written independently of the DataFrame code in
:mod:`stockroom.sources.fixtures`.  DuckDB types are pinned with casts where they
differ from Spark's (``SUM(int)`` is HUGEINT there, ``date - date`` BIGINT).
"""

from __future__ import annotations

AS_OF = "DATE '1998-06-01'"

FIXTURE_CTES = {
    "user_roles": """
user_roles AS (
  SELECT CAST(role_id AS BIGINT) AS role_id, role_name, description FROM (VALUES
    (1, 'Администратор', 'Полный доступ'),
    (2, 'Кладовщик', 'Управление запасами'),
    (3, 'Менеджер', 'Управление заказами и отчеты')) t(role_id, role_name, description))""",
    "warehouses": """
warehouses AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS warehouse_id, r_name AS name, 'Region ' || r_name AS location
  FROM region)""",
    "storage_zones": """
storage_zones AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS zone_id, CAST(n_regionkey + 1 AS BIGINT) AS warehouse_id,
         n_name AS code, CAST(100 + 20 * n_nationkey AS DECIMAL(18,2)) AS storage_capacity
  FROM nation)""",
    "suppliers": """
suppliers AS (
  SELECT CAST(s_suppkey AS BIGINT) AS supplier_id, s_name AS name,
         CASE s_suppkey % 7
           WHEN 3 THEN '{"phone":"+' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') || '","email":null,"website":null}'
           WHEN 5 THEN 'phone +' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0')
           ELSE '{' || concat_ws(',',
                  '"phone":"+' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') || '"',
                  '"email":"contact_' || substr(md5(s_name), 1, 8) || '@supplier.com"',
                  CASE WHEN s_suppkey % 3 = 0
                       THEN '"website":"http://supplier_' || CAST(s_suppkey AS VARCHAR) || '.com"' END,
                  CASE WHEN s_suppkey % 4 <> 0 THEN '"notes":"n' || CAST(s_nationkey AS VARCHAR) || '"' END) || '}'
         END AS contact_info
  FROM supplier)""",
    "products": """
products AS (
  SELECT CAST(p_partkey AS BIGINT) AS product_id, p_name AS name,
         CASE p_type WHEN 'ECONOMY' THEN 'Электроника' WHEN 'LARGE' THEN 'Одежда'
                     WHEN 'MEDIUM' THEN 'Продукты питания' WHEN 'PROMO' THEN 'Стройматериалы'
                     ELSE 'Канцтовары' END AS category,
         CAST(10 * p_size AS INTEGER) AS reorder_level,
         CAST(10 * p_size + 250 AS INTEGER) AS max_stock_level,
         p_partkey % 10 <> 0 AS is_active
  FROM part)""",
    "inventory": """
inventory AS (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS inventory_id,
         CAST(l_partkey - CASE WHEN l_partkey > 0 AND l_partkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS product_id,
         CAST(l_suppkey % 25 + 1 AS BIGINT) AS zone_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         'BATCH-' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 10)
           AS batch_number,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_shipdate AS DATE) END AS expiration_date
  FROM lineitem)""",
    "purchase_orders": """
purchase_orders AS (
  SELECT CAST(o_orderkey AS BIGINT) AS purchase_order_id, CAST(o_custkey AS BIGINT) AS product_id,
         CAST(o_orderkey % 10 AS BIGINT) AS supplier_id, CAST(o_orderdate AS DATE) AS order_date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Новый' WHEN '2-HIGH' THEN 'В обработке'
                              WHEN '3-MEDIUM' THEN 'Отправлен' WHEN '4-NOT SPECIFIED' THEN 'Получен'
                              ELSE 'Отменен' END AS status,
         CAST(o_orderkey % 50 + 1 AS INTEGER) AS quantity_ordered
  FROM orders)""",
    "employees": """
employees AS (
  SELECT CAST(c_custkey AS BIGINT) AS employee_id, 'emp_' || CAST(c_custkey AS VARCHAR) AS username,
         CASE WHEN c_custkey % 13 <> 0 THEN 'FirstName' || CAST(c_custkey AS VARCHAR) END AS first_name,
         CASE WHEN c_custkey % 17 <> 0 THEN 'LastName' || CAST(c_custkey AS VARCHAR) END AS last_name,
         CAST(c_nationkey % 3 + 1 AS BIGINT) AS role_id
  FROM customer)""",
    "stock_takes": """
stock_takes AS (
  SELECT CAST(o_orderkey AS BIGINT) AS stock_take_id, CAST(o_orderdate AS DATE) AS stock_take_date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Планируется' WHEN '2-HIGH' THEN 'В процессе'
                              WHEN '5-LOW' THEN 'Отменена' ELSE 'Завершена' END AS status,
         CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 25 + 1 AS BIGINT) END AS zone_id,
         o_orderkey % 10 < 3 AS has_discrepancies,
         o_orderkey % 7 = 0 AS is_initial_stock_take,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS BIGINT) END AS performed_by_employee_id
  FROM orders)""",
    "inventory_transactions": """
inventory_transactions AS (
  SELECT CAST(event_id AS BIGINT) AS transaction_id, ts AS transaction_timestamp,
         CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS BIGINT) END AS employee_id,
         CAST(event_id % 200 AS BIGINT) AS product_id,
         CASE WHEN event_type <> 'purchase' THEN CAST(event_id % 25 + 1 AS BIGINT) END AS source_zone_id,
         CASE WHEN event_type IN ('purchase', 'view') THEN CAST(event_id % 24 + 1 AS BIGINT) END
           AS destination_zone_id,
         CASE event_type WHEN 'purchase' THEN 'Приход' WHEN 'click' THEN 'Расход'
                         WHEN 'view' THEN 'Перемещение' WHEN 'error' THEN 'Списание'
                         ELSE 'Инвентаризация' END AS transaction_type,
         CAST(NULL AS BIGINT) AS inventory_id
  FROM events)""",
    "partial_products": """
partial_products AS (SELECT CAST(p_partkey AS BIGINT) AS product_id FROM part WHERE p_partkey % 50 <> 0)""",
    "spare_zones": """
spare_zones AS (
  SELECT zone_id, CASE WHEN warehouse_id = 5 THEN 4 ELSE warehouse_id END AS warehouse_id FROM storage_zones
  UNION ALL SELECT warehouse_id + 100, warehouse_id FROM warehouses)""",
    "d_employees": """
d_employees AS (
  SELECT CAST(c_custkey AS BIGINT) AS employee_id,
         CASE WHEN c_custkey % 37 <> 0
              THEN 'emp_' || CAST(CASE WHEN c_custkey % 100 = 99 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) END
           AS username,
         CAST(c_nationkey % 4 + 1 AS BIGINT) AS role_id,
         CASE WHEN c_custkey % 41 = 0 THEN repeat('7', 25) END AS phone
  FROM customer)""",
    "d_stock_takes": """
d_stock_takes AS (
  SELECT * REPLACE (
    CASE WHEN stock_take_id % 89 = 0 THEN 'Неизвестно' WHEN stock_take_id % 83 <> 0 THEN status END AS status,
    CASE WHEN stock_take_id % 71 = 0 THEN 99 ELSE zone_id END AS zone_id)
  FROM stock_takes)""",
    "d_transactions": """
d_transactions AS (
  SELECT * REPLACE (
    CASE WHEN transaction_id % 101 = 0 THEN 'Возврат' ELSE transaction_type END AS transaction_type,
    CASE WHEN transaction_id % 103 <> 0 THEN transaction_timestamp END AS transaction_timestamp,
    CASE WHEN transaction_id % 97 = 0 THEN 77 ELSE destination_zone_id END AS destination_zone_id,
    CASE WHEN transaction_id % 2 = 0 THEN transaction_id END AS inventory_id)
  FROM inventory_transactions)""",
    "d_products": """
d_products AS (
  SELECT CAST(p_partkey AS BIGINT) AS product_id,
         CASE WHEN p_partkey % 40 = 0 THEN repeat(p_name, 20) ELSE p_name END AS name,
         CASE WHEN p_partkey % 60 <> 0 THEN p_type END AS category,
         p_retailprice + 4 * p_size AS markup_percentage
  FROM part)""",
    "d_purchase_orders": """
d_purchase_orders AS (
  SELECT CAST(o_orderkey AS BIGINT) AS purchase_order_id, CAST(o_custkey AS BIGINT) AS product_id,
         CAST(o_orderkey % 50 AS INTEGER) AS quantity_ordered,
         CASE WHEN o_orderkey % 97 = 0 THEN 'Неизвестно' ELSE 'Новый' END AS status
  FROM orders)""",
}


def with_fixtures(*names: str, body: str, extra: str = "") -> str:
    """``WITH <fixture CTEs>[, extra CTEs] <body>``."""
    ctes = [FIXTURE_CTES[n].strip() for n in names]
    if extra.strip():
        ctes.append(extra.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------
def _days_ahead(n: int) -> str:
    """One row per day from the report date to ``n`` days after it."""
    return f"ahead AS (SELECT CAST(k AS INTEGER) AS days, {AS_OF} + CAST(k AS INTEGER) AS day FROM range(0, {n + 1}) t(k))"


# Where a batch lies: zone code and warehouse name per zone.
_PLACES = """
places AS (
  SELECT zone_id, code AS zone_code, (SELECT name FROM warehouses WHERE warehouses.warehouse_id = storage_zones.warehouse_id)
    AS warehouse_name
  FROM storage_zones)"""

_EXPIRY_TABLES = ("inventory", "products", "storage_zones", "warehouses")

R1 = with_fixtures(
    *_EXPIRY_TABLES,
    extra=_PLACES + ",\n" + _days_ahead(30),
    body="""
SELECT inventory_id, product_id, products.name AS product_name, batch_number, quantity, day AS expiration_date,
       warehouse_name, zone_code, days AS days_until_expiration
FROM ahead JOIN inventory ON inventory.expiration_date = ahead.day
JOIN products USING (product_id) JOIN places USING (zone_id)
ORDER BY days""",
)

R2 = with_fixtures(
    *_EXPIRY_TABLES,
    extra=_PLACES + ",\n" + _days_ahead(7),
    body="""
SELECT products.name AS product_name, batch_number, quantity, day AS expiration_date, days AS days_until_expiration,
       warehouse_name, zone_code
FROM ahead JOIN inventory ON inventory.expiration_date = ahead.day
JOIN products USING (product_id) JOIN places USING (zone_id)""",
)

# Completed takes with discrepancies, less the initial ones, as sets of ids.
_REPEAT_TAKES = """
hits AS (
  SELECT stock_take_id FROM stock_takes WHERE status = 'Завершена'
  INTERSECT SELECT stock_take_id FROM stock_takes WHERE has_discrepancies
  EXCEPT SELECT stock_take_id FROM stock_takes WHERE is_initial_stock_take),
done AS (SELECT * FROM stock_takes WHERE stock_take_id IN (SELECT stock_take_id FROM hits))"""

R3 = with_fixtures(
    "employees",
    "stock_takes",
    extra=_REPEAT_TAKES,
    body="""
SELECT employee_id, username, first_name, last_name, stock_take_id, stock_take_date, zone_id, has_discrepancies
FROM done JOIN employees ON employee_id = performed_by_employee_id""",
)

R4 = with_fixtures(
    "employees",
    "stock_takes",
    extra=_REPEAT_TAKES,
    body="""
SELECT employee_id, username, first_name, last_name, stock_take_id, stock_take_date, zone_id
FROM employees JOIN done ON performed_by_employee_id = employee_id
ORDER BY stock_take_date DESC, last_name ASC NULLS LAST""",
)

R5 = with_fixtures(
    "employees",
    "stock_takes",
    extra=_REPEAT_TAKES
    + """,
per_employee AS (SELECT performed_by_employee_id AS employee_id, count(*) AS n FROM done GROUP BY ALL)""",
    body="""
SELECT username, first_name, last_name, CAST(sum(n) AS BIGINT) AS number_of_secondary_discrepancy_stock_takes
FROM per_employee JOIN employees USING (employee_id)
GROUP BY ALL ORDER BY 4 DESC""",
)

R6 = with_fixtures(
    "inventory",
    body="""
SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS current_stock
FROM inventory GROUP BY product_id""",
)

R7 = with_fixtures(
    "purchase_orders",
    body="""
SELECT product_id, CAST(SUM(quantity_ordered) AS BIGINT) AS quantity_on_order
FROM purchase_orders WHERE status IN ('Новый', 'В обработке', 'Отправлен')
GROUP BY product_id""",
)

# Stock and open orders looked up product by product.
_REORDER = """
levels AS (
  SELECT product_id, name AS product_name, reorder_level, max_stock_level,
         CAST(coalesce((SELECT sum(quantity) FROM inventory WHERE inventory.product_id = products.product_id), 0)
              AS BIGINT) AS current_stock,
         CAST(coalesce((SELECT sum(quantity_ordered) FROM purchase_orders
                        WHERE purchase_orders.product_id = products.product_id
                          AND status NOT IN ('Получен', 'Отменен')), 0) AS BIGINT) AS quantity_on_order
  FROM products WHERE is_active),
r8 AS (SELECT *, reorder_level >= current_stock AND quantity_on_order = 0 AS needs_reorder FROM levels)"""

R8 = with_fixtures("products", "inventory", "purchase_orders", extra=_REORDER, body="SELECT * FROM r8")

# The statements over the views under the original names: the same rows with the names as written there.
REPORT_SQL = {
    "sql_expiring_within_7_days": f"""
SELECT product_name AS ProductName, batch_number AS BatchNumber, quantity AS Quantity, expiration_date AS ExpirationDate,
       days_until_expiration AS DaysUntilExpiration, warehouse_name AS WarehouseName, zone_code AS ZoneCode
FROM ({R2})""",
    "sql_secondary_discrepancy_listing": f"""
SELECT employee_id AS EmployeeID, username AS Username, first_name AS FirstName, last_name AS LastName,
       stock_take_id AS StockTakeID, stock_take_date AS StockTakeDate, zone_id AS ZoneID
FROM ({R4})""",
    "sql_discrepancies_per_employee": f"""
SELECT username AS Username, first_name AS FirstName, last_name AS LastName,
       number_of_secondary_discrepancy_stock_takes AS NumberOfSecondaryDiscrepancyStockTakes
FROM ({R5})""",
    "sql_products_to_reorder": f"""
SELECT product_id AS productid, product_name AS productname, reorder_level AS reorderlevel,
       max_stock_level AS maxstocklevel, current_stock AS currentstock, quantity_on_order AS quantityonorder,
       needs_reorder AS needsreorder
FROM ({R8})""",
}

# ---------------------------------------------------------------------------
# Jobs decided by us
# ---------------------------------------------------------------------------
D1 = with_fixtures(
    "products",
    "inventory",
    "purchase_orders",
    extra=_REORDER
    + """,
latest AS (
  SELECT product_id, supplier_id,
         row_number() OVER (PARTITION BY product_id ORDER BY order_date DESC, purchase_order_id DESC) AS rn
  FROM purchase_orders WHERE status <> 'Отменен')""",
    body=f"""
SELECT r8.product_id, l.supplier_id, {AS_OF} AS order_date, 'Новый' AS status,
       CAST(r8.max_stock_level - r8.current_stock AS INTEGER) AS quantity_ordered
FROM r8 LEFT JOIN latest l ON l.product_id = r8.product_id AND l.rn = 1
WHERE r8.needs_reorder AND r8.max_stock_level - r8.current_stock > 0""",
)

D2 = with_fixtures(
    "suppliers",
    extra="""
read AS (SELECT supplier_id, CASE WHEN json_valid(contact_info) THEN contact_info END AS contact_info FROM suppliers)""",
    body="""
SELECT supplier_id,
       json_extract_string(contact_info, '$.phone') AS phone,
       json_extract_string(contact_info, '$.email') AS email,
       json_extract_string(contact_info, '$.website') AS website,
       json_extract_string(contact_info, '$.notes') AS notes
FROM read""",
)

# ---------------------------------------------------------------------------
# Integrity audits
# ---------------------------------------------------------------------------
Q1 = with_fixtures(
    "inventory",
    body="""
SELECT inventory_id, COUNT(*) AS n FROM inventory GROUP BY inventory_id
HAVING COUNT(*) > 1 OR inventory_id IS NULL""",
)

Q2 = with_fixtures(
    "d_employees",
    body="""
SELECT username, COUNT(*) AS n FROM d_employees WHERE username IS NOT NULL
GROUP BY username HAVING COUNT(*) > 1""",
)

Q3 = with_fixtures(
    "d_products",
    body="""
SELECT product_id, 'product_id' AS column_name FROM d_products WHERE product_id IS NULL
UNION ALL SELECT product_id, 'name' FROM d_products WHERE name IS NULL
UNION ALL SELECT product_id, 'category' FROM d_products WHERE category IS NULL
UNION ALL SELECT NULL, 'unit_of_measure'""",
)

Q4 = with_fixtures(
    "inventory",
    "purchase_orders",
    "partial_products",
    body="""
SELECT 'inventory' AS child_table, 'product_id' AS fk_column, CAST(i.inventory_id AS BIGINT) AS child_id,
       CAST(i.product_id AS BIGINT) AS fk_value
FROM inventory i
WHERE i.product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM partial_products p WHERE p.product_id = i.product_id)
UNION ALL
SELECT 'purchase_orders', 'product_id', CAST(o.purchase_order_id AS BIGINT), CAST(o.product_id AS BIGINT)
FROM purchase_orders o
WHERE o.product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM partial_products p WHERE p.product_id = o.product_id)""",
)

Q5 = with_fixtures(
    "inventory",
    "d_purchase_orders",
    body="""
SELECT 'ck_inventory_quantity' AS constraint_name, CAST(inventory_id AS BIGINT) AS row_id
FROM inventory WHERE NOT (quantity - 2 >= 0)
UNION ALL
SELECT 'ck_quantity_ordered', CAST(purchase_order_id AS BIGINT)
FROM d_purchase_orders WHERE NOT (quantity_ordered > 0)""",
)

Q6 = with_fixtures(
    "d_purchase_orders",
    body="""
SELECT purchase_order_id, status FROM d_purchase_orders
WHERE status IS NOT NULL AND status NOT IN ('Новый', 'В обработке', 'Отправлен', 'Получен', 'Отменен')""",
)

Q7 = with_fixtures(
    "d_products",
    body="""
SELECT product_id, CAST(length(name) AS INTEGER) AS name_length FROM d_products
WHERE length(rtrim(name)) > 150""",
)

Q8 = with_fixtures(
    "d_products",
    body="""
SELECT product_id, markup_percentage FROM d_products
WHERE abs(round(CAST(markup_percentage AS DECIMAL(38,10)), 2)) >= 1000""",
)

Q9 = with_fixtures(
    "stock_takes",
    body=f"""
SELECT stock_take_id, {AS_OF} AS stock_take_date, status, zone_id, FALSE AS has_discrepancies,
       FALSE AS is_initial_stock_take, performed_by_employee_id
FROM stock_takes""",
)

Q9_PRODUCTS = with_fixtures(
    "products",
    body="""
SELECT product_id, name, category, CAST(0 AS INTEGER) AS reorder_level, CAST(0 AS INTEGER) AS max_stock_level,
       TRUE AS is_active
FROM products""",
)
Q9_PURCHASE_ORDERS = with_fixtures(
    "purchase_orders", body=f"SELECT * REPLACE ({AS_OF} AS order_date) FROM purchase_orders"
)
Q9_INVENTORY = with_fixtures("inventory", body="SELECT * REPLACE (CAST(0 AS INTEGER) AS quantity) FROM inventory")
Q9_EMPLOYEES = with_fixtures("employees", body=f"SELECT *, {AS_OF} AS hire_date FROM employees")
Q9_TRANSACTIONS = with_fixtures(
    "inventory_transactions",
    body="""
SELECT * REPLACE (TIMESTAMP '1998-06-01 12:00:00' AS transaction_timestamp) FROM inventory_transactions""",
)


def delete_warehouses(*ids: int) -> str:
    """Q10 as one statement: nothing is deleted once a zone to be deleted is referenced."""
    listed = ", ".join(map(str, ids))
    return with_fixtures(
        "warehouses",
        "storage_zones",
        "spare_zones",
        "inventory",
        "inventory_transactions",
        "stock_takes",
        extra=f"""
refs AS (
  SELECT zone_id FROM inventory
  UNION SELECT source_zone_id FROM inventory_transactions
  UNION SELECT destination_zone_id FROM inventory_transactions
  UNION SELECT zone_id FROM stock_takes),
hit AS (
  SELECT zone_id, warehouse_id FROM spare_zones
  WHERE warehouse_id IN ({listed}) AND zone_id IN (SELECT zone_id FROM refs WHERE zone_id IS NOT NULL)),
rows_ AS (
  SELECT 'zone' AS entity, zone_id AS id, warehouse_id, zone_id IN (SELECT zone_id FROM hit) AS referenced
  FROM spare_zones
  UNION ALL
  SELECT 'warehouse', warehouse_id, warehouse_id, warehouse_id IN (SELECT warehouse_id FROM hit) FROM warehouses)""",
        body=f"""
SELECT entity, id, warehouse_id,
       CASE WHEN referenced THEN 'blocked'
            WHEN warehouse_id IN ({listed}) AND NOT EXISTS (SELECT 1 FROM hit) THEN 'deleted'
            ELSE 'kept' END AS outcome
FROM rows_""",
    )


# ---------------------------------------------------------------------------
# Whole-table audits
# ---------------------------------------------------------------------------
def _broken(table: str, source: str, key: str, rules: list[tuple[str, str, str]], absent: tuple[str, ...] = ()) -> str:
    """UNION ALL of one SELECT per (rule, column, condition), duplicate keys, and absent NOT NULL columns."""
    parts = [
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, "
        f"CAST({key} AS VARCHAR) AS row_key FROM {source} WHERE {condition}"
        for rule, column, condition in rules
    ]
    parts.append(
        f"SELECT '{table}', 'primary_key', '{key}', CAST({key} AS VARCHAR) FROM {source} "
        f"GROUP BY {key} HAVING count(*) > 1 OR {key} IS NULL"
    )
    parts += [f"SELECT '{table}', 'not_null', '{c}', NULL" for c in absent]
    return "\nUNION ALL ".join(parts)


def _null(*names: str) -> list[tuple[str, str, str]]:
    return [("not_null", c, f"{c} IS NULL") for c in names]


def _orphan(column: str, parent: str, parent_key: str, source: str | None = None) -> tuple[str, str, str]:
    return (
        f"foreign_key:{parent}",
        column,
        f"{column} IS NOT NULL AND {column} NOT IN (SELECT {parent_key} FROM {source or parent})",
    )


_PRODUCT = _orphan("product_id", "products", "product_id", "partial_products")
AUDITS = {
    "inventory": with_fixtures(
        "inventory",
        "partial_products",
        "storage_zones",
        extra="d_inventory AS (SELECT * REPLACE (quantity - 2 AS quantity) FROM inventory)",
        body=_broken(
            "inventory",
            "d_inventory",
            "inventory_id",
            [
                *_null("inventory_id", "product_id", "zone_id", "quantity"),
                ("ck_inventory_quantity", "quantity", "quantity < 0"),
                ("varchar(100)", "batch_number", "length(rtrim(batch_number)) > 100"),
                _PRODUCT,
                _orphan("zone_id", "storage_zones", "zone_id"),
            ],
        ),
    ),
    "purchase_orders": with_fixtures(
        "d_purchase_orders",
        "partial_products",
        body=_broken(
            "purchase_orders",
            "d_purchase_orders",
            "purchase_order_id",
            [
                *_null("purchase_order_id", "product_id", "status", "quantity_ordered"),
                ("ck_quantity_ordered", "quantity_ordered", "quantity_ordered <= 0"),
                ("enum", "status", "status NOT IN ('Новый', 'В обработке', 'Отправлен', 'Получен', 'Отменен')"),
                _PRODUCT,
            ],
            absent=("supplier_id", "purchase_price"),
        ),
    ),
    "stock_takes": with_fixtures(
        "stock_takes",
        "d_stock_takes",
        "storage_zones",
        "employees",
        body=_broken(
            "stock_takes",
            "d_stock_takes",
            "stock_take_id",
            [
                *_null("stock_take_id", "stock_take_date", "status", "has_discrepancies", "is_initial_stock_take"),
                ("enum", "status", "status NOT IN ('Планируется', 'В процессе', 'Завершена', 'Отменена')"),
                _orphan("zone_id", "storage_zones", "zone_id"),
                _orphan("performed_by_employee_id", "employees", "employee_id"),
            ],
        ),
    ),
    "inventory_transactions": with_fixtures(
        "inventory_transactions",
        "d_transactions",
        "partial_products",
        "storage_zones",
        "employees",
        "inventory",
        body=_broken(
            "inventory_transactions",
            "d_transactions",
            "transaction_id",
            [
                *_null("transaction_id", "transaction_timestamp", "product_id", "transaction_type"),
                (
                    "enum",
                    "transaction_type",
                    "transaction_type NOT IN ('Приход', 'Расход', 'Перемещение', 'Списание', 'Инвентаризация')",
                ),
                _orphan("employee_id", "employees", "employee_id"),
                _PRODUCT,
                _orphan("source_zone_id", "storage_zones", "zone_id"),
                _orphan("destination_zone_id", "storage_zones", "zone_id"),
                _orphan("inventory_id", "inventory", "inventory_id"),
            ],
        ),
    ),
    "employees": with_fixtures(
        "d_employees",
        "user_roles",
        body=_broken(
            "employees",
            "d_employees",
            "employee_id",
            [
                *_null("employee_id", "username", "role_id"),
                ("varchar(50)", "username", "length(rtrim(username)) > 50"),
                ("varchar(20)", "phone", "length(rtrim(phone)) > 20"),
                _orphan("role_id", "user_roles", "role_id"),
            ],
            absent=("password_hash",),
        )
        + """
UNION ALL SELECT 'employees', 'unique', 'username', username FROM d_employees
WHERE username IS NOT NULL GROUP BY username HAVING count(*) > 1""",
    ),
    "products": with_fixtures(
        "d_products",
        body=_broken(
            "products",
            "d_products",
            "product_id",
            [
                *_null("product_id", "name", "category"),
                (
                    "enum",
                    "category",
                    "category NOT IN ('Электроника', 'Одежда', 'Продукты питания', 'Стройматериалы', 'Канцтовары')",
                ),
                ("varchar(150)", "name", "length(rtrim(name)) > 150"),
                (
                    "numeric(5,2)",
                    "markup_percentage",
                    "abs(round(CAST(markup_percentage AS DECIMAL(38,10)), 2)) >= 1000",
                ),
            ],
            absent=("unit_of_measure",),
        ),
    ),
    "suppliers": """
WITH d_suppliers AS (
  SELECT CAST(s_suppkey - CASE WHEN s_suppkey % 9 = 8 THEN 1 ELSE 0 END AS BIGINT) AS supplier_id,
         CASE WHEN s_suppkey % 5 = 0 THEN repeat(s_name, 20) WHEN s_suppkey % 7 <> 1 THEN s_name END AS name
  FROM supplier)
"""
    + _broken(
        "suppliers",
        "d_suppliers",
        "supplier_id",
        [*_null("supplier_id", "name"), ("varchar(150)", "name", "length(rtrim(name)) > 150")],
    ),
    "warehouses": """
WITH d_warehouses AS (
  SELECT CAST(nullif(r_regionkey + 1, 5) AS BIGINT) AS warehouse_id,
         CASE WHEN r_regionkey % 4 <> 1 THEN r_name END AS name,
         CASE WHEN r_regionkey % 2 = 0 THEN repeat(r_name, 60) END AS location
  FROM region)
"""
    + _broken(
        "warehouses",
        "d_warehouses",
        "warehouse_id",
        [
            *_null("warehouse_id", "name"),
            ("varchar(100)", "name", "length(rtrim(name)) > 100"),
            ("varchar(255)", "location", "length(rtrim(location)) > 255"),
        ],
    ),
    "storage_zones": with_fixtures(
        "warehouses",
        extra="""
d_zones AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS zone_id,
         CAST(CASE WHEN n_nationkey % 6 = 0 THEN 9 ELSE n_regionkey + 1 END AS BIGINT) AS warehouse_id,
         CASE WHEN n_nationkey < 10 THEN 'Z' || CAST(n_nationkey // 2 AS VARCHAR)
              WHEN n_nationkey % 11 <> 10 THEN n_name END AS code,
         CASE WHEN n_nationkey % 7 = 3 THEN 20000000000000000 ELSE 100 END AS storage_capacity
  FROM nation)""",
        body=_broken(
            "storage_zones",
            "d_zones",
            "zone_id",
            [
                *_null("zone_id", "warehouse_id", "code", "storage_capacity"),
                ("varchar(50)", "code", "length(rtrim(code)) > 50"),
                ("numeric(18,2)", "storage_capacity", "storage_capacity >= 10000000000000000"),
                _orphan("warehouse_id", "warehouses", "warehouse_id"),
            ],
        )
        + """
UNION ALL SELECT 'storage_zones', 'unique', 'code', code FROM d_zones
WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1""",
    ),
    "user_roles": """
WITH d_roles AS (
  SELECT CAST(n_nationkey AS BIGINT) AS role_id,
         CASE WHEN n_nationkey % 9 <> 8 THEN 'role ' || CAST(n_nationkey % 20 AS VARCHAR) END AS role_name,
         CASE WHEN n_nationkey % 4 = 0 THEN repeat(n_name, 60) END AS description
  FROM nation)
"""
    + _broken(
        "user_roles",
        "d_roles",
        "role_id",
        [
            *_null("role_id", "role_name"),
            ("varchar(50)", "role_name", "length(rtrim(role_name)) > 50"),
            ("varchar(255)", "description", "length(rtrim(description)) > 255"),
        ],
    )
    + """
UNION ALL SELECT 'user_roles', 'unique', 'role_name', role_name FROM d_roles
WHERE role_name IS NOT NULL GROUP BY role_name HAVING count(*) > 1""",
}
