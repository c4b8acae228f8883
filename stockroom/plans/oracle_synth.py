"""Oracle SQL for the generators (G1-G10), in DuckDB's dialect.

The seeded uniform is restated in SQL::

    ('0x' || substr(md5('<seed>|<tag>|' || id), 1, 13))::UBIGINT / 2^52

and a foreign-key draw is a join on ``row_number() OVER (ORDER BY key) - 1 =
floor(u * count(parent))``.  Seeds and tags are the generators' own; the rest is
written independently of the DataFrame code.
"""

from __future__ import annotations

from stockroom import schemas
from stockroom.functions.random import TEXT_ALPHABET
from stockroom.operators.synth import DEFAULT_SEED, DESTINATION_ZONE_TYPES, SOURCE_ZONE_TYPES
from stockroom.plans.oracle import AS_OF, FIXTURE_CTES

SEED = DEFAULT_SEED
NOW = "TIMESTAMP '1998-06-01 12:00:00'"


def u(tag: str, ident: str = "i") -> str:
    return f"(('0x' || substr(md5('{SEED}|{tag}|' || CAST({ident} AS VARCHAR)), 1, 13))::UBIGINT / 4503599627370496.0)"


def uint(tag: str, low: int, count: int, ident: str = "i") -> str:
    return f"CAST(floor({u(tag, ident)} * {count}) + {low} AS INTEGER)"


def hex_token(tag: str, length: int, ident: str = "i") -> str:
    return f"substr(md5('{SEED}|{tag}|' || CAST({ident} AS VARCHAR)), 1, {length})"


def text(tag: str, lo: int, hi: int, ident: str = "i") -> str:
    length = uint(f"{tag}.len", lo, hi - lo + 1, ident)
    char_id = f"CAST({ident} AS VARCHAR) || ':' || CAST(k AS VARCHAR)"
    char = f"substr('{TEXT_ALPHABET}', {uint(f'{tag}.chr', 1, len(TEXT_ALPHABET), char_id)}, 1)"
    return (
        f"CASE WHEN {length} > 0 THEN trim(array_to_string(list_transform(range(1, {length} + 1), "
        f"lambda k: {char}), '')) ELSE '' END"
    )


def enum(tag: str, domain: tuple[str, ...], ident: str = "i") -> str:
    values = ", ".join(f"'{v}'" for v in domain)
    return f"([{values}])[{uint(tag, 1, len(domain), ident)}]"


def maybe(tag: str, value: str, p: float, ident: str = "i") -> str:
    return f"CASE WHEN {u(tag, ident)} < {p} THEN {value} END"


def dec(tag: str, scale: int, offset: int, precision: int, ident: str = "i") -> str:
    return f"CAST(round(CAST({u(tag, ident)} * {scale} + {offset} AS DECIMAL(18,10)), 2) AS DECIMAL({precision},2))"


def ids(count_sql: str) -> str:
    return f"ids AS (SELECT unnest(generate_series(1, ({count_sql}))) AS i)"


def indexed(name: str, source: str, key: str, carry: tuple[str, ...] = ()) -> str:
    cols = ", ".join((key,) + carry)
    return (
        f"{name} AS (SELECT {cols}, row_number() OVER (ORDER BY {cols}) - 1 AS idx, "
        f"count(*) OVER () AS cnt FROM {source} WHERE {key} IS NOT NULL)"
    )


def draw(parent: str, tag: str) -> str:
    """Join condition for one draw from an indexed parent aliased ``parent``."""
    return f"{parent}.idx = CAST(floor({u(tag)} * (SELECT max(cnt) FROM {parent})) AS BIGINT)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ---------------------------------------------------------------------------
# G1: existing roles are one per market segment of ``customer``
# ---------------------------------------------------------------------------
_seed_values = ", ".join(f"({i}, '{n}', '{d}')" for i, (n, d) in enumerate(schemas.ROLES))
G1 = _with(
    "existing AS (SELECT CAST(min(c_custkey) AS BIGINT) AS role_id, c_mktsegment AS role_name, "
    "CAST(NULL AS VARCHAR) AS description FROM customer GROUP BY c_mktsegment)",
    f"seeds AS (SELECT * FROM (VALUES {_seed_values}) t(ord, role_name, description))",
    "missing AS (SELECT * FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.role_name = s.role_name))",
) + """
SELECT role_id, role_name, description FROM existing
UNION ALL
SELECT CAST((SELECT coalesce(max(role_id), 0) FROM existing) + row_number() OVER (ORDER BY ord) AS BIGINT),
       role_name, description
FROM missing"""


def _contact(tag: str) -> str:
    phone = f"'+' || lpad(CAST(CAST(floor({u(tag + '.phone')} * 1e10) AS BIGINT) AS VARCHAR), 12, '0')"
    return (
        f"json_object('email', 'contact_' || {hex_token(tag + '.email', 8)} || '@supplier.com', "
        f"'notes', {text(tag + '.notes', 10, 50)}, 'phone', {phone}, "
        f"'website', 'http://supplier_' || {hex_token(tag + '.web', 8)} || '.com')::VARCHAR"
    )


G2 = _with(FIXTURE_CTES["suppliers"], ids("SELECT count(*) FROM supplier")) + f"""
SELECT supplier_id, name, CAST(NULL AS VARCHAR) AS address, contact_info FROM suppliers
UNION ALL
SELECT CAST(i AS BIGINT) + (SELECT max(supplier_id) FROM suppliers) AS supplier_id, 'Supplier ' || CAST(i AS VARCHAR) AS name,
       'Address ' || CAST(i AS VARCHAR) || ', City ' || CAST({uint('suppliers.city', 1, 100)} AS VARCHAR) AS address,
       {_contact('suppliers.contact')} AS contact_info
FROM ids"""

G3 = _with(FIXTURE_CTES["products"], ids("SELECT count(*) FROM part")) + f"""
SELECT product_id, name, CAST(NULL AS VARCHAR) AS description, category, CAST(NULL AS VARCHAR) AS unit_of_measure,
       CAST(NULL AS DECIMAL(5,2)) AS markup_percentage, reorder_level, max_stock_level, is_active FROM products
UNION ALL
SELECT CAST(i AS BIGINT) + (SELECT max(product_id) FROM products) AS product_id, 'Product ' || CAST(i AS VARCHAR) AS name,
       {text('products.description', 20, 100)} AS description,
       {enum('products.category', schemas.PRODUCT_CATEGORY)} AS category,
       {enum('products.unit', schemas.UNIT_OF_MEASURE)} AS unit_of_measure,
       {dec('products.markup', 50, 5, 5)} AS markup_percentage,
       {uint('products.reorder', 5, 20)} AS reorder_level,
       {uint('products.max_stock', 50, 100)} AS max_stock_level,
       TRUE AS is_active
FROM ids"""

G4 = _with(FIXTURE_CTES["warehouses"], ids("SELECT count(*) FROM region")) + f"""
SELECT warehouse_id, name, location FROM warehouses
UNION ALL
SELECT CAST(i AS BIGINT) + (SELECT max(warehouse_id) FROM warehouses), 'Warehouse ' || CAST(i AS VARCHAR),
       'Warehouse Address ' || CAST(i AS VARCHAR) || ', City ' || CAST({uint('warehouses.city', 1, 100)} AS VARCHAR)
FROM ids"""

G5 = (
    _with(
        FIXTURE_CTES["warehouses"],
        indexed("pw", "warehouses", "warehouse_id"),
        ids("SELECT count(*) * 20 FROM warehouses"),
    )
    + f"""
SELECT CAST(i AS BIGINT) AS zone_id, pw.warehouse_id,
       'ZONE-' || CAST(i AS VARCHAR) || '-' || CAST({uint('zones.code', 0, 1000)} AS VARCHAR) AS code,
       {dec('zones.capacity', 500, 100, 18)} AS storage_capacity
FROM ids LEFT JOIN pw ON {draw('pw', 'zones.warehouse')}"""
)

_positions = " ".join(f"WHEN '{r}' THEN '{p}'" for r, p in schemas.POSITION_BY_ROLE)
G6 = (
    _with(
        f"roles AS ({G1})",
        indexed("pr", "roles", "role_id", ("role_name",)),
        ids("SELECT count(*) FROM customer"),
    )
    + f"""
SELECT CAST(i AS BIGINT) AS employee_id, 'emp_' || CAST(i AS VARCHAR) AS username,
       md5('password' || CAST(i AS VARCHAR)) AS password_hash,
       'FirstName' || CAST(i AS VARCHAR) AS first_name, 'LastName' || CAST(i AS VARCHAR) AS last_name,
       pr.role_id, {AS_OF} AS hire_date,
       '+' || lpad(CAST(CAST(floor({u('employees.phone')} * 1e10) AS BIGINT) AS VARCHAR), 12, '0') AS phone,
       'emp' || CAST(i AS VARCHAR) || '@company.com' AS email,
       CASE pr.role_name {_positions} ELSE '{schemas.DEFAULT_POSITION}' END AS position
FROM ids LEFT JOIN pr ON {draw('pr', 'employees.role')}"""
)

G7 = (
    _with(
        FIXTURE_CTES["products"],
        FIXTURE_CTES["storage_zones"],
        indexed("pp", "products", "product_id"),
        indexed("pz", "storage_zones", "zone_id"),
        ids("SELECT count(*) FROM lineitem"),
    )
    + f"""
SELECT CAST(i AS BIGINT) AS inventory_id, pp.product_id, pz.zone_id,
       {uint('inventory.quantity', 0, 500)} AS quantity,
       'BATCH-' || {hex_token('inventory.batch', 10)} || '-' || strftime({AS_OF}, '%Y%m%d') AS batch_number,
       {maybe('inventory.has_expiry', f"{AS_OF} + {uint('inventory.expiry_days', 0, 730)}", 0.7)} AS expiration_date
FROM ids
LEFT JOIN pp ON {draw('pp', 'inventory.product')}
LEFT JOIN pz ON {draw('pz', 'inventory.zone')}"""
)

G8 = (
    _with(
        FIXTURE_CTES["products"],
        FIXTURE_CTES["suppliers"],
        indexed("pp", "products", "product_id"),
        indexed("ps", "suppliers", "supplier_id"),
        ids("SELECT count(*) FROM orders"),
    )
    + f"""
SELECT CAST(i AS BIGINT) AS purchase_order_id, pp.product_id, ps.supplier_id,
       {AS_OF} - {uint('orders.order_days', 0, 180)} AS order_date,
       {maybe('orders.has_expected', f"{AS_OF} + {uint('orders.expected_days', 0, 30)}", 0.8)} AS expected_delivery_date,
       {maybe('orders.has_actual', f"{AS_OF} - {uint('orders.actual_days', 0, 90)}", 0.6)} AS actual_delivery_date,
       {enum('orders.status', schemas.ORDER_STATUS)} AS status,
       {dec('orders.price', 1000, 50, 18)} AS purchase_price,
       {uint('orders.quantity', 1, 50)} AS quantity_ordered
FROM ids
LEFT JOIN pp ON {draw('pp', 'orders.product')}
LEFT JOIN ps ON {draw('ps', 'orders.supplier')}"""
)

_src = ", ".join(f"'{t}'" for t in SOURCE_ZONE_TYPES)
_dst = ", ".join(f"'{t}'" for t in DESTINATION_ZONE_TYPES)
G9 = (
    _with(
        FIXTURE_CTES["inventory"],
        FIXTURE_CTES["employees"],
        FIXTURE_CTES["storage_zones"],
        indexed("pi", "inventory", "inventory_id", ("product_id",)),
        indexed("pe", "employees", "employee_id"),
        indexed("pzs", "storage_zones", "zone_id"),
        indexed("pzd", "storage_zones", "zone_id"),
        ids("SELECT count(*) FROM events"),
        f"typed AS (SELECT i, {enum('tx.type', schemas.TRANSACTION_TYPE)} AS transaction_type FROM ids)",
    )
    + f"""
SELECT CAST(i AS BIGINT) AS transaction_id,
       {NOW} - to_days({uint('tx.days_back', 0, 365)}) AS transaction_timestamp,
       {maybe('tx.has_employee', 'pe.employee_id', 0.8)} AS employee_id,
       pi.product_id,
       CASE WHEN transaction_type IN ({_src}) THEN pzs.zone_id END AS source_zone_id,
       CASE WHEN transaction_type IN ({_dst}) THEN pzd.zone_id END AS destination_zone_id,
       transaction_type,
       pi.inventory_id
FROM typed
LEFT JOIN pi ON {draw('pi', 'tx.inventory')}
LEFT JOIN pe ON {draw('pe', 'tx.employee')}
LEFT JOIN pzs ON {draw('pzs', 'tx.source_zone')}
LEFT JOIN pzd ON {draw('pzd', 'tx.destination_zone')}"""
)

G10 = (
    _with(
        FIXTURE_CTES["employees"],
        FIXTURE_CTES["storage_zones"],
        indexed("pe", "employees", "employee_id"),
        indexed("pz", "storage_zones", "zone_id"),
        ids("SELECT count(*) FROM orders"),
    )
    + f"""
SELECT CAST(i AS BIGINT) AS stock_take_id,
       {AS_OF} - {uint('st.days_back', 0, 365)} AS stock_take_date,
       {enum('st.status', schemas.STOCKTAKE_STATUS)} AS status,
       {maybe('st.has_zone', 'pz.zone_id', 0.5)} AS zone_id,
       {u('st.discrepancy')} < 0.3 AS has_discrepancies,
       {u('st.initial')} < 0.1 AS is_initial_stock_take,
       {maybe('st.has_employee', 'pe.employee_id', 0.8)} AS performed_by_employee_id
FROM ids
LEFT JOIN pz ON {draw('pz', 'st.zone')}
LEFT JOIN pe ON {draw('pe', 'st.employee')}"""
)


# ---------------------------------------------------------------------------
# The generators as INSERTs into a filled table: serial keys go on after the largest one
# ---------------------------------------------------------------------------
def _appended(table: str, key: str, generated: str) -> str:
    return (
        _with(FIXTURE_CTES[table], f"added AS ({generated})")
        + f"""
SELECT * FROM {table}
UNION ALL BY NAME
SELECT * REPLACE (CAST({key} + (SELECT max({key}) FROM {table}) AS BIGINT) AS {key}) FROM added"""
    )


A5 = _appended("storage_zones", "zone_id", G5)
A6 = _appended("employees", "employee_id", G6)
A7 = _appended("inventory", "inventory_id", G7)
A8 = _appended("purchase_orders", "purchase_order_id", G8)
A9 = _appended("inventory_transactions", "transaction_id", G9)
A10 = _appended("stock_takes", "stock_take_id", G10)
