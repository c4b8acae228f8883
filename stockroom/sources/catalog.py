"""Register the warehouse tables and report views under their original SQL names.

The original schema spells identifiers in mixed case without underscores
(``StorageZones.ZoneID``); unquoted, the database folds them to lower case
(``storagezones.zoneid``).  Spark resolves names case-insensitively, so a table or
column whose snake_case name loses its underscores answers to the original
spelling.  After :func:`register_sql_names`, report queries written for the
original database run unchanged through ``spark.sql`` — for example::

    SELECT ProductName, DaysUntilExpiration FROM vw_ExpiringInventory
    WHERE DaysUntilExpiration <= 7

The views are the library's report functions (R1, R3, R8) with ``as_of`` in place
of the current date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from stockroom.operators import reports

# Original view names (identifiers of the data model).
VIEW_SQL_NAMES = {
    "expiring_inventory": "vw_ExpiringInventory",
    "secondary_discrepancy_stock_takes": "vw_EmployeesWithCompletedSecondaryDiscrepancyStockTakes",
    "products_to_reorder": "v_ProductsToReorder",
}


def sql_name(snake: str) -> str:
    """``storage_zones`` -> ``storagezones``: the folded form of the original identifier."""
    return snake.replace("_", "")


def with_sql_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[sql_name(c) for c in df.columns])


def register_sql_names(tables: dict[str, DataFrame], as_of=None) -> list[str]:
    """Register every given table and the three report views; return the view names."""
    names = []
    for table, df in tables.items():
        with_sql_names(df).createOrReplaceTempView(sql_name(table))
        names.append(sql_name(table))
    views = {
        "expiring_inventory": reports.expiring_inventory(
            tables["inventory"], tables["products"], tables["storage_zones"], tables["warehouses"], as_of
        ),
        "secondary_discrepancy_stock_takes": reports.secondary_discrepancy_stock_takes(
            tables["employees"], tables["stock_takes"]
        ),
        "products_to_reorder": reports.products_to_reorder(
            tables["products"], tables["inventory"], tables["purchase_orders"]
        ),
    }
    for key, df in views.items():
        with_sql_names(df).createOrReplaceTempView(VIEW_SQL_NAMES[key])
        names.append(VIEW_SQL_NAMES[key])
    return names
