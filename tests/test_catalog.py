"""Report queries written against the original names run unchanged through spark.sql."""

from __future__ import annotations

from stockroom.plans.registry import ORACLE_SQL
from stockroom.sources import catalog
from stockroom.sources import fixtures as fx
from tests.conftest import SF_SMALL
from tests.oracle_util import compare, duck


def test_original_names_resolve(spark):
    tables = fx.load_all(spark, SF_SMALL)
    catalog.register_sql_names(tables, fx.AS_OF)

    week = spark.sql(
        "SELECT ProductName, BatchNumber, Quantity, ExpirationDate, DaysUntilExpiration, WarehouseName, ZoneCode "
        "FROM vw_ExpiringInventory WHERE DaysUntilExpiration <= 7"
    )
    assert week.count() == 10

    per_employee = spark.sql(
        "SELECT Username, FirstName, LastName, COUNT(StockTakeID) AS NumberOfSecondaryDiscrepancyStockTakes "
        "FROM vw_EmployeesWithCompletedSecondaryDiscrepancyStockTakes "
        "GROUP BY Username, FirstName, LastName ORDER BY NumberOfSecondaryDiscrepancyStockTakes DESC"
    )
    assert per_employee.count() == 72

    assert spark.sql("SELECT * FROM v_ProductsToReorder WHERE NeedsReorder").count() == 5
    # base tables answer to their original spelling too
    assert spark.sql("SELECT COUNT(*) FROM StorageZones sz JOIN Warehouses w ON sz.WarehouseID = w.WarehouseID").first()[0] == 25


ORIGINAL_NAMES = {
    "r1_expiring_inventory": "SELECT * FROM vw_ExpiringInventory",
    "r3_secondary_discrepancy_stock_takes": "SELECT * FROM vw_EmployeesWithCompletedSecondaryDiscrepancyStockTakes",
    "r8_products_to_reorder": "SELECT * FROM v_ProductsToReorder",
}


def test_original_names_give_the_same_values(spark):
    """Every value under the original names equals the oracle's, column by column."""
    catalog.register_sql_names(fx.load_all(spark, SF_SMALL), fx.AS_OF)
    con = duck(SF_SMALL)
    for job, sql in ORIGINAL_NAMES.items():
        snake = {catalog.sql_name(c): c for c in con.sql(ORACLE_SQL[job]).columns}
        plain = spark.sql(sql)
        plain = plain.toDF(*[snake[c.lower()] for c in plain.columns])
        srows, drows, same_cols, same_vals = compare(plain, con, ORACLE_SQL[job])
        assert same_cols and same_vals and len(srows) == len(drows), job
