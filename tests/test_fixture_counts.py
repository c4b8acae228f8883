"""Row counts at sf0.01 equal the table in FIXTURES.md §4."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockroom.plans import registry
from stockroom.sources import fixtures as fx
from tests.conftest import SF_MEDIUM

EXPECTED = {
    "r1_expiring_inventory": 508,
    "r2_expiring_within_7_days": 132,
    "r3_secondary_discrepancy_stock_takes": 1046,
    "r5_discrepancies_per_employee": 758,
    "r6_product_stock": 1819,
    "r7_product_on_order": 1497,
    "r8_products_to_reorder": 1800,
    "d1_replenishment_proposals": 42,
    "d2_supplier_contacts": 100,
    "q1_duplicate_inventory_ids": 11785,
    "q2_duplicate_usernames": 14,
    "q3_null_product_columns": 35,
    "q4_foreign_key_orphans": 1531,
    "q5_check_violations": 1450,
    "q6_unknown_order_status": 155,
    "q7_product_name_too_long": 49,
    "q8_markup_overflow": 1504,
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_count(spark, name):
    assert registry.QUERIES[name](spark, SF_MEDIUM).count() == EXPECTED[name]


def test_fixture_sizes_and_reorder_breakdown(spark):
    assert fx.inventory(spark, SF_MEDIUM).count() == 60000
    assert fx.purchase_orders(spark, SF_MEDIUM).count() == 15000
    assert fx.stock_takes(spark, SF_MEDIUM).count() == 15000
    r8 = registry.QUERIES["r8_products_to_reorder"](spark, SF_MEDIUM)
    assert r8.filter(F.col("needs_reorder")).count() == 42
    assert r8.filter(F.col("current_stock") == 0).count() == 163
