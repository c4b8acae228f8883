"""Every registered query against its DuckDB oracle, on the smallest test scale."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry
from stockroom.plans import registry
from tests.conftest import SF_MEDIUM, SF_SMALL
from tests.oracle_util import compare, duck

# the jobs of the data model; the training-data operators have tests of their own
QUERIES = {name: entry.queries()[name] for name in registry.QUERIES}
ORACLE = {name: entry.oracle_sql()[name] for name in registry.ORACLE_SQL}

# Row counts at sf0.001 (FIXTURES.md §4).
EXPECTED_ROWS = {
    "r1_expiring_inventory": 43,
    "r2_expiring_within_7_days": 10,
    "r3_secondary_discrepancy_stock_takes": 99,
    "r4_secondary_discrepancy_listing": 99,
    "r5_discrepancies_per_employee": 72,
    "r6_product_stock": 182,
    "r7_product_on_order": 150,
    "r8_products_to_reorder": 180,
    "d1_replenishment_proposals": 5,
    "d2_supplier_contacts": 10,
    "q1_duplicate_inventory_ids": 1161,
    "q2_duplicate_usernames": 1,
    "q3_null_product_columns": 5,
    "q4_foreign_key_orphans": 157,
    "q5_check_violations": 175,
    "q6_unknown_order_status": 16,
    "q7_product_name_too_long": 5,
    "q8_markup_overflow": 97,
    "q10_delete_warehouse_1": 5 + 30,
    "audit_inventory": 1434,
    "audit_purchase_orders": 77,
    "audit_stock_takes": 57,
    "audit_inventory_transactions": 387,
    "audit_employees": 51,
}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) == 59


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows, drows, same_cols, same_vals = compare(df, con, ORACLE[name])
    assert same_cols, (df.columns, name)
    assert len(srows) == len(drows)
    assert same_vals
    if name in EXPECTED_ROWS:
        assert len(srows) == EXPECTED_ROWS[name]
    assert len(srows) > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 180
    assert df.columns == [
        "product_id",
        "product_name",
        "reorder_level",
        "max_stock_level",
        "current_stock",
        "quantity_on_order",
        "needs_reorder",
    ]


def test_q10_counts(spark):
    def outcomes(name, entity):
        rows = QUERIES[name](spark, SF_SMALL).collect()
        return Counter(r.outcome for r in rows if r.entity == entity)

    # the used zones of warehouse 1 block the statement, so its spare zone stays
    assert outcomes("q10_delete_warehouse_1", "zone") == {"blocked": 5, "kept": 25}
    assert outcomes("q10_delete_warehouse_1", "warehouse") == {"blocked": 1, "kept": 4}
    assert outcomes("q10_delete_warehouses_1_and_2", "zone") == {"blocked": 10, "kept": 20}
    # a warehouse with nothing but an unused zone goes
    assert outcomes("q10_delete_spare_warehouse", "zone") == {"deleted": 1, "kept": 29}
    assert outcomes("q10_delete_spare_warehouse", "warehouse") == {"deleted": 1, "kept": 4}


def test_contacts_have_websites_and_unreadable_rows(spark):
    rows = QUERIES["d2_supplier_contacts"](spark, SF_MEDIUM).collect()
    assert sum(r.website is not None for r in rows) > 20
    assert sum(r.phone is None for r in rows) > 10


SPARK_TO_DUCK = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp": "TIMESTAMP",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_column_types_match_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.sql(ORACLE[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for col, spark_type in df.dtypes:
        assert duck_types[col] == SPARK_TO_DUCK.get(spark_type, spark_type.upper()), (name, col)


@pytest.fixture(scope="module")
def con_medium():
    return duck(SF_MEDIUM)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_at_gate_scale(spark, con_medium, name):
    """The driver's correctness gate runs at sf0.01; check the same comparison here."""
    srows, drows, same_cols, same_vals = compare(QUERIES[name](spark, SF_MEDIUM), con_medium, ORACLE[name])
    assert same_cols and len(srows) == len(drows) and same_vals, name
