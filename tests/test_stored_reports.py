"""Stored ordered reports and contact documents kept as VARIANT."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from stockroom.operators import contacts, reports
from stockroom.sources import tables
from tests.conftest import SF_SMALL
from tests.oracle_util import duck

STORED = {
    "r1_expiring_inventory": (reports.expiring_order, "ORDER BY days_until_expiration, inventory_id"),
    "r4_secondary_discrepancy_listing": (
        reports.listing_order,
        "ORDER BY stock_take_date DESC, last_name NULLS LAST, stock_take_id",
    ),
}


@pytest.mark.parametrize("name", sorted(STORED))
@pytest.mark.parametrize("rows_a_file", [500_000, 7])
def test_files_in_name_order_are_the_report(spark, tmp_path, monkeypatch, name, rows_a_file):
    monkeypatch.setattr(tables, "ORDERED_FILE_ROWS", rows_a_file)
    keys, order = STORED[name]
    path = str(tmp_path / name)
    tables.write_ordered(entry.queries()[name](spark, SF_SMALL), path, keys(), files=4)
    files = sorted(glob.glob(f"{path}/*.parquet"))
    assert len(files) >= (3 if rows_a_file > 100 else 6)
    read = [tuple(r.values()) for f in files for r in pq.read_table(f).to_pylist()]
    expected = duck(SF_SMALL).execute(f"SELECT * FROM ({entry.oracle_sql()[name]}) {order}").fetchall()
    assert read == expected and len(read) > 40
    assert [tuple(r) for r in tables.iterate_ordered(spark, path)] == expected


DOCUMENTS = [
    (1, '{"phone":"+1","email":"a@b.c","website":"http://x","notes":"n"}'),
    (2, '{"phone":null,"email":"a@b.c"}'),
    (3, '{"phone":5,"fax":"+9","tags":["x",1],"notes":{"by":"me"}}'),
    (4, '{"phone":"+1",'),
    (5, "phone +1"),
    (6, None),
    (7, "{}"),
    (8, "[1, 2]"),
    (9, '{"notes":""}'),
]


def test_contact_documents_as_variant_through_parquet(spark, tmp_path):
    path = str(tmp_path / "variants")
    suppliers = spark.createDataFrame(DOCUMENTS, "supplier_id bigint, contact_info string")
    contacts.contact_variants(suppliers).write.parquet(path)
    stored = spark.read.parquet(path)
    assert dict(stored.dtypes)["contact"] == "variant"
    got = {r.supplier_id: tuple(r)[1:] for r in contacts.variant_contacts(stored).collect()}
    nothing = (None, None, None, None)
    assert got == {
        1: ("+1", "a@b.c", "http://x", "n"),
        2: (None, "a@b.c", None, None),
        3: ("5", None, None, '{"by":"me"}'),
        4: nothing,
        5: nothing,
        6: nothing,
        7: nothing,
        8: nothing,
        9: (None, None, None, ""),
    }
    kept = stored.selectExpr(
        "supplier_id", "try_variant_get(contact, '$.fax', 'string') AS fax", "schema_of_variant(contact) AS kind"
    )
    by_id = {r.supplier_id: r for r in kept.collect()}
    assert by_id[3].fax == "+9" and "tags: ARRAY" in by_id[3].kind and by_id[3].kind.count("phone: BIGINT") == 1
    assert by_id[4].kind is None and by_id[5].kind is None


def test_variant_fields_equal_the_typed_fields(spark):
    suppliers = entry.queries()["d2_supplier_contacts"](spark, SF_SMALL).collect()
    variants = entry.queries()["d2_contacts_from_variant"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, suppliers)) == sorted(map(tuple, variants))
