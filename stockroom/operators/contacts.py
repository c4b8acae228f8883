"""Supplier contacts read back from the JSON column.

The contact document has the keys phone, email, website and notes.  A missing key,
a JSON null or unparsable text gives NULL fields (``from_json`` in its default
permissive mode); the job is a map-only projection.

:func:`contact_variants` keeps the whole document as a VARIANT instead: unknown keys and the types of
their values survive, also through Parquet, and text that is no JSON is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTACT_SCHEMA = "phone string, email string, website string, notes string"


def supplier_contacts(suppliers: DataFrame) -> DataFrame:
    """supplier_id, phone, email, website, notes."""
    doc = F.from_json(F.col("contact_info"), CONTACT_SCHEMA)
    return suppliers.select(
        "supplier_id",
        doc.getField("phone").alias("phone"),
        doc.getField("email").alias("email"),
        doc.getField("website").alias("website"),
        doc.getField("notes").alias("notes"),
    )


def contact_variants(suppliers: DataFrame) -> DataFrame:
    """supplier_id, contact: the JSON document as a VARIANT (NULL where the text is no JSON)."""
    return suppliers.select("supplier_id", F.try_parse_json(F.col("contact_info")).alias("contact"))


def variant_contacts(variants: DataFrame) -> DataFrame:
    """The columns of :func:`supplier_contacts` read from :func:`contact_variants`.

    A JSON null is NULL, and a value of another type (a number, a nested object) comes as its text.
    """

    def field(name: str) -> Column:
        found = F.try_variant_get(F.col("contact"), f"$.{name}", "string")
        nested = F.try_variant_get(F.col("contact"), f"$.{name}", "variant")  # what no cast to text is defined for
        return F.coalesce(found, F.when(~F.is_variant_null(nested), F.to_json(nested))).alias(name)

    return variants.select("supplier_id", *[field(c.split()[0]) for c in CONTACT_SCHEMA.split(", ")])
