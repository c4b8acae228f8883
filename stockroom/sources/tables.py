"""Reading and writing the ten warehouse tables as Parquet with their declared schema.

``read_table`` never infers a schema: the declared ``StructType`` is given to the
reader, so a file with a drifted type fails fast instead of changing a report.

``write_table`` is the INSERT of the original scripts.  Rows are conformed to the
declared column order and types, and each table is laid out for the reports that
read it at scale:

* inventory is range-partitioned and sorted by ``expiration_date``, so the pushed
  date bounds of the expiry report skip whole files and row groups by their
  min/max statistics;
* stocktakes are clustered by status and the discrepancy flag, the filter of the
  stocktake reports;
* the other tables are written as they come: no report filters them, and a range
  shuffle at write time would cost more than it saves.

Appends are idempotent per ``batch_id`` when one is given: the batch is written to
its own ``_batch=<id>`` partition with dynamic partition overwrite, so a retried
batch replaces itself instead of duplicating rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stockroom import schemas

# Clustering columns per table; tables not listed are written as they come (a
# range shuffle at write time is only worth it where a report's pushed filter can
# then skip row groups).  The primary key is the last column so that a hot value
# (NULL expiry dates are ~30 % of batches; one status holds a quarter of all
# stocktakes) is split over several files by the range partitioner instead of
# landing in one task.
CLUSTER_BY: dict[str, tuple[str, ...]] = {
    # R1/R2 bound expiration_date
    "inventory": ("expiration_date", "inventory_id"),
    # R3-R5 read only completed stocktakes with discrepancies
    "stock_takes": ("status", "has_discrepancies", "stock_take_id"),
}

BATCH_COLUMN = "_batch"

# Inventory by expiry month: the partition column of the stored table.
MONTH_COLUMN = "expiration_month"
MONTHLY_INVENTORY = "inventory_by_month"

# Rows in one file of a stored report: a file is read by one task, in its order.
ORDERED_FILE_ROWS = 500_000


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns of ``table`` in order, cast to the declared types (missing ones NULL)."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(c.name) if c.name in present else F.lit(None)).cast(c.dtype).alias(c.name)
            for c in schemas.columns(table)
        ]
    )


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Read ``<root>/<table>`` with the declared schema (batch partitions, if any, are read too)."""
    return spark.read.schema(schemas.struct_type(table)).parquet(table_path(root, table))


def write_table(
    df: DataFrame,
    root: str,
    table: str,
    mode: str = "append",
    batch_id: int | None = None,
    files_per_write: int | None = None,
) -> None:
    """Write ``df`` as rows of ``table`` under ``root`` (see module notes for layout)."""
    out = conform(df, table)
    keys = CLUSTER_BY.get(table)
    if keys:
        ranged = out.repartitionByRange(files_per_write, *keys) if files_per_write else out.repartitionByRange(*keys)
        out = ranged.sortWithinPartitions(*keys)
    elif files_per_write:
        out = out.repartition(files_per_write)
    path = table_path(root, table)
    if batch_id is None:
        out.write.mode(mode).parquet(path)
        return
    (
        out.withColumn(BATCH_COLUMN, F.lit(int(batch_id)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH_COLUMN)
        .parquet(path)
    )


# ---------------------------------------------------------------------------
# Inventory partitioned by expiry month
# ---------------------------------------------------------------------------
def write_inventory_by_month(inventory: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Write inventory as ``<root>/inventory_by_month/expiration_month=<first of month>/``.

    The expiry report then reads only the months its horizon touches.  Rows are range-partitioned by
    (month, date, key) first, so a month is spread over as many files as it has rows for, most tasks write one
    month only, and batches without an expiry date (a month of their own) do not meet in one task.
    """
    keys = (MONTH_COLUMN, "expiration_date", "inventory_id")
    out = conform(inventory, "inventory").withColumn(MONTH_COLUMN, F.trunc("expiration_date", "month"))
    ranged = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.write.mode(mode).partitionBy(MONTH_COLUMN).parquet(table_path(root, MONTHLY_INVENTORY))


def read_inventory_by_month(spark: SparkSession, root: str) -> DataFrame:
    """The table of :func:`write_inventory_by_month`, with its partition column as last column."""
    schema = schemas.struct_type("inventory").add(MONTH_COLUMN, "date")
    return spark.read.schema(schema).parquet(table_path(root, MONTHLY_INVENTORY))


# ---------------------------------------------------------------------------
# Stored reports whose file order is the report's order
# ---------------------------------------------------------------------------
def write_ordered(report: DataFrame, path: str, keys: list[Column], files: int | None = None) -> None:
    """Store ``report`` so that its files in name order, each read from its start, give ``keys`` order.

    One range partitioning by ``keys`` and a sort inside each range; nothing is gathered in one task.  End
    ``keys`` with a unique column, or a value shared by many rows cannot be split over files.
    """
    ranged = report.repartitionByRange(files, *keys) if files else report.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", ORDERED_FILE_ROWS).parquet(path)


def ordered_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a stored report in the order of their names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath() for f in found if f.getPath().getName().endswith(".parquet")]
    return [p.toString() for p in sorted(names, key=lambda p: p.getName())]


def iterate_ordered(spark: SparkSession, path: str) -> Iterator[Row]:
    """The rows of a stored report in its order, without a sort: one file at a time.

    The first page of a report of any size reads its first file only.
    """
    for file in ordered_files(spark, path):
        yield from spark.read.parquet(file).toLocalIterator()
