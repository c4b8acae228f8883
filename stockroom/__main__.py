"""Command line: load a warehouse, run a report, audit the tables.

    python -m stockroom load ROOT [--scale X] [--seed S] [--as-of DATE]
    python -m stockroom report NAME ROOT [--as-of DATE] [--out PATH] [--show N]
    python -m stockroom audit ROOT [--out PATH]
    python -m stockroom sql ROOT "SELECT ... FROM vw_ExpiringInventory ..." [--as-of DATE] [--out PATH]

Tables live under ROOT as Parquet (``sources.tables``).  Under ``spark-submit``
the cluster's master and settings are used; run directly, a local session starts.
Results go to ``--out`` as Parquet when given (the normal case on a cluster),
otherwise the first ``--show`` rows are printed.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from stockroom import schemas
from stockroom.operators import contacts, quality, replenish, reports, synth
from stockroom.plans.session import apply_defaults, ensure_checkpoint_dir
from stockroom.sources import catalog, tables


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("stockroom").config("spark.ui.enabled", "false")
    active = SparkSession.getActiveSession()
    spark = active or builder.getOrCreate()
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    return spark


def _tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: tables.read_table(spark, root, name) for name in schemas.TABLES}


def _report(name: str, t: dict[str, DataFrame], as_of) -> DataFrame:
    r1 = lambda: reports.expiring_inventory(t["inventory"], t["products"], t["storage_zones"], t["warehouses"], as_of)
    r8 = lambda: reports.products_to_reorder(t["products"], t["inventory"], t["purchase_orders"])
    r3 = lambda: reports.secondary_discrepancy_stock_takes(t["employees"], t["stock_takes"])
    builders = {
        "expiring": r1,
        "expiring-7": lambda: reports.expiring_within(
            reports.expiring_inventory(
                t["inventory"], t["products"], t["storage_zones"], t["warehouses"], as_of, ordered=False
            ),
            7,
        ),
        "discrepancies": r3,
        "discrepancy-listing": lambda: reports.secondary_discrepancy_listing(r3()),
        "discrepancies-per-employee": lambda: reports.secondary_discrepancies_per_employee(
            t["employees"], t["stock_takes"]
        ),
        "stock": lambda: reports.product_stock(t["inventory"]),
        "on-order": lambda: reports.product_on_order(t["purchase_orders"]),
        "reorder": r8,
        "replenishment": lambda: replenish.replenishment_from_tables(
            t["products"], t["inventory"], t["purchase_orders"], as_of
        ),
        "contacts": lambda: contacts.supplier_contacts(t["suppliers"]),
    }
    if name not in builders:
        raise SystemExit(f"unknown report {name!r}; choose from {', '.join(builders)}")
    return builders[name]()


def _audit(t: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for name, df in t.items():
        parents = {fk.parent: t[fk.parent] for fk in schemas.FOREIGN_KEYS if fk.child == name}
        parts.append(quality.audit_table(df, name, parents))
    return reduce(DataFrame.unionByName, parts)


def _emit(df: DataFrame, out: str | None, show: int) -> None:
    if out:
        df.write.mode("overwrite").parquet(out)
    else:
        df.show(show, truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stockroom")
    sub = parser.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="generate and store all ten tables")
    load.add_argument("root")
    load.add_argument("--scale", type=float, default=1.0, help="multiple of the default load")
    load.add_argument("--seed", type=int, default=synth.DEFAULT_SEED)
    load.add_argument("--as-of", default=None)
    report = sub.add_parser("report", help="run one report over stored tables")
    report.add_argument("name")
    report.add_argument("root")
    report.add_argument("--as-of", default=None)
    report.add_argument("--out", default=None)
    report.add_argument("--show", type=int, default=20)
    audit = sub.add_parser("audit", help="check every declared rule of every stored table")
    audit.add_argument("root")
    audit.add_argument("--out", default=None)
    audit.add_argument("--show", type=int, default=20)
    sql = sub.add_parser("sql", help="run SQL over the stored tables and views under their original names")
    sql.add_argument("root")
    sql.add_argument("query")
    sql.add_argument("--as-of", default=None)
    sql.add_argument("--out", default=None)
    sql.add_argument("--show", type=int, default=20)
    args = parser.parse_args(argv)

    spark = _session()
    if args.command == "load":
        sizes = {k: max(1, int(v * args.scale)) for k, v in synth.DEFAULT_LOAD.items() if k != "zones_per_warehouse"}
        stored = synth.load(spark, args.root, sizes, seed=args.seed, as_of=args.as_of)
        for name, df in stored.items():
            print(f"{name}: {df.count()} rows")
    elif args.command == "report":
        _emit(_report(args.name, _tables(spark, args.root), args.as_of), args.out, args.show)
    elif args.command == "audit":
        _emit(_audit(_tables(spark, args.root)), args.out, args.show)
    else:
        catalog.register_sql_names(_tables(spark, args.root), args.as_of)
        _emit(spark.sql(args.query), args.out, args.show)


if __name__ == "__main__":
    main()
