"""Generate the warehouse at a multiple of the default load, store it, and time the jobs on it.

Usage: python scripts/scale_run.py <scale> [root]

``scale`` multiplies the original default load (50 000 batches, 25 000 orders,
200 000 transactions, 50 000 stocktakes, 500 products, 100 employees ...).  Tables
are written with ``sources.tables.write_table`` (inventory clustered by expiry),
read back with their declared schema, and each job runs in full through the
``noop`` sink.  Prints one JSON line with row counts and seconds per step.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stockroom.operators import quality, replenish, reports, synth  # noqa: E402
from stockroom.plans.session import local_session  # noqa: E402
from stockroom.sources import tables  # noqa: E402


def main(argv):
    scale = float(argv[1]) if len(argv) > 1 else 10
    root = argv[2] if len(argv) > 2 else tempfile.mkdtemp(prefix="stockroom-scale-", dir="/tmp")
    spark = local_session(shuffle_partitions=int(os.environ.get("SCALE_SHUFFLE_PARTITIONS", "64")))
    sizes = {k: max(1, int(v * scale)) for k, v in synth.DEFAULT_LOAD.items() if k != "zones_per_warehouse"}
    sizes["zones_per_warehouse"] = synth.DEFAULT_LOAD["zones_per_warehouse"]
    as_of, now = "2024-06-01", "2024-06-01 12:00:00"

    timings = {}
    t0 = time.perf_counter()
    synth.load(spark, root, sizes, as_of=as_of, now=now)
    timings["generate_and_write_all"] = round(time.perf_counter() - t0, 2)

    t = {name: tables.read_table(spark, root, name) for name in synth.schemas.TABLES}
    counts = {name: df.count() for name, df in t.items()}

    r8 = reports.products_to_reorder(t["products"], t["inventory"], t["purchase_orders"])
    jobs = {
        "r1_expiring_inventory": reports.expiring_inventory(
            t["inventory"], t["products"], t["storage_zones"], t["warehouses"], as_of
        ),
        "r3_secondary_discrepancy_stock_takes": reports.secondary_discrepancy_stock_takes(
            t["employees"], t["stock_takes"]
        ),
        "r5_discrepancies_per_employee": reports.secondary_discrepancies_per_employee(
            t["employees"], t["stock_takes"]
        ),
        "r8_products_to_reorder": r8,
        "d1_replenishment_proposals": replenish.replenishment_proposals(r8, t["purchase_orders"], as_of),
        "q1_inventory_primary_key": quality.audit_primary_key(t["inventory"], "inventory_id"),
        "q4_transaction_inventory_fk": quality.audit_foreign_key(
            t["inventory_transactions"], t["inventory"], "inventory_id", "inventory_id"
        ),
        "audit_table_inventory": quality.audit_table(
            t["inventory"], "inventory", {"products": t["products"], "storage_zones": t["storage_zones"]}
        ),
    }
    for name, df in jobs.items():
        t1 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t1, 2)
    spark.stop()
    print(json.dumps({"scale": scale, "root": root, "rows": counts, "seconds": timings}))


if __name__ == "__main__":
    main(sys.argv)
