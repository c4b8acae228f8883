"""The command line: load, report, audit."""

from __future__ import annotations

from stockroom.__main__ import main
from stockroom.sources import tables


def test_load_report_audit(spark, tmp_path):
    root = str(tmp_path / "wh")
    main(["load", root, "--scale", "0.05", "--as-of", "2024-06-01"])
    assert tables.read_table(spark, root, "inventory").count() == 2500
    out = str(tmp_path / "reorder")
    main(["report", "reorder", root, "--out", out])
    assert spark.read.parquet(out).count() == 25  # every generated product is active
    audit = str(tmp_path / "audit")
    main(["audit", root, "--out", audit])
    assert spark.read.parquet(audit).count() == 0
    answer = str(tmp_path / "sql")
    main(["sql", root, "SELECT COUNT(*) AS n FROM v_ProductsToReorder WHERE ReorderLevel >= 0", "--out", answer])
    assert spark.read.parquet(answer).first().n == 25
