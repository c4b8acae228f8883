"""Operator 10 against brute force and on awkward inputs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from stockroom.llm import decontaminate as d
from stockroom.plans.joins import BROADCAST_LIMIT_CONF
from tests.llm import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), []
        for item_id, item in items:
            ns = words(item)
            k = min(10, len(ns))
            starts = set()
            for i in range(len(ns) - k + 1) if ns else ():
                starts |= {p for p in range(len(ws) - k + 1) if ws[p : p + k] == ns[i : i + k]}
            if starts:
                found.append("" if item_id is None else str(item_id))
                hit |= {p + j for p in starts for j in range(k)}
        out.append((doc_id, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(params=["broadcast", "shuffle"])
def way(request, spark):
    """Both ways to the windows: broadcast, and shuffled as beyond the bound."""
    if request.param == "shuffle":
        spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    yield request.param
    spark.conf.unset(BROADCAST_LIMIT_CONF)


def test_against_brute_force(spark, way):
    item = edge.prose(7, 30)
    items = [(1, item), (20, item), (3, "Short ITEM here"), (4, None), (5, ""), (None, "lonely words"), (6, edge.prose(8, 10))]
    extra = [
        (100, "before " + item + " after", None, None, None, None, None, None, None),
        (101, "x short item HERE, short-item_here lonely  Words", None, None, None, None, None, None, None),
        (102, " ".join(item.split()[5:15]) + " ... " + " ".join(item.split()[8:22]), None, None, None, None, None, None, None),
        (103, " ".join(item.split()[:9]), None, None, None, None, None, None, None),
    ]
    docs = edge.documents(spark, extra)
    bench = spark.createDataFrame([(*i, "q") for i in items], "item_id bigint, text string, items string")
    found = d.contamination(docs, bench).collect()
    got = []
    for r in found:
        hit = {p for s in r.spans for p in range(s.start, s.start + s.length)}
        got.append((r.doc_id, r.n_words, len(hit), list(r["items"])))
    expected = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], items)
    assert sorted(got, key=str) == expected
    assert any(x[3] == ["1", "20"] for x in got)


def test_filters_keep_columns_and_clean_rows(spark, way):
    item = edge.prose(7, 30)
    dirty = (100, "Keep this. " + item + " And this.", "en", "s", 1, "x", "y", "z", 1)
    docs = edge.documents(spark, [dirty])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    cut = {r.doc_id: r.text for r in d.remove_spans(docs, bench).collect() if r.doc_id == 100}
    assert cut == {100: "Keep this. And this."}
    assert d.remove_spans(docs, bench).count() == docs.count()


def test_empty_tables(spark, way):
    bench = spark.createDataFrame([(1, edge.prose(7, 30))], "item_id bigint, text string")
    assert d.contamination(edge.empty(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(not r.spans for r in d.contamination(edge.documents(spark), none).collect())
    assert d.drop_contaminated(edge.documents(spark), none).count() == edge.documents(spark).count()


def test_equal_hashes_of_items_and_windows_do_not_mix(spark, way, monkeypatch):
    """With every window of one hash, only the words decide; items go by a digest of their words."""
    monkeypatch.setattr(d.F, "xxhash64", lambda *_: d.F.lit(7).cast("bigint"))
    items = [(1, edge.prose(7, 12)), (2, edge.prose(8, 12)), (3, "short one")]
    docs = [(10, edge.prose(7, 12)), (11, "x " + edge.prose(8, 14)), (12, edge.prose(9, 40)), (13, "a short one b")]
    found = d.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    got = {r.doc_id: (sum(s.length for s in r.spans) > 0, list(r["items"])) for r in found}
    want = {i: (n > 0, ids) for i, _, n, ids in brute(docs, items)}
    assert got == want and got[10][1] == ["1"]


def test_no_shuffled_row_holds_a_documents_words(spark):
    spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bench = spark.createDataFrame([(1, edge.prose(7, 30))], "item_id bigint, text string")
        docs = edge.documents(spark)
        windows, _ = d.benchmark_windows(bench)
        base = docs.select(F.xxhash64("doc_id").alias("doc"), d.words(F.col("text")).alias("ws"))
        for frame in (d._possible(base, windows, [10]), d.window_hits(docs, bench)):
            plan = frame._jdf.queryExecution().executedPlan()
            text = spark.sparkContext._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
            exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
            assert exchanges and plan is not None
            # the benchmark's own items are shuffled by their words; no row of a document is
            assert not [e for e in exchanges if "ws#" in e and ("doc" in e or "text_key" in e)]
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
