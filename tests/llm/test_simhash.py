"""Operator 7 against brute force, in both ways through the buckets."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stockroom.llm import simhash
from stockroom.llm.components import components
from stockroom.plans.joins import BROADCAST_LIMIT_CONF
from tests.llm import edge


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in [*(r[1] for r in edge.rows() if r[1] != edge.LONG), "Ab  cD\x0bef\x85gh", "one two three four"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("bucket_limit", [8192, 2])
def test_links_of_clustered_fingerprints(spark, bucket_limit):
    rng = random.Random(5)
    fps = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(12)}
    fps = sorted(simhash._signed(f) for f in fps)
    arr = np.array(fps, dtype=np.int64).view(np.uint64)
    close = [(fps[i], fps[j]) for i in range(len(fps)) for j in range(i) if np.bitwise_count(arr[i] ^ arr[j]) <= 4]
    frame = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    edges = simhash.links(frame, bucket_limit=bucket_limit)
    wrong = edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4)
    got = {r.node: r.root for r in components(edges).collect()}
    expected = {n: r for n, r in union(fps, close).items()}
    assert {n: got.get(n, n) for n in fps} == expected
    assert len(close) > 100
    if bucket_limit == 2:  # edges through a common neighbour are exact too
        assert wrong.count() == 0


@pytest.fixture(params=["broadcast", "shuffle"])
def way(request, spark):
    """Both ways to drop documents: by broadcast keys, and by one shuffle as beyond the bound."""
    if request.param == "shuffle":
        spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    yield request.param
    spark.conf.unset(BROADCAST_LIMIT_CONF)


def test_documents_and_keep_one(spark, way):
    near = edge.prose(1, 400)
    changed = near.replace(" the ", " a ", 1)
    docs = edge.documents(spark, [(50, near, *[None] * 7), (51, changed, *[None] * 7), (52, near, *[None] * 7)])
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    fps = {r.fp for r in rows}
    arr = {f: np.uint64(f & (2**64 - 1)) for f in fps}
    close = [(a, b) for a in fps for b in fps if a < b and np.bitwise_count(arr[a] ^ arr[b]) <= 4]
    root = union(fps, close)
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[root[r.fp]] = min(first.get(root[r.fp], r.doc_id), r.doc_id)
    assert all(r.component_id == first.get(root[r.fp]) for r in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root[r.fp] for r in rows})
    zero = [r.doc_id for r in rows if r.fp == 0]
    assert sorted(x for x in zero if x is not None) == [0, 1, 2]  # null, empty and blank texts are one group


def test_groups_without_an_id_or_with_a_common_id_stay_apart(spark, way):
    a, b, c, d = (edge.prose(seed, 200) for seed in (21, 22, 23, 24))
    rows = [(None, a), (None, b), (None, b), (None, b.replace(" the ", " a ", 1)), (7, c), (7, d), (8, d), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    of_b = [k for k in kept if k[0] is None and k[1] != a]
    assert len(of_b) == 1 and of_b[0][1] in (rows[1][1], rows[3][1])
    assert [k for k in kept if k not in of_b] == sorted([(None, a), (7, c), (7, d)], key=str)


def test_empty_table(spark, way):
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0
    assert simhash.keep_one(edge.empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_kept_documents_are_not_shuffled(spark):
    docs = edge.documents(spark)
    kept = simhash.keep_one(docs)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    first = plan.split("Union")[1] if "Union" in plan else plan
    assert "LeftAnti" in plan and "BroadcastHashJoin" in first
