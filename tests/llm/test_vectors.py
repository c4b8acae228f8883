"""Operators 11 and 13 against plain versions, with awkward vectors."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import pivot_clusters, topk_search

SCHEMA = "vec_id bigint, embedding array<double>, score bigint, cluster string, payload string, vec int"


def vectors(seed: int, n: int, width: int = 64) -> list[list[float]]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    return [[c + rng.gauss(0, 0.1) for c in rng.choice(centres)] for _ in range(n)]


def awkward() -> list[tuple]:
    made = vectors(3, 230)
    rows = [(i, v) for i, v in enumerate(made)]
    rows += [(500, made[0])] * 40 + [(600, made[5]), (600, made[5]), (600, made[6]), (None, made[7]), (None, made[7])]
    rows += [(700, None), (800, []), (801, []), (900, [1.0, 2.0]), (901, [3.0, -2.0]), (1000, [None] + made[1][1:])]
    rows += [(1100, [float("nan")] + made[1][1:]), (1200, [float("inf")] + made[1][1:]), (1300, [1e300] * 64)]
    rows += [(1400, [0.0] * 64), (1500, [-x for x in made[2]]), (1600, [900000.0] * 64), (1601, [800000.5] * 64)]
    return rows


def frame(spark, rows, partitions: int = 4):
    full = [(i, v, 1, "x", "y", 2) for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def plain_top(rows, k):
    whole = []
    for at, (i, v) in enumerate(rows):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(1024 * x) for x in v]
        if sum(x * x for x in ints) < 1 << 62:
            whole.append((at, i, ints))
    out = []
    for at, i, q in whole:
        if i is None or i % 100:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, c, strict=True)), j is None, j)
            for other, j, c in whole
            if other != at and len(c) == len(q)
        ]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "sizes"), [(10, {}), (3, {"shard_values": 640, "block_values": 300, "leaf": 2})])
def test_top_k_equals_brute_force(spark, k, sizes):
    rows = awkward()
    found = topk_search.search(frame(spark, rows), F.col("vec_id") % 100 == 0, k=k, **sizes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_top(rows, k)


def test_top_k_of_empty_tables_and_without_queries(spark):
    assert topk_search.search(frame(spark, [], 1), F.col("vec_id") % 100 == 0).count() == 0
    assert topk_search.search(frame(spark, [(7, [1.0]), (8, [2.0])], 1), F.col("vec_id") % 100 == 0).count() == 0
    one = topk_search.search(frame(spark, [(100, [1.0]), (8, [2.0])], 1), F.col("vec_id") % 100 == 0)
    assert [tuple(r) for r in one.collect()] == [(100, 1, 8, 2048 * 1024)]


def test_ball_tree_holds_every_row_in_its_nodes():
    rows = np.array([[math.floor(1024 * x) for x in v] for v in vectors(9, 500, 8)] + [[5] * 8] * 300)
    order, centres, radii, levels = topk_search.ball_tree(rows, 16)
    assert sorted(order) == list(range(800)) and levels == 6
    for d in range(levels + 1):
        for i in range(1 << d):
            mine = rows[order[800 * i >> d : 800 * (i + 1) >> d]]
            node = (1 << d) - 1 + i
            assert len(mine) <= 16 or d < levels
            assert np.sqrt(((mine - centres[node]) ** 2).sum(axis=1)).max() <= radii[node] * (1 + 1e-12)


def test_clustered_shards_are_cut():
    rows = np.array([[math.floor(1024 * x) for x in v] for v in vectors(4, 4000)])
    order, centres, radii, levels = topk_search.ball_tree(rows)
    shard = {
        "rows": rows[order],
        "ids": order.astype(np.int64),
        "no_id": np.zeros(4000, dtype=bool),
        "centres": centres,
        "radii": radii,
        "levels": np.array(levels),
    }
    best = topk_search.Best(rows[:50], 11, np.full(50, topk_search.NONE))
    topk_search.search_shard(shard, best)
    scores = rows[:50] @ rows.T
    assert (best.scores == -np.sort(-scores, axis=1)[:, :11]).all()
    assert best.visited < 0.5 * scores.size
    again = topk_search.Best(rows[:50], 11, best.floor)  # the k-th score of earlier shards cuts more
    topk_search.search_shard(shard, again)
    assert (again.scores == best.scores).all() and again.visited <= best.visited


def test_top_k_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found = topk_search.op11_exact_top_k(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, found.collect()), key=str) == plain_top(rows, 10)


def plain_clusters(rows, k=16, rounds=3):
    """Per vector (vec_id, cluster, distance), and the centroids: every distance computed."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) < 1 << 27 for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))

    def start(row):
        i, v = row
        return (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), i or 0, v)

    centroids = [v for _, v in sorted(kept, key=start)[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            mine = [v for (_, cluster, _), (_, v) in zip(at, kept, strict=True) if cluster == c]
            if mine:
                centroids[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return assign(), centroids


@pytest.mark.parametrize("k", [16, 3])
def test_clusters_equal_plain_rounds(spark, k):
    rows = awkward()
    found, points = pivot_clusters.cluster(frame(spark, rows), centroids=k)
    expected, centroids = plain_clusters(rows, k)
    assert points.tolist() == centroids
    got = sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str)
    assert got == sorted(expected, key=str)


def test_bounds_leave_out_distances(spark):
    rows = list(enumerate(vectors(11, 600)))
    found, _ = pivot_clusters.cluster(frame(spark, rows))
    assert found.agg(F.avg("checked")).first()[0] < 8  # of 16


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (3, [1.0])]
    found, points = pivot_clusters.cluster(frame(spark, rows, 1))
    assert len(points) == 2 and sorted(r.distance for r in found.collect()) == [0, 0]
    found, points = pivot_clusters.cluster(frame(spark, [(3, [1.0]), (4, None)], 1))
    assert len(points) == 0 and found.count() == 0
    assert pivot_clusters.cluster(frame(spark, [], 1))[0].count() == 0


def test_text_ids_of_vectors(spark):
    made = vectors(2, 30)
    named = spark.createDataFrame([(f"v{i}", v) for i, v in enumerate(made)], "vec_id string, embedding array<float>")
    found, _ = pivot_clusters.cluster(named)
    assert {r.vec_id for r in found.collect()} == {f"v{i}" for i in range(30)}


def test_digest_columns(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    expected, centroids = plain_clusters(rows)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [sum(d for _, at, d in expected if at == c) for c in range(16)]
    want = sorted((i, c, d, inertia[c], sum(inertia), hashes[c]) for i, c, d in expected)
    assert sorted(map(tuple, pivot_clusters.op13_centroid_clustering(spark, "/root/testdata/sf0.001").collect())) == want
