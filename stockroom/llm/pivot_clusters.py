"""Operator 13: centroid clustering with exact integer distances behind a LAESA pivot table.

Vectors are turned into integers once and stored with their squared distances to fixed pivots (the
starting centroids).  In every round the triangle inequality bounds the distance to each centroid from
below by the largest difference of two stored pivot distances; only centroids whose bound is not above
the best distance so far get an exact integer distance.  A task hands on one sum per centroid, so that
rows are never shuffled; the driver holds the centroids only.

Vectors take part with exactly ``components`` components, none null or non-finite, and each under
2^21 in amount after division by the scale's 64 (that is under 2^27 as an integer), which keeps every
distance inside a long.  Bounds are floats with a slack far over their rounding, and equal distances
are always computed, so the smaller centroid number wins ties exactly.

Defined results: rows of other vectors are left out; fewer vectors than centroids give fewer centroids;
an empty table gives no rows; repeated rows each take part and may each start a centroid, in which case
the later, equal one stays empty and unmoved; rows without vec_id take part but start a centroid only
after all others; ties of the starting order fall to the smaller vec_id, then the smaller vector; an
inertia beyond a long is null; extra columns are ignored; vec_id keeps its type.  Each table is written to
the shared folder, so a lost executor repeats its own tasks only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm.common import only, read, shared_folder

COMPONENTS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
AMOUNT = 1 << 27  # integers below this keep a distance of 64 components inside a long
SALT = "1:"


def integer_rows(batch: pa.RecordBatch, components: int, scale: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of ``batch`` (id, vector) that take part, and their integers as an array."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), components), False))
    values = pc.fill_null(batch.column(1).flatten().cast(pa.float64()), float("nan"))
    scaled = values.to_numpy(zero_copy_only=False).reshape(-1, components) * scale
    fits = (np.abs(scaled) < AMOUNT).all(axis=1)  # false for what is not finite
    return batch.filter(pa.array(fits)), np.floor(scaled[fits]).astype(np.int64)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one integer point."""
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray):
    """Per row: nearest centroid (ties: smaller number), squared distance, exact distances computed.

    ``to_pivots`` holds the squared distances of the rows to ``pivots``.
    """
    n, k = len(rows), len(centroids)
    far = np.sqrt(to_pivots.astype(np.float64))
    near = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))  # k x pivots
    slack = 1e-9 * (far.max(axis=1, initial=0.0) + near.max(initial=0.0)) + 1e-9
    low = np.empty((n, k))
    for c in range(k):
        low[:, c] = np.abs(far - near[c]).max(axis=1)
    low = np.maximum(low - slack[:, None], 0.0) ** 2
    cluster = low.argmin(axis=1).astype(np.int32)  # the most promising centroid first
    best = np.empty(n, dtype=np.int64)
    for c in range(k):
        mine = cluster == c
        best[mine] = squared(rows[mine], centroids[c])
    first, checked = cluster.copy(), np.ones(n, dtype=np.int32)
    for c in range(k):
        open_ = np.flatnonzero((low[:, c] <= best) & (first != c))
        found = squared(rows[open_], centroids[c])
        checked[open_] += 1
        better = (found < best[open_]) | ((found == best[open_]) & (c < cluster[open_]))
        best[open_[better]], cluster[open_[better]] = found[better], c
    return cluster, best, checked


def _starts(rows: DataFrame, components: int, scale: int, centroids: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in hash order."""
    id_type = rows.schema["vec_id"].dataType

    def integers(batches):
        for batch in batches:
            kept, ints = integer_rows(batch, components, scale)
            if len(ints):
                yield pa.RecordBatch.from_arrays([kept.column(0), _lists(ints, pa.int32())], ["vec_id", "vec"])

    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("vec", T.ArrayType(T.IntegerType()))])
    named = rows.mapInArrow(integers, schema).withColumn(
        "hash", F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    )
    first = named.orderBy(F.col("hash").asc_nulls_last(), F.col("vec_id"), F.col("vec")).limit(centroids)
    return np.array([r["vec"] for r in first.collect()], dtype=np.int64).reshape(-1, components)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def cluster(
    vectors: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, checked) per vector that takes part, and the final centroids.

    ``checked`` is the number of exact distances the last assignment computed for the vector.
    """
    if centroids < 1 or rounds < 0:
        raise ValueError("at least one centroid and no negative number of rounds")
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("vec"))
    id_field = T.StructField("vec_id", rows.schema["vec_id"].dataType)
    pivots = points = _starts(rows, components, scale, centroids)
    width = max(1, len(pivots))
    folder = shared_folder(spark, "pivot-clusters")

    def table(batches):
        for batch in batches:
            kept, ints = integer_rows(batch, components, scale)
            if len(ints):
                to_pivots = np.stack([squared(ints, p) for p in pivots], axis=1)
                columns = [kept.column(0), _lists(ints, pa.int32()), _lists(to_pivots, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "to_pivots"])

    fields = [
        id_field,
        T.StructField("vec", T.ArrayType(T.IntegerType())),
        T.StructField("to_pivots", T.ArrayType(T.LongType())),
    ]
    rows.mapInArrow(table, T.StructType(fields)).write.parquet(f"{folder}/table")
    stored = spark.read.parquet(f"{folder}/table")

    def sums(now: np.ndarray):
        def add(batches):
            count = np.zeros(len(now), dtype=np.int64)
            total = np.zeros((len(now), components), dtype=np.int64)
            for batch in batches:
                ints = _matrix(batch.column(0), components)
                at, _, _ = nearest(ints, _matrix(batch.column(1), width), now, pivots)
                for c in np.unique(at):
                    mine = ints[at == c]
                    count[c] += len(mine)
                    total[c] += mine.sum(axis=0)
            used = np.flatnonzero(count)
            columns = [pa.array(used, pa.int32()), pa.array(count[used]), _lists(total[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "total"])

        return add

    for _ in range(rounds if len(points) else 0):
        partial = stored.select("vec", "to_pivots").mapInArrow(sums(points), "cluster int, n bigint, total array<bigint>")
        whole = partial.groupBy("cluster").agg(
            F.sum(F.col("n").cast("decimal(38,0)")).alias("n"),
            *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(components)],
        )
        moved = points.copy()
        for r in whole.collect():  # one row per centroid
            moved[r["cluster"]] = [int(r[f"t{i}"]) // int(r["n"]) for i in range(components)]
        points = moved

    def assign(batches):
        for batch in batches:
            at, far, checked = nearest(
                _matrix(batch.column(1), components), _matrix(batch.column(2), width), points, pivots
            )
            columns = [batch.column(0), pa.array(at, pa.int32()), pa.array(far), pa.array(checked, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "checked"])

    fields = [
        id_field,
        T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType()),
        T.StructField("checked", T.IntegerType()),
    ]
    stored.mapInArrow(assign, T.StructType(fields)).write.parquet(f"{folder}/assigned")
    return spark.read.parquet(f"{folder}/assigned"), points


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`cluster` over the whole embeddings table."""
    found, points = cluster(only(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in sums.collect()}  # one row per centroid

    def long_or_none(value: int) -> int | None:
        return value if value < 1 << 63 else None

    rows = [
        (
            c,
            long_or_none(inertia.get(c, 0)),
            long_or_none(sum(inertia.values())),
            hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest(),
        )
        for c, p in enumerate(points)
    ]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = found.join(F.broadcast(facts), "cluster")  # at most one row per centroid
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    """The rounds written out: components as rows, distances by joining on the component number."""
    ctes = [
        """kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        "cells AS (SELECT vec_id, i, v[i] AS x FROM kept, range(1, 65) AS r(i))",
        """start AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id) - 1 AS c, v FROM kept
    QUALIFY c < 16
)""",
        "c0 AS (SELECT c, i, v[i] AS x FROM start, range(1, 65) AS r(i))",
    ]
    for n in range(rounds + 1):
        ctes.append(
            f"""a{n} AS MATERIALIZED (
    SELECT vec_id, c AS cluster, d AS distance FROM (
        SELECT vec_id, c, sum((cells.x - c{n}.x) * (cells.x - c{n}.x))::BIGINT AS d
        FROM cells JOIN c{n} USING (i) GROUP BY vec_id, c
    ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
)"""
        )
        if n < rounds:
            ctes.append(
                f"""m{n} AS (
    SELECT cluster AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN cells USING (vec_id) GROUP BY cluster, i
), c{n + 1} AS MATERIALIZED (
    SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, c{n}.x)::BIGINT AS x FROM c{n} LEFT JOIN m{n} USING (c, i)
)"""
            )
    return (
        "WITH "
        + ", ".join(ctes)
        + f""", hashed AS (
    SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN hashed USING (cluster)
"""
    )


ORACLE = _oracle()
