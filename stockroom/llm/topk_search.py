"""Operator 11: exact top-k inner products by ball trees over shards, branch and bound.

Each task packs the vectors it reads into shards of bounded size and builds one ball tree per shard:
halves at the median along the line between two far points, down to leaves of ``LEAF`` rows, every node
with its centre and radius.  The trees are written to the shared folder once.

Queries are packed into blocks of bounded size, and each block meets every shard.  For a query q no row
below a node scores more than <q, centre> + |q| * radius, nor more than its parent allows.  Subtrees under
the query's current k-th score are cut; the leaves left are visited best bound first, those of many
queries at a time as one matrix product, until no bound reaches the k-th score.  That score is shared:
a task keeps it from shard to shard, and a first wave of shards gives every task of the second wave the
k-th scores it found.  Shards hand on at most k + 1 rows per query, ranked by a window with its own limit.

Exactness: products are taken in doubles only while Cauchy-Schwarz proves every partial sum under 2^53,
else in longs; bounds carry a slack far over their rounding, and rows that tie the k-th score are visited.

Vectors take part unless they are null, hold a null or non-finite component, or are so large that a
score could leave the range of a long (squared integer norm of 2^62 and more).  Only vectors with as many
components as the query have an inner product with it.

Defined results: a query's own row is left out once: of rows repeated under a query's id the others are
candidates, and each such row is a query whose result is given again; ties fall to the smaller vec_id,
a null vec_id last; fewer candidates than k give them all; an empty table gives no rows; extra columns are
ignored; a very long vector makes a shard or block of its own.  A lost executor repeats its own tasks.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm.common import only, read, remove_folder, shared_folder

SCALE = 1024
TOP = 10
QUERY_EVERY = 100
LEAF = 64
SHARD_VALUES = 1 << 19  # components in a shard: 8,192 vectors of 64
BLOCK_VALUES = 1 << 20  # components in a block of queries
FIRST_WAVE = 16  # one partition in so many gives its first shard to the first wave
NORM_LIMIT = 1 << 62
EXACT_DOUBLE = 1 << 53
NONE = np.iinfo(np.int64).min  # below any score


def integer_vectors(batch: pa.RecordBatch, scale: int):
    """Yield (ids, integer rows) of a batch (id, vector), one pair per number of components."""
    lengths = pc.list_value_length(batch.column(1))
    for width in pc.unique(lengths.drop_null()).to_pylist():
        part = batch.filter(pc.fill_null(pc.equal(lengths, width), False))
        flat = pc.fill_null(part.column(1).flatten().cast(pa.float64()), float("nan"))
        scaled = flat.to_numpy(zero_copy_only=False).reshape(len(part), width) * scale
        finite = (np.abs(scaled) < 1 << 31).all(axis=1)  # false for what is not finite; others fail the norm too
        rows = np.floor(np.where(finite[:, None], scaled, 0))
        fits = finite & ((rows * rows).sum(axis=1) < NORM_LIMIT)
        if fits.any():
            yield part.column(0).filter(pa.array(fits)), rows[fits].astype(np.int64)


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as found:
        return {name: found[name] for name in found.files}


def _packer(values: int, scale: int, payload):
    """Rows (part, width, n, payload): a task's vectors in packs of at most ``values`` components."""

    def pack(batches):
        waiting: dict[int, list] = {}
        held, made = 0, 0
        number = TaskContext.get().partitionId()

        def flush():
            nonlocal held, made
            for width, parts in sorted(waiting.items()):
                ids = pa.chunked_array([p[0] for p in parts], pa.int64())
                rows = np.concatenate([p[1] for p in parts])
                content = payload(ids, rows)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([(number << 33) + made], pa.int64()),
                        "wave": pa.array([int(number % FIRST_WAVE != 0 or made > 0)], pa.int32()),
                        "n": pa.array([len(rows)], pa.int64()),
                        "payload": pa.array([content], pa.binary()),
                    }
                )
                made += 1
            waiting.clear()
            held = 0

        for batch in batches:
            for ids, rows in integer_vectors(batch, scale):
                width = max(1, rows.shape[1])
                at = 0
                while at < len(rows):
                    room = max(1, (values - held) // width)
                    waiting.setdefault(rows.shape[1], []).append((ids[at : at + room], rows[at : at + room]))
                    taken = min(room, len(rows) - at)
                    at, held = at + taken, held + taken * width
                    if held + width > values:
                        yield from flush()
        yield from flush()

    return pack


PACKED = "part bigint, wave int, n bigint, payload binary"


def ball_tree(rows: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(order of the rows, centres, radii, levels) of a balanced ball tree.

    Level d has 2^d nodes; node i of it holds rows n*i >> d up to n*(i+1) >> d of the order.  Nodes
    are numbered as in a heap without its first place: level d starts at 2^d - 1.
    """
    n = len(rows)
    levels = 0
    while n >> levels > leaf:
        levels += 1
    points = rows.astype(np.float64)
    order = np.arange(n)
    centres, radii = [], []
    for d in range(levels + 1):
        for i in range(1 << d):
            lo, hi = n * i >> d, n * (i + 1) >> d
            mine = points[order[lo:hi]]
            centre = mine.mean(axis=0)
            away = np.sqrt(((mine - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(away.max())
            if d < levels:
                one = mine[away.argmax()]
                other = mine[((mine - one) ** 2).sum(axis=1).argmax()]
                half = (n * (2 * i + 1) >> (d + 1)) - lo
                order[lo:hi] = order[lo:hi][np.argpartition(mine @ (other - one), half)]
    return order, np.array(centres), np.array(radii), levels


def _shard(leaf: int):
    def payload(ids: pa.ChunkedArray, rows: np.ndarray) -> bytes:
        order, centres, radii, levels = ball_tree(rows, leaf)
        return _pack(
            rows=rows[order].astype(np.int32),
            ids=pc.fill_null(ids, 0).to_numpy()[order],
            no_id=pc.is_null(ids).to_numpy()[order],
            centres=centres,
            radii=radii,
            levels=np.array(levels),
        )

    return payload


def _block(ids: pa.ChunkedArray, rows: np.ndarray) -> bytes:
    return _pack(ids=ids.to_numpy(), rows=rows)


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


class Best:
    """The best ``k`` rows so far of every query: score descending, then id, null ids last."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray):
        self.rows, self.k = queries, k
        self.norms = _norms(queries)
        self.scores = np.full((len(queries), k), NONE)
        self.ids = np.zeros((len(queries), k), dtype=np.int64)
        self.no_id = np.ones((len(queries), k), dtype=bool)
        self.floor = floor.copy()  # no row under it is among the best k
        self.visited = 0  # rows scored

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """Merge one leaf's ``scores`` (queries ``at`` x rows)."""
        self.visited += scores.size
        hit = (scores >= self.floor[at, None]).any(axis=1)
        at, scores = at[hit], scores[hit]
        if not len(at):
            return
        wide = (len(at), len(ids))
        all_scores = np.concatenate([self.scores[at], scores], axis=1)
        all_ids = np.concatenate([self.ids[at], np.broadcast_to(ids, wide)], axis=1)
        all_no_id = np.concatenate([self.no_id[at], np.broadcast_to(no_id, wide)], axis=1)
        first = np.lexsort((all_ids, all_no_id, ~all_scores), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(all_scores, first, axis=1)
        self.ids[at] = np.take_along_axis(all_ids, first, axis=1)
        self.no_id[at] = np.take_along_axis(all_no_id, first, axis=1)
        self.floor[at] = np.maximum(self.floor[at], self.scores[at, -1])


def search_shard(shard: dict[str, np.ndarray], best: Best) -> None:
    """Branch and bound of all queries of ``best`` over one shard's tree."""
    rows, ids, no_id = shard["rows"], shard["ids"], shard["no_id"]
    centres, radii, levels = shard["centres"], shard["radii"], int(shard["levels"])
    n = len(rows)
    size = _norms(rows).max(initial=0.0)
    kind = np.float64 if size * best.norms.max(initial=0.0) < EXACT_DOUBLE / 2 else np.int64
    points, queries = rows.astype(kind), best.rows.astype(kind)
    real = best.rows.astype(np.float64)
    slack = 1e-9 * (best.norms[:, None] * 2 * size + 1)

    alive = np.arange(len(real))  # queries with an open node
    bounds = np.full((len(real), 1), np.inf)
    for d in range(levels + 1):
        first, last = (1 << d) - 1, (1 << d + 1) - 1
        reach = real[alive] @ centres[first:last].T + best.norms[alive, None] * radii[first:last] + slack[alive]
        parents = np.repeat(bounds, 2, axis=1) if d else bounds
        bounds = np.minimum(reach, parents)
        bounds[bounds < best.floor[alive, None]] = -np.inf
        open_ = (bounds > -np.inf).any(axis=1)
        alive, bounds = alive[open_], bounds[open_]
    if not len(alive):
        return
    leaves = np.argsort(-bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, leaves, axis=1)
    for turn in range(leaves.shape[1]):  # each query visits its next best leaf
        going = bounds[:, turn] >= best.floor[alive]
        if not going.any():
            return
        alive, leaves, bounds = alive[going], leaves[going], bounds[going]
        leaf = leaves[:, turn]
        by_leaf = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for group in np.split(by_leaf, cuts):
            i = int(leaf[group[0]])
            lo, hi = n * i >> levels, n * (i + 1) >> levels
            at = alive[group]
            scores = (queries[at] @ points[lo:hi].T).astype(np.int64)
            best.add(at, scores, ids[lo:hi], no_id[lo:hi])


FOUND = "query int, query_id bigint, own bigint, vec_id bigint, score bigint"


def _searcher(block, k: int):
    """Rows (:data:`FOUND`) of the best ``k`` that a task's shards give the queries of a block."""

    def search(batches):
        given = block.value
        best = Best(given["rows"], k, given["floor"])
        for batch in batches:
            for payload in batch.column(0):
                shard = _unpack(payload.as_py())
                if shard["rows"].shape[1] == given["rows"].shape[1]:
                    search_shard(shard, best)
        query, place = np.nonzero((best.scores > NONE) & (best.scores >= best.floor[:, None]))
        own = (given["rows"] ** 2).sum(axis=1)
        yield pa.RecordBatch.from_pydict(
            {
                "query": pa.array(query, pa.int32()),
                "query_id": pa.array(given["ids"][query], pa.int64()),
                "own": pa.array(own[query], pa.int64()),
                "vec_id": pa.array(best.ids[query, place], pa.int64(), mask=best.no_id[query, place]),
                "score": pa.array(best.scores[query, place], pa.int64()),
            }
        )

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query, with their place."""
    order = Window.partitionBy("block", "query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = TOP,
    scale: int = SCALE,
    shard_values: int = SHARD_VALUES,
    block_values: int = BLOCK_VALUES,
    leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for every row of ``vectors`` with ``is_query``.

    ``vectors`` has vec_id (a whole number) and embedding.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    folder = shared_folder(spark, "ball-trees")
    shards = rows.mapInArrow(_packer(shard_values, scale, _shard(leaf)), PACKED)
    shards.write.partitionBy("wave").parquet(f"{folder}/shards")
    index = spark.read.schema("part bigint, n bigint, payload binary, wave int").parquet(f"{folder}/shards")

    asked = rows.filter(is_query & F.col("vec_id").isNotNull())
    values = asked.agg(F.sum(F.size("embedding").cast("bigint"))).first()[0] or 0
    dealt = asked.repartition(max(1, -(-values // block_values)))  # about one block to a task
    dealt.mapInArrow(_packer(block_values, scale, _block), PACKED).drop("wave").write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema("part bigint, n bigint, payload binary").parquet(f"{folder}/blocks")

    keep = k + 1  # the query's own row may be among them
    results = f"{folder}-found"
    for number in sorted(r["part"] for r in blocks.select("part").collect()):  # bounded: one per block of queries
        block = _unpack(blocks.filter(F.col("part") == number).first()["payload"])
        floor = np.full(len(block["ids"]), NONE)
        for wave in (0, 1):
            sent = spark.sparkContext.broadcast({**block, "floor": floor})  # at most block_values components
            found = index.filter(F.col("wave") == wave).select("payload").mapInArrow(_searcher(sent, keep), FOUND)
            found = _ranked(found.withColumn("block", F.lit(number).cast("bigint")), keep)
            found.write.mode("append").parquet(results)
            if wave == 0:
                kth = spark.read.parquet(results).filter((F.col("block") == number) & (F.col("place") == keep))
                for r in kth.select("query", "score").collect():  # one per query of the block
                    floor[r["query"]] = r["score"]
            sent.unpersist()
    remove_folder(spark, folder)

    schema = f"{FOUND}, block bigint"
    spark.createDataFrame([], schema + ", place int").write.mode("append").parquet(results)  # no query: no rows
    best = _ranked(spark.read.schema(schema).parquet(results), keep)
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    own_place = F.min(F.when(itself, F.col("place"))).over(Window.partitionBy("block", "query"))
    others = best.withColumn("own_place", F.coalesce(own_place, F.lit(keep))).filter(F.col("place") != F.col("own_place"))
    rank = (F.col("place") - F.when(F.col("place") > F.col("own_place"), 1).otherwise(0)).cast("int")
    return others.select("query_id", rank.alias("rank"), "vec_id", "score")


def op11_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """:func:`search` of the whole embeddings table for every row whose vec_id is divisible by 100."""
    vectors = only(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
WITH whole AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id,
        list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT::DOUBLE) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.rid <> c.rid AND len(q.v) = len(c.v)
    WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score
FROM scored
QUALIFY rank <= 10
"""
