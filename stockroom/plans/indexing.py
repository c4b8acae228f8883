"""A dense 0..n-1 row index by a rank directory: no global sort and no copy of the table.

``row_number() OVER (ORDER BY key)`` moves every row into one task.  Here a few cut values, taken from a
sample, divide the order into ranges; how many rows each range holds is counted in one aggregation.  The
counts' prefix sums are the directory: one number per range, bounded by ``MAX_RANGES``.  A row finds its
range by binary search among the cuts, and its rank is the range's prefix sum plus its position inside
the range.  Ranges are windows of their own, spread over the tasks by hash.

The sample decides only how evenly the ranges are filled, never a rank.  Rows equal to a cut are a range of
their own: they are all equal, so they are not read again but made from the cut and their count, in chunks.
A value that a third of all rows share is almost surely a cut and so never lands in one window.

The rank is a function of the rows alone.  A lost executor, another sample or another cluster size gives
the same index, so nothing has to be kept between passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_RANGE = 1 << 15
MAX_RANGES = 4096
SAMPLED_PER_RANGE = 20
SMALL = 1 << 12  # a table of at most so many rows is sorted by the driver
CHUNK = 1 << 20  # rows made from one entry of the directory at a time

_GROUP = "_sr_range"


def _cuts(df: DataFrame, cols: list[str], n: int, ranges: int) -> list[tuple]:
    """Up to ``ranges`` distinct rows of ``df`` in order, with their JSON text as last field."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    wanted = SAMPLED_PER_RANGE * ranges
    some = df.sample(fraction=min(1.0, wanted / n), seed=7) if n > wanted else df
    texts = F.to_json(row, {"ignoreNullFields": "false"})
    found = some.select(*cols, texts.alias("_sr_json")).orderBy(*cols).collect()  # about SAMPLED_PER_RANGE * ranges
    if not found:  # an empty sample of a table with rows
        found = df.select(*cols, texts.alias("_sr_json")).limit(1).collect()
    step = len(found) / ranges
    chosen = [found[min(len(found) - 1, int((i + 0.5) * step))] for i in range(ranges)]
    return list(dict.fromkeys(map(tuple, chosen)))


def _array(values: str, dtype: str) -> Column:
    """An array literal from JSON; the optimizer folds it into one constant."""
    return F.from_json(F.lit(values), f"array<{dtype}>")


def binary_search(sorted_array: Column, size: int, value: Column) -> Column:
    """How many of the ``size`` values of ``sorted_array`` are at most ``value``."""
    steps = [1 << b for b in reversed(range(size.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(F.get(sorted_array, low + step - 1) <= value, low + step).otherwise(low),
    )


def with_dense_index(df: DataFrame, order: str | list[str], index_col: str = "_idx") -> tuple[DataFrame, int]:
    """Return ``(df + index_col, n)`` where ``index_col`` is the 0-based rank in ``ORDER BY order``.

    NULLs sort first, as in Spark's default ascending order; rows equal in ``order`` are ranked by
    their other columns, so the index is the same on any partitioning.
    """
    spark = df.sparkSession
    first = [order] if isinstance(order, str) else list(order)
    cols = first + [c for c in df.columns if c not in first]
    n = df.count()
    if n == 0:
        return df.withColumn(index_col, F.lit(None).cast("bigint")).limit(0), 0
    if n <= SMALL:
        rows = [(*r, i) for i, r in enumerate(df.select(*cols).orderBy(*cols).collect())]
        schema = df.select(*cols, F.lit(0).cast("bigint").alias(index_col)).schema
        return spark.createDataFrame(rows, schema).select(*df.columns, index_col), len(rows)
    cuts = _cuts(df, cols, n, min(MAX_RANGES, math.ceil(n / ROWS_PER_RANGE)))

    types = dict(df.dtypes)
    fields = ",".join(f"c{i}:{types[c]}" for i, c in enumerate(cols))
    known = _array("[" + ",".join(c[-1] for c in cuts) + "]", f"struct<{fields}>")
    value = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    at = F.col("_sr_at")
    # range 2i+1 holds the rows equal to cut i, range 2i+2 those between it and the next one
    is_cut = F.coalesce(F.get(known, at - 1).eqNullSafe(value), F.lit(False))
    ranged = (
        df.withColumn("_sr_at", binary_search(known, len(cuts), value))
        .withColumn(_GROUP, at * 2 - F.when((at > 0) & is_cut, 1).otherwise(0))
        .drop("_sr_at")
    )
    held = {r[_GROUP]: r["count"] for r in ranged.groupBy(_GROUP).count().collect()}  # at most two per cut and one
    starts, running = [], 0
    for g in range(2 * len(cuts) + 1):
        starts.append(running)
        running += held.get(g, 0)

    inside = Window.partitionBy(_GROUP).orderBy(*cols)
    start = F.get(_array(str(starts), "bigint"), F.col(_GROUP))
    between = ranged.filter(F.col(_GROUP) % 2 == 0).select(
        *df.columns, (start + F.row_number().over(inside) - 1).alias(index_col)
    )
    made = [(*c[:-1], starts[2 * i + 1], held.get(2 * i + 1, 0)) for i, c in enumerate(cuts)]
    counted = df.select(*cols, F.lit(0).cast("bigint").alias("_sr_start"), F.lit(0).cast("bigint").alias("_sr_n"))
    equal = spark.createDataFrame([m for m in made if m[-1]], counted.schema)
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_sr_n") - 1, F.lit(CHUNK).cast("bigint")))
    equal = equal.select("*", chunk.alias("_sr_chunk"))
    if max(m[-1] for m in made) > CHUNK:
        equal = equal.repartition("_sr_start", "_sr_chunk")
    place = F.explode(F.sequence("_sr_chunk", F.least(F.col("_sr_chunk") + CHUNK, F.col("_sr_n")) - 1))
    equal = equal.select(*df.columns, "_sr_start", place.alias("_sr_place")).select(
        *df.columns, (F.col("_sr_start") + F.col("_sr_place")).alias(index_col)
    )
    return between.unionByName(equal), n
