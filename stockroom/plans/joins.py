"""Join helpers: a broadcast hint that is given only behind a measured size bound.

``F.broadcast`` overrides Spark's own size test, so an unchecked hint on a table
that grows with the data turns into an out-of-memory error at scale.  The helpers
below hint only when a measured upper bound of the frame's rows (row count and
exact variable-length bytes, one small aggregation) is under the bound.  Catalyst's
estimate screens out fact tables first, so they cost nothing.  Without a hint the
planner chooses a shuffled join, and AQE may still switch to a broadcast at run
time when the measured shuffle output is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dimension tables (zones, warehouses, the candidate set of a delete) are hinted
# up to this many bytes of estimated plan size; a session can lower or raise the
# bound with the setting below (0 turns the hint off).
DIMENSION_BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_LIMIT_CONF = "spark.stockroom.broadcastMaxBytes"


def estimated_size(df: DataFrame) -> int | None:
    """Catalyst's ``sizeInBytes`` estimate for ``df``, or None when unavailable."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # Spark Connect or an API change: no estimate, no hint
        return None


def broadcast_limit(df: DataFrame) -> int:
    """The hint bound for ``df``'s session: the setting if present, else the default."""
    value = df.sparkSession.conf.get(BROADCAST_LIMIT_CONF, None)
    return DIMENSION_BROADCAST_BYTES if value is None else int(value)


# Types stored inline in Spark's binary row (one 8-byte slot each).
_INLINE_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType,
    T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType,
)
_NO_BOUND = 1 << 50  # of a type whose size is not known here: never hinted


def _is_inline(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INLINE_TYPES) or (isinstance(dtype, T.DecimalType) and dtype.precision <= 18)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _beside_slot(value: Column, dtype: T.DataType) -> Column:
    """Upper bound of the bytes of ``value`` beside its slot and the rounding to a word (0 for NULL)."""
    if _is_inline(dtype):
        return _long(0)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value).cast("bigint"), _long(0))
    if isinstance(dtype, T.DecimalType):
        return _long(16)
    if isinstance(dtype, T.ArrayType):
        count = F.coalesce(F.size(value), F.lit(0)).cast("bigint")
        # the count, the null bits in words, a slot per element, and what the elements hold beside it
        own = _long(16) + count * 8 + F.floor(count / 64) * 8
        if _is_inline(dtype.elementType):
            return own
        held = F.aggregate(
            value, _long(0), lambda total, x: total + _beside_slot(x, dtype.elementType) + 8
        )
        return own + F.coalesce(held, _long(0))
    if isinstance(dtype, T.MapType):
        keys = _beside_slot(F.map_keys(value), T.ArrayType(dtype.keyType))
        return keys + _beside_slot(F.map_values(value), T.ArrayType(dtype.valueType)) + 8
    if isinstance(dtype, T.StructType):
        own = 8 * ((len(dtype.fields) + 63) // 64) + 8 * len(dtype.fields)
        variable = [f for f in dtype.fields if not _is_inline(f.dataType)]
        return sum(
            (_beside_slot(value.getField(f.name), f.dataType) for f in variable), _long(own + 8 * len(variable))
        )
    return _long(_NO_BOUND)


def measured_size(df: DataFrame) -> int:
    """An upper bound of ``df``'s rows in Spark's binary row format, measured by one aggregation.

    Per row: the null bits, one 8-byte slot per field, and for each variable-length field its exact
    content rounded up to a word (bounded by content + 8): the UTF-8 bytes of a string, the
    slots and contents of an array's elements, a struct's fields, a map's keys and values.  The row
    count and the sums are computed, not estimated.
    """
    variable = [f for f in df.schema.fields if not _is_inline(f.dataType)]
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.sum(_beside_slot(F.col(f"`{f.name}`"), f.dataType).cast("decimal(38,0)")).alias(f"_b{i}")
        for i, f in enumerate(variable)
    ]
    row = df.agg(*aggs).first()
    rows = row["_n"]
    var_bytes = sum(int(row[f"_b{i}"] or 0) for i in range(len(variable)))
    fields = len(df.columns)
    per_row = 8 * ((fields + 63) // 64) + 8 * fields + 8 * len(variable)
    return rows * per_row + var_bytes


def broadcast_if_rows_fit(df: DataFrame, rows: int, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast for a frame whose exact row count is known (``rows``).

    Used for frames Catalyst cannot size (checkpointed or joined data without CBO).
    If even the fixed part of ``rows`` rows exceeds the bound nothing is measured;
    otherwise :func:`measured_size` decides.
    """
    limit = broadcast_limit(df) if max_bytes is None else max_bytes
    if limit <= 0 or rows * 8 * len(df.columns) > limit:
        return df
    return F.broadcast(df) if measured_size(df) <= limit else df


# A frame whose Catalyst estimate exceeds the bound by this factor is not measured.
ESTIMATE_SLACK = 8
# Rows that come from the driver or a checkpoint have no estimate: Catalyst then takes its default of 2^63
# bytes, more or less by the columns.  No stored table is so large, so such a figure says nothing.
UNKNOWN_ESTIMATE = 1 << 56


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``F.broadcast(df)`` when its measured size is at most the bound, else ``df``.

    Catalyst's estimate screens first: a frame estimated far above the bound (a
    fact table) is left to the planner without running anything.  A frame without an estimate
    (made from driver rows or read from a checkpoint) is not screened.  Otherwise one
    small aggregation measures the frame (:func:`measured_size`), so every hint
    rests on counted rows and bytes, not on file sizes.
    """
    limit = broadcast_limit(df) if max_bytes is None else max_bytes
    if limit <= 0:
        return df
    estimate = estimated_size(df)
    if estimate is not None and ESTIMATE_SLACK * limit < estimate < UNKNOWN_ESTIMATE:
        return df
    return F.broadcast(df) if measured_size(df) <= limit else df
