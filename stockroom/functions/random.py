"""Seeded random columns (helpers H1, H2, H4, H5).

``rand(seed)`` depends on how rows fall into partitions, so it changes with the
cluster size and no SQL oracle can reproduce it.  Every draw here is instead a pure
function of ``(seed, tag, row id)``: the first 13 hex digits of an MD5 digest, read
as an integer and divided by 2^52, give a uniform number in [0, 1) that is the same
on any partitioning, on recomputation after a lost executor, and in DuckDB::

    ('0x' || substr(md5('<seed>|<tag>|<id>'), 1, 13))::UBIGINT / 4503599627370496.0

Each generated column uses its own tag, so draws are independent.  All helpers are
built-in JVM expressions (no Python); they run inside whole-stage code generation,
except that the higher-order ``transform`` of :func:`random_text` is evaluated
interpreted within the generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2**52)

# Fixed value: the 63-symbol alphabet of random text (letters, digits, space).
TEXT_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 "


def draw_key(seed: int, tag: str, row_id: Column) -> Column:
    """The text hashed for one draw: ``'<seed>|<tag>|<id>'``."""
    return F.concat(F.lit(f"{seed}|{tag}|"), row_id.cast("string"))


def uniform(seed: int, tag: str, row_id: Column) -> Column:
    """A uniform double in [0, 1), a pure function of (seed, tag, row_id)."""
    digest = F.md5(draw_key(seed, tag, row_id))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_POW_52)


def uniform_int(seed: int, tag: str, row_id: Column, low: int, count: int) -> Column:
    """``floor(u * count) + low``: a uniform integer in [low, low + count)."""
    return (F.floor(uniform(seed, tag, row_id) * count) + low).cast("int")


def hex_token(seed: int, tag: str, row_id: Column, length: int) -> Column:
    """``length`` hex characters of an MD5 digest (stands in for ``md5(random()::text)``)."""
    return F.substring(F.md5(draw_key(seed, tag, row_id)), 1, length)


def rounded_decimal(u: Column, scale: float, offset: float, precision: int, digits: int = 2) -> Column:
    """``round(u * scale + offset, digits)`` as DECIMAL(precision, digits), rounding half away from zero."""
    exact = (u * scale + offset).cast("decimal(18,10)")
    return F.round(exact, digits).cast(f"decimal({precision},{digits})")


def random_text(seed: int, tag: str, row_id: Column, min_len: int, max_len: int) -> Column:
    """H1: text of uniform length in [min_len, max_len] over :data:`TEXT_ALPHABET`, trimmed.

    Because the result is trimmed, it can be shorter than ``min_len`` (as in the
    original function).  Character ``k`` is drawn with the row id suffixed by ``:k``.
    """
    length = uniform_int(seed, f"{tag}.len", row_id, min_len, max_len - min_len + 1)
    alphabet = F.array(*[F.lit(ch) for ch in TEXT_ALPHABET])
    n = len(TEXT_ALPHABET)

    def char(k: Column) -> Column:
        char_id = F.concat(row_id.cast("string"), F.lit(":"), k.cast("string"))
        return F.element_at(alphabet, uniform_int(seed, f"{tag}.chr", char_id, 1, n))

    chars = F.transform(F.sequence(F.lit(1), length), char)
    return F.when(length > 0, F.trim(F.array_join(chars, ""))).otherwise(F.lit(""))


def pick_enum(seed: int, tag: str, row_id: Column, domain: tuple[str, ...]) -> Column:
    """H4: a uniform element of a literal domain (1-based ``element_at``)."""
    values = F.array(*[F.lit(v) for v in domain])
    return F.element_at(values, uniform_int(seed, tag, row_id, 1, len(domain)))


def null_with_probability(seed: int, tag: str, row_id: Column, value: Column, p_keep: float) -> Column:
    """H5: ``value`` when a fresh uniform is below ``p_keep``, else NULL."""
    return F.when(uniform(seed, tag, row_id) < p_keep, value)


def bernoulli(seed: int, tag: str, row_id: Column, p: float) -> Column:
    """``u < p`` as a boolean column."""
    return uniform(seed, tag, row_id) < p


def contact_json(seed: int, tag: str, row_id: Column) -> Column:
    """H2: supplier contact JSON with keys email, notes, phone, website.

    Keys are written in the order a JSONB value prints them (shorter keys first,
    then byte order).  ``ignoreNullFields`` is off so a NULL value keeps its key.
    """
    phone_digits = F.floor(uniform(seed, f"{tag}.phone", row_id) * 1e10).cast("bigint").cast("string")
    doc = F.struct(
        F.concat(F.lit("contact_"), hex_token(seed, f"{tag}.email", row_id, 8), F.lit("@supplier.com")).alias("email"),
        random_text(seed, f"{tag}.notes", row_id, 10, 50).alias("notes"),
        F.concat(F.lit("+"), F.lpad(phone_digits, 12, "0")).alias("phone"),
        F.concat(F.lit("http://supplier_"), hex_token(seed, f"{tag}.web", row_id, 8), F.lit(".com")).alias("website"),
    )
    return F.to_json(doc, {"ignoreNullFields": "false"})
