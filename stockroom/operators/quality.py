"""Integrity audits (Q1-Q10): the declared rules of the data model, checked in batch.

Spark's file tables do not enforce PRIMARY KEY, UNIQUE, FOREIGN KEY, CHECK or
NOT NULL on write, so each rule kind is a job that returns the rows (or keys) that
break it.  Semantics follow SQL: a UNIQUE column admits any number of NULLs, a
NULL foreign key passes, and a CHECK that evaluates to unknown passes.

Scale notes: key audits are aggregations (combined on the map side, so a key that
holds a third of all rows costs one row per map task); foreign-key audits are
anti joins whose parent side is broadcast only behind a size check, as keys or as
bitmaps of 64 keys a row; the other rules are map-only filters that Catalyst pushes
into the scan where it can.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import schemas
from stockroom.plans.joins import broadcast_if_small, broadcast_limit, measured_size


def _as_list(cols: str | list[str] | tuple[str, ...]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


# ---------------------------------------------------------------------------
# Q1, Q2: keys
# ---------------------------------------------------------------------------
def audit_primary_key(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Q1: key values that occur more than once or are NULL → key column(s), n."""
    keys = _as_list(key)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") > 1) | _any([F.col(k).isNull() for k in keys]))


def audit_unique(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Q2: non-NULL key values that occur more than once → key column(s), n."""
    keys = _as_list(key)
    present = df.filter(~_any([F.col(k).isNull() for k in keys]))
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


# ---------------------------------------------------------------------------
# Q3: NOT NULL
# ---------------------------------------------------------------------------
def audit_not_null(df: DataFrame, cols: list[str], row_key: str | list[str]) -> DataFrame:
    """Q3: one row per (row, NULL column) → row key column(s), column_name.

    A column of ``cols`` that ``df`` lacks is reported once, with a NULL row key.
    """
    keys = _as_list(row_key)
    absent = [c for c in cols if c not in df.columns]
    cols = [c for c in cols if c in df.columns]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", column_name string"
    missing = df.sparkSession.createDataFrame([(*[None] * len(keys), c) for c in absent], schema)
    if not cols:
        return missing
    hits = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]),
        lambda name: name.isNotNull(),
    )
    found = df.filter(_any([F.col(c).isNull() for c in cols])).select(*keys, F.explode(hits).alias("column_name"))
    return found.unionByName(missing) if absent else found


# ---------------------------------------------------------------------------
# Q4: FOREIGN KEY
# ---------------------------------------------------------------------------
INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")
KEYS_PER_WORD = 64  # bits of a long


def _word(key: Column) -> Column:
    return F.shiftright(key.cast("bigint"), 6)


def _bit(key: Column) -> Column:
    return key.cast("bigint").bitwiseAND(KEYS_PER_WORD - 1).cast("int")


def key_words(keys: DataFrame, column: str) -> DataFrame:
    """The set of non-NULL integer keys as bitmaps: one row (_sr_word, _sr_bits) per 64 consecutive keys.

    Dense keys take half a byte each instead of a row, and sparse ones never more than a row.
    """
    key = F.col(column)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(key))
    return (
        keys.filter(key.isNotNull())
        .groupBy(_word(key).alias("_sr_word"))
        .agg(F.bit_or(bit).alias("_sr_bits"))  # a hash aggregate, combined on the map side
    )


def _has_key(bits: Column, key: Column) -> Column:
    return F.getbit(bits, _bit(key)) == 1


class ParentKeys:
    """The keys of a parent table, measured once for any number of child columns.

    Keys whose column measures under the broadcast bound are broadcast (``small``).  Integer keys beyond it
    become bitmap words (:func:`key_words`) and are broadcast as such while these fit (``words``).  In both
    cases no child row moves, however hot its key.

    Larger parents are joined by shuffle, key by key.  They are neither made distinct nor packed into words
    then: an aggregation between shuffle and join would keep AQE from splitting a hot key.
    """

    def __init__(self, parent: DataFrame, pk: str):
        keys = parent.select(F.col(pk).alias("_sr_pk")).filter(F.col("_sr_pk").isNotNull())
        self.keys = broadcast_if_small(keys)
        self.small = self.keys is not keys  # hinted: the keys fit the broadcast bound
        self.whole = dict(keys.dtypes)["_sr_pk"] in INTEGER_TYPES
        self.words: DataFrame | None = None
        limit = broadcast_limit(keys)
        if not self.small and self.whole and limit > 0:
            words = key_words(keys, "_sr_pk")
            if measured_size(words) <= limit:
                self.words = F.broadcast(words)


def audit_foreign_key(child: DataFrame, parent: DataFrame | ParentKeys, fk: str, pk: str) -> DataFrame:
    """Q4: child rows whose non-NULL ``fk`` has no parent row with ``pk == fk``.

    Give a :class:`ParentKeys` to audit several children of one parent with one measurement.
    """
    found = parent if isinstance(parent, ParentKeys) else ParentKeys(parent, pk)
    refs = child.filter(F.col(fk).isNotNull())
    if found.words is None or dict(child.dtypes)[fk] not in INTEGER_TYPES:
        return refs.join(found.keys, refs[fk] == found.keys["_sr_pk"], "left_anti")
    known = (_word(refs[fk]) == found.words["_sr_word"]) & _has_key(found.words["_sr_bits"], refs[fk])
    return refs.join(found.words, known, "left_anti")


# ---------------------------------------------------------------------------
# Q5-Q8: CHECK, enum domain, VARCHAR length, NUMERIC precision
# ---------------------------------------------------------------------------
def audit_check(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Q5: rows where ``predicate`` is FALSE (unknown passes, as in SQL)."""
    cond = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~cond)


def audit_enum(df: DataFrame, col: str, domain: tuple[str, ...]) -> DataFrame:
    """Q6: rows whose non-NULL ``col`` is outside ``domain``."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*domain))


def audit_varchar(df: DataFrame, col: str, max_length: int) -> DataFrame:
    """Q7: rows whose ``col`` has more than ``max_length`` characters.

    Trailing blanks beyond the limit are forgiven (they would be cut on insert),
    so the length of the right-trimmed text is compared.
    """
    return df.filter(F.length(F.rtrim(F.col(col))) > max_length)


def audit_numeric(df: DataFrame, col: str, precision: int, scale: int) -> DataFrame:
    """Q8: rows whose ``col``, rounded to ``scale`` places, needs more than ``precision - scale``
    integer digits (it would not fit NUMERIC(precision, scale))."""
    limit = F.lit(10 ** (precision - scale))
    exact = F.col(col).try_cast("decimal(38,10)")
    too_big = F.abs(F.round(exact, scale)) >= limit
    overflow = F.col(col).isNotNull() & exact.isNull()  # beyond even DECIMAL(38,10)
    return df.filter(too_big | overflow)


# ---------------------------------------------------------------------------
# Q9: defaults
# ---------------------------------------------------------------------------
def default_value(table: str, column: str, as_of=None, now=None) -> Column:
    c = schemas.column(table, column)
    if c.default == "today":
        value = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    elif c.default == "now":
        value = F.current_timestamp() if now is None else F.lit(str(now)).cast("timestamp")
    else:
        value = F.expr(c.default)
    return value.cast(c.dtype)


def apply_defaults(df: DataFrame, table: str, as_of=None, now=None) -> DataFrame:
    """Q9: add each defaulted column of ``table`` that is absent from ``df``.

    An explicit NULL in a present column is kept (it then fails Q3 if the column is
    NOT NULL).  Columns come out in the table's declared order, extra input
    columns after them.
    """
    present = set(df.columns)
    fills = {name: default_value(table, name, as_of, now) for name in schemas.defaults(table) if name not in present}
    declared = [c.name for c in schemas.columns(table)]
    order = [n for n in declared if n in present or n in fills] + [n for n in df.columns if n not in declared]
    return df.select(*[fills[n].alias(n) if n in fills else F.col(n) for n in order])


# ---------------------------------------------------------------------------
# Q10: ON DELETE CASCADE with blocking references
# ---------------------------------------------------------------------------
def cascade_delete_warehouses(
    warehouses: DataFrame,
    zones: DataFrame,
    inventory: DataFrame,
    transactions: DataFrame,
    stock_takes: DataFrame,
    ids: list[int] | DataFrame,
) -> DataFrame:
    """Q10: the effect of one DELETE of the warehouses ``ids``.

    Deleting a warehouse deletes its zones (cascade), but a zone still referenced by a batch,
    a transaction (source or destination) or a stocktake has no cascade, and then the
    statement fails whole: nothing is deleted.  Returns one row per warehouse and per zone:
    entity ('warehouse' | 'zone'), id, warehouse_id, outcome.  ``deleted`` is only given when
    no doomed zone is referenced; otherwise the referenced zones and their warehouses are
    ``blocked`` and everything else is ``kept``.
    """
    if isinstance(ids, DataFrame):
        doomed_ids = ids.select(F.col(ids.columns[0]).alias("warehouse_id")).distinct()
    else:
        doomed_ids = warehouses.select("warehouse_id").filter(F.col("warehouse_id").isin(*ids)).distinct()
    doomed_ids = broadcast_if_small(doomed_ids.withColumn("_listed", F.lit(True)))

    # The referenced zones as bitmap words: each task of the facts hands on one row per 64 zone ids,
    # however many rows refer to a zone.  One scan per table; a transaction refers to up to two zones.
    moves = transactions.select(F.explode(F.array("source_zone_id", "destination_zone_id")).alias("zone_id"))
    references = inventory.select("zone_id").unionByName(moves).unionByName(stock_takes.select("zone_id"))
    words = key_words(references, "zone_id")

    zone = F.col("zone_id")
    marked = (
        zones.select("zone_id", "warehouse_id")
        .join(doomed_ids, "warehouse_id", "left")
        .join(words, _word(zone) == F.col("_sr_word"), "left")
        .select(
            "zone_id",
            "warehouse_id",
            F.coalesce("_listed", F.lit(False)).alias("_doomed"),
            (F.col("_listed").isNotNull() & F.coalesce(_has_key(F.col("_sr_bits"), zone), F.lit(False))).alias("_blocked"),
        )
    )
    # one flag for the whole statement: a row for the doomed zones, a row for the others
    fails = marked.groupBy(F.col("_doomed").alias("_of")).agg(F.bool_or("_blocked").alias("_fails"))
    stopped = marked.filter("_blocked").groupBy("warehouse_id").agg(F.lit(True).alias("_stopped"))

    def outcomes(rows: DataFrame, entity: str, key: str) -> DataFrame:
        return rows.join(F.broadcast(fails), F.col("_doomed") == F.col("_of"), "left").select(  # two rows
            F.lit(entity).alias("entity"),
            F.col(key).alias("id"),
            "warehouse_id",
            F.when(~F.col("_doomed"), "kept")
            .when(F.col("_blocked"), "blocked")
            .when(F.coalesce("_fails", F.lit(False)), "kept")
            .otherwise("deleted")
            .alias("outcome"),
        )

    owners = (
        warehouses.select("warehouse_id")
        .join(doomed_ids, "warehouse_id", "left")
        .join(stopped, "warehouse_id", "left")
        .select(
            "warehouse_id",
            F.coalesce("_listed", F.lit(False)).alias("_doomed"),
            F.coalesce("_stopped", F.lit(False)).alias("_blocked"),
        )
    )
    return outcomes(owners, "warehouse", "warehouse_id").unionByName(outcomes(marked, "zone", "zone_id"))


# ---------------------------------------------------------------------------
# All rules of one table, from the constraint table in ``schemas``
# ---------------------------------------------------------------------------
VIOLATION_COLUMNS = ("table_name", "rule", "column_name", "row_key")


def _violations(df: DataFrame, table: str, rule: str, column: str, key: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.lit(column).alias("column_name"),
        F.col(key).cast("string").alias("row_key"),
    )


def row_rules(df: DataFrame, table: str) -> list[tuple[str, str, Column]]:
    """The declared row-level rules of ``table`` that ``df`` can be checked against.

    Each is ``(rule, column, violated)`` where ``violated`` is TRUE exactly when the
    row breaks the rule (NULL-safe: an unknown CHECK is not a violation).
    """
    cols = set(df.columns)
    out: list[tuple[str, str, Column]] = []
    for c in schemas.not_null_columns(table):
        if c in cols:
            out.append(("not_null", c, F.col(c).isNull()))
    for name, t, predicate, needs in schemas.CHECKS:
        if t == table and all(c in cols for c in needs):
            out.append((name, ",".join(needs), F.coalesce(~F.expr(predicate), F.lit(False))))
    for c, domain in schemas.enum_columns(table):
        if c in cols:
            out.append(("enum", c, F.col(c).isNotNull() & ~F.col(c).isin(*domain)))
    for c, n in schemas.varchar_columns(table):
        if c in cols:
            out.append((f"varchar({n})", c, F.coalesce(F.length(F.rtrim(F.col(c))) > n, F.lit(False))))
    for c, p, sc in schemas.numeric_columns(table):
        if c in cols:
            exact = F.col(c).try_cast("decimal(38,10)")
            bad = (F.abs(F.round(exact, sc)) >= 10 ** (p - sc)) | (F.col(c).isNotNull() & exact.isNull())
            out.append((f"numeric({p},{sc})", c, F.coalesce(bad, F.lit(False))))
    return out


def audit_keys(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """All key rules of a table in one pass: rule, column_name, row_key of every broken key.

    ``rules`` are ('primary_key' | 'unique', column).  Keys that occur more than once break either rule, a
    NULL only a primary key.  Every row is read once and gives one (rule, key) per rule, counted in one
    aggregation by the key itself (integers as longs, others as text), combined on the map side: a key that
    a third of all rows share costs one row per task, and no digest can take two keys for one.
    """
    types = dict(df.dtypes)

    def entry(i: int, column: str) -> Column:
        whole = types[column] in INTEGER_TYPES
        return F.struct(
            F.lit(i).alias("i"),
            (F.col(column) if whole else F.lit(None)).cast("bigint").alias("number"),
            (F.lit(None) if whole else F.col(column)).cast("string").alias("text"),
        )

    entries = F.explode(F.array(*[entry(i, column) for i, (_, column) in enumerate(rules)]))
    nullable = [i for i, (rule, _) in enumerate(rules) if rule == "unique"]
    is_null = F.col("number").isNull() & F.col("text").isNull()
    counted = df.select(entries.alias("_k")).select("_k.*").groupBy("i", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    broken = F.when(is_null, ~F.col("i").isin(*nullable) if nullable else F.lit(True)).otherwise(F.col("n") > 1)

    def of_rule(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("i"))

    return counted.filter(broken).select(
        of_rule([rule for rule, _ in rules]).alias("rule"),
        of_rule([column for _, column in rules]).alias("column_name"),
        F.coalesce(F.col("number").cast("string"), F.col("text")).alias("row_key"),
    )


def stacked_orphans(df: DataFrame, key: str, references: list[tuple[str, str, ParentKeys]]) -> DataFrame:
    """Orphans of several columns whose parents all exceed the broadcast bound, by one scan and one join.

    ``references`` are (rule, column, parent) with integer keys.  Each row gives one (parent, key) pair per
    non-NULL column; the keys of all parents are stacked the same way, and one anti join by (parent, key)
    resolves them all.  AQE splits a hot key of it.  Returns rule, column_name, row_key.
    """
    parents: list[ParentKeys] = []
    for _, _, p in references:
        if not any(p is q for q in parents):
            parents.append(p)

    def number(p: ParentKeys) -> int:
        return next(i for i, q in enumerate(parents) if p is q)

    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(number(p)).alias("parent"), F.col(column).cast("bigint").alias("fk"))
            for i, (_, column, p) in enumerate(references)
        ]
    )
    refs = (
        df.select(F.col(key).cast("string").alias("row_key"), F.explode(pairs).alias("_r"))
        .select("row_key", "_r.*")
        .filter(F.col("fk").isNotNull())
    )
    keys = reduce(
        DataFrame.unionByName,
        [p.keys.select(F.lit(i).alias("_sr_parent"), F.col("_sr_pk").cast("bigint")) for i, p in enumerate(parents)],
    )
    found = refs.join(keys, (refs["parent"] == keys["_sr_parent"]) & (refs["fk"] == keys["_sr_pk"]), "left_anti")

    def of_reference(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("i"))

    return found.select(
        of_reference([rule for rule, _, _ in references]).alias("rule"),
        of_reference([column for _, column, _ in references]).alias("column_name"),
        "row_key",
    )


def audit_table(
    df: DataFrame, table: str, parents: dict[str, DataFrame | ParentKeys] | None = None
) -> DataFrame:
    """Every declared rule of ``table`` as one frame: table_name, rule, column_name, row_key.

    At most three passes over ``df``, whatever the number of rules and the size of the parents:

    * one evaluates all row-level rules (NOT NULL, CHECK, enum, VARCHAR, NUMERIC) and the foreign keys whose
      parent's keys, or their bitmap words, fit the broadcast bound.  Each row gets the array of rules it
      breaks, and only rows with some violation are exploded;
    * one counts the keys of all key rules (:func:`audit_keys`);
    * one resolves the foreign keys to larger parents, all in one join (:func:`stacked_orphans`).

    Only a large parent with keys other than integers adds an anti join of its own.  A parent is measured
    once, however many columns refer to it.

    NOT NULL columns that ``df`` lacks are reported with a NULL row key, unless the table has
    a default for them.  Other rules on absent columns have nothing to check.
    """
    cols = set(df.columns)
    types = dict(df.dtypes)
    key = schemas.PRIMARY_KEYS[table]
    if key not in cols:
        raise ValueError(f"{table}: the key column {key} is needed to name the violations")
    parts: list[DataFrame] = []
    rules = [(rule, col, bad) for rule, col, bad in row_rules(df, table)]

    measured: dict[str, ParentKeys] = {}
    marked = df
    stacked: list[tuple[str, str, ParentKeys]] = []
    for i, fk in enumerate(schemas.FOREIGN_KEYS):
        if fk.child != table or fk.column not in cols or fk.parent not in (parents or {}):
            continue
        if fk.parent not in measured:
            given = parents[fk.parent]
            measured[fk.parent] = given if isinstance(given, ParentKeys) else ParentKeys(given, fk.parent_key)
        found = measured[fk.parent]
        rule, ref = f"foreign_key:{fk.parent}", F.col(fk.column)
        if found.small:
            known = found.keys.select(F.col("_sr_pk").alias(f"_sr_fk{i}")).distinct()  # a repeated key adds no row
            marked = marked.join(F.broadcast(known), ref == F.col(f"_sr_fk{i}"), "left")
            rules.append((rule, fk.column, ref.isNotNull() & F.col(f"_sr_fk{i}").isNull()))
        elif not found.whole or types[fk.column] not in INTEGER_TYPES:
            parts.append(_violations(audit_foreign_key(df, found, fk.column, fk.parent_key), table, rule, fk.column, key))
        elif found.words is not None:
            words = found.words.select(F.col("_sr_word").alias(f"_sr_word{i}"), F.col("_sr_bits").alias(f"_sr_bits{i}"))
            marked = marked.join(F.broadcast(words), _word(ref) == F.col(f"_sr_word{i}"), "left")
            known_key = F.coalesce(_has_key(F.col(f"_sr_bits{i}"), ref), F.lit(False))
            rules.append((rule, fk.column, ref.isNotNull() & ~known_key))
        else:
            stacked.append((rule, fk.column, found))
    if stacked:
        parts.append(stacked_orphans(df, key, stacked).select(F.lit(table).alias("table_name"), "*"))

    if rules:
        hits = F.filter(
            F.array(
                *[F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column_name"))) for rule, col, bad in rules]
            ),
            lambda h: h.isNotNull(),
        )
        parts.append(
            marked.select(F.col(key).cast("string").alias("row_key"), hits.alias("_hits"))
            .filter(F.size("_hits") > 0)
            .select(F.lit(table).alias("table_name"), F.explode("_hits").alias("_h"), "row_key")
            .select("table_name", "_h.rule", "_h.column_name", "row_key")
        )
    unique = [("unique", col) for t, col in schemas.UNIQUE_KEYS if t == table and col in cols]
    parts.append(audit_keys(df, [("primary_key", key), *unique]).select(F.lit(table).alias("table_name"), "*"))
    absent = [c for c in schemas.not_null_columns(table) if c not in cols and c not in schemas.defaults(table)]
    if absent:
        rows = [(table, "not_null", c, None) for c in absent]
        schema = "table_name string, rule string, column_name string, row_key string"
        parts.append(df.sparkSession.createDataFrame(rows, schema))
    return reduce(DataFrame.unionByName, parts)
