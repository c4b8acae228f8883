"""Operator 12: how five filters interact, by exact constrained least squares over their coalitions.

Every document gets a mask of the filters it fails: A (few words), B (repeated words), C (many
capitals), D (symbols), E (its text stands under a smaller doc_id too, anywhere in the table).
Per part (language) the documents removed by each of the 32 coalitions of filters are tabulated:
all of them, those labelled good and those labelled toxic.

* Step counts of any order are differences of coalitions: what a filter removes after a prefix P is
  v(P + filter) - v(P).
* A filter's Shapley value is the solution of the least squares problem with the Shapley kernel
  weights, constrained to efficiency (the values add up to v(all)).  Its normal equations are solved
  in rationals, so the value is exact; times 120 it is the filter's removals summed over all orders.

Only 32 counts per part leave the aggregation; masks are bytes, texts are read once, and no text is
shuffled, only its SHA-256.  Copies are found by aggregation: a text that a third of all rows share
costs one row per task and part.

Defined results: a null text is the empty text and a null lang the part ``''``; a text without words
fails A only (and E if it is a copy); rows without doc_id are never copies of a smaller doc_id and
make no other row one; rows repeated under the smallest doc_id of their text do not fail E, for no
smaller doc_id has it; a document is good (toxic) if any of its label rows says so, a null label says nothing;
an empty table has no parts and gives no rows; extra columns are ignored; very long texts are read
whole, one at a time.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm.common import only, read

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
COALITIONS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
# Fixed values of the filters.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"

SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_mask(text: bytes | None) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    text = text or b""
    words = text.split()  # bytes: ASCII white space only
    n_words, n_distinct = len(words), len(set(words))
    n_capitals = len(text) - len(text.translate(None, CAPITALS))
    n_chars = len(text.translate(None, bytes(range(0x80, 0xC0))))  # code points: all but continuation bytes
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    fails = (
        n_words < MIN_WORDS,
        100 * n_distinct < MIN_DISTINCT_PERCENT * n_words,
        100 * n_capitals > MAX_CAPITALS_PERCENT * n_chars,
        n_symbols > 0,
    )
    return sum(bool(f) << i for i, f in enumerate(fails))


def text_masks(text: Column) -> Column:
    @F.pandas_udf("int")
    def masks(texts: pd.Series) -> pd.Series:
        return pd.Series([text_mask(t) for t in texts], dtype="int32")

    return masks(text.cast("binary"))


def masked_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and by their labels."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text", "lang").select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_masks(F.col("text")).alias("mask"),
        # rows without an id match no label: dealt over many tasks instead of one
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("deal"),
    )
    marks = (
        only(labels, "doc_id", "quality", "toxic")
        .filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
        .withColumn("label_deal", F.lit(0).cast("bigint"))
    )
    labelled = rows.join(
        marks, (F.col("doc_id") == F.col("label_id")) & (F.col("deal") == F.col("label_deal")), "left"
    ).select(
        "doc_id",
        "part",
        "digest",
        "mask",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    # one row per text, part and labels: its rows, its smallest id and the rows under that id
    kind = ["digest", "part", "good", "toxic"]
    by_id = labelled.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("mask").alias("mask"))
    texts = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.first("mask").alias("mask"),
        F.min("doc_id").alias("low"),
        F.coalesce(F.min_by("n", F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))), F.lit(0)).alias("n_low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id"),
    )
    lowest = F.min("low").over(Window.partitionBy("digest"))  # at most four rows a part
    firsts = F.col("n_no_id") + F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(0)
    split = texts.withColumn("lowest", lowest).withColumn("firsts", firsts)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")),
    )
    return split.select("part", "good", "toxic", F.explode(both).alias("m")).select(
        "part", F.col("m.mask").alias("mask"), "good", "toxic", F.col("m.n").alias("n")
    ).filter("n > 0")


def coalitions(counts: DataFrame) -> DataFrame:
    """Per part: total, and what each of the 32 coalitions removes of all, good and toxic documents."""

    def removals(weight: Column) -> Column:
        fails = [F.col("mask").bitwiseAND(F.lit(s)) != 0 for s in range(COALITIONS)]
        return F.array(*[F.sum(F.when(f, weight).otherwise(0)) for f in fails])

    return counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        removals(F.col("n")).alias("removed"),
        removals(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        removals(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular linear system in rationals (Gauss-Jordan)."""
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        head = rows[i][i]
        rows[i] = [x / head for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                factor = rows[j][i]
                rows[j] = [x - factor * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [r[-1] for r in rows]


def shapley(values: list[int]) -> list[Fraction]:
    """Shapley values of the game ``values`` (by coalition mask): kernel-weighted least squares.

    Minimises the sum over proper coalitions S of w(S) (v(S) - v(0) - sum of the members' values)^2,
    subject to the values adding up to v(all) - v(0); the multiplier of the constraint is the last unknown.
    """
    m = len(values).bit_length() - 1
    full = (1 << m) - 1
    zero, one = Fraction(0), Fraction(1)
    matrix = [[zero] * m + [one] for _ in range(m)] + [[one] * m + [zero]]
    right = [zero] * m + [Fraction(int(values[full]) - int(values[0]))]
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(m - 1, comb(m, size) * size * (m - size))
        members = [i for i in range(m) if s >> i & 1]
        for i in members:
            right[i] += weight * (int(values[s]) - int(values[0]))
            for j in members:
                matrix[i][j] += weight
    return solve(matrix, right)[:m]


def steps(part: str, total: int, removed: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """The rows of one part: every order and step."""
    full = COALITIONS - 1
    summed = [int(ORDERS * x) for x in shapley(removed)]
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            out.append(
                (
                    part,
                    name,
                    step,
                    total - removed[after],
                    here,
                    removed[1 << i] - here,
                    removed[full] - removed[full ^ 1 << i],
                    good[after] - good[before],
                    toxic[after] - toxic[before],
                    summed[i],
                )
            )
            before = after
    return out


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step (see :data:`SCHEMA`)."""

    def tables(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for part, *counts in batch[["part", "total", "removed", "good", "toxic"]].itertuples(index=False):
                total, *lists = counts
                rows = steps(part, int(total), *[[int(x) for x in v] for v in lists])
                yield pd.DataFrame(rows, columns=names)

    return coalitions(masked_counts(docs, labels)).mapInPandas(tables, SCHEMA)


def op12_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    """:func:`interaction_audit` of the whole documents and labels tables."""
    return interaction_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


# Step counts by walking every order over the documents' masks; the Shapley column is the plain sum over all orders.
ORACLE = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lowest FROM docs
), failed AS (
    SELECT doc_id, part,
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > lowest THEN 'E' ELSE '' END AS fails
    FROM words
), marked AS (
    SELECT part, fails, count(*) AS n,
        count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
        count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
    FROM failed GROUP BY part, fails
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), stepped AS (
    SELECT filter_order, s AS step, filter_order[s] AS f,
        CASE WHEN s = 1 THEN '' ELSE filter_order[1:s - 1] END AS earlier
    FROM orders, range(1, 6) AS r(s)
), counted AS (
    SELECT part, filter_order, step, f,
        sum(CASE WHEN NOT gone AND NOT fails_f THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND fails_f THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails_f THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails_f THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND fails_f THEN toxic ELSE 0 END) AS toxic_lost
    FROM (
        SELECT *, contains(fails, f) AS fails_f, earlier <> '' AND regexp_matches(fails, '[' || earlier || 'x]') AS gone
        FROM marked, stepped
    ) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
