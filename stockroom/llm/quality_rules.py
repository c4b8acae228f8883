"""Operator 9: quality rules by distribution divergence, with DataFrame operations only.

Base rules (fixed by contract): word, character, symbol, repeated-line and repeated-window
counts; a document fails when it has fewer than 10 words or over 20 % of its words lie in
5-word windows found at least twice.

Divergence rules: every document is compared with the reference of its language by
Jensen-Shannon distance (square root of the base-2 divergence, 0 to 1) of

* its character classes (lower-case, upper-case and other letters, digits, white space,
  sentence marks, other marks), and
* its common words (the language's ``n_common`` most frequent words, plus one class for
  all other words).

References are counted over all documents of a language: every word of every document, combined
on the map side, so that a task hands on its distinct words once.  A window with its own limit ranks them
(ties: by the word), and only the common ones of each task leave it.  A language without
``MIN_REFERENCE_WORDS`` counted words has no reference; its documents, like those of a null
language, are held against the nearest reference.  Documents shorter than the minimum lengths skip
a divergence rule, since a short text's histogram is noise.

Defined results: null and empty texts have no words and fail the base rules; repeated rows
each get the same row; an empty table gives no rows; without any reference only the base
rules apply; extra columns are ignored.  Very long texts are counted inside their row in
time linear in their length (times log for the window sort).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm.common import LOWER, checkpointed, let, only, read

# Fixed values of the base rules.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Parameters of the divergence rules.
N_COMMON = 16
MIN_REFERENCE_WORDS = 1000
MIN_CHARS = 200
MIN_DIVERGENCE_WORDS = 60
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.25
# Character classes after lower-case letters and white space, in the order they are stripped from what is left
# without those two; the last class, other ASCII marks (with all of SYMBOLS), is what then remains.
# Every character is named: Java looks such a class up in a table, and tests ranges one by one.
LOWER_OR_SPACE = rf"[{LOWER}\x20\x09\x0A\x0B\x0C\x0D]+"
CLASSES = {
    "other": r"[^\x00-\x7F]+",
    "sentence": "[.,;:!?'\"()-]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
}


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def window_hashes(hs: Column) -> Column:
    """Hashes of the 5-word windows of a text, given its words' hashes."""

    def windows(words):
        firsts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
        return F.transform(firsts, lambda h, i: F.xxhash64(h, *[words[i + k] for k in range(1, WINDOW)]))

    return let(hs, windows)


def repeat_words(windows: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text, given the windows' hashes.

    A text whose hashes are all distinct (the usual case) is done.  Otherwise (hash, position)
    pairs are sorted, those equal to a neighbour are kept, and each start covers up to the next
    start or five words.
    """
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equal_to_neighbour(pairs):
        last = F.size(pairs) - 1
        return F.filter(
            pairs,
            lambda p, i: ((i > 0) & (pairs[F.greatest(i - 1, F.lit(0))]["h"] == p["h"]))
            | ((i < last) & (pairs[F.least(i + 1, last)]["h"] == p["h"])),
        )

    def cover(at):
        last = F.size(at) - 1
        spans = F.transform(
            at, lambda s, i: F.when(i == last, WINDOW).otherwise(F.least(F.lit(WINDOW), at[F.least(i + 1, last)] - s))
        )
        return F.aggregate(spans, F.lit(0), lambda acc, x: acc + x)

    starts = F.sort_array(F.transform(let(tagged, equal_to_neighbour), lambda p: p["i"]))
    none_twice = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(none_twice, F.lit(0)).otherwise(let(starts, cover))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def _strip(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def char_classes(text: Column, rest: Column) -> Column:
    """Code points of ``text``: lower-case letters and white space together, then each class of :data:`CLASSES`, then the last.

    ``rest`` is the text without the first two; each class is stripped from what the last left.
    """

    def strip(left, lengths, classes):
        if not classes:
            return F.array(*lengths)
        return let(_strip(left, classes[0]), lambda r: strip(r, [*lengths, F.length(r)], classes[1:]))

    def differences(ls):
        n = len(CLASSES) + 1
        return F.array(*[(ls[i] - ls[i + 1]).cast("bigint") for i in range(n)], ls[n].cast("bigint"))

    lengths = let(rest, lambda r: strip(r, [F.length(text), F.length(r)], list(CLASSES.values())))
    return let(lengths, differences)


def _space_apart(chars: Column, word_chars: Column) -> Column:
    """:func:`char_classes` with its first entry parted into lower-case letters and white space."""
    n_space = F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, x: a + x) - word_chars
    return F.concat(F.array(chars[0] - n_space, n_space), F.slice(chars, F.lit(2), F.size(chars)))


def measures(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, character-class counts ``chars`` and the words' hashes ``hs``.

    Arrays that are used more than once are columns of a step of their own, so they are made
    once and array functions on them are compiled; inside a lambda everything is interpreted.
    """
    base = only(docs, "doc_id", "text", "lang").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    split = base.withColumn("ws", words(text)).withColumn("rest", _strip(text, LOWER_OR_SPACE))
    hashed = split.select(
        "doc_id",
        "lang",
        F.size("ws").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("bigint").alias("word_chars"),
        char_classes(text, F.col("rest")).alias("chars"),
        F.length(_strip(F.col("rest"), f"[^{SYMBOLS}]+")).alias("n_symbols"),
        _dup_lines(text).alias("n_dup_lines"),
        F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"),
    )
    counted = hashed.withColumn("windows", window_hashes(F.col("hs"))).withColumn(
        "n_repeat_words", repeat_words(F.col("windows"))
    )
    too_repeated = 100 * F.col("n_repeat_words").cast("bigint") > MAX_REPEAT_PERCENT * F.col("n_words").cast("bigint")
    return counted.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "hs",
        _space_apart(F.col("chars"), F.col("word_chars")).alias("chars"),
        F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_chars"),
        ((F.col("n_words") < MIN_WORDS) | too_repeated).alias("base_failed"),
    )


def _common_words(words_of_lang: DataFrame, n_common: int) -> DataFrame:
    """(lang, ranked, n_words, word_chars): the ``n_common`` most frequent words per language with their counts."""
    counted = words_of_lang.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("word"))
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_common)
    ranked = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("ranked"))
    totals = counted.groupBy("lang").agg(  # reads the same shuffled counts
        F.sum("n").alias("n_words"), F.sum(F.col("n") * F.length("word")).alias("word_chars")
    )
    return ranked.join(totals, "lang")


def references(docs: DataFrame, n_common: int = N_COMMON) -> DataFrame:
    """One row per language: character-class counts, common words and their counts (the last: all others)."""
    known = only(docs, "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chars = known.select("lang", char_classes(F.col("text"), _strip(F.col("text"), LOWER_OR_SPACE)).alias("chars"))
    chars = chars.groupBy("lang").agg(
        F.array(*[F.sum(F.col("chars")[i]) for i in range(len(CLASSES) + 2)]).alias("ref_chars")
    )
    pieces = known.select("lang", F.explode_outer(F.split("text", SPACES)).alias("word")).filter(F.col("word") != "")
    common = _common_words(pieces, n_common)
    counts = F.transform("ranked", lambda r: r["n"])
    rest = F.col("n_words") - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (
        chars.join(common, "lang")
        .filter(F.col("n_words") >= MIN_REFERENCE_WORDS)
        .select(
            "lang",
            _space_apart(F.col("ref_chars"), F.col("word_chars")).cast("array<double>").alias("ref_chars"),
            F.transform("ranked", lambda r: r["word"]).alias("common"),
            F.concat(counts, F.array(rest)).cast("array<double>").alias("ref_words"),
        )
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal size (1 if either is all zero).

    From the base-2 divergence goes what a sample of the reference itself would show:
    (classes - 1) / (8 ln 2 * size of ``p``).  Without it short clean texts look far away.
    """

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def divergence(pn, qn):
        def term(a, b):
            one = F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(F.lit(0.0))
            two = F.when(b > 0, b * F.log2(F.lit(2.0) * b / (a + b))).otherwise(F.lit(0.0))
            return (one + two) / 2

        return total(F.zip_with(pn, qn, term))

    def normal(a, t):
        return F.transform(a, lambda x: x / t)

    def distance(tp, tq):
        noise = (F.size(p) - 1) / (F.lit(8.0 * math.log(2)) * tp)
        return F.sqrt(F.greatest(F.lit(0.0), divergence(normal(p, tp), normal(q, tq)) - noise))

    return let(
        total(p), lambda tp: let(total(q), lambda tq: F.when((tp > 0) & (tq > 0), distance(tp, tq)).otherwise(1.0))
    )


def _word_histogram(hs: Column, common: Column) -> Column:
    """Counts of the common words in the text, and of all other words; both sides are word hashes."""

    def with_others(counts):
        known = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        return F.concat(counts, F.array(F.size(hs) - known)).cast("array<double>")

    def counts(at):
        return F.transform(common, lambda c: F.size(at) - F.size(F.array_remove(at, c)))

    return let(let(hs, counts), with_others)


def score(docs: DataFrame, n_common: int = N_COMMON) -> DataFrame:
    """Base measures plus char_distance, word_distance (null where a guard skips them) and ``kept``."""
    measured = measures(docs)
    refs = checkpointed(references(docs, n_common))
    # one row holding every language's reference: bounded by languages times (n_common + classes)
    hashed = refs.withColumn("common", F.transform("common", lambda w: F.xxhash64(w)))
    table = hashed.agg(F.collect_list(F.struct("lang", "ref_chars", "common", "ref_words")).alias("refs"))
    joined = measured.join(F.broadcast(table))  # one row on the right: every document gets it, no pairs are made
    own = F.filter("refs", lambda r: r["lang"] == F.col("lang"))
    chosen = joined.withColumn("own", F.when(F.size(own) > 0, own).otherwise(F.col("refs")))
    doc_chars = F.col("chars").cast("array<double>")
    char_distance = F.array_min(F.transform("own", lambda r: js_distance(doc_chars, r["ref_chars"])))
    word_distance = F.array_min(
        F.transform(
            "own",
            lambda r: let(_word_histogram(F.col("hs"), r["common"]), lambda h: js_distance(h, r["ref_words"])),
        )
    )
    some = F.size("own") > 0
    scored = chosen.select(
        *[c for c in measured.columns if c not in ("hs", "chars", "n_chars")],
        F.when(some & (F.col("n_chars") >= MIN_CHARS), char_distance).alias("char_distance"),
        F.when(some & ~F.col("base_failed") & (F.col("n_words") >= MIN_DIVERGENCE_WORDS), word_distance).alias(
            "word_distance"
        ),
    )
    good = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (
        F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return scored.withColumn("kept", ~F.col("base_failed") & good)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`score` over the whole documents table (distances to six digits)."""
    found = score(read(spark, sf_dir, "documents"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(
        "doc_id",
        *[F.col(c).cast("bigint").alias(c) for c in longs],
        "base_failed",
        "kept",
        F.round("char_distance", 6).alias("char_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )


# The same rules as relations: histograms in long form, joined with the references class by class.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text IS NULL AS no_text, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS lines FROM d),
grams AS (SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM again) GROUP BY rid),
cls AS (
  SELECT rid, lang, no_text, unnest([0, 1, 2, 3, 4, 5, 6]) AS k, unnest([
    length(regexp_replace(text, '[^a-z]+', '', 'g')),
    length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')),
    length(regexp_replace(text, '[\x00-\x7F]+', '', 'g')),
    length(regexp_replace(text, '[^.,;:!?''"()-]+', '', 'g')),
    length(regexp_replace(text, '[^A-Z]+', '', 'g')),
    length(regexp_replace(text, '[^0-9]+', '', 'g')),
    length(regexp_replace(text, '[^\x00-\x7F]|[a-zA-Z0-9\x20\x09-\x0D.,;:!?''"()-]', '', 'g'))]) AS n
  FROM w),
base AS (
  SELECT w.rid, doc_id, lang, length(text) AS n_chars, len(ws) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
word AS (SELECT rid, lang, unnest(ws) AS word FROM w),
by_lang AS (SELECT lang, word, count(*) AS n FROM word WHERE lang IS NOT NULL GROUP BY ALL),
lang_words AS (SELECT lang, sum(n) AS total FROM by_lang GROUP BY lang HAVING sum(n) >= {MIN_REFERENCE_WORDS}),
common AS (
  SELECT lang, word, n FROM by_lang JOIN lang_words USING (lang)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {N_COMMON}),
ref_chars AS (SELECT lang, k, sum(n) AS q FROM cls JOIN lang_words USING (lang) WHERE NOT no_text GROUP BY ALL),
pairs AS (
  SELECT rid, lang FROM b JOIN lang_words USING (lang)
  UNION ALL
  SELECT b.rid, l.lang FROM b, lang_words l WHERE b.lang IS NULL OR b.lang NOT IN (SELECT lang FROM lang_words)),
doc_words AS (SELECT rid, word, count(*) AS n FROM word GROUP BY ALL),
hist AS (
  SELECT 'c' AS kind, p.rid, p.lang, r.k, CAST(c.n AS DOUBLE) AS p, CAST(r.q AS DOUBLE) AS q
  FROM pairs p JOIN cls c ON c.rid = p.rid JOIN ref_chars r ON r.lang = p.lang AND r.k = c.k
  UNION ALL
  SELECT 'w', p.rid, p.lang, 0, CAST(coalesce(dw.n, 0) AS DOUBLE), CAST(c.n AS DOUBLE)
  FROM pairs p JOIN common c ON c.lang = p.lang LEFT JOIN doc_words dw ON dw.rid = p.rid AND dw.word = c.word
  UNION ALL
  SELECT 'w', p.rid, p.lang, 1,
    CAST(b.n_words - (SELECT coalesce(sum(dw.n), 0) FROM doc_words dw JOIN common c ON c.word = dw.word
                      WHERE dw.rid = p.rid AND c.lang = p.lang) AS DOUBLE),
    CAST(l.total - (SELECT sum(c.n) FROM common c WHERE c.lang = p.lang) AS DOUBLE)
  FROM pairs p JOIN b ON b.rid = p.rid JOIN lang_words l ON l.lang = p.lang),
shares AS (
  SELECT *, p / sum(p) OVER g AS ps, q / sum(q) OVER g AS qs, sum(p) OVER g AS tp, count(*) OVER g AS classes
  FROM hist WINDOW g AS (PARTITION BY kind, rid, lang)),
div AS (
  SELECT kind, rid, lang, any_value(tp) AS tp, any_value(classes) AS classes,
    sum((CASE WHEN p > 0 THEN ps * log2(2 * ps / (ps + qs)) ELSE 0 END
       + CASE WHEN q > 0 THEN qs * log2(2 * qs / (ps + qs)) ELSE 0 END) / 2) AS js
  FROM shares GROUP BY ALL),
dist AS (
  SELECT rid, kind, min(CASE WHEN tp > 0 THEN sqrt(greatest(0, js - (classes - 1) / (8 * ln(2) * tp))) ELSE 1 END) AS x
  FROM div GROUP BY ALL),
scored AS (
  SELECT b.*,
    CASE WHEN n_chars >= {MIN_CHARS} THEN c.x END AS cd,
    CASE WHEN NOT base_failed AND n_words >= {MIN_DIVERGENCE_WORDS} THEN v.x END AS wd
  FROM b LEFT JOIN dist c ON c.rid = b.rid AND c.kind = 'c' LEFT JOIN dist v ON v.rid = b.rid AND v.kind = 'w')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(wd, 0) <= {MAX_WORD_DISTANCE} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM scored
"""
