"""Operator 10: benchmark decontamination with DataFrame operations only.

Words are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased.  A benchmark item gives every window of ``ngram`` consecutive words; an
item of fewer words is one window.  The windows form a hash set keyed by a 64-bit hash,
broadcast only behind a measured size bound.  Training texts are cut into the same windows inside
their row, the hashes are probed, and each hit is verified word by word, so a hash collision
never counts.  Beyond the bound the join is shuffled in two steps: first the hashes alone name the
documents and places that may hit (:func:`_possible`), then only these documents are read again, and
the few windows at those places are joined word by word.  A document's words never travel.
Items are keyed by the SHA-256 of their words.

Defined results: a null or empty text has no words and no hits; a text shorter than a
window is never hit by it; repeated rows each get the same result; equal benchmark items
are matched once and all their ids are reported; a null item id is the empty string; an
empty benchmark leaves every document clean; extra columns are ignored (reports) or kept
(filters).  Very long texts stay in their row: the work is linear in their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import ascii_lower, checkpointed, let, only, text_key
from stockroom.plans.joins import broadcast_if_rows_fit, broadcast_if_small

NGRAM = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words in a text that is not lower-cased, each with the gap after it, and the gap before the first.
WORD_AND_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
LEADING_GAP = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    """The normalised words of a text (empty array for null)."""
    parts = F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def _hashes(ws: Column, length: int) -> Column:
    """Hash of every window of ``length`` words (empty when the text has fewer)."""

    def windows(hs):
        last = F.size(hs) - (length - 1)
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hs, i, F.lit(length))))

    word_hashes = F.transform(ws, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(ws) >= length, let(word_hashes, windows)).otherwise(none)


def benchmark_windows(benchmark: DataFrame, ngram: int = NGRAM) -> tuple[DataFrame, DataFrame]:
    """(windows, items): distinct windows with the keys of the items holding them, and item ids per key.

    Items of equal word sequences share one key, so copies in the benchmark add one id
    to a list and no window.
    """
    items = (
        only(benchmark, "item_id", "text")
        .select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws"))
        .filter(F.size("ws") > 0)
        .groupBy("ws")
        .agg(F.collect_list("item").alias("items"))
        .withColumn("item_key", F.unhex(F.sha2(F.array_join("ws", " "), 256)))  # words hold no space
    )
    length = F.least(F.size("ws"), F.lit(ngram))
    windows = (
        items.withColumn("length", length)
        .select(
            "item_key",
            "length",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("ws") - F.col("length") + 1),
                    lambda i: F.slice(F.col("ws"), i, F.col("length")),
                )
            ).alias("window"),
        )
        .groupBy("window", "length")
        .agg(F.collect_set("item_key").alias("item_keys"))
        .withColumn("window_hash", F.xxhash64(F.transform("window", lambda w: F.xxhash64(w))))
    )
    return windows, items.select("item_key", "items")


def _probed(ws: Column, lengths: list[int]) -> Column:
    """Hashes of a text's windows of all lengths in one array (its places are the slots)."""
    return F.concat(*([_hashes(ws, k) for k in lengths] or [F.array().cast("array<bigint>")]))


def _start(slot: Column, size: Column, length: Column, lengths: list[int]) -> Column:
    """First word of the window of ``length`` in a slot: its place less the windows of shorter lengths."""
    for k in lengths:
        earlier = F.greatest(size - (k - 1), F.lit(0))
        slot = slot - F.when(length > k, earlier).otherwise(0)
    return slot


def _possible(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc, places): per hash of a document, the (slot, length) whose window hash is one of ``windows``.

    Only hashes are shuffled, 28 bytes a window.  ``doc`` is a 64-bit hash: documents that share
    one get each other's places, which the word by word check discards.
    """
    hashes = docs.select("doc", F.posexplode(_probed(F.col("ws"), lengths)).alias("slot", "window_hash"))
    hit = hashes.join(windows.select("window_hash", "length").distinct(), "window_hash")
    # at most the windows of one text
    return hit.groupBy("doc").agg(F.collect_set(F.struct("slot", "length")).alias("places"))


def window_hits(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """One row per document (id and text digest) with hits: hit spans of words and item ids."""
    windows, items = benchmark_windows(benchmark, ngram)
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most `ngram` rows
    keyed = only(docs, "doc_id", "text").withColumn("text_key", text_key(F.col("text")))
    base = keyed.select("doc_id", "text_key", words(F.col("text")).alias("ws"))
    small = broadcast_if_small(windows)
    if small is not windows:  # hinted
        # The hashes are a column of their own, so that explode, probe and check share one generated
        # stage; the outer form keeps Catalyst from adding a filter that would compute them twice.
        hashed = base.withColumn("probes", _probed(F.col("ws"), lengths))
        probes = hashed.select("doc_id", "text_key", "ws", F.posexplode_outer("probes").alias("slot", "window_hash"))
        found = (
            probes.join(small, "window_hash")
            .withColumn("start", _start(F.col("slot"), F.size("ws"), F.col("length"), lengths))
            .filter(F.col("start") >= 0)
            .filter(F.slice(F.col("ws"), F.col("start") + 1, F.col("length")) == F.col("window"))
            .select("doc_id", "text_key", "start", "length", "item_keys")
        )
    else:
        doc = F.xxhash64("doc_id", "text_key").alias("doc")
        places = checkpointed(_possible(base.select(doc, "ws"), windows, lengths))
        again = keyed.select("doc_id", "text_key", "text", doc).join(broadcast_if_rows_fit(places, places.count()), "doc")
        at = again.select("doc_id", "text_key", words(F.col("text")).alias("ws"), F.explode("places").alias("p"))
        start = _start(F.col("p.slot"), F.size("ws"), F.col("p.length"), lengths)
        cut = (
            at.select("doc_id", "text_key", "ws", start.alias("start"), F.col("p.length").alias("length"))
            .filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("ws")))
            .select("doc_id", "text_key", "start", "length", F.slice("ws", F.col("start") + 1, F.col("length")).alias("window"))
        )
        found = cut.join(windows.drop("window_hash"), ["length", "window"]).select(
            "doc_id", "text_key", "start", "length", "item_keys"
        )
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("item_keys"))).alias("keys"),
    )
    listed = (
        per_doc.select("doc_id", "text_key", "spans", F.explode("keys").alias("item_key"))
        .join(broadcast_if_small(items), "item_key")
        .groupBy("doc_id", "text_key", "spans")
        .agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    )
    return listed


def covered(spans: Column) -> Column:
    """Words under at least one span; spans are (start, length) sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, s):
        end = s["start"] + s["length"]
        more = F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """Per document: doc_id, n_words, hit spans of words, and the ids of items with a window in it."""
    base = only(docs, "doc_id", "text").select(
        "doc_id", text_key(F.col("text")).alias("text_key"), F.size(words(F.col("text"))).alias("n_words")
    )
    hits = window_hits(docs, benchmark, ngram)
    return base.join(hits, _same_document(base, hits), "left").select(
        base["doc_id"],
        base["text_key"],
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _marked(docs: DataFrame, benchmark: DataFrame, ngram: int) -> tuple[DataFrame, DataFrame, Column]:
    """The documents with a key column of their own, the hits, and the condition that joins them."""
    keyed = docs.withColumn("_sr_text_key", text_key(F.col("text")))
    hits = window_hits(docs, benchmark, ngram).select(
        F.col("doc_id").alias("_sr_hit_doc"), F.col("text_key").alias("_sr_hit_key"), F.col("spans").alias("_sr_spans")
    )
    same = keyed["doc_id"].eqNullSafe(hits["_sr_hit_doc"]) & (keyed["_sr_text_key"] == hits["_sr_hit_key"])
    return keyed, hits, same


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """The documents without any hit, with all their columns.

    The hits' keys are kept and counted first: while they fit the broadcast bound, no document moves.
    """
    keyed, hits, _ = _marked(docs, benchmark, ngram)
    hits = checkpointed(hits.select("_sr_hit_doc", "_sr_hit_key"))
    hits = broadcast_if_rows_fit(hits, hits.count())
    same = keyed["doc_id"].eqNullSafe(hits["_sr_hit_doc"]) & (keyed["_sr_text_key"] == hits["_sr_hit_key"])
    return keyed.join(hits, same, "left_anti").drop("_sr_text_key")


def remove_spans(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """All documents, with the hit words and the gap after each cut out of ``text``."""
    keyed, hits, same = _marked(docs, benchmark, ngram)
    lead = F.regexp_extract(F.col("text"), LEADING_GAP, 0)
    tokens = F.regexp_extract_all(F.col("text"), F.lit(WORD_AND_GAP), F.lit(0))
    kept = F.filter(
        tokens,
        lambda _, i: ~F.exists("_sr_spans", lambda s: (s["start"] <= i) & (i < s["start"] + s["length"])),
    )
    cut = F.when(F.col("_sr_spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, "")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.join(hits, same, "left").withColumn("text", cut).select(*names)


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`contamination` over the whole documents and benchmark tables."""
    from stockroom.llm.common import read

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("spans")).cast("bigint")
    return found.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT item, least(len(ws), 10) AS l, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i, ws FROM b WHERE len(ws) > 0
),
win AS (SELECT DISTINCT item, l, array_to_string(ws[i : i + l - 1], ' ') AS w FROM bw),
lens AS (SELECT DISTINCT l FROM win),
dw AS (
  SELECT rid, l, unnest(range(1, len(ws) - l + 2)) AS i, ws FROM d, lens WHERE len(ws) >= l
),
dg AS (SELECT rid, l, i, array_to_string(ws[i : i + l - 1], ' ') AS w FROM dw),
hit AS (SELECT dg.rid, dg.i, dg.l, win.item FROM dg JOIN win ON dg.l = win.l AND dg.w = win.w),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hit) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (
    SELECT h.rid, h.item FROM (SELECT DISTINCT rid, item FROM hit) h
  ) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
