"""Operator 7: SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z), cut into words at ASCII white space and into 4-word shingles
with repeats (fewer words: the whole sequence is one shingle).  Bit i of the fingerprint
is set when it is set in over half of the shingles' XXH64 hashes (seed 42).  Texts link
when their fingerprints differ in at most ``max_bits`` bits.

Blocks: the 64 bits are cut into ``max_bits + 4`` blocks.  Two fingerprints within
``max_bits`` agree in at least four whole blocks, so every choice of four blocks is one
table, keyed by the bits of those blocks; any close pair meets in some table, and every
met pair is verified by Hamming distance.  Work is on distinct fingerprints, so exact
copies cost one row.  In a bucket the links found are reduced to a spanning star before
they leave the task.  A bucket of over ``bucket_limit`` fingerprints takes another exact
way: each of its fingerprints is expanded to all values within ``max_bits / 2`` flips, and
those that share a value are linked; such a group has at most 2,081 members for 4 bits.

Defined results: null, empty and blank texts have fingerprint zero, which links like any
other; repeated rows each get a row; an empty table gives no rows; extra columns are
ignored (report) or kept (filter); a null doc_id never names a group that has another id.
Very long texts are hashed in slices of bounded memory.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import checkpointed, only, read, text_key
from stockroom.llm.components import components
from stockroom.plans.joins import broadcast_if_rows_fit

SHINGLE_WORDS = 4
MAX_BITS = 4
SHARED_BLOCKS = 4
BUCKET_LIMIT = 8192
SLICE = 1 << 16  # shingles hashed at a time


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not parts:
        return 0
    width = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SLICE):
        spans = zip(starts[at : at + SLICE], stops[at : at + SLICE], strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed long (the same 64 bits)."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return simhash(text)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks(max_bits: int = MAX_BITS) -> list[int]:
    """One mask per choice of four of the ``max_bits + 4`` blocks."""
    n = max_bits + SHARED_BLOCKS
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(blocks, SHARED_BLOCKS)]


def flip_masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` set bits."""
    return [_signed(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(range(64), r)]


def _spanning_links(max_bits: int):
    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def spanning(buckets: pd.Series) -> pd.Series:
        """Star of every linked set of a bucket: each member hung on the set's smallest member."""
        out = []
        for members in buckets:
            fps = np.unique(np.asarray(members, dtype=np.int64))
            rest = fps.view(np.uint64).copy()
            links = []
            while len(rest):
                reached, frontier, rest = [rest[0]], [rest[0]], rest[1:]
                while frontier and len(rest):
                    near = np.bitwise_count(rest ^ frontier.pop()) <= max_bits
                    frontier.extend(rest[near])
                    reached.extend(rest[near])
                    rest = rest[~near]
                group = np.sort(np.array(reached, dtype=np.uint64).view(np.int64))
                links.extend({"a": int(x), "b": int(group[0])} for x in group[1:])
            out.append(links)
        return pd.Series(out)

    return spanning


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b) over distinct ``fp`` values: edges whose closure is that of all links within ``max_bits``."""
    if max_bits % 2:
        raise ValueError("max_bits must be even: oversized buckets meet half way")
    tables = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(max_bits)])
    rows = fingerprints.select("fp", F.posexplode(tables).alias("table", "bits"))
    buckets = checkpointed(
        rows.groupBy("table", "bits")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1")
    )
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = buckets.filter("n = 2").filter(close).select("a", "b")

    larger = buckets.filter("n > 2").select("table", "bits", "n")
    members = rows.join(broadcast_if_rows_fit(larger, larger.count()), ["table", "bits"])
    stars = (
        members.filter(F.col("n") <= bucket_limit)
        .groupBy("table", "bits")
        .agg(F.collect_list("fp").alias("members"))
        .select(F.explode(_spanning_links(max_bits)("members")).alias("link"))
        .select("link.a", "link.b")
    )
    found = pairs.unionByName(stars)
    if larger.filter(F.col("n") > bucket_limit).limit(1).count():
        hot = members.filter(F.col("n") > bucket_limit).select("fp").distinct()
        flips = F.array(*[F.lit(m) for m in flip_masks(max_bits // 2)])
        near = hot.select("fp", F.explode(flips).alias("flip")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("meet")
        )
        met = near.groupBy("meet").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        found = found.unionByName(
            met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).select("a", "b").filter("a <> b")
        )
    return found.distinct()


def _labelled(docs: DataFrame, words: int, max_bits: int, bucket_limit: int) -> DataFrame:
    """Per document: doc_id, text_key, fp, component_id, and root, the fingerprint that names its group."""
    fps = checkpointed(
        only(docs, "doc_id", "text").select(
            "doc_id", text_key(F.col("text")).alias("text_key"), fingerprint_column(F.col("text"), words).alias("fp")
        )
    )
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(links(nodes.select("fp"), max_bits, bucket_limit))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    lowest = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = labelled.join(lowest, "root").select(F.col("fp").alias("node_fp"), "component_id", "root")
    found = fps.join(named, fps["fp"] == named["node_fp"], "left")
    return found.select("doc_id", "text_key", "fp", "component_id", "root")


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """Per document: doc_id, text_key, fp (signed long) and component_id (smallest reachable doc_id)."""
    return _labelled(docs, words, max_bits, bucket_limit).drop("root")


def _row_key(doc_id: Column, digest: Column) -> Column:
    """A row's id and text digest as one value that is never null."""
    return F.concat(F.hex(digest), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("none")))


def keep_one(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """One document of each group, with all columns of ``docs``.

    The row kept is that of the smallest doc_id (ties: smallest text digest; equal rows: any one).
    Groups go by their root fingerprint: groups without any id, or with an id in common, stay apart.
    """
    labels = checkpointed(
        _labelled(docs, words, max_bits, bucket_limit).groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_key"))
    best = labels.groupBy("root").agg(F.min(order).alias("keep"))
    best = checkpointed(best.select(_row_key(F.col("keep.doc_id"), F.col("keep.text_key")).alias("_sr_best")))
    keys = labels.select(_row_key(F.col("doc_id"), F.col("text_key")).alias("_sr_key"), "n")
    is_best = F.col("_sr_key") == F.col("_sr_best")
    # What goes: every other row of a group, and all but one of the rows that repeat the kept one.
    gone = checkpointed(keys.join(best, is_best, "left_anti").select("_sr_key"))
    repeated = checkpointed(keys.filter("n > 1").join(best, is_best, "left_semi").select("_sr_key"))
    n_gone, n_repeated = gone.count(), repeated.count()

    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("_sr_row_key", _row_key(F.col("doc_id"), text_key(F.col("text"))))
    some = broadcast_if_rows_fit(repeated, n_repeated)
    out = gone.unionByName(repeated)
    hinted = broadcast_if_rows_fit(out, n_gone + n_repeated)
    if hinted is not out and some is not repeated:  # both fit: no document is shuffled
        rest = keyed.join(hinted, F.col("_sr_row_key") == F.col("_sr_key"), "left_anti").select(*names)
        if not n_repeated:
            return rest
        once = keyed.join(some, F.col("_sr_row_key") == F.col("_sr_key"), "left_semi").dropDuplicates(["_sr_row_key"])
        return rest.unionByName(once.select(*names))
    # one shuffle of the documents, by the key of both the join and the choice among repeated rows
    kept = keyed.join(best, F.col("_sr_row_key") == F.col("_sr_best"), "left_semi")
    return kept.dropDuplicates(["_sr_row_key"]).select(*names)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`near_duplicates` over the whole documents table."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
