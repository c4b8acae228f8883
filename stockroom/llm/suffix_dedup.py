"""Operator 5: removal of byte strings that start at two places, by column-wise construction.

A byte goes when a string of ``length`` (400) bytes that covers it also starts anywhere else,
in the same document or another one.

1. Anchors.  Every window of ``length`` bytes names one of its ``GRAM``-byte grams, the leftmost
   of smallest hash.  Equal windows name the same gram at the same offset, so they meet under
   that gram's hash.  Grams named once in the whole corpus are done.
2. Segments.  Around every other anchor lies a segment that holds all windows over the anchor:
   ``length - GRAM`` bytes before it and ``length`` bytes from its start.
3. Construction.  All segments of a hash are one collection of strings, aligned at the anchor.
   The collection is built from the right, one column a round: each round inserts one symbol
   per string, re-sorts the suffixes stably by that symbol, and updates the common prefixes of
   neighbours from the last round's.  The symbols that a round inserts are the Burrows-Wheeler
   transform of the round before (the symbol in front of each suffix, in suffix order), read
   from one sequential file, to which the round appends its own transform from the next column
   of a second one.  Order and common prefixes are appended to a third, which is then read
   once to mark the windows that share ``length`` symbols with a neighbour.  Since equal windows
   stand at equal offsets, each round only has to keep the suffixes that start in its column,
   so a round costs the number of strings, not the size of all earlier columns, and the
   number of rounds is fixed by ``length``, not by the longest document.
4. Marked windows are merged to removed runs per document.

Exact copies of a text are collapsed first: their windows all start twice.  Equal segments in
one document are marked at once and sent once.  A hash with over ``group_limit`` segments is
not gathered in one task: its windows are counted by 128-bit digest instead, which is exact
for any group size.

Defined results: a null text is an empty text; texts shorter than ``length`` lose nothing,
copies or not; repeated rows are copies of each other; an empty table gives no rows; extra
columns are ignored.  Very long texts are hashed in blocks of bounded memory.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import checkpointed, only, read
from stockroom.plans.joins import broadcast_if_rows_fit

LENGTH = 400
GRAM = 128
GROUP_LIMIT = 16384
COLLECTION = 8192  # strings built at a time (whole groups, so up to GROUP_LIMIT more)
BLOCK = 1 << 20
POSITION_BITS = 24
PAD = 256  # stands for "outside the text"; no byte equals it


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _hash_tables(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of an odd base and their inverses, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    values = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A55A5A5A5A)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values, _powers(base, block), _powers(pow(base, -1, 1 << 64), block)


class Anchors:
    """Anchor positions and gram hashes of a text, worked in blocks."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.grams = length - gram + 1  # grams in a window
        self.tables = _hash_tables(BLOCK + length)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        values, powers, inverse = self.tables
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * inverse[: len(data) - self.gram + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def _leftmost_minima(self, h: np.ndarray) -> np.ndarray:
        """Positions that are the leftmost smallest hash of some window of ``grams`` grams."""
        w = self.grams
        mask = np.uint64((1 << POSITION_BITS) - 1)
        keyed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(keyed) // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(keyed)] = keyed
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(keyed) - w + 1
        lowest = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        return np.unique(lowest[np.concatenate(([True], lowest[1:] != lowest[:-1]))] & mask).astype(np.int64)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes as signed longs) of a text of at least ``length`` bytes."""
        at, out = 0, {}
        while at + self.length <= len(data):
            part = data[at : at + BLOCK + self.length - 1]
            h = self._hashes(part)
            found = self._leftmost_minima(h)
            out.update(zip((found + at).tolist(), h[found].view(np.int64).tolist(), strict=True))
            at += BLOCK
        positions = np.array(sorted(out), dtype=np.int64)
        return positions, np.array([out[p] for p in positions.tolist()], dtype=np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _once_per_text(data: bytes, positions: list[int], hashes: list[int], length: int, reach: int):
    """Anchors with segments that are new in this text, and the runs under segments seen twice in it.

    Equal segments of one text mark each other whole, so one of them stands for all
    (a long run of one repeated word has an anchor in every period).
    """
    times = Counter(hashes)
    first_seen: dict[tuple, tuple[int, int]] = {}
    kept, marks = [], []
    for p, h in zip(positions, hashes, strict=True):
        if times[h] > 1:
            start, end = max(0, p - reach), min(len(data), p + length)
            name = (h, p - start, _digest(data[start:end]))
            if name in first_seen:
                if end - start >= length:
                    marks += [first_seen[name], (start, end)]
                continue
            first_seen[name] = (start, end)
        kept.append((p, h))
    return kept, _merged(marks)


ANCHOR_SCHEMA = (
    "text_key binary, positions array<bigint>, hashes array<bigint>, starts array<bigint>, ends array<bigint>"
)


def _anchor_rows(length: int, gram: int):
    lists = pa.list_(pa.int64())

    def rows(batches):
        finder = Anchors(length, gram)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = _bytes(text)
                if len(data) < length:
                    continue
                positions, hashes = finder.find(np.frombuffer(data, dtype=np.uint8))
                kept, marks = _once_per_text(data, positions.tolist(), hashes.tolist(), length, length - gram)
                row = (key, [p for p, _ in kept], [h for _, h in kept], [m[0] for m in marks], [m[1] for m in marks])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [pa.array(out[0], pa.binary()), *[pa.array(c, lists) for c in out[1:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["text_key", "positions", "hashes", "starts", "ends"])

    return rows


SEGMENT_SCHEMA = (
    "hash bigint, text_key binary, first bigint, before int, segment binary, digest binary, cover_end bigint"
)
ROWS_AT_ONCE = 4096


def _segment_rows(length: int, gram: int):
    """Per text: segments (hash set), window digests of oversized groups (digest set), marked runs (cover_end set)."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
    reach = length - gram

    def of_text(key, data, anchors):
        windows: dict[bytes, int] = {}
        marks = []
        done = 0  # windows before this start are digested
        for a in sorted(anchors, key=lambda x: x["position"]):
            p = a["position"]
            start, end = max(0, p - reach), min(len(data), p + length)
            if end - start < length:
                continue
            if not a["oversized"]:
                yield a["hash"], key, start, p - start, data[start:end], None, None
                continue
            for s in range(max(start, done), end - length + 1):
                digest = _digest(data[s : s + length])
                if digest in windows:  # twice in this text: marked here, sent once
                    marks += [(windows[digest], windows[digest] + length), (s, s + length)]
                else:
                    windows[digest] = s
                    yield None, key, s, None, None, digest, None
            done = max(done, end - length + 1)
        for start, end in _merged(marks):
            yield None, key, start, None, None, None, end

    def batch_of(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def rows(batches):
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                key, text, anchors = (batch.column(c)[i].as_py() for c in ("text_key", "text", "anchors"))
                for row in of_text(key, _bytes(text), anchors):
                    held.append(row)
                    if len(held) == ROWS_AT_ONCE:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return rows


def repeated_columns(groups: np.ndarray, before: np.ndarray, segments: list[bytes], length: int, gram: int):
    """Column-wise construction over one collection; (lowest, highest) marked window start per segment.

    ``groups`` numbers the collections' groups; ``before`` is how far each anchor lies in its
    segment.  Starts are columns of the aligned matrix; a segment without a mark has highest -1.
    """
    reach = length - gram
    m, width = len(segments), reach + length
    lowest, highest = np.full(m, width), np.full(m, -1)
    left = reach - before
    right = left + np.array([len(s) for s in segments])
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as transforms, tempfile.TemporaryFile() as built:
        matrix = np.full((m, width), PAD, dtype=np.uint16)
        for i, segment in enumerate(segments):
            matrix[i, left[i] : left[i] + len(segment)] = np.frombuffer(segment, dtype=np.uint8)
        matrix.T[::-1].tofile(columns)  # last column first, as the rounds read them
        del matrix
        columns.seek(0)
        order = np.argsort(groups, kind="stable").astype(np.int32)
        shared = np.zeros(m, dtype=np.int32)  # common prefix of order[i - 1] and order[i]
        np.fromfile(columns, dtype=np.uint16, count=m)[order].tofile(transforms)  # in front of the empty suffixes
        transforms.seek(0)
        for column in range(width - 1, -1, -1):
            inserted = np.fromfile(transforms, dtype=np.uint16, count=m)
            moved = np.lexsort((inserted, groups[order]))  # stable: by group, then by the new symbol
            # least common prefix between each suffix and the last one before it with the same symbol
            by_symbol = np.argsort(inserted, kind="stable")
            ranked = inserted[by_symbol]
            cuts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            low = np.zeros(m, dtype=np.int32)
            for a, b in zip(cuts, np.append(cuts[1:], m), strict=True):
                places = by_symbol[a:b]
                if len(places) > 1:
                    low[places[1:]] = np.minimum.reduceat(shared[: places[-1] + 1], places[:-1] + 1)
            same = (inserted[moved][1:] == inserted[moved][:-1]) & (groups[order][moved][1:] == groups[order][moved][:-1])
            shared = np.zeros(m, dtype=np.int32)
            shared[1:] = np.where(same, low[moved][1:] + 1, 0)
            order = order[moved]
            if column:
                read_to = transforms.tell()
                np.fromfile(columns, dtype=np.uint16, count=m)[order].tofile(transforms)
                transforms.seek(read_to)
            if column <= reach:  # only windows that hold the anchor are asked for
                order.tofile(built)
                shared.tofile(built)
        built.seek(0)
        for column in range(reach, -1, -1):
            order = np.fromfile(built, dtype=np.int32, count=m)
            shared = np.fromfile(built, dtype=np.int32, count=m)
            pair = shared >= length
            twice = pair | np.append(pair[1:], False)
            rows = order[twice]
            rows = rows[(left[rows] <= column) & (column + length <= right[rows])]  # windows inside the text
            lowest[rows] = np.minimum(lowest[rows], column)
            highest[rows] = np.maximum(highest[rows], column)
    return lowest, highest


def _construct_rows(length: int, gram: int):
    def build(rows: list[tuple]):
        hashes = np.array([r[0] for r in rows], dtype=np.int64)
        _, groups = np.unique(hashes, return_inverse=True)
        before = np.array([r[3] for r in rows], dtype=np.int64)
        segments = [r[4] for r in rows]
        lowest, highest = repeated_columns(groups.astype(np.int64), before, segments, length, gram)
        keys, starts, ends = [], [], []
        for i in np.flatnonzero(highest >= 0):
            origin = rows[i][2] - (length - gram - rows[i][3])  # text position of column 0
            keys.append(rows[i][1])
            starts.append(int(origin + lowest[i]))
            ends.append(int(min(origin + highest[i] + length, rows[i][2] + len(rows[i][4]))))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            names=["text_key", "start", "end"],
        )

    def collections(batches):
        held: list[tuple] = []
        names = ("hash", "text_key", "first", "before", "segment")
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if len(held) >= COLLECTION and row[0] != held[-1][0]:
                    yield build(held)
                    held = []
                held.append(row)
        if held:
            yield build(held)

    return collections


def content_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def covers(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(text_key, start, end): byte ranges under strings that start twice among distinct texts."""
    texts = only(docs, "text").select(content_key(F.col("text")).alias("text_key"), "text")
    texts = texts.filter(F.octet_length("text") >= length)
    anchors = checkpointed(
        texts.mapInArrow(_anchor_rows(length, gram), ANCHOR_SCHEMA).dropDuplicates(["text_key"])
    )
    flat = anchors.select("text_key", F.explode(F.arrays_zip("positions", "hashes")).alias("a")).select(
        "text_key", F.col("a.positions").alias("position"), F.col("a.hashes").alias("hash")
    )
    counts = flat.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = (
        flat.join(counts, "hash")
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("position", "hash", (F.col("n") > group_limit).alias("oversized"))).alias("anchors"))
    )
    # segments, digests and marks of oversized groups; read three times below
    pieces = checkpointed(
        texts.dropDuplicates(["text_key"]).join(wanted, "text_key").mapInArrow(_segment_rows(length, gram), SEGMENT_SCHEMA)
    )
    segments = pieces.filter("hash is not null").select("hash", "text_key", "first", "before", "segment")
    built = (
        segments.repartition("hash")
        .sortWithinPartitions("hash", "text_key", "first")
        .mapInArrow(_construct_rows(length, gram), "text_key binary, start bigint, end bigint")
    )
    digests = pieces.filter("digest is not null").select("digest", "text_key", "first")
    twice = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    start = F.col("first").alias("start")
    counted = digests.join(twice, "digest").select("text_key", start, (F.col("first") + length).alias("end"))
    marked = pieces.filter("cover_end is not null").select("text_key", start, F.col("cover_end").alias("end"))
    own = anchors.select("text_key", F.explode(F.arrays_zip("starts", "ends")).alias("m")).select(
        "text_key", F.col("m.starts").alias("start"), F.col("m.ends").alias("end")
    )
    return built.unionByName(counted).unionByName(marked).unionByName(own)


def removed_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(text_key, runs): maximal removed byte runs [start, end) of each distinct text that loses bytes."""

    def merge(spans: Column) -> Column:
        empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

        def step(runs, s):
            last = F.try_element_at(runs, F.lit(-1))
            touches = (F.size(runs) > 0) & (s["start"] <= last["end"])
            grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
            earlier = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))
            return F.when(touches, F.concat(earlier, F.array(grown))).otherwise(F.concat(runs, F.array(s)))

        return F.aggregate(spans, empty, step)

    found = covers(docs, length, gram, group_limit).groupBy("text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    )
    return found.select("text_key", merge(F.col("spans")).alias("runs"))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Per document: doc_id, n_bytes, the removed runs, and the remaining bytes' SHA-256."""
    slim = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    slim = slim.withColumn("text_key", content_key(F.col("text"))).withColumn(
        "n_bytes", F.octet_length("text").cast("bigint")
    )
    copies = slim.filter(F.col("n_bytes") >= length).groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    runs = checkpointed(removed_runs(docs, length, gram, group_limit))
    twice = checkpointed(copies.filter("n > 1").select("text_key", F.lit(True).alias("copied")))
    for_rows = [broadcast_if_rows_fit(df, df.count()) for df in (twice, runs)]
    joined = slim.join(for_rows[0], "text_key", "left").join(for_rows[1], "text_key", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    chosen = joined.withColumn("runs", F.when(F.col("copied"), whole).otherwise(F.coalesce("runs", none)))
    raw = F.encode("text", "UTF-8")

    def kept(runs):
        first = F.when(F.size(runs) > 0, F.substring(raw, F.lit(1), runs[0]["start"].cast("int"))).otherwise(raw)
        after = F.transform(
            runs,
            lambda r, i: F.substring(
                raw,
                (r["end"] + 1).cast("int"),
                (F.coalesce(F.get(runs, i + 1)["start"], F.col("n_bytes")) - r["end"]).cast("int"),
            ),
        )
        return F.concat(first, F.aggregate(after, F.lit(b""), lambda a, x: F.concat(a, x)))

    return chosen.select("doc_id", "n_bytes", "runs", F.sha2(kept(F.col("runs")), 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`remove_repeats` over the whole documents table."""
    found = remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("bigint").alias("n_spans"), "kept_sha256"
    )
