"""Operator 2: SentencePiece encoding and decoding over a relational lattice.

Texts are escaped as the library does (one leading ``\\u2581``, every space becomes
``\\u2581``) and cut into units that no piece can cross: before a ``\\u2581`` that follows
another symbol, around line feeds, and between a letter and a following ASCII mark or digit
(checked against the piece table; cuts it does not allow are not made).  Then

1. the input's partitions are put together to groups, and each group gathers the distinct units of its texts,
2. each unit's substrings up to the longest piece are exploded and equi-joined to the piece
   table: the joined rows are the edges of the unit's lattice,
3. edges are grouped by unit and folded with Spark's higher-order ``aggregate``:
   * ``unigram`` models: Viterbi, the path of the highest total score;
   * ``bpe`` models: the library's merge order, as a fold over a bit mask of symbol borders
     (Viterbi over the same lattice does not give a BPE model's results),
4. the folded units are joined to the groups that hold them, one row per unit and group (a common word is many
   small rows, not one long one), and every group receives its units and writes each document's ids in order.

Units with symbols outside the piece table (byte fallback) or of over 62 symbols are merged
by a small heap in :func:`merge_exactly` where a document needs them, which gives the same result.

Decoding looks ids up in the piece table and joins the pieces' bytes.  Every document's ids are
decoded as they are written and compared with its stored text (``round_trip``).

Defined results: null and empty texts have no ids and decode to the empty text; a literal
``\\u2581`` in a text has the ids of a space, as in the library, and counts as one in
``round_trip``; repeated rows each get a row; an empty table gives no rows; extra columns are
ignored; ``doc_id`` keeps its type.  Very long texts are encoded whole, a batch holding only them.  Memory per task
is one group's dictionary of units (flushed in parts when it is gathered) plus one batch.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm.common import let, only, read
from stockroom.plans.joins import broadcast_if_rows_fit

SPACE = "▁"
MASK_SYMBOLS = 62
# An edge is one long: rank, start, end and id of its piece.  Longs sort by rank, then start.
END_SHIFT = 16
START_SHIFT, RANK_SHIFT = 22, 28
UNITS_HELD = 1_000_000
WORDS_HELD = 100_000  # words that wait to be cut into units
WORDS_REMEMBERED = 100_000
REMEMBERED_SYMBOLS = 200  # longer words are cut and merged each time they come up
DOCUMENTS_AT_ONCE = 500
IDS_AT_ONCE = 1 << 16  # ids decoded at a time
UNIT_END = b"\xff"
LATTICE_SPREAD = 4
GROUP_BYTES = 48 << 20  # at most so many input bytes share one dictionary of units
GROUPS_A_CORE = 2  # at least so many groups per core, if the input has as many partitions


@dataclass
class Pieces:
    """The piece table of a model file."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_of: list[bytes]  # what each id decodes to
    byte_ids: list[int]  # id of every fallback byte
    longest: int
    letters_cut: bool  # no piece joins a letter with a following ASCII mark or digit

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids, scores, bytes_of = {}, {}, []
        byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                bytes_of.append(b"")
            else:
                ids[piece], scores[piece] = i, model.get_score(i)
                bytes_of.append(piece.replace(SPACE, " ").encode("utf-8"))
        if len(bytes_of) > 1 << END_SHIFT:
            raise ValueError(f"ids are packed in {END_SHIFT} bits")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
            raise ValueError("pieces cross word borders: units cannot be cut at spaces")
        cut = not any(a.isalpha() and b.isascii() and not b.isalpha() for p in ids for a, b in zip(p, p[1:], strict=False))
        return cls(ids, scores, bytes_of, byte_ids, max(map(len, ids)), cut)

    def unit_pattern(self) -> re.Pattern:
        if not self.letters_cut:
            return re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        # marks before letters stay with them; letters end at the next ASCII mark or digit
        letter, mark = r"[^\W\d_]", r"[\x00-\x09\x0b-\x40\x5b-\x60\x7b-\x7f]"
        other = rf"(?!{letter})(?!{mark})[^{SPACE}\n]"
        tail = rf"(?:{letter}+(?:{other}(?:(?!{letter})[^{SPACE}\n])*)?)+"
        return re.compile(rf"\n|{SPACE}*(?:(?!{letter})[^{SPACE}\n])*{tail}|{SPACE}*(?:(?!{letter})[^{SPACE}\n])+|{SPACE}+")

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, code): the code holds rank and id; pieces of equal score share a rank, the best score has rank 0."""
        ranks = {score: r for r, score in enumerate(self.ranked_scores())}
        rows = [(p, (ranks[self.scores[p]] << RANK_SHIFT) | i) for p, i in self.ids.items()]
        return spark.createDataFrame(rows, "piece string, code bigint")

    def ranked_scores(self) -> list[float]:
        return sorted(set(self.scores.values()), reverse=True)


def escape(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def merge_exactly(unit: str, pieces: Pieces) -> list[int]:
    """The library's BPE merges of one unit: best score first, leftmost on ties; unknown symbols as bytes."""
    symbols: list[str | None] = list(unit)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    heap: list[tuple] = []

    def offer(i):
        j = after[i] if i >= 0 else len(symbols)
        if i >= 0 and j < len(symbols) and symbols[i] + symbols[j] in pieces.ids:
            merged = symbols[i] + symbols[j]
            heapq.heappush(heap, (-pieces.scores[merged], i, j, merged))

    for i in range(len(symbols) - 1):
        offer(i)
    while heap:
        _, i, j, merged = heapq.heappop(heap)
        if symbols[i] is None or after[i] != j or symbols[i] + symbols[j] != merged:
            continue
        symbols[i], symbols[j], after[i] = merged, None, after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    out: list[int] = []
    for s in symbols:
        if s is not None:
            found = pieces.ids.get(s)
            out += [found] if found is not None else [pieces.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
    return out


def cut_at_spaces(text: str | bytes, space: str | bytes = " ", mark: str | bytes = SPACE) -> bool:
    """Every space of the text stands between two words.

    Else a space run belongs to the unit after it, and the unit pattern has to cut the whole text.
    """
    edges = text.startswith(space) or text.endswith(space)
    return bool(text) and not edges and space + space not in text and mark not in text


def objects(batch: pa.RecordBatch, name: str) -> list:
    """A column's values as Python objects (some ten times faster than ``to_pylist``)."""
    return batch.column(name).to_numpy(zero_copy_only=False).tolist()


def slices(batch: pa.RecordBatch, rows: int = DOCUMENTS_AT_ONCE) -> list[pa.RecordBatch]:
    """The batch in parts, so that only one part's texts are Python objects at a time."""
    return [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)]


def group_units(texts: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, mark): the units of every input group (partition), dealt by unit.

    A mark is twice the group's number, plus one for a unit that the lattice folds.  One column holds both, so that
    whoever reads these rows reads all of them, and one exchange serves all.
    """
    pattern, known = pieces.unit_pattern(), frozenset(p for p in pieces.ids if len(p) == 1)
    alone = pieces.letters_cut

    def gather(batches):
        group = TaskContext.get().partitionId()

        def cut(words, units):
            for w in words:
                if w.isalpha() and alone:  # letters only: nothing to cut
                    units.add(SPACE + w)
                else:
                    units.update(pattern.findall(SPACE + w))
            words.clear()

        def rows(units):
            units.discard("")
            found = list(units)
            for at in range(0, len(found), 50_000):
                part = found[at : at + 50_000]
                marks = [2 * group + (len(u) <= MASK_SYMBOLS and known.issuperset(u)) for u in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array(marks, pa.int32())], names=["unit", "mark"]
                )

        words: set[str] = set()
        units: set[str] = set()
        for part in (p for batch in batches for p in slices(batch)):
            for text in part.column("text").to_pylist():
                if cut_at_spaces(text):
                    words.update(text.split(" "))
                else:
                    units.update(pattern.findall(escape(text)))
            if len(words) > WORDS_HELD:
                cut(words, units)
            if len(units) > UNITS_HELD:
                yield from rows(units)
                units = set()
        cut(words, units)
        yield from rows(units)

    found = texts.select("text").mapInArrow(gather, "unit string, mark int")
    # a unit's lattice is some 50 times its bytes: more and smaller partitions than the shuffled bytes ask for
    parts = LATTICE_SPREAD * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "unit")


def lattice(units: DataFrame, piece_table: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): the edges of every unit of ``units`` (unit, simple) that is simple, as sorted longs.

    With ``piece_table`` broadcast, the rows stay where ``units`` has them (partitioned by
    unit), so that grouping by unit moves nothing.
    """
    places = F.when(F.col("simple"), F.sequence(F.lit(0), F.length("unit") - 1))
    starts = units.select("unit", F.explode_outer(places).alias("s"))  # outer: no filter is moved below the exchange
    ends = F.explode(F.sequence(F.col("s") + 1, F.least(F.length("unit"), F.col("s") + longest))).alias("e")
    spans = starts.select("unit", "s", ends)
    text = F.substring("unit", F.col("s") + 1, F.col("e") - F.col("s"))
    edges = spans.withColumn("piece", text).join(piece_table, "piece")
    place = F.shiftleft(F.col("s").cast("bigint"), START_SHIFT).bitwiseOR(
        F.shiftleft(F.col("e").cast("bigint"), END_SHIFT)
    )
    edge = F.col("code").bitwiseOR(place)
    return edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _field(edge: Column, shift: int, bits: int) -> Column:
    return F.shiftright(edge, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _edge(edge: Column) -> dict[str, Column]:
    return {
        "s": _field(edge, START_SHIFT, 6),
        "e": _field(edge, END_SHIFT, 6),
        "id": edge.bitwiseAND(F.lit((1 << END_SHIFT) - 1)).cast("int"),
    }


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def fold_merges(n: Column, edges: Column) -> Column:
    """Ids by BPE merge order: borders are bits; the best merge with one border inside is applied, up to n - 1 times."""

    def masks(edge):
        e = _edge(edge)
        need = _bit(e["s"]).bitwiseOR(_bit(e["e"]))
        inner = (_bit(e["e"]) - 1).bitwiseAND(F.bitwise_not(_bit(e["s"] + 1) - 1))
        return F.struct(need.alias("need"), inner.alias("inner"), e["s"].alias("s"), e["id"].alias("id"))

    def fold(all_edges):
        merges = F.filter(all_edges, lambda e: e["inner"] != 0)

        def borders(ordered):
            def step(mask, _):
                open_ = F.filter(
                    ordered,
                    lambda e: (mask.bitwiseAND(e["need"]) == e["need"])
                    & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1),
                )
                first = F.try_element_at(open_, F.lit(1))
                return F.coalesce(mask.bitwiseAND(F.bitwise_not(first["inner"])), mask)

            return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), _bit(n + 1) - 1, step)

        def chosen(mask):
            used = F.filter(
                all_edges,
                lambda e: (mask.bitwiseAND(e["need"]) == e["need"]) & (mask.bitwiseAND(e["inner"]) == 0),
            )
            return F.transform(
                F.array_sort(F.transform(used, lambda e: F.struct(e["s"].alias("s"), e["id"].alias("id")))),
                lambda e: e["id"],
            )

        return let(let(merges, borders), chosen)

    return let(F.transform(edges, masks), fold)


def fold_viterbi(n: Column, edges: Column, scores: list[float]) -> Column:
    """Ids of the path of highest total score (ties: the larger id sequence); null if no path spans the unit."""
    by_rank = F.array(*[F.lit(x) for x in scores])  # bounded by the model

    def unpacked(edge):
        score = F.get(by_rank, F.shiftright(edge, RANK_SHIFT).cast("int")).alias("score")
        return F.struct(score, *[c.alias(k) for k, c in _edge(edge).items()])

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))

    def fold(all_edges):
        def step(best, end):
            arriving = F.filter(all_edges, lambda e: (e["e"] == end) & F.get(best, e["s"])["ids"].isNotNull())
            paths = F.transform(
                arriving,
                lambda e: F.struct(
                    (best[e["s"]]["score"] + e["score"]).alias("score"),
                    F.concat(best[e["s"]]["ids"], F.array(e["id"])).alias("ids"),
                ),
            )
            none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("array<int>").alias("ids"))
            return F.concat(best, F.array(F.coalesce(F.array_max(paths), none)))

        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: F.element_at(best, -1)["ids"])

    return let(F.transform(edges, unpacked), fold)


def fold_units(units: DataFrame, pieces: Pieces, model_type: str = "bpe") -> DataFrame:
    """(unit, ids) of the units (unit, simple) that are simple, folded over the lattice."""
    table = broadcast_if_rows_fit(pieces.frame(units.sparkSession), len(pieces.ids))
    edges = lattice(units, table, pieces.longest)
    arguments = (F.length("unit"), F.col("edges"))
    ids = fold_merges(*arguments) if model_type == "bpe" else fold_viterbi(*arguments, pieces.ranked_scores())
    return edges.select("unit", ids.alias("ids"))


def encode_units(units: DataFrame, pieces: Pieces, model_type: str = "bpe") -> DataFrame:
    """(unit, ids) for every row of ``units`` (unit, simple): folded, or merged one by one."""

    @F.pandas_udf("array<int>")
    def merged(found):
        return found.map(lambda u: merge_exactly(u, pieces))

    rest = units.filter(~F.col("simple")).select("unit", merged("unit").alias("ids"))
    return fold_units(units, pieces, model_type).unionByName(rest)


def encode(docs: DataFrame, pieces: Pieces, model_type: str = "bpe") -> DataFrame:
    """Per document: doc_id, ids, and round_trip (the ids decode to the document's text again)."""
    spark = docs.sparkSession
    slim = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    id_type = slim.schema["doc_id"].dataType
    parts = slim.rdd.getNumPartitions()
    by_size = -(-parts * _split_bytes(spark) // GROUP_BYTES)
    groups = max(1, min(parts, max(by_size, GROUPS_A_CORE * spark.sparkContext.defaultParallelism)))
    grouped = slim.coalesce(groups)
    units = group_units(grouped, pieces)

    # The rows (unit, mark) and the units' folded ids are both dealt by unit: this join moves nothing.
    distinct = units.groupBy("unit").agg(F.max("mark").alias("mark")).select("unit", (F.col("mark") % 2 == 1).alias("simple"))
    # the unit, a byte that is in no UTF-8 text, and two bytes an id, the high one first
    packed = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 4, "0")), ""))
    payload = F.concat(F.col("unit").cast("binary"), F.lit(UNIT_END), packed).alias("payload")
    folded = fold_units(distinct, pieces, model_type).select("unit", payload)
    # a group that gathered in parts may name a unit twice, with the same ids
    entries = units.join(folded.hint("shuffle_hash"), "unit").select(
        F.shiftright("mark", 1).alias("group"), F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("doc_id"), "payload"
    )
    schema = entries.schema

    def compress(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        group = TaskContext.get().partitionId()
        if group >= groups:
            raise RuntimeError("the texts' partitions are not the groups that the units were gathered in")
        for part in (p for batch in batches for p in slices(batch)):
            n = part.num_rows
            texts = [press.compress(t.encode("utf-8")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group] * n, pa.int32()),
                    pa.array([1] * n, pa.int32()),
                    part.column("doc_id"),
                    pa.array(texts, pa.binary()),
                ],
                names=["group", "kind", "doc_id", "payload"],
            )

    texts = grouped.select("doc_id", "text").mapInArrow(compress, schema)
    pattern, space = pieces.unit_pattern(), SPACE.encode("utf-8")
    bytes_of = np.array([*pieces.bytes_of, None], dtype=object)[:-1]  # None: an array of objects, whatever the pieces

    def assemble(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()

        class Units(dict):
            """Packed ids of the group's units, by their UTF-8 bytes; words of several units, and units not folded, as they come up."""

            def __missing__(self, word):
                found = others.get(word)
                if found is None:
                    text = word.decode("utf-8")
                    cut = [u for u in pattern.findall(text) if u]
                    if cut and cut != [text]:
                        found = b"".join([self[u.encode("utf-8")] for u in cut])
                    else:  # unknown or many symbols, or the input was split in another way before
                        found = np.asarray(merge_exactly(text, pieces), dtype=">u2").tobytes()
                    if len(others) >= WORDS_REMEMBERED:
                        others.clear()
                    if len(text) <= REMEMBERED_SYMBOLS:
                        others[word] = found
                return found

        current, units, others = None, Units(), {}

        def ids_of(text):
            if not cut_at_spaces(text, b" ", space):
                found = pattern.findall(escape(text.decode("utf-8")))
                return b"".join([units[u.encode("utf-8")] for u in found if u])
            # every word with its leading space symbol
            return b"".join(map(units.__getitem__, (space + text.replace(b" ", b" " + space)).split(b" ")))

        def encoded_batch(part):
            encoded, alike = [], []
            for payload in objects(part, "payload"):
                text = expand.decompress(payload)
                ids = ids_of(text)
                encoded.append(ids)
                alike.append(decoded(ids, bytes_of) == text.replace(space, b" "))
            offsets = np.concatenate(([0], np.cumsum([len(x) // 2 for x in encoded]))).astype(np.int32)
            values = np.frombuffer(b"".join(encoded), dtype=">u2").astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    pa.array(alike, pa.bool_()),
                ],
                names=["doc_id", "ids", "round_trip"],
            )

        for batch in batches:
            group, kind = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
            borders = [0, *cuts.tolist(), batch.num_rows]
            for first, last in zip(borders, borders[1:], strict=False):  # rows of one group and kind
                if first == last:
                    continue
                if group[first] != current:
                    current = group[first]
                    units.clear()
                    others.clear()
                if kind[first] == 0:
                    part = batch.slice(first, last - first)
                    units.update(p.split(UNIT_END, 1) for p in objects(part, "payload"))
                    continue
                yield from map(encoded_batch, slices(batch.slice(first, last - first)))

    # Texts first: a union numbers its first part's partitions from 0, so that a text's group is its partition.
    together = texts.unionByName(entries).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind")
    fields = [
        T.StructField("doc_id", id_type),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("round_trip", T.BooleanType()),
    ]
    return together.mapInArrow(assemble, T.StructType(fields))


def _split_bytes(spark: SparkSession) -> int:
    """Bytes of input per partition, from the session's setting."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def decoded(ids: bytes, bytes_of: np.ndarray) -> bytes:
    """Bytes of the text of packed ids (two bytes each, the high one first): as :func:`decode`, for one document."""
    packed = np.frombuffer(ids, dtype=">u2")
    spans = (packed[at : at + IDS_AT_ONCE] for at in range(0, len(packed), IDS_AT_ONCE))
    return b"".join([b"".join(bytes_of[span].tolist()) for span in spans]).removeprefix(b" ")


def joined_pieces(ids: Column, bytes_of: list[bytes]) -> Column:
    """The pieces' bytes of an id array as one text."""
    table = F.split(F.lit(" ".join(b.hex() for b in bytes_of)), " ")  # one constant: bounded by the model
    hexes = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    return F.decode(F.unhex(hexes), "UTF-8")


def decode(ids: Column, bytes_of: list[bytes]) -> Column:
    """Text of an id array: the joined pieces without the leading space that escaping adds."""
    return F.regexp_replace(joined_pieces(ids, bytes_of), "^ ", "")


def encode_and_check(docs: DataFrame, model_file: str, model_type: str = "bpe") -> DataFrame:
    """Per document: doc_id, n_pieces, ids, and whether decoding its ids gives the text back."""
    found = encode(docs, Pieces.load(model_file), model_type)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "round_trip")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids and round trip of the whole documents table with the public 32k BPE model."""
    import public_tokenizers

    return encode_and_check(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
