"""Operator 1: chat formatting by transcript parsing with a hidden Markov model.

Input is raw transcripts: (conv_id, part, text) rows whose lines may carry a speaker marker
(``User:``, ``[assistant]``, ``<|system|>``, ``### Human:``, ``**AI**:`` ...), a wrong-looking
one, or none.  Each role has two hidden states, first line of a turn and later line.  A line
shows four features: its marker word, whether a blank line or a part border precedes it,
whether it ends in a question mark, and its length class.  Start, transition and emission
probabilities are counted over labelled transcripts with add-one smoothing.  A marker is one word of up
to ``MARKER_LETTERS`` letters; longer ones are text.  Markers seen under ``MIN_MARKER_COUNT`` times in training,
or beyond the ``MAX_MARKERS`` commonest, count as one unknown marker, whose emissions are learned too.

The rows of a conversation are numbered densely in the order of part and text, by a range sort
with an offset per partition.  Viterbi runs over whole conversations of any length, in three
levels: lines of a block of ``BLOCK`` rows, blocks of a super-block of ``BLOCK`` blocks, and
super-blocks.  A level
passes one (states x states) table of best scores up, and gets the entry and end state back,
so that the path is the one of the whole sequence, while a task holds one block only.

Each turn is rendered as ``<|role|>``, its lines without markers, ``<|end|>``.

Defined results: blank lines and null or empty parts show no line and make no turn, but count
as a blank line; repeated (conv_id, part) rows are read in the order of their text; a null
conv_id is one conversation of its own; null parts come first; an empty table gives no rows; ties between
paths go to the lower state (roles by name, first line before later line); conv_id keeps its type, text ids
included; extra columns are ignored.  Training without labelled rows raises a ValueError; :func:`untrained` then gives
the model of the smoothed counts alone, in which a conversation is one turn of the first role.  A very long text is
one row: its task holds it whole beside at most ``BLOCK`` - 1 other rows, and a turn's lines make one rendered row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockroom.llm.common import checkpointed, only, read

BLOCK = 512
MIN_MARKER_COUNT = 20
MAX_MARKERS = 1000  # marker words the model knows; the rest count as the unknown marker
MARKER_LETTERS = 20
_WORD = rf"(\w{{1,{MARKER_LETTERS}}})"
MARKER = re.compile(rf"^\s*(?:#{{1,4}}\s*)?(?:<\|{_WORD}\|>|\[{_WORD}\]:?|\*\*{_WORD}:?\*\*:?|{_WORD}\s?:)(?:\s+|$)")
ROLES = ("assistant", "system", "user")  # of a model without labelled rows
LENGTHS = (20, 60, 120, 300)  # upper ends of the length classes, in characters
NO_MARKER, RARE_MARKER = "", "?"


def lines_of(text: str | None, after_blank: bool = True) -> list[tuple[str, int, int, int, str]]:
    """(marker, after_blank, question, length class, body) of every line that is not blank."""
    out = []
    for raw in (text or "").split("\n"):
        if not raw.strip():
            after_blank = True
            continue
        m = MARKER.match(raw)
        marker = next(g for g in m.groups() if g).lower() if m else NO_MARKER
        body = raw[m.end() :] if m else raw
        size = sum(len(body) > n for n in LENGTHS)
        out.append((marker, int(after_blank), int(body.rstrip().endswith("?")), size, body))
        after_blank = False
    return out


@dataclass
class Model:
    """States are 2 * role (first line of a turn) and 2 * role + 1 (later line); all tables are log probabilities."""

    roles: list[str]
    markers: list[str]
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]  # one (states x values) table per feature

    def scores(self, lines: list[tuple]) -> np.ndarray:
        """(lines x states) emission scores."""
        known = {m: i for i, m in enumerate(self.markers)}
        at = [[known.get(x[0], known[RARE_MARKER]) for x in lines], *[[x[k] for x in lines] for k in (1, 2, 3)]]
        return sum((table[:, a].T for table, a in zip(self.emit, at, strict=True)), np.zeros((len(lines), 1)))


def train(labelled: DataFrame) -> Model:
    """Count the model over labelled transcripts (conv_id, part, text, role), all rows."""
    rows = only(labelled, "conv_id", "part", "text", "role").filter(F.col("role").isNotNull())
    roles = sorted(r["role"] for r in rows.select("role").distinct().collect())  # the label set
    if not roles:
        raise ValueError("no labelled transcripts to train on")

    def count(batches):
        for batch in batches:
            found = [
                (role, int(k > 0), *line[:4])
                for role, text in zip(batch["role"], batch["text"], strict=True)
                for k, line in enumerate(lines_of(text))
            ]
            columns = ["role", "later", "marker", "blank", "question", "size"]
            tally = Counter(found)
            yield pd.DataFrame([(*k, n) for k, n in tally.items()], columns=[*columns, "n"])

    schema = "role string, later int, marker string, blank int, question int, size int, n bigint"
    counted = rows.select("role", "text").mapInPandas(count, schema)
    shown = checkpointed(
        counted.groupBy("role", "later", "marker", "blank", "question", "size").agg(F.sum("n").alias("n"))
    )
    frequent = shown.filter(F.col("marker") != NO_MARKER).groupBy("marker").agg(F.sum("n").alias("n"))
    markers = [NO_MARKER, RARE_MARKER]
    ranked = frequent.filter(F.col("n") >= MIN_MARKER_COUNT).orderBy(F.desc("n"), "marker").limit(MAX_MARKERS)
    markers += sorted(r["marker"] for r in ranked.collect())
    marker = F.when(F.col("marker").isin(markers), F.col("marker")).otherwise(RARE_MARKER)
    table = shown.groupBy("role", "later", marker.alias("marker"), "blank", "question", "size").agg(F.sum("n").alias("n"))
    n = 2 * len(roles)
    emit = [np.ones((n, k)) for k in (len(markers), 2, 2, len(LENGTHS) + 1)]
    first, later = np.zeros(len(roles)), np.zeros(len(roles))
    for r in table.collect():  # states x feature values: bounded by the model
        role = roles.index(r["role"])
        state = 2 * role + r["later"]
        for t, value in zip(emit, (markers.index(r["marker"]), r["blank"], r["question"], r["size"]), strict=True):
            t[state, value] += r["n"]
        (later if r["later"] else first)[role] += r["n"]
    place = rows.select("conv_id", "part", "role")
    before = place.select(
        F.col("conv_id").alias("c"), (F.col("part") + 1).alias("p"), F.col("role").alias("previous")
    ).dropDuplicates(["c", "p"])
    pairs = place.join(before, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    turns = np.ones((len(roles), len(roles)))
    starts = np.ones(len(roles))
    for r in pairs.groupBy("previous", "role").agg(F.count(F.lit(1)).alias("n")).collect():  # roles squared
        if r["previous"] is None:
            starts[roles.index(r["role"])] += r["n"]
        else:
            turns[roles.index(r["previous"]), roles.index(r["role"])] += r["n"]
    return _model(roles, markers, starts, turns, first, later, emit)


def _model(roles, markers, starts, turns, first, later, emit) -> Model:
    """The log probabilities of smoothed counts (``first`` and ``later`` lines per role are smoothed here)."""
    n = 2 * len(roles)
    turns = turns / turns.sum(axis=1, keepdims=True)
    stay = (later + 1) / (first + later + 2)  # chance that the next line belongs to the same turn
    move = np.full((n, n), -np.inf)
    for i in range(len(roles)):
        for s in (2 * i, 2 * i + 1):
            move[s, 2 * i + 1] = np.log(stay[i])
            for j in range(len(roles)):
                move[s, 2 * j] = np.log((1 - stay[i]) * turns[i, j])
    start = np.full(n, -np.inf)
    start[::2] = np.log(starts / starts.sum())
    return Model(roles, markers, start, move, [np.log(t / t.sum(axis=1, keepdims=True)) for t in emit])


def untrained(roles: tuple[str, ...] = ROLES) -> Model:
    """The model of the smoothed counts alone, for transcripts without any labelled row."""
    names, k = sorted(roles), len(roles)
    emit = [np.ones((2 * k, values)) for values in (2, 2, 2, len(LENGTHS) + 1)]
    return _model(names, [NO_MARKER, RARE_MARKER], np.ones(k), np.ones((k, k)), np.zeros(k), np.zeros(k), emit)


def _chain(tables: list[np.ndarray]) -> np.ndarray:
    """Best score from the state before the first table to the state after the last."""
    out = tables[0]
    for t in tables[1:]:
        out = (out[:, :, None] + t[None, :, :]).max(axis=1)
    return out


def _path(tables: list[np.ndarray], entry: int, end: int | None) -> list[int]:
    """Best states after each table, from ``entry``, ending in ``end`` (any if None; ties: lowest state)."""
    score, back = tables[0][entry], []
    for t in tables[1:]:
        reached = score[:, None] + t
        back.append(reached.argmax(axis=0))
        score = reached.max(axis=0)
    states = [int(score.argmax()) if end is None else end]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _id_kind(df: DataFrame) -> str:
    """How conv_id travels: whole numbers as bigint, all else as text."""
    return "bigint" if dict(df.dtypes)["conv_id"] in _WHOLE else "string"


def _by_group(df: DataFrame, keys: list[str], order: list[str], solve, schema: str) -> DataFrame:
    """Apply ``solve`` (rows of one group in order -> result rows) to every group of ``keys``.

    Rows are co-located and sorted, then read as one stream, so that a task pays per row and
    holds one group; starting a call per group would cost more than solving a short one.
    """
    names, kinds = zip(*[c.split(" ", 1) for c in schema.split(", ")], strict=True)
    types = [_ARROW[k] for k in kinds]
    rest = [c for c in df.columns if c not in keys]

    def batch_of(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    def stream(batches):
        held, out = [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[: len(keys)] != held[0][: len(keys)]:
                    out += solve(held)
                    held = []
                held.append(row)
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
        if held:
            out += solve(held)
        if out:
            yield batch_of(out)

    located = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return located.mapInArrow(stream, schema)


def _starts(conv: pa.Array) -> np.ndarray:
    """Places of a sorted column where a conversation begins (a null is one of its own); the first row is one."""
    nothing = "" if pa.types.is_string(conv.type) else 0
    filled, null = conv.fill_null(nothing).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
    new = (filled[1:] != filled[:-1]) | (null[1:] != null[:-1])
    return np.concatenate(([0], np.flatnonzero(new) + 1)) if len(conv) else np.zeros(0, np.int64)


def _numbered(parts: DataFrame) -> DataFrame:
    """(conv_id, block, position, text): dense positions by part and text; a block is ``BLOCK`` rows in a row.

    A conversation may lie across partitions of the range sort (equal rows are spread too), so
    each partition counts on from what the ones before hold of its first conversation.
    """
    order = ["conv_id", "part", "text", "spread"]
    kind = _id_kind(parts)
    spread = parts.select(F.col("conv_id").cast(kind), "part", "text").withColumn(
        "spread", F.monotonically_increasing_id()
    )
    ranged = checkpointed(spread.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "text"))

    def ends(batches):
        first, last, n, n_last = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            starts = _starts(conv)
            if first is None:
                first = (conv[0].as_py(),)
            n_last = batch.num_rows - int(starts[-1]) + (n_last if len(starts) == 1 and (conv[0].as_py(),) == last else 0)
            last = (conv[-1].as_py(),)
            n += batch.num_rows
        if n:
            found = [[TaskContext.get().partitionId()], [first[0]], [last[0]], [n], [n_last]]
            types = [pa.int64(), _ARROW[kind], _ARROW[kind], pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["p", "first", "last", "n", "n_last"])

    found = ranged.select("conv_id").mapInArrow(ends, f"p bigint, first {kind}, last {kind}, n bigint, n_last bigint")
    offsets: dict[int, int] = {}
    before, held = None, 0  # the last conversation so far and its rows
    for r in sorted(found.collect(), key=lambda r: r["p"]):  # one row per partition
        offsets[r["p"]] = held if before == (r["first"],) else 0
        held = r["n_last"] + (offsets[r["p"]] if r["n_last"] == r["n"] else 0)
        before = (r["last"],)
    size = BLOCK

    def number(batches):
        last, following = None, offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            starts = _starts(conv)
            same = last is None or (conv[0].as_py(),) == last
            position = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            if same:
                position[: starts[1] if len(starts) > 1 else None] += following
            last, following = (conv[-1].as_py(),), int(position[-1]) + 1
            arrays = [conv, pa.array(position // size, pa.int64()), pa.array(position, pa.int64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "block", "position", "text"])

    return ranged.mapInArrow(number, f"conv_id {kind}, block bigint, position bigint, text string")


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """One row per recovered turn: conv_id, turn (order key), role, n_lines, rendered."""
    n = len(model.move)
    # state n is the one before a conversation's first line
    shared = transcripts.sparkSession.sparkContext.broadcast(model)  # states x feature values

    kind, id_type = _id_kind(transcripts), transcripts.schema["conv_id"].dataType
    parts = _numbered(only(transcripts, "conv_id", "part", "text"))

    def lines_in(texts) -> list[tuple]:
        return [line for text in texts for line in lines_of(text)]

    def line_tables(lines: list[tuple]) -> list[np.ndarray]:
        m = shared.value
        move = np.full((n + 1, n + 1), -np.inf)
        move[:n, :n], move[n, :n] = m.move, m.start
        return [move + np.append(e, -np.inf)[None, :] for e in m.scores(lines)]

    def tables_of(rows, at) -> list[np.ndarray]:
        return [np.asarray(r[at]).reshape(n + 1, n + 1) for r in rows]

    def block_scores(rows):  # conv_id, block, position, text
        lines = lines_in(r[3] for r in rows)
        return [(*rows[0][:2], _chain(line_tables(lines)).ravel().tolist())] if lines else []

    blocks = _by_group(
        parts, ["conv_id", "block"], ["position"], block_scores, f"conv_id {kind}, block bigint, scores array<double>"
    )
    blocks = checkpointed(blocks.withColumn("super", F.floor(F.col("block") / BLOCK)))

    def super_scores(rows):  # conv_id, super, block, scores
        return [(*rows[0][:2], _chain(tables_of(rows, 3)).ravel().tolist())]

    supers = _by_group(
        blocks, ["conv_id", "super"], ["block"], super_scores, f"conv_id {kind}, super bigint, scores array<double>"
    )

    def super_ends(rows):  # conv_id, super, scores
        states = _path(tables_of(rows, 2), n, None)
        return [(*r[:2], a, b) for r, a, b in zip(rows, [n, *states], states, strict=False)]

    resolved = _by_group(
        supers, ["conv_id"], ["super"], super_ends, f"conv_id {kind}, super bigint, entry int, end int"
    )
    same_super = blocks["conv_id"].eqNullSafe(resolved["conv_id"]) & (blocks["super"] == resolved["super"])
    inner = blocks.join(resolved, same_super).select(
        blocks["conv_id"], blocks["super"], "block", "scores", F.col("entry").alias("from"), F.col("end").alias("to")
    )

    def block_ends(rows):  # conv_id, super, block, scores, from, to
        states = _path(tables_of(rows, 3), rows[0][4], rows[0][5])
        return [(r[0], r[2], a, b) for r, a, b in zip(rows, [rows[0][4], *states], states, strict=False)]

    borders = _by_group(
        inner, ["conv_id", "super"], ["block"], block_ends, f"conv_id {kind}, block bigint, entry int, end int"
    )
    border = borders.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), "entry", "end")
    same_block = parts["conv_id"].eqNullSafe(border["b_conv"]) & (parts["block"] == border["b_block"])
    located = parts.join(border, same_block).drop("b_conv", "b_block")

    def block_runs(rows):  # conv_id, block, position, text, entry, end
        """Runs of lines of one turn inside the block; run 0 continues the last block's turn."""
        lines = lines_in(r[3] for r in rows)
        out: list[list] = []
        for line, state in zip(lines, _path(line_tables(lines), rows[0][4], rows[0][5]), strict=True):
            if state % 2 == 0 or not out:
                number = out[-1][0] + 1 if out else int(state % 2 == 0)
                out.append([number, state // 2, []])
            out[-1][2].append(line[4].strip())
        return [(*rows[0][:2], run, role, len(b), "\n".join(x for x in b if x)) for run, role, b in out]

    pieces = checkpointed(
        _by_group(
            located,
            ["conv_id", "block"],
            ["position"],
            block_runs,
            f"conv_id {kind}, block bigint, run int, role int, n_lines bigint, body string",
        )
    )
    # a block's run 0 belongs to the last turn opened before it: found per super-block, then across super-blocks
    opened = pieces.groupBy("conv_id", "block").agg(F.max(F.struct("run")).getField("run").alias("last_run"))
    opened = opened.withColumn("super", F.floor(F.col("block") / BLOCK)).withColumn(
        "opens", F.when(F.col("last_run") > 0, F.struct(F.col("block"), F.col("last_run").alias("run")))
    )
    within = Window.partitionBy("conv_id", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_super = opened.groupBy("conv_id", "super").agg(F.max("opens").alias("opens"))
    across = Window.partitionBy("conv_id").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    of_super = of_super.select(
        F.col("conv_id").alias("s_conv"), F.col("super").alias("s_super"), F.last("opens", True).over(across).alias("earlier")
    )
    inside = opened.select("conv_id", "super", "block", F.last("opens", True).over(within).alias("open_here"))
    same = inside["conv_id"].eqNullSafe(of_super["s_conv"]) & (inside["super"] == of_super["s_super"])
    open_turn = inside.join(of_super, same).select(
        F.col("conv_id").alias("o_conv"), F.col("block").alias("o_block"), F.coalesce("open_here", "earlier").alias("open")
    )
    continued = pieces["conv_id"].eqNullSafe(open_turn["o_conv"]) & (pieces["block"] == open_turn["o_block"])
    own = F.struct(F.col("block"), F.col("run"))
    keyed = pieces.join(open_turn, continued).withColumn("turn", F.when(F.col("run") > 0, own).otherwise(F.col("open")))
    turns = keyed.groupBy("conv_id", "turn").agg(
        F.first("role").alias("role"),
        F.sum("n_lines").alias("n_lines"),
        F.sort_array(F.collect_list(F.struct("block", "run", "body"))).alias("bodies"),
    )
    names = F.array(*[F.lit(r) for r in model.roles])
    body = F.array_join(F.filter(F.transform("bodies", lambda b: b["body"]), lambda b: b != ""), "\n")
    role = F.get(names, F.col("role"))
    return turns.select(
        F.col("conv_id").cast(id_type).alias("conv_id"),
        (F.col("turn.block") * (1 << 32) + F.col("turn.run")).alias("turn"),
        role.alias("role"),
        "n_lines",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>")).alias("rendered"),
    )


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Stand-in input: each turn as a raw part in one of four marker styles, some parts without a marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    bare = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0)
    names = F.create_map(*[F.lit(x) for p in (("user", "Human"), ("assistant", "AI"), ("system", "Context")) for x in p])
    short = F.create_map(*[F.lit(x) for p in (("user", "Q"), ("assistant", "A"), ("system", "Note")) for x in p])
    marker = (
        F.when(bare, "")
        .when(style == 0, F.concat(F.initcap("role"), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), F.element_at(names, F.col("role")), F.lit(":\n")))
        .when(style == 2, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
        .otherwise(F.concat(F.element_at(short, F.col("role")), F.lit(": ")))
    )
    return conversations.select(
        "conv_id", F.col("turn").alias("part"), F.concat(F.coalesce(marker, F.lit("")), "text").alias("text"), "role"
    )


def train_or_smooth(labelled: DataFrame) -> Model:
    """:func:`train`, or :func:`untrained` where no row is labelled."""
    try:
        return train(labelled)
    except ValueError:
        return untrained()


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Turns recovered from raw transcripts of all conversations; trained on four fifths of them."""
    parts = raw_transcripts(read(spark, sf_dir, "conversations"))
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return parse(parts.drop("role"), train_or_smooth(parts.filter(~held_out)))
