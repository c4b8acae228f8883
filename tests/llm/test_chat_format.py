"""Operator 1: roles recovered from marked and unmarked transcripts, blocks against whole sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import chat_format as c
from stockroom.llm.common import read
from tests.conftest import SF_MEDIUM, SF_SMALL

SCHEMA = "conv_id bigint, part bigint, text string, role string, block string, run string"


@pytest.fixture(scope="module")
def model(spark):
    return c.train(c.raw_transcripts(read(spark, SF_MEDIUM, "conversations")))


def turns(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.turn)):
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_roles_of_held_out_conversations(spark):
    conversations = read(spark, SF_MEDIUM, "conversations")
    truth = {}
    for r in conversations.orderBy("conv_id", "turn").collect():
        truth.setdefault(r.conv_id, []).append(r.role)
    found = turns(c.op1_chat_formatting(spark, SF_MEDIUM).collect())
    assert found.keys() == truth.keys()
    right = sum([r.role for r in found[k]] == truth[k] for k in truth)
    assert right / len(truth) > 0.95


def test_rendering_and_edges(spark, model):
    rows = [
        (1, 0, "User: How are you?\n\nASSISTANT: Fine.\nAnd you?", None),
        (1, 1, None, None),
        (1, 2, "", None),
        (1, 3, "### Human:\nWell.", None),
        (2, 0, " \n\n", None),
        (None, 0, "Q: what?\nstill what", None),
        (None, None, "[system] first", None),
        (3, 5, "AI: same", None),
        (3, 5, "AI: same", None),
    ]
    frame = spark.createDataFrame([(*r, "b", "r") for r in rows], SCHEMA)
    found = turns(c.parse(frame, model).collect())
    assert set(found) == {1, 3, None}
    assert [r.role for r in found[1]] == ["user", "assistant", "user"]
    assert found[1][1].rendered == "<|assistant|>\nFine.\nAnd you?\n<|end|>"
    assert found[1][2].rendered == "<|user|>\nWell.\n<|end|>"
    assert [r.role for r in found[None]] == ["system", "user"]
    assert c.parse(frame.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        c.train(frame)


def test_blocks_give_the_path_of_the_whole_sequence(spark, model, monkeypatch):
    """One conversation over many blocks and super-blocks, some turns longer than a block."""
    rows = []
    for i in range(150):
        text = "User: why?" if i % 10 == 0 else "assistant: since" if i % 10 == 1 else None
        rows.append((1, i, text if text else "more of it here\nand on", None, "b", "r"))
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = [(r.role, r.n_lines, r.rendered) for r in turns(c.parse(frame, model).collect())[1]]
    monkeypatch.setattr(c, "BLOCK", 4)
    cut = [(r.role, r.n_lines, r.rendered) for r in turns(c.parse(frame, model).collect())[1]]
    assert cut == whole and len(whole) > 10


def test_blocks_are_bounded_by_rows(spark, model, monkeypatch):
    """A null conv_id with many rows per part, null parts and repeated rows: dense positions, small blocks, same path."""
    texts = ["User: why?", "assistant: since", "more of it here\nand on", "just so", ""]
    rows = [(None, i % 3, f"{texts[i % 5]} {i % 40}") for i in range(300)] + [(None, None, texts[i % 2]) for i in range(50)]
    rows += [(4, 1, "User: again")] * 60 + [(c, i, texts[i % 5]) for c in (1, 2, 3, 9) for i in range(5)]
    frame = spark.createDataFrame(rows, "conv_id bigint, part bigint, text string").repartition(7)

    def found():
        return {k: [(r.role, r.n_lines, r.rendered) for r in v] for k, v in turns(c.parse(frame, model).collect()).items()}

    whole = found()
    monkeypatch.setattr(c, "BLOCK", 8)
    numbered = c._numbered(frame).collect()
    by_block, by_conv = {}, {}
    for r in numbered:
        by_block.setdefault((r.conv_id, r.block), []).append(r.position)
        by_conv.setdefault(r.conv_id, []).append((r.position, r.text))
    assert max(map(len, by_block.values())) == 8
    for conv, got in by_conv.items():
        expected = sorted((-1 if p is None else p, t) for k, p, t in rows if k == conv)
        assert sorted(got) == [(i, t) for i, (_, t) in enumerate(expected)]
    assert found() == whole and len(whole[None]) > 10


def test_path_is_the_best_one():
    rng = np.random.default_rng(1)
    tables = [rng.normal(size=(3, 3)) for _ in range(6)]
    best = max(
        np.ndindex(*[3] * 6), key=lambda p: sum(t[a, b] for t, a, b in zip(tables, (0, *p), p, strict=False))
    )
    assert c._path(tables, 0, None) == list(best)
    assert np.isclose(c._chain(tables)[0].max(), sum(t[a, b] for t, a, b in zip(tables, (0, *best), best, strict=False)))


def test_hot_part_text_is_read_in_order(spark, model):
    frame = spark.createDataFrame([(7, 1, "b: second", None, "", ""), (7, 0, "User: first", None, "", "")], SCHEMA)
    found = c.parse(frame.orderBy(F.desc("part")), model).collect()
    assert min(found, key=lambda r: r.turn).rendered.startswith("<|user|>\nfirst")


def test_text_ids_and_long_texts(spark, model):
    long = "\n".join(f"line {i} of a very long answer" for i in range(40_000))
    rows = [("c-1", 0, "User: why?"), ("c-1", 1, "assistant: " + long), ("c-1", 2, "User: thanks"), (None, 0, "User: hi"), ("", 0, "AI: x")]
    frame = spark.createDataFrame(rows, "conv_id string, part bigint, text string")
    parsed = c.parse(frame, model)
    assert dict(parsed.dtypes)["conv_id"] == "string"
    found = turns(parsed.collect())
    assert set(found) == {"c-1", None, ""}
    assert sum(r.n_lines for r in found["c-1"]) == 40_002
    bodies = "\n".join(r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>") for r in found["c-1"])
    assert bodies == "why?\n" + long + "\nthanks"  # every line, in order
    whole = spark.createDataFrame([(5, 0, "User: hi")], "conv_id int, part int, text string")
    assert dict(c.parse(whole, model).dtypes)["conv_id"] == "int"


def write_conversations(spark, path, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    frame.write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_query_on_an_empty_table_and_without_labelled_rows(spark, tmp_path):
    empty = c.op1_chat_formatting(spark, write_conversations(spark, tmp_path / "empty", []))
    assert empty.columns == ["conv_id", "turn", "role", "n_lines", "rendered"] and empty.count() == 0
    held_out = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0)
    rows = [(held_out, 0, "user", "Hello?\nAnyone?"), (held_out, 1, "assistant", "Yes.")]
    found = c.op1_chat_formatting(spark, write_conversations(spark, tmp_path / "held", rows)).collect()
    rendered = "\n".join(r.rendered for r in found)
    assert all(r.role in c.ROLES for r in found) and all(x in rendered for x in ("Hello?", "Anyone?", "Yes."))
    no_role = [(1, 0, None, "Hello?"), (2, 0, None, None)]
    assert c.op1_chat_formatting(spark, write_conversations(spark, tmp_path / "none", no_role)).count() <= 1


def plain_viterbi(lines, model):
    """States of the best path, by dynamic programming over the whole sequence, one state at a time."""
    known = {m: i for i, m in enumerate(model.markers)}
    n = len(model.move)

    def emission(state, line):
        marker = known.get(line[0], known[c.RARE_MARKER])
        return sum(t[state, v] for t, v in zip(model.emit, (marker, *line[1:4]), strict=True))

    best = [model.start[s] + emission(s, lines[0]) for s in range(n)]
    back = []
    for line in lines[1:]:
        came = [max(range(n), key=lambda a: (best[a] + model.move[a, s], -a)) for s in range(n)]
        best = [best[came[s]] + model.move[came[s], s] + emission(s, line) for s in range(n)]
        back.append(came)
    states = [max(range(n), key=lambda s: (best[s], -s))]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def test_every_conversation_equals_an_independent_viterbi(spark, model):
    parts = c.raw_transcripts(read(spark, SF_SMALL, "conversations"))
    by_conversation = {}
    for r in parts.orderBy("conv_id", "part", "text").collect():
        by_conversation.setdefault(r.conv_id, []).append(r.text)
    found = turns(c.parse(parts.drop("role"), model).collect())
    for conv, texts in by_conversation.items():
        lines = [line for t in texts for line in c.lines_of(t)]
        expected = []
        for line, state in zip(lines, plain_viterbi(lines, model), strict=True):
            if state % 2 == 0 or not expected:
                expected.append([model.roles[state // 2], []])
            expected[-1][1].append(line[4].strip())
        want = [(role, len(b), f"<|{role}|>\n" + "\n".join(x for x in b if x) + "\n<|end|>") for role, b in expected]
        assert [(r.role, r.n_lines, r.rendered) for r in found[conv]] == want, conv
    assert len(by_conversation) >= 20
