"""Operator 5 against brute force over all 400-byte strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stockroom.llm import suffix_dedup as s
from tests.llm import edge


def brute(rows, length=s.LENGTH):
    data = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def documents(spark):
    shared, other = edge.prose(11, 200), edge.prose(12, 160)
    near = edge.prose(13, 500)
    texts = [
        edge.prose(14, 80) + shared + edge.prose(15, 90),
        edge.prose(16, 70) + shared[30:] + other + edge.prose(17, 20),
        other[:399],
        other[:400],
        near,
        near.replace(" the ", " this ", 3),
        near[:1500] + "é" + near[1500:],
        "onhe. Is " * 300 + edge.prose(18, 50),
        edge.prose(19, 50) + "onhe. Is " * 70,
        "a" * 399,
        "b" * 400,
        "c" * 401,
        shared + shared,
        edge.prose(20, 4000),
    ]
    return edge.documents(spark, [(700 + i, t, *[None] * 7) for i, t in enumerate(texts)])


@pytest.mark.parametrize("group_limit", [s.GROUP_LIMIT, 2])
def test_removed_bytes(spark, group_limit):
    docs = documents(spark)
    found = s.remove_repeats(docs, group_limit=group_limit).collect()
    got = [(r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.runs), len(r.runs), r.kept_sha256) for r in found]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(g[2] for g in got) > 10_000


def test_empty_table(spark):
    assert s.remove_repeats(edge.empty(spark)).count() == 0


def test_equal_windows_share_an_anchor(monkeypatch):
    """Every window holds the same anchor wherever it stands, also across the blocks of a long text."""
    monkeypatch.setattr(s, "BLOCK", 1500)
    finder = s.Anchors(60, 20)
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcd") for _ in range(4000))
    data = np.frombuffer(text * 2, dtype=np.uint8)
    positions = set(finder.find(data)[0].tolist())
    for k in range(0, 3900, 7):
        offsets = {p - k for p in positions if k <= p <= k + 40}
        again = {p - 4000 - k for p in positions if 4000 + k <= p <= 4000 + k + 40}
        assert offsets & again


def test_columns_against_naive_prefixes():
    rng = random.Random(8)
    length, gram = 12, 4
    reach = length - gram
    middle = b"WXYZ"
    segments, before = [], []
    for _ in range(40):
        left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, reach)))
        right = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, length - gram)))
        if len(left + middle + right) >= length:
            segments.append(left + middle + right)
            before.append(len(left))
    groups = np.array([i % 2 for i in range(len(segments))])
    low, high = s.repeated_columns(groups, np.array(before), segments, length, gram)
    for i, seg in enumerate(segments):
        marks = []
        for k in range(len(seg) - length + 1):
            column = reach - before[i] + k
            same = [
                j
                for j, other in enumerate(segments)
                if j != i and groups[j] == groups[i] and (at := column - (reach - before[j])) >= 0
                and other[at : at + length] == seg[k : k + length]
            ]
            if same:
                marks.append(column)
        assert (low[i], high[i]) == ((min(marks), max(marks)) if marks else (reach + length, -1))
