"""Operator 12 against every order walked over every document."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import permutations

from stockroom.llm import filter_audit
from tests.llm import edge


def fails(text: str | None) -> set[str]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    return out


def plain_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, mark in labels if i is not None and mark == 1}
    failed = []
    for i, text, lang in docs:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        failed.append((i, lang or "", fails(text) | ({"E"} if copy else set())))
    out = []
    for part in sorted({p for _, p, _ in failed}):
        rows, removals = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in failed if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                redundant = sum(letter in f for _, f in gone)
                gone += here
                removals[letter] += len(here)
                unique = sum(f == {letter} for _, p, f in failed if p == part)
                lost = [sum(i in marked for i, _ in here) for marked in (good, toxic)]
                rows.append((part, "".join(order), step, len(left), len(here), redundant, unique, *lost, letter))
        out += [(*r[:-1], removals[r[-1]]) for r in rows]
    return sorted(out)


def cases() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(8)
    made = [edge.prose(seed, n) for seed, n in [(1, 120), (2, 260), (3, 300), (4, 30)]]
    made += [made[1].upper(), "same words here " * 90, made[2] + " 5%", made[2].replace("the", "THE"), "É" * 300, edge.LONG]
    made += [None, "", " \n\t", "a\x85b c \x1cd"]
    docs = [(i, rng.choice(made), rng.choice(["en", "fr", None, ""])) for i in range(90)]
    docs += [docs[3]] * 3 + [(3, made[1], "en"), (None, made[1], "en"), (None, made[1], None), (None, None, None), (-1, made[0], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1), (777, 1, 1)]
    return docs, labels


def test_equals_every_order_walked(spark):
    docs, labels = cases()
    doc_frame = spark.createDataFrame(
        [(*d, "digest", 9, True) for d in docs], "doc_id bigint, text string, lang string, part string, mask int, good boolean"
    ).repartition(5)
    label_frame = spark.createDataFrame(
        [(*m, 1, "x") for m in labels], "doc_id bigint, quality int, toxic int, n int, text string"
    )
    found = filter_audit.interaction_audit(doc_frame, label_frame)
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, labels)


def test_empty_tables(spark):
    docs, labels = cases()
    no_docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    with_labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert filter_audit.interaction_audit(no_docs, with_labels).count() == 0
    found = filter_audit.interaction_audit(spark.createDataFrame(docs, no_docs.schema), no_labels)
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, [])


def test_least_squares_gives_the_shapley_value():
    rng = random.Random(6)
    for m in (2, 3, 5):
        values = [0] + [rng.randint(-50, 10**20) for _ in range((1 << m) - 1)]
        sums = [Fraction(0)] * m
        orders = list(permutations(range(m)))
        for order in orders:
            before = 0
            for i in order:
                sums[i] += values[before | 1 << i] - values[before]
                before |= 1 << i
        assert filter_audit.shapley(values) == [s / len(orders) for s in sums]
