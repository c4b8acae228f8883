"""Operator 4's randomness battery and step-up against a plain version that imports nothing of the operator's code."""

from __future__ import annotations

import itertools
import math
import random
import re

import pytest

from stockroom.llm import secret_scan
from stockroom.llm.common import read
from tests.conftest import SF_SMALL
from tests.llm.test_text_operators import SECRETS, plain_base

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Symbols in order, excess of repeats of a text.
TABLE = [
    (DIGITS + "abcdef", 1.0),
    (DIGITS + "ABCDEF", 1.0),
    (LOWER, 0.73),
    (UPPER, 0.73),
    (UPPER + "234567", 1.1),
    (LOWER + DIGITS, 1.4),
    (UPPER + DIGITS, 1.4),
    (UPPER + LOWER + DIGITS, 3.1),
    (UPPER + LOWER + DIGITS + "+/", 3.2),
    (UPPER + LOWER + DIGITS + "-_", 3.2),
]
SHORTEST = (20, 24, 32, 48, 96)


def beyond(z):
    return math.erfc(z / math.sqrt(2)) / 2


def plain_probability(token):
    """The three tests by their textbook sums, one symbol at a time."""
    body = token.rstrip("=")
    fitting = [(a, x) for a, x in TABLE if all(c in a for c in body)]
    if len(body) < 20 or all(c in DIGITS for c in body) or not fitting:
        return 1.0
    alphabet, excess = fitting[0]
    n, size = len(body), len(alphabet)
    chi = sum((body.count(c) - n / size) ** 2 / (n / size) for c in alphabet)
    spread = 2 / (9 * (size - 1))
    if beyond(((chi / (size - 1)) ** (1 / 3) - 1 + spread) / spread**0.5) < 0.001:
        return 1.0
    places = [alphabet.index(c) for c in body]
    sides = [2 * p >= size for p in places]
    high, low = sides.count(True), sides.count(False)
    if high == 0 or low == 0:
        return 1.0
    runs = len(list(itertools.groupby(sides)))
    expected = 1 + 2 * high * low / n
    variance = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    if variance > 0 and 2 * beyond(abs(runs - expected) / variance**0.5) < 0.001:
        return 1.0
    mean = sum(places) / n
    power = sum((p - mean) ** 2 for p in places)
    follow = sum((a - mean) * (b - mean) for a, b in itertools.pairwise(places))
    if 2 * beyond(abs(follow / power) * n**0.5) < 0.001:
        return 1.0
    more = n * excess
    return beyond((size - 1 + more - chi) / (2 * (size - 1) + 4 * more) ** 0.5)


def plain_candidates(text):
    """(start, end, stratum, level) of the tokens and parts outside base spans; overlaps by plain comparison."""
    text = text or ""
    base = [(a, b) for a, _, b in plain_base(text)]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}(=+(?![A-Za-z0-9+/_=-]))?", text):
        spans, ways = [m.span()], 1
        if re.search("[+/]", m[0]) and re.search("[-_]", m[0]):
            cuts = ("[A-Za-z0-9]{20,}=*", "[A-Za-z0-9+/]{20,}=*", "[A-Za-z0-9_-]{20,}=*")
            spans = {(m.start() + p.start(), m.start() + p.end()) for c in cuts for p in re.finditer(c, m[0])}
            ways = 3
        free = [s for s in spans if not any(a < s[1] and s[0] < b for a, b in base)]
        taken = []
        for p, a, b in sorted((plain_probability(text[a:b]), a, b) for a, b in free):
            if not any(a < d and c < b for c, d in taken):
                taken.append((a, b))
                p = min(1.0, ways * p)
                level = 600 if p <= 0 else min(600, int(-math.log10(p) * 10))
                out.append((a, b, max(k for k, s in enumerate(SHORTEST) if b - a >= s), level))
    return sorted(out)


def plain_limits(texts):
    """Step-up over the sorted list of all tokens of a stratum."""
    found = {}
    for text in texts:
        for _, _, stratum, level in plain_candidates(text):
            found.setdefault(stratum, []).append(level)
    limits = {}
    for stratum, levels in found.items():
        levels.sort(reverse=True)
        good = [x for k, x in enumerate(levels, 1) if 10 ** (-x / 10) <= 0.001 * k / len(levels)]
        if good:
            limits[stratum] = min(good)
    return limits


def plain_spans(text, limits):
    extra = [(a, 3, b) for a, b, stratum, level in plain_candidates(text) if level >= limits.get(stratum, 601)]
    return sorted([*plain_base(text), *extra])


def plain_redaction(text, limits):
    """Every maximal run of overlapping spans becomes the mark."""
    runs = []
    for a, _, b in plain_spans(text, limits):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in reversed(runs):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def tokens():
    rng = random.Random(11)
    out = []
    for alphabet, _ in TABLE:
        for n in (20, 23, 24, 40, 64, 97, 300):
            out.append("".join(rng.choice(alphabet) for _ in range(n)))
            out.append("".join(rng.choice(alphabet[:5]) for _ in range(n)))
            out.append("".join(sorted(out[-2])))
    return [*out, "1" * 30, "ab" * 20, "A" * 25 + "==", "short", "", "theseareplainwordsinarow", "x=" * 15]


def test_battery_equals_the_textbook_sums():
    for token in tokens():
        assert secret_scan.randomness(token) == pytest.approx(plain_probability(token), rel=1e-6, abs=1e-300), token


def awkward():
    made = tokens()
    mixed = [f"/path/of-the_file/{a}_{b}-{a[:22]}/x+{b}=" for a, b in zip(made[::5], made[2::5], strict=False)]
    return [*SECRETS, *made, *mixed, " ".join(made), None, "", "=" * 50]


def test_candidates_equal_the_plain_ones():
    for text in awkward():
        text = text or ""
        assert sorted(secret_scan.candidates(text, secret_scan.base_spans(text))) == plain_candidates(text), text


def test_query_equals_the_plain_version(spark):
    """op4 over the whole small table, every span of every document."""
    texts = {r.doc_id: r.text for r in read(spark, SF_SMALL, "documents").collect()}
    limits = plain_limits(texts.values())
    rows = secret_scan.op4_secret_scans(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in plain_spans(texts[r.doc_id], limits))
        assert r.spans == expected, r.doc_id


def test_step_up_and_redaction_equal_the_plain_version(spark):
    texts = awkward()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    limits = plain_limits(texts)
    assert limits and secret_scan.limits(docs) == limits
    got = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert got == {i: t if t is None else plain_redaction(t, limits) for i, t in enumerate(texts)}
