"""Operator 4: secret scans by a randomness test battery.

Base kinds are fixed patterns (assignments, access keys, hex runs).  The method adds spans
of kind ``random``: tokens of at least 20 ASCII letters, digits and ``+/_-``, with ``=`` as
padding at the end only, outside base spans.  The token's encoding is inferred (the smallest
alphabet that holds it) and its symbols are tested as a random draw from that alphabet:

* chi-squared test of uniformity,
* Wald-Wolfowitz runs test above and below the middle of the alphabet,
* lag-1 serial correlation.

No alphabet holds both ``+/`` and ``-_``.  A token of both is read in three ways, cut at ``-_``,
at ``+/`` and at all four; of parts of at least 20 symbols that overlap, the one that looks
most random counts, with its probability times the three ways.

A token that any test rejects at ``ALPHA`` is not random.  The others get the probability
that text-like symbols of the same length look as even as that: under text the statistic
is non-central chi-squared with non-centrality growing with the length, so short tokens can
never be significant.  False discoveries are controlled per length stratum by the
Benjamini-Hochberg step-up over all tokens of all documents; Spark sums a histogram of
probabilities (strata x bins rows), from which the driver reads one limit per stratum.

Defined results: a null text is an empty text and has no spans; repeated rows each get the
same row; an empty table has no limits and no rows; extra columns are ignored (report) or
kept (redaction).  Very long texts are scanned whole, in linear time.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import only, read

# Fixed patterns and lengths of the base kinds, in the order of their rank.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: a shorter run fails and holds no other match
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 6, 20

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
# Ways to cut a token that mixes the separators of two alphabets, and the symbols that mix them.
PARTS = tuple(re.compile(rf"[A-Za-z0-9{inner}]{{20,}}=*") for inner in ("", "+/", "_-"))
MIXED = (frozenset("+/"), frozenset("-_"))
ALPHA = 0.001
FALSE_DISCOVERY_RATE = 0.001
STRATA = (20, 24, 32, 48, 96)  # shortest length of each stratum
BINS_PER_DECADE, MAX_BIN = 10, 600
# Alphabets from small to large, with the excess of a text's symbol repeats over an even draw
# (alphabet size * chance that two symbols agree - 1; English letters agree at about 0.066).
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    (_DIGITS + "abcdef", 1.0),
    (_DIGITS + "ABCDEF", 1.0),
    (_LOWER, 0.73),
    (_UPPER, 0.73),
    (_UPPER + "234567", 1.1),
    (_LOWER + _DIGITS, 1.4),
    (_UPPER + _DIGITS, 1.4),
    (_UPPER + _LOWER + _DIGITS, 3.1),
    (_UPPER + _LOWER + _DIGITS + "+/", 3.2),
    (_UPPER + _LOWER + _DIGITS + "-_", 3.2),
)
_PLACES = [({c: i for i, c in enumerate(a)}, len(a), excess) for a, excess in ALPHABETS]


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty cube-root approximation."""
    spread = 2 / (9 * df)
    return _upper_tail(((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def randomness(token: str) -> float:
    """Probability that text of this length looks as random as the token; 1 if a test rejects randomness."""
    body = token.rstrip("=")
    if len(body) < STRATA[0] or body.isdigit():
        return 1.0
    symbols = set(body)
    for places, size, excess in _PLACES:
        if symbols <= places.keys():
            break
    else:
        return 1.0
    at = np.fromiter((places[c] for c in body), dtype=np.float64, count=len(body))
    n = len(at)
    counts = np.bincount(at.astype(int), minlength=size)
    even = n / size
    statistic = float(((counts - even) ** 2).sum() / even)
    df = size - 1
    if _chi_squared_tail(statistic, df) < ALPHA:
        return 1.0
    high = at >= size / 2
    n1 = int(high.sum())
    n2 = n - n1
    if not n1 or not n2:
        return 1.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * n1 * n2 / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    if variance > 0 and 2 * _upper_tail(abs(runs - mean) / math.sqrt(variance)) < ALPHA:
        return 1.0
    centred = at - at.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    if 2 * _upper_tail(abs(serial) * math.sqrt(n)) < ALPHA:
        return 1.0
    shift = n * excess
    z = (statistic - (df + shift)) / math.sqrt(2 * df + 4 * shift)
    return _upper_tail(-z)


def _bin(p: float) -> int:
    """Bins of -log10 p; a bin's probabilities are at most 10 ** (-bin / BINS_PER_DECADE)."""
    return MAX_BIN if p <= 0 else min(MAX_BIN, int(-math.log10(p) * BINS_PER_DECADE))


def _stratum(length: int) -> int:
    return sum(length >= s for s in STRATA) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base matches, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of the tokens outside base spans."""
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))

    def outside(a, b):
        k = bisect_left(starts, b)
        return not k or reach[k - 1] <= a

    out = []
    for m in TOKEN.finditer(text):
        token = m[0]
        if not all(map(frozenset(token).intersection, MIXED)):
            if outside(*m.span()):
                out.append((*m.span(), _stratum(len(token)), _bin(randomness(token))))
            continue
        spans = {p.span() for cut in PARTS for p in cut.finditer(token)}
        parts = [(randomness(token[a:b]), a, b) for a, b in spans if outside(m.start() + a, m.start() + b)]
        taken, chosen = bytearray(len(token)), []
        for p, a, b in sorted(parts):
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                chosen.append((m.start() + a, m.start() + b, _stratum(b - a), _bin(min(1.0, len(PARTS) * p))))
        out += sorted(chosen)
    return out


def limits(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> dict[int, int]:
    """Smallest significant bin per length stratum, by Benjamini-Hochberg over all documents' tokens."""

    def scan(batches):
        for batch in batches:
            tally = {}
            for text in batch["text"]:
                for _, _, stratum, level in candidates(text, base_spans(text)):
                    tally[stratum, level] = tally.get((stratum, level), 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in tally.items()], columns=["stratum", "level", "n"])

    texts = docs.filter(F.col("text").isNotNull()).select("text")
    tallies = texts.mapInPandas(scan, "stratum int, level int, n bigint").groupBy("stratum", "level")
    rows = tallies.agg(F.sum("n").alias("n")).collect()  # at most strata * (MAX_BIN + 1) rows
    out = {}
    for stratum in {r["stratum"] for r in rows}:
        by_level = {r["level"]: r["n"] for r in rows if r["stratum"] == stratum}
        tested, passed = sum(by_level.values()), 0
        for level in range(MAX_BIN, -1, -1):
            passed += by_level.get(level, 0)
            # step-up: the largest p whose rank k allows p <= rate * k / tested
            if by_level.get(level) and 10 ** (-level / BINS_PER_DECADE) <= rate * passed / tested:
                out[stratum] = level
    return out


def all_spans(text: str | None, allowed: dict[int, int]) -> list[tuple[int, int, int]]:
    base = base_spans(text or "")
    extra = candidates(text or "", base)
    return sorted(base + [(a, 3, b) for a, b, s, level in extra if level >= allowed.get(s, MAX_BIN + 1)])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and all spans as text."""
    slim = only(docs, "doc_id", "text")
    allowed = limits(slim)

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")
    def report(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = all_spans(text, allowed)
            kinds = [k for _, k, _ in spans]
            base = _joined(s for s in spans if s[1] < 3)
            digest = hashlib.sha256(base.encode()).hexdigest()
            rows.append((*[kinds.count(k) for k in range(4)], digest, _joined(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return slim.select("doc_id", report("text").alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents; every maximal run of overlapping spans in ``text`` is replaced by ``mark``."""
    allowed = limits(docs)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            parts, end = [], 0
            for a, _, b in all_spans(text, allowed):
                if a >= end:
                    parts += [text[end:a], mark]
                end = max(end, b)
            out.append(text if not parts else "".join([*parts, text[end:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", cleaned(F.col("text")))


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`scan` over the whole documents table."""
    return scan(read(spark, sf_dir, "documents"))
