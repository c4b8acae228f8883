"""Operator 3 against a plain version: grams as strings, sums one number at a time, no code of the operator.

Only the learned centroids are taken from the trained model; document frequencies, vectors, cosines, the limit for a
text's length and the choice of language are worked out again.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stockroom.llm import language_id
from stockroom.llm.common import read
from tests.conftest import SF_SMALL
from tests.llm import edge

WORD = (1 << 64) - 1


def plain_feature(gram):
    """Number of a gram's feature among 8,192."""
    code = 0
    for symbol in gram:
        code = (code * 0x1FFFFF + symbol) & WORD
    code = (code * 0x9E3779B97F4A7C15 + len(gram)) & WORD
    return (((code ^ (code >> 29)) * 0xBF58476D1CE4E5B9) & WORD) >> 51


def plain_counts(text):
    """Feature counts, or None without letters; a run of other symbols is one separator, and one stands at each end."""
    symbols, any_letter = [0], False
    inner = []
    for c in (text or "").lower():
        if c.isalpha():
            inner.append(ord(c))
            any_letter = True
        elif not inner or inner[-1]:
            inner.append(0)
    if not any_letter:
        return None
    symbols += inner + [0]
    grams = [tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1)]
    grams.remove((0,))  # the separator added in front starts no gram of its own
    return Counter(map(plain_feature, grams))


def plain_vector(counts, idf):
    weights = {f: (1 + math.log(n)) * idf[f] for f, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {f: w / norm for f, w in weights.items()} if norm else weights


def plain_predict(text, model, idf):
    """(language, cosine, rejected)."""
    counts = plain_counts(text)
    if counts is None or not len(model.owner):
        return "und", 0.0, True
    vector = plain_vector(counts, idf)
    cosines = [sum(w * float(row[f]) for f, w in vector.items()) for row in model.centroids]
    best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
    at, xs, ys = math.log(sum(counts.values())), model.limit_grams, model.limits
    if at <= xs[0]:
        limit = ys[0]
    elif at >= xs[-1]:
        limit = ys[-1]
    else:
        k = next(i for i in range(1, len(xs)) if at <= xs[i])
        limit = ys[k - 1] + (ys[k] - ys[k - 1]) * (at - xs[k - 1]) / (xs[k] - xs[k - 1])
    score = min(max(cosines[best], 0.0), 1.0)
    return model.languages[model.owner[best]], score, score < limit


def learning_rows(rows):
    return [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]


def plain_idf(rows):
    """Inverse document frequencies over the distinct texts of each language."""
    seen, total = Counter(), 0
    for lang, text in {(r.lang, r.text) for r in rows}:
        counts = plain_counts(text)
        if counts is not None:
            seen.update(counts.keys())
            total += 1
    idf = np.full(1 << 13, math.log(1.0 + total))
    for f, n in seen.items():
        idf[f] = math.log((1.0 + total) / (1.0 + n)) + 0.1
    return idf


@pytest.fixture(scope="module")
def learned(spark):
    docs = read(spark, SF_SMALL, "documents")
    rows = learning_rows(docs.select("doc_id", "text", "lang").collect())
    return language_id.train(docs.filter(~language_id.held_out("doc_id"))), rows


def test_frequencies_equal_the_plain_count(learned):
    """Under 400 rows a language, all of them are drawn, so the sample is the whole table."""
    model, rows = learned
    assert max(Counter(r.lang for r in rows).values()) < language_id.SAMPLE
    assert np.allclose(model.idf, plain_idf(rows), atol=1e-5)


def test_centroids_are_unit_vectors_of_their_language(learned):
    """Every language has its centroids, of length one, and each is nearest to texts of its own language."""
    model, rows = learned
    assert model.languages == sorted({r.lang for r in rows})
    assert set(model.owner.tolist()) == set(range(len(model.languages)))
    assert max(Counter(model.owner.tolist()).values()) <= language_id.CENTROIDS
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    idf = plain_idf(rows)
    vectors = [(r.lang, plain_vector(c, idf)) for r in rows if (c := plain_counts(r.text)) is not None]
    for owner, row in zip(model.owner, model.centroids, strict=True):
        lang, _ = max(vectors, key=lambda v: sum(w * float(row[f]) for f, w in v[1].items()))
        assert lang == model.languages[owner]


def test_query_equals_the_plain_version(spark, learned):
    model, rows = learned
    idf = plain_idf(rows)
    texts = {r.doc_id: r.text for r in read(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    found = language_id.op3_language_id(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        lang, score, rejected = plain_predict(texts[r.doc_id], model, idf)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred, r.rejected) == (lang, rejected)
        assert r.score == pytest.approx(score, abs=1e-4)


def test_awkward_texts_equal_the_plain_version(spark, learned):
    model, rows = learned
    idf = plain_idf(rows)
    extra = ["\U0001f600 \U0001f601", "ÄÖÜ ß", "x", "..a..", "漢字かな", "İstanbul", "1234 5678", "퟿ z"]
    texts = [r[1] for r in edge.rows()] + extra
    found = language_id.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for r in found:
        lang, score, rejected = plain_predict(r.text, model, idf)
        assert (r.lang_pred, r.rejected) == (lang, rejected), r.text
        assert r.score == pytest.approx(score, abs=1e-4)
