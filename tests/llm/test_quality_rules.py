"""Operator 9: base counts against brute force, divergence rules on planted junk."""

from __future__ import annotations

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stockroom.llm import quality_rules as q
from tests.llm import edge


def base(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for k in range(len(ws) - 4):
        at.setdefault(tuple(ws[k : k + 5]), []).append(k)
    covered = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def test_base_counts(spark):
    odd = ["x y z w v x y z w v q", "# a | b & c\n# a | b & c\n\n \nend", "a a a a a a a a a a a a"]
    docs = edge.documents(spark, [(200 + i, t, *[None] * 7) for i, t in enumerate(odd)])
    texts = sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=str)
    got = [
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in q.score(docs).collect()
    ]
    assert sorted(got, key=str) == texts


def test_divergence_of_junk(spark):
    good = [(i, edge.prose(i, 150).capitalize() + ".", "en", *[None] * 6) for i in range(60)]
    shouting = (900, edge.prose(70, 150).upper(), "en", *[None] * 6)
    symbols = (901, " ".join(w + "###" for w in edge.prose(71, 150).split()), "en", *[None] * 6)
    unknown = (902, edge.prose(72, 150), None, *[None] * 6)
    docs = spark.createDataFrame([*good, shouting, symbols, unknown], edge.SCHEMA)
    kept = {r.doc_id: r.kept for r in q.score(docs).collect()}
    assert not kept[900] and not kept[901]
    assert kept[902] and all(kept[i] for i in range(60))


def test_js_distance(spark):
    frame = spark.createDataFrame([([1e9, 1e9, 0.0], [1.0, 1.0, 2.0]), ([0.0], [1.0])], "p array<double>, q array<double>")
    got = [r[0] for r in frame.select(q.js_distance(F.col("p"), F.col("q"))).collect()]
    p, r = (0.5, 0.5, 0.0), (0.25, 0.25, 0.5)
    m = [(a + b) / 2 for a, b in zip(p, r, strict=True)]
    js = sum(a * math.log2(a / x) for a, x in zip(p, m, strict=True) if a) / 2
    js += sum(b * math.log2(b / x) for b, x in zip(r, m, strict=True) if b) / 2
    assert abs(got[0] - math.sqrt(js)) < 1e-6 and got[1] == 1.0


def test_empty_and_without_references(spark):
    assert q.score(edge.empty(spark)).count() == 0
    few = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", None, *[None] * 6)], edge.SCHEMA)
    assert [r.kept for r in q.score(few).collect()] == [True]


def test_plan_is_native(spark):
    plan = q.score(edge.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def flat_vocabulary(lang: str, seed: int, n_docs: int = 500) -> list[tuple]:
    """Documents of one language: 60,000 words of nearly equal counts, 16 of them a little commoner."""
    rng = random.Random(seed)
    pool = [f"{lang}{i:05d}" for i in range(60_000)]
    body = pool * 2 + pool[:16] * 2
    rng.shuffle(body)
    size = -(-len(body) // n_docs)
    return [(seed * 10_000 + i, " ".join(body[i * size : (i + 1) * size]), lang) for i in range(n_docs)]


@pytest.mark.parametrize("partitions", [1, 32])
def test_common_words_of_a_flat_vocabulary_are_exact(spark, tmp_path, partitions):
    rows = flat_vocabulary("xx", 1) + flat_vocabulary("yy", 2) + [(1, "few words only", "zz"), (2, None, "xx"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(partitions)
    refs = {r.lang: r for r in q.references(docs).collect()}
    assert set(refs) == {"xx", "yy"}
    for lang, ref in refs.items():
        assert list(ref.common) == [f"{lang}{i:05d}" for i in range(16)]
        assert list(ref.ref_words) == [4.0] * 16 + [120_000.0 - 32]
    if partitions == 32:
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = con.execute(q.ORACLE).fetchall()
        got = [tuple(r) for r in q.op9_quality_rules(spark, str(tmp_path)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected))
        assert all(r[-1] is not None for r in got if r[1] >= q.MIN_DIVERGENCE_WORDS)  # every long text is judged


def test_whole_text_work_is_done_once(spark):
    """One regex pass strips letters and spaces, words are split once, common words are looked up as hashes."""
    plan = q.score(edge.documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan  # a string comparison of every word with every common word
    assert plan.count("split(") == 2  # words, and lines
    assert plan.count("regexp_replace(coalesce") <= 1 and plan.count("regexp_replace(text") == 1


def test_filtered_results_of_long_texts(spark):
    """A filter that the optimizer pushes down to the texts must not work them again for every word."""
    long = " ".join(f"w{i % 9000}" for i in range(18_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, "a b c d e f g h i j k", "en")], "doc_id bigint, text string, lang string")
    scored = q.score(docs)
    assert [(r.doc_id, r.n_words, r.n_repeat_words) for r in scored.filter("n_repeat_words > 0").collect()] == [(1, 18_000, 18_000)]
    assert [r.doc_id for r in scored.filter("kept").collect()] == [2]


def test_classes_with_odd_spaces_and_letters(spark):
    texts = ["Ab1\t\x0b\x0c\r\n é漢\U0001f600 .,;'-#<|~`\x1c\xa0 z", "", "   ", "#*$%&|<>@", "aZ9"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    got = [list(r[0]) for r in frame.select(q.char_classes(text, q._strip(text, q.LOWER_OR_SPACE))).collect()]
    named = ["[a-z\x20\x09-\x0D]", r"[^\x00-\x7F]", "[.,;:!?'\"()-]", "[A-Z]", "[0-9]"]
    for t, counts in zip(texts, got, strict=True):
        expected = [len(re.findall(c, t)) for c in named]
        assert counts == [*expected, len(t) - sum(expected)]
