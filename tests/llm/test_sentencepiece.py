"""Operator 2 against the library, and its Viterbi fold against all paths."""

from __future__ import annotations

import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from stockroom.llm import sentencepiece_lattice as s
from tests.llm import edge

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "Hello  world", "  lead", "trail  ", "a▁b ▁", "tab\tand\r\nline\n\n end", "x" * 200, "https://a.com/b?c=1&d=2 (e) don't",
    "漢字かな交じり文 한국어 عربى", "\U0001f600 \x00\x01", "A.B,c;d 1,234.5e-6 ...", "ñandú é é ﬁ", "aaaaaaa bbbbbbbb " * 5, " ",
]


def test_ids_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = edge.documents(spark, [(600 + i, t, *[None] * 7) for i, t in enumerate(ODD)])
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    rows = s.encode_and_check(docs, MODEL).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert list(r.ids) == library.encode(texts[r.doc_id]), texts[r.doc_id][:60]
        assert r.round_trip and r.n_pieces == len(r.ids)
    assert s.encode_and_check(edge.empty(spark), MODEL).count() == 0


def test_round_trip_decodes_the_assembled_document(spark, monkeypatch):
    """A unit pattern that loses a symbol of some documents: every unit decodes, the documents do not."""
    texts = ["one two, three", "one ~two, three", "plain  words", "plain ~ words", "", None, "~"]
    whole = s.Pieces.unit_pattern

    class Lossy:  # finds the units, but leaves out the symbol
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            return [u for x in self.pattern.findall(text) for u in x.split("~") if u]

    monkeypatch.setattr(s.Pieces, "unit_pattern", lambda self: Lossy(whole(self)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.round_trip for r in s.encode_and_check(docs, MODEL).collect()}
    assert got == {i: "~" not in (t or "") for i, t in enumerate(texts)}


def test_decoding_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = s.Pieces.load(MODEL)
    ids = [library.encode(t) for t in ODD] + [[]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, ids array<int>")
    got = {r.i: r.t for r in frame.select("i", s.decode(F.col("ids"), pieces.bytes_of).alias("t")).collect()}
    assert [got[i] for i in range(len(ids))] == [library.decode(x) for x in ids]


def test_heap_merges_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = s.Pieces.load(MODEL)
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("abcdeiounstrlé▁") for _ in range(rng.randint(1, 40)))
        assert s.merge_exactly(s.escape(word), pieces) == library.encode(word)


def best_path(unit, scores, ids):
    best = [(0.0, [])] + [None] * len(unit)
    for end in range(1, len(unit) + 1):
        options = [
            (best[a][0] + scores[unit[a:end]], best[a][1] + [ids[unit[a:end]]])
            for a in range(end)
            if best[a] is not None and unit[a:end] in scores
        ]
        best[end] = max(options) if options else None
    return best[-1][1] if best[-1] else None


def test_viterbi_fold(spark):
    rng = random.Random(2)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa", "bca"]
    scores = {n: -float(rng.randint(1, 40)) / 4 for n in names}
    ids = {n: i for i, n in enumerate(names)}
    pieces = s.Pieces(ids, scores, [n.encode() for n in names], [0] * 256, 3, False)
    units = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(60)} | {"xb", "abx"})
    frame = spark.createDataFrame([(u, True, [0]) for u in units], "unit string, simple boolean, groups array<int>")
    got = {r.unit: r.ids for r in s.encode_units(frame, pieces, "unigram").collect()}
    for u in units:
        expected = best_path(u, scores, ids)
        assert got.get(u) == expected or expected is None


def test_ids_of_any_type_and_many_groups(spark):
    """Text ids, a third of all rows one text, input over many partitions: the library's ids, no unbounded row."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [edge.prose(i % 40, 60) + f" w{i}, don't" for i in range(120)] + [ODD[0]] * 60 + [edge.LONG]
    docs = spark.createDataFrame([(f"id-{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(40)
    found = s.encode_and_check(docs, MODEL)
    assert dict(found.dtypes)["doc_id"] == "string"
    got = {r.doc_id: (list(r.ids), r.round_trip) for r in found.collect()}
    assert got == {f"id-{i}": (library.encode(t), True) for i, t in enumerate(texts)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan


def test_units_are_gathered_once_and_joined_where_they_are(spark):
    docs = spark.createDataFrame([(i, edge.prose(i, 40)) for i in range(60)], "doc_id bigint, text string").repartition(9)
    found = s.encode(docs, s.Pieces.load(MODEL))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow gather") == 1 and plan.count("ReusedExchange") == 1
    assert plan.count("+- Exchange hashpartitioning(unit") == 1


def test_documents_are_written_from_the_folded_units(spark, monkeypatch, tmp_path):
    """Ordinary words come from the lattice of their own group: the heap is never asked."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def refuse(unit, pieces):
        raise AssertionError(f"{unit!r} was not folded")

    monkeypatch.setattr(s, "merge_exactly", refuse)
    rows = [(i, edge.prose(i, 50) + ", and more.") for i in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20).write.parquet(str(tmp_path / "docs"))
    found = s.encode_and_check(spark.read.parquet(str(tmp_path / "docs")), MODEL).collect()
    assert {r.doc_id: list(r.ids) for r in found} == {i: library.encode(t) for i, t in rows}
    assert all(r.round_trip for r in found)
