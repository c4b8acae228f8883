"""The whole pipeline on awkward and on empty tables."""

from __future__ import annotations

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm import edge

BENCHMARK = "item_id string, text string"


def run(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns: one row per group, no letterless text."""
    leak = " ".join(f"benchmark{i}" for i in range(10))
    more = [(700 + i, edge.prose(i + 50), "en", *[None] * 6) for i in range(30)]
    extra = [*more, more[0], (800, f"{edge.prose(90)} {leak} {edge.prose(91)}", "en", *[None] * 6)]
    docs = edge.documents(spark, extra)
    rows = run(spark, tmp_path, docs, [("a", leak), ("b", None), (None, ""), ("a", leak)])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {tuple(library.encode(t)) for t in {r.text for r in docs.collect()} if t and any(c.isalpha() for c in t)}
    got = [tuple(r.ids) for r in rows]
    assert len(got) == len(set(got)) and set(got) <= texts
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    ids = [r.doc_id for r in rows]
    assert 800 not in ids and {700 + i for i in range(30)} <= set(ids)
    assert tuple(library.encode(edge.prose(3))) in got and None in ids  # a null id is no reason to drop a text


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, edge.empty(spark), []) == []
