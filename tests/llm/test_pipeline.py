"""The whole pipeline against plain versions of its stages; of the code under test only the learned centroids are used."""

from __future__ import annotations

import public_tokenizers
import sentencepiece

import corpus_pipeline
from stockroom.llm import language_id
from stockroom.llm.common import read
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_language_plain import learning_rows, plain_idf, plain_predict
from tests.llm.test_secret_battery import plain_limits, plain_redaction
from tests.llm.test_simhash import plain_fingerprint, union


def test_stage_list():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_against_brute_force(spark):
    docs = read(spark, SF_SMALL, "documents")
    model = language_id.train(docs.filter(~language_id.held_out("doc_id")))
    rows = docs.collect()
    idf = plain_idf(learning_rows(rows))
    kept = [(r.doc_id, r.text) for r in rows if not plain_predict(r.text, model, idf)[2]]
    assert len(kept) > 0.95 * docs.count()

    prints = {i: plain_fingerprint(t) for i, t in kept}
    values = sorted(set(prints.values()))
    close = [(a, b) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 4]
    root = union(values, close)
    first = {}
    for i, f in prints.items():
        first[root[f]] = min(first.get(root[f], i), i)
    kept = [(i, t) for i, t in kept if first[root[prints[i]]] == i]

    items = [(r.item_id, r.text) for r in read(spark, SF_SMALL, "benchmark").collect()]
    dirty = {row[0] for row in hits(kept, items) if row[2]}
    kept = [(i, t) for i, t in kept if i not in dirty]
    assert dirty

    limits = plain_limits([t for _, t in kept])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {i: library.encode(plain_redaction(text, limits)) for i, text in kept}
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == expected
    assert len(rows) == len(expected) and all(r.round_trip for r in rows)


def test_stages_keep_the_columns(spark):
    docs = read(spark, SF_SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == docs.columns
