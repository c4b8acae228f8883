"""Operator 6: token counts through a digest cache.

A text's content is normalised (runs of ASCII white space become one space, ends are
trimmed, null is empty) and named by its SHA-256; a tokenizer by the SHA-256 of its file.
Counts are stored as (version, digest, n_tokens) rows.  A call joins the texts' digests with
the stored counts, encodes each missing distinct content once, appends the new counts, and
joins every document with its count.

Inside a task a content is counted piece by piece between white space, with counts of
pieces remembered up to a bound.  That equals encoding the whole when the tokenizer drops
white space and joins nothing across it, which :func:`splits_at_spaces` checks from the
tokenizer's definition; other tokenizers encode the whole content, which is then not normalised.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row
and cost one encoding; an empty table gives no rows and an empty cache; extra columns are
ignored.  A lost executor repeats its tasks only: the append commits whole tasks.  If two
calls append the same digest, readers take one of the equal rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import only, read, worker_memory
from stockroom.plans.session import ensure_checkpoint_dir

SCHEMA = "version string, digest binary, n_tokens bigint"
LIMIT = 2048
PIECES_REMEMBERED = 800_000
TEXTS_AT_ONCE = 500
SPACES = r"[\x20\x09-\x0D]+"


def splits_at_spaces(definition: str) -> bool:
    """True when a tokenizer definition drops white space before its model sees any word."""
    spec = json.loads(definition)
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    removing = [
        s
        for s in steps
        if s.get("type") == "Split"
        and s.get("behavior") == "Removed"
        and s.get("invert")  # only what matches the pattern is kept, and its last branch takes no white space
        and str(s["pattern"].get("Regex", "")).endswith(r"[^\s\p{L}\p{N}]+")
    ]
    joined = any(
        any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
        for t in spec.get("added_tokens", [])
    )
    return bool(removing) and not joined and not spec.get("post_processor")


def content(text: Column, normalise: bool) -> Column:
    filled = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(filled, SPACES, " ")) if normalise else filled


def _counter(definition: str, version: str, by_piece: bool):
    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core; Spark runs many tasks
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(texts):
            return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        known = worker_memory(f"pieces of {version}")  # a piece's count never changes: any task may use it

        def totals(texts):
            if not by_piece:
                return encode(texts)
            pieces = [t.encode("utf-8").split() for t in texts]  # ASCII white space only
            if len(known) > PIECES_REMEMBERED:
                known.clear()
            new = list(set().union(*pieces).difference(known))
            known.update(zip(new, encode([p.decode("utf-8") for p in new]), strict=True))
            return [sum(map(known.__getitem__, ps)) for ps in pieces]

        for batch in batches:
            texts = batch["content"].tolist()
            counts = [n for at in range(0, len(texts), TEXTS_AT_ONCE) for n in totals(texts[at : at + TEXTS_AT_ONCE])]
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": counts})

    return count


def count_tokens(docs: DataFrame, cache: str, tokenizer_file: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens.  ``cache`` is a shared folder of stored counts."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    version = hashlib.sha256(definition.encode("utf-8")).hexdigest()
    by_piece = splits_at_spaces(definition)

    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache)  # the folder exists from here on

    def stored() -> DataFrame:
        rows = spark.read.schema(SCHEMA).parquet(cache).filter(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    named = only(docs, "doc_id", "text").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        content(F.col("text"), by_piece).alias("content"),
    )
    named = named.withColumn("digest", F.unhex(F.sha2("content", 256)))
    distinct = named.select("digest", "content").dropDuplicates(["digest"])  # combined before the shuffle
    missing = distinct.join(stored(), "digest", "left_anti")
    counted = missing.mapInPandas(_counter(definition, version, by_piece), "digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return named.drop("content").join(stored(), "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`count_tokens` over the whole documents table, from an empty cache."""
    import public_tokenizers

    cache = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    found = count_tokens(read(spark, sf_dir, "documents"), cache, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
