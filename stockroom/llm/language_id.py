"""Operator 3: language identification by nearest TF-IDF centroids.

A text is lower-cased, everything but letters becomes one separator, and its character
1-, 2- and 3-grams are counted in ``DIMS`` hashed features.  The vector is
(1 + log tf) * idf, scaled to length one.  Each language has up to ``CENTROIDS`` centroids
(spherical k-means over its training vectors); a text takes the language of the centroid
of highest cosine.  It is rejected when that cosine is below the limit for its length:
a low quantile of what training pieces of that length reach, times a margin.

Training reads a bounded sample: about ``SAMPLE`` labelled rows per language, chosen by a
hash of the text, from rows that the caller marks as usable.  The features of the sample
are made in tasks, document frequencies are summed by Spark, and each language is
clustered in its own task of at most about ``SAMPLE`` rows; only centroids and limits
(languages x CENTROIDS rows) reach the driver.

Defined results: a null text or one without letters is ``und`` with score 0; with no
training rows every text is ``und``; ties go to the first language in alphabetical order;
repeated rows each get the same row; extra columns are ignored (report) or kept (filter).
Very long texts are counted in slices of bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import checkpointed, only, read
from stockroom.plans.joins import broadcast_if_small

DIMS = 1 << 13
CENTROIDS = 3
SAMPLE = 400
PIECE_CHARS = (12, 25, 50, 100, 200)  # lengths of the training pieces that set the limits
QUANTILE = 0.01
MARGIN = 0.6
SLICE = 1 << 20
UNKNOWN = "und"

_LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of anything but letters is one zero."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kept = np.where(_LETTERS[codes], codes, 0).astype(np.uint64)
    return kept[(kept != 0) | np.concatenate(([True], kept[:-1] != 0))]


def _gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed 1-, 2- and 3-gram counts, or None for a text without letters."""
    counts = np.zeros(DIMS, dtype=np.float32)
    tail = np.zeros(1, dtype=np.uint64)  # two symbols carried over, so that slices lose no gram
    any_letter = False
    for at in range(0, len(text or ""), SLICE):
        fresh = _letters(text[at : at + SLICE])
        any_letter = any_letter or bool(fresh.any())
        symbols = np.concatenate((tail, fresh))
        if at + SLICE >= len(text):
            symbols = np.concatenate((symbols, np.zeros(1, dtype=np.uint64)))
        old = len(tail)
        code, grams = symbols, []
        for n in (1, 2, 3):
            if n > 1:
                code = code[:-1] * np.uint64(0x1FFFFF) + symbols[n - 1 :]
            new = code[max(0, old - n + 1) :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            grams.append((new ^ (new >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 13))
        counts += np.bincount(np.concatenate(grams).astype(np.int64), minlength=DIMS)
        tail = symbols[-2:]
    return counts if any_letter else None


def _pieces(text: str) -> list[str]:
    """Pieces of the training lengths, one of each, spread over the text."""
    return [text[(len(text) * k) // 8 :][:n] for k, n in enumerate(PIECE_CHARS) if len(text) >= 2 * n]


@dataclass
class Model:
    """Languages and unit centroids (row i belongs to ``owner[i]``), idf, and limits per letters."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    limit_grams: np.ndarray
    limits: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * self.idf
        norm = np.linalg.norm(weighted)
        return weighted / norm if norm else weighted

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        counts = _gram_counts(text)
        if counts is None or not len(self.owner):
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vector(counts)
        best = int(np.argmax(cosines))
        score = float(min(max(cosines[best], 0.0), 1.0))
        limit = np.interp(np.log(counts.sum()), self.limit_grams, self.limits) if len(self.limits) else 0.0
        return self.languages[self.owner[best]], score, bool(score < limit)


def _k_means(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the start rows are the first row and then the farthest from those chosen."""
    chosen = [0]
    while len(chosen) < min(k, len(vectors)):
        nearest = (vectors @ vectors[chosen].T).max(axis=1)
        chosen.append(int(np.argmin(nearest)))
    centroids = vectors[chosen].copy()
    for _ in range(rounds):
        owner = np.argmax(vectors @ centroids.T, axis=1)
        for i in range(len(centroids)):
            mean = vectors[owner == i].sum(axis=0)
            if np.linalg.norm(mean):
                centroids[i] = mean / np.linalg.norm(mean)
    return centroids


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit on about ``sample`` rows per language of ``labelled`` (text, lang)."""
    usable = only(labelled, "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.join(broadcast_if_small(sizes), "lang").filter(draw * F.col("n") < sample)
    drawn = drawn.select("lang", "text").dropDuplicates()  # copies are drawn together and count once

    def features(batches):
        for batch in batches:
            rows = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for piece, part in enumerate([text, *_pieces(text)]):
                    counts = _gram_counts(part)
                    if counts is not None:
                        at = np.flatnonzero(counts)
                        rows.append((lang, piece, at.tolist(), counts[at].tolist()))
            yield pd.DataFrame(rows, columns=["lang", "piece", "at", "tf"])

    rows = checkpointed(drawn.mapInPandas(features, "lang string, piece int, at array<int>, tf array<float>"))
    whole = rows.filter("piece = 0")
    total = whole.count()
    seen = whole.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).collect()
    idf = np.full(DIMS, np.log(1.0 + total))
    for r in seen:  # at most DIMS rows
        idf[r["at"]] = np.log((1.0 + total) / (1.0 + r["df"])) + 0.1
    blank = Model([], np.zeros(0, int), np.zeros((0, DIMS)), idf.astype(np.float32), np.zeros(0), np.zeros(0))

    def dense(frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), DIMS), dtype=np.float32)
        for i, (at, tf) in enumerate(zip(frame["at"], frame["tf"], strict=True)):
            out[i, np.asarray(at, dtype=int)] = np.asarray(tf, dtype=np.float32)
            out[i] = blank.vector(out[i])
        return out

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key").reset_index(drop=True)
        main, parts = frame[frame.piece == 0], frame[frame.piece > 0]
        found = _k_means(dense(main), centroids)
        log_grams = np.log([sum(tf) for tf in parts["tf"]] or [1.0])
        scores = (dense(parts) @ found.T).max(axis=1) if len(parts) else np.ones(1)
        out = [(frame.lang[0], 0, c.astype(float).tolist()) for c in found]
        for n in sorted(set(parts["piece"])):
            held = (parts["piece"] == n).to_numpy()
            out.append((frame.lang[0], int(n), [float(log_grams[held].mean()), float(np.quantile(scores[held], QUANTILE))]))
        return pd.DataFrame(out, columns=["lang", "piece", "values"])

    keyed = rows.withColumn("key", F.xxhash64("at", "tf"))
    learned = keyed.groupBy("lang").applyInPandas(cluster, "lang string, piece int, values array<double>").collect()
    if not learned:
        return blank
    languages = sorted({r["lang"] for r in learned})
    tops = sorted((r for r in learned if r["piece"] == 0), key=lambda r: languages.index(r["lang"]))
    at_length = {}
    for r in learned:
        if r["piece"]:
            at_length.setdefault(r["piece"], []).append(r["values"])
    steps = sorted((np.mean([v[0] for v in vs]), min(v[1] for v in vs) * MARGIN) for vs in at_length.values())
    if steps:  # below the shortest training piece nothing is rejected
        steps = [(steps[0][0] - 1e-6, 0.0), *steps]
    return Model(
        languages,
        np.array([languages.index(r["lang"]) for r in tops]),
        np.array([r["values"] for r in tops], dtype=np.float32),
        idf.astype(np.float32),
        np.array([s[0] for s in steps]),
        np.array([s[1] for s in steps]),
    )


def _found(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the struct column ``_sr_language``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids and limits: bounded by the languages

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("_sr_language", predict(F.col("text")))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (without columns of these names) with lang_pred, score and rejected."""
    names = ("lang_pred", "score", "rejected")
    return _found(docs, model).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col(f"_sr_language.{c}") for c in names]
    )


def held_out(doc_id: str) -> Column:
    """True for rows kept out of training: crc32 of the id's text is divisible by five (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def known_languages(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their columns (rejected ones go)."""
    model = train(docs.filter(~held_out("doc_id")))
    return _found(docs, model).filter(~F.col("_sr_language.rejected")).drop("_sr_language")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`identify` over the whole documents table."""
    docs = only(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = train(docs.filter(~held_out("doc_id")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
