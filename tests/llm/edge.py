"""Shared awkward inputs: nulls in any column, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, fp string, ws string, n int"

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(12_000))


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    common = "the of and to in is that for it with".split()
    made = ["".join(rng.choice(["tion", "er", "an", "re", "on", "st", "le", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(made) for _ in range(n))


def rows() -> list[tuple]:
    texts = [None, "", "   \n\t ", "a", "A b c", prose(1), prose(1), prose(2), LONG, "é ü 漢字 \u0000 \U0001f600 end", "same line\n" * 30]
    out = [(i, t, "en" if i % 3 else None, "s", len(t) if t else None, "x", "y", "z", 1) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, prose(3), "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


def documents(spark, extra: list[tuple] = ()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
