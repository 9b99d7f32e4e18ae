"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.01"
CLASHES = "fp long, row long, text_hash long, digest string, score double, copies int, ids string, base string, block int, held_out string, `range` int, n_tokens int"
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "The QUICK brown fox jumps over the lazy dog"),
    (2, "The QUICK brown fox jumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, "a row without an id, mail me at x@y.org"),
    (7, "word " * 50_000),
    (8, "x" * 30_000),
    (9, "é ñ 中 😀 ▁  İ Σ <|endoftext|> <s> it's 42"),
    (10, "token = 'abcdef123456' AKIA" + "Q7" * 9 + " card 4111 1111 1111 1111, ip 1.2.3.4 +1 (212) 555-0100"),
]


def awkward(spark):
    rows = [(*r, 1, 2, 3, "d", 0.5, 9, "i", "b", 4, "h", 5, 6) for r in AWKWARD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(spark, n: int | None = None):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.where(f"doc_id < {n}") if n else docs


def invented(seed: int, n: int, alphabet: list[str], longest: int = 25) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def texts(df) -> list[str]:
    return [r["text"] or "" for r in df.collect()]
