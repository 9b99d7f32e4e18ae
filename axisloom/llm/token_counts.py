"""Token counts behind a digest cache: normalised content and tokenizer version are looked up, only distinct misses encoded.

The cache is a table (tokenizer string, digest binary, n_tokens long) of Parquet files. A run digests every text and
anti-joins the bare digests to the cache; only texts of digests that are left move, one for each, and are encoded. Their
counts are appended, and counts are joined back to rows by digest.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from itertools import chain

import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisloom.llm.common import fresh_path, saved, slices, text_docs

CACHE = "tokenizer string, digest binary, n_tokens long"
#: Characters for which lower-casing, composition and classes are the same everywhere; other texts go to the library whole.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ſ‐-‧€]*")


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return f"{os.path.basename(path)}:{hashlib.sha256(f.read()).hexdigest()[:16]}"


class WordCounter:
    """Token counts of whole texts, exactly as the library's encode gives them, with a memory of pieces.

    A tokenizer whose Split step cuts texts into pieces, each encoded alone, gives a text the sum of its pieces' counts.
    That holds for plain characters and texts without special strings; any other text is encoded whole. The memory of
    pieces is emptied when it has `memory` entries, so it stays bounded.
    """

    def __init__(self, path: str, memory: int = 400_000):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        names = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers") or []]
        split = steps[0] if steps and steps[0].get("type") == "Split" else None
        by_pieces = split and split.get("invert") and split.get("behavior") == "Removed" and names == ["NFC", "Replace", "Lowercase"] and not spec.get("post_processor")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall if by_pieces else None
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.known: dict[str, int] = {}
        self.memory = memory

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for i in range(0, len(texts), 256) for e in self.library.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces is None:
            return self.encoded(texts)
        plain = [PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        cut = [self.pieces(t.lower()) if p else None for t, p in zip(texts, plain, strict=True)]
        new = list(set(chain.from_iterable(c for c in cut if c)).difference(self.known))
        if len(self.known) + len(new) > self.memory:
            self.known.clear()
            new = list(set(chain.from_iterable(c for c in cut if c)))
        self.known.update(zip(new, self.encoded(new), strict=True))
        whole = deque(self.encoded([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [sum(map(self.known.__getitem__, c)) if c is not None else whole.popleft() for c in cut]


def folds_spaces(path: str) -> bool:
    """Whether the tokenizer's own normaliser makes one space of every white-space run, as its file says."""
    import json

    with open(path, encoding="utf-8") as f:
        steps = (json.load(f).get("normalizer") or {}).get("normalizers") or []
    return any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)


def normalised(text):
    """What the digest covers where the tokenizer folds white space: a space for every run of these four."""
    return F.regexp_replace(text, "[ \\n\\t\\r]+", " ")


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none if there are no files yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def misses(digested: DataFrame, missing: DataFrame, most_bytes: int = 64_000_000) -> DataFrame:
    """(digest, text): one text of each missing digest.

    digested: (doc_id, text, digest). Of texts with one digest, one leaves each task. The digests (160 bytes each) are broadcast, so that
    no other text moves, where they take up most_bytes at most; more of them meet the texts where these are shuffled to.
    """
    n = missing.count()
    if not n:
        return digested.select("digest", "text").where("false")
    one = Window.partitionBy("digest").orderBy("doc_id")
    first = lambda df: df.withColumn("rank", F.row_number().over(one)).where("rank = 1").select("digest", "text")
    if n * 160 <= most_bytes:
        return first(digested.join(F.broadcast(missing), "digest", "left_semi"))
    return first(digested).join(missing, "digest", "left_semi")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs, and new counts appended to the cache.

    tokenizer: path of a `tokenizers` .json file, the same on all workers. cache: path of the cache in storage that all
    workers share; by default the one named in the session's axisloom.token.cache, or else a new one for this call. Where
    the tokenizer folds white space, its amount is left out of the digest. Null texts count as empty (no bytes, no
    tokens); repeated rows are encoded once and give a row each; a null doc_id stays null; an empty table gives no rows
    and an empty append; columns other than doc_id and text are ignored. Two runs that append the same digest at once
    leave two equal rows; reads take one.
    """
    spark = docs.sparkSession
    cache = cache or spark.conf.get("axisloom.token.cache", None) or fresh_path(spark, "token-cache")
    version = tokenizer_version(tokenizer)
    content = normalised(F.col("text")) if folds_spaces(tokenizer) else F.col("text")
    digested = text_docs(docs).withColumn("digest", F.unhex(F.sha2(F.concat(F.lit(version), F.lit("\n"), content), 256)))

    def encode(batches):
        counter = WordCounter(tokenizer)
        for b in batches:
            digests = b.column("digest")
            for at, texts in slices(b, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts), pa.string()), digests.slice(at, len(texts)), pa.array(counter.counts(texts), pa.int64())], ["tokenizer", "digest", "n_tokens"])

    # Stored: rows without their texts are read twice more.
    rows = saved(digested.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    known = cached(spark, cache).where(F.col("tokenizer") == version).select("digest")
    missing = saved(rows.select("digest").distinct().join(known, "digest", "left_anti"))
    misses(digested, missing).mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Both sides of the join are plain shuffles, which Spark splits where copies make a digest hot.
    return rows.join(saved(counts), "digest").select("doc_id", "n_bytes", "n_tokens")
