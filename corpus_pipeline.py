"""Corpus pipeline: quality, near-duplicates, secrets, mixing, SentencePiece. Each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
further columns of docs are left out. In every stage null texts count as empty, repeated rows (of one id and text) have
the same fate, a null doc_id is kept as it is, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.llm import mixing, pieces, quality, secrets, simhash
from axisloom.llm.common import fresh_path, table
from axisloom.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3
#: Shares of tokens by language that the mixture is to have.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is LEAST_QUALITY or more; the model learns as op8 does, held-out labels unseen.

    Texts without words have the score of the labels' shares alone.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn_from=~quality.held_out())
    return quality.scores(docs.select(*COLUMNS), model, *COLUMNS[2:], memory=50_000).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that with the smallest id, rows without an id last; of equal rows one.

    Texts whose sets of five-word shingles are alike by 0.8 or more are linked (simhash.classes). Texts without words are
    one class.
    """
    return simhash.deduplicated(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with <SECRET> in place of secrets and n_chars as it is then."""
    clean = secrets.scan(docs, texts=True, more=("lang", "source"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, so that expected tokens by language are in the shares of TARGETS.

    The classifier learns a document's language from those that the labels table covers.
    """
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    return mixing.mixed(docs.select(*COLUMNS), labelled, TARGETS, least=1.0)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    Blocks are a third of the operator's usual size, as workers have run the stages before.
    """
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), digests=True, chars_per_block=2_000_000, chars_per_part=4_000_000)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", piece_stage),
]
#: No stage can be written in SQL as a whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
