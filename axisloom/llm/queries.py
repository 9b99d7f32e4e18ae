"""Registered queries of the text operators: each applies its operator to the whole table and returns the whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.llm import hard_negatives, language_id, language_model, mixing, neighbours, pieces, private_data, quality, secrets, simhash, token_counts, whitening, winnowing
from axisloom.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two or fewer differing bits; see simhash.near_groups for edge cases."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns and runs that the models of made samples find random; see secrets.scan for edge cases."""
    return secrets.scan(table(spark, sf_dir, "documents"))


#: Shares of tokens by language for op3.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages are the domains: `source` says nothing of a text here, and a language is what the texts show.

    See mixing.soft_mix for edge cases.
    """
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    domains, rows = mixing.soft_mix(docs, labelled, TARGETS)
    return rows.select("doc_id", "tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", "copies")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vec_id among all rows; see neighbours.nearest for edge cases."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), modulus=20, k=20)


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns and revealing terms, generalised or removed; see private_data.spans for edge cases."""
    return private_data.digest(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether there are more than 2048; see token_counts.token_counts for edge cases."""
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and decoded text; see pieces.encode for edge cases."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), digests=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of quality 1, learned from rows that are not held out; see quality.train and quality.scores for edge cases."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn_from=~quality.held_out())
    scored = quality.scores(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores, learned from rows that are not held out; see language_model.score for edge cases."""
    return language_model.score(table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 8-grams in windows of 5, of every text and its edited text; see winnowing.edited_fingerprints for edge cases."""
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"), k=8, window=5, share=4)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from rows that are not held out; see language_id.train and language_id.predict for edge cases."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs, learn_from=~language_id.held_out()))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vec_id, every seventh row with the next label; see hard_negatives.mined for edge cases."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), modulus=50, label=label)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every row; see whitening.whitened for edge cases."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=8)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_duplicates, op2_secret_scan, op3_soft_mixing, op4_nearest_neighbours, op5_private_data,
        op6_token_counts, op7_sentencepiece, op8_quality, op9_language_model, op10_winnowing,
        op11_language_id, op12_hard_negatives, op13_whitening,
    )
}
#: The others cannot be written in SQL as a whole; their tests hold them against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
            FROM (SELECT * FROM r WHERE vec_id % 50 = 0) a JOIN r ON a.vec_id <> r.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
               s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
    """,
}
