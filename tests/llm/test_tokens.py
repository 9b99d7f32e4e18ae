import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from axisloom.llm import pieces, token_counts
from tests.llm.helpers import AWKWARD, awkward, documents, empty, invented

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "é", "ñ", "▁", "😀", "中", "<s>", "the", " of", "1", "\u0000", "ab", "   ", "’", "'s", "Σ", "İ", "<|endoftext|>", " ", "́", "!'", "ſ", "Ǆ", "\x85", "\x1c"]


def test_word_counter_equals_the_library():
    library, counter = Tokenizer.from_file(WORDS), token_counts.WordCounter(WORDS, memory=50)
    texts = invented(3, 3000, ALPHABET, 30)
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_are_encoded_whole(name):
    path = public_tokenizers.path(name)
    library, counter = Tokenizer.from_file(path), token_counts.WordCounter(path)
    texts = invented(4, 200, ALPHABET)
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_documents_and_of_a_cache_that_is_there(spark, tmp_path):
    docs, cache = documents(spark, 200), str(tmp_path / "cache")
    library = Tokenizer.from_file(WORDS)
    want = {r["doc_id"]: (len(r["text"].encode()), len(library.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect()}
    once = token_counts.token_counts(docs.where("doc_id < 100"), WORDS, cache)
    assert once.count() == 100
    held = spark.read.parquet(cache).count()
    got = token_counts.token_counts(docs, WORDS, cache)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got.collect()} == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() > held
    again = token_counts.token_counts(docs, WORDS, cache)
    assert again.count() == len(want)
    assert spark.read.parquet(cache).count() == stored.count()


def test_a_warm_cache_moves_no_text(spark, tmp_path):
    docs, cache = documents(spark, 200), str(tmp_path / "cache")
    token_counts.token_counts(docs, WORDS, cache).count()
    digested = token_counts.text_docs(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    few = digested.limit(3).select("digest").distinct()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    none, some = token_counts.misses(digested, few.where("false")), token_counts.misses(digested, few)
    assert none.count() == 0
    assert "Exchange" not in plan(none)
    assert some.count() == few.count()
    assert "BroadcastHashJoin" in plan(some)
    many = token_counts.misses(digested, few, most_bytes=0)
    assert {bytes(r["digest"]) for r in many.collect()} == {bytes(r["digest"]) for r in few.collect()}
    spark.conf.set("axisloom.token.cache", cache)
    held = spark.read.parquet(cache).count()
    assert token_counts.token_counts(docs, WORDS).count() == 200
    spark.conf.unset("axisloom.token.cache")
    assert spark.read.parquet(cache).count() == held


def test_white_space_is_folded_only_where_the_tokenizer_does():
    assert token_counts.folds_spaces(WORDS)
    assert not token_counts.folds_spaces(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_of_awkward_rows(spark):
    library = Tokenizer.from_file(WORDS)
    want = sorted((i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD)
    got = token_counts.token_counts(awkward(spark), WORDS).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(empty(spark), WORDS).count() == 0


def test_chunks_give_the_library_ids_and_text():
    sp, texts = SentencePieceProcessor(model_file=PIECES), invented(1, 3000, ALPHABET, 30)
    assert pieces.chunkable(sp)
    distinct = sorted({c for t in texts for c in pieces.chunks(t)})
    ids = dict(zip(distinct, pieces.segments(sp, distinct), strict=True))
    mid = dict(zip(distinct, pieces.inside(sp, list(ids.values())), strict=True))
    for t in texts:
        if pieces.MARK not in t:
            cut = pieces.chunks(t)
            assert [i for c in cut for i in ids[c]] == sp.encode(t)
            assert (sp.decode(ids[cut[0]]) + "".join(mid[c] for c in cut[1:]) if cut else "") == sp.decode(sp.encode(t))


def digests(sp, text):
    ids = sp.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize(("block", "part"), [(9000, 20_000), (6_000_000, 12_000_000)])
def test_encoding_and_decoding_documents(spark, block, part):
    sp, docs = SentencePieceProcessor(model_file=PIECES), documents(spark, 150)
    want = {r["doc_id"]: digests(sp, r["text"]) for r in docs.collect()}
    got = pieces.encode(docs, PIECES, digests=True, chars_per_block=block, chars_per_part=part).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_encoding_invented_texts(spark):
    sp, rows = SentencePieceProcessor(model_file=PIECES), list(enumerate(invented(8, 400, ALPHABET, 40)))
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, chars_per_block=1000, chars_per_part=800).collect()
    assert {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in got} == {i: (sp.encode(t), sp.decode(sp.encode(t))) for i, t in rows}


def test_a_block_whose_replies_are_for_other_requests_is_right_all_the_same(spark, monkeypatch):
    sp, docs = SentencePieceProcessor(model_file=PIECES), documents(spark, 60)
    want = {r["doc_id"]: digests(sp, r["text"]) for r in docs.collect()}
    real = pieces.chunk_table
    for other in (docs.orderBy("doc_id"), docs.repartition(3), docs.where("doc_id > 30")):
        monkeypatch.setattr(pieces, "chunk_table", lambda rows, *more, other=other: real(pieces.text_docs(other), *more))
        got = pieces.encode(docs, PIECES, digests=True, chars_per_block=20_000, chars_per_part=50_000).collect()
        assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_places_come_back():
    x = np.array([0, 5, 2**32 - 1, 7], np.uint32)
    assert pieces.from_places(pieces.places(x)).tolist() == x.tolist()
    assert pieces.from_places(pieces.places(x[:0])).tolist() == []


def test_a_model_with_crossing_pieces_is_left_to_the_library(spark, monkeypatch):
    monkeypatch.setattr(pieces, "chunkable", lambda sp: False)
    sp, docs = SentencePieceProcessor(model_file=PIECES), documents(spark, 30)
    want = {r["doc_id"]: digests(sp, r["text"]) for r in docs.collect()}
    got = pieces.encode(docs, PIECES, digests=True).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_encoding_awkward_rows(spark):
    sp = SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode(awkward(spark), PIECES).collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((i or 0, sp.encode(t or "")) for i, t in AWKWARD)
    assert all(r["decoded"] == sp.decode(list(r["ids"])) for r in got)
    assert pieces.encode(empty(spark), PIECES, digests=True).count() == 0
