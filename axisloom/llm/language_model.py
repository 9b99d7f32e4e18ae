"""Language-model scores from a log-frequency Bloom filter.

Bigram counts are quantised to floor(log2(count)); the filter holds, for each bigram, its hash with every level from 0 up
to its own. A probe asks level after level until one is missing, so a count comes back as its level (too high where the
filter errs, never too low), and a pair that was seen once (level 0) is told from one that was not (no level).
Probabilities are those of a Dirichlet prior: (c(u w) + strength * p(w)) / (c(u) + strength), p(w) the add-one share.

1. Texts are tokenised once, where they are read, into blocks of about `tokens_per_block` tokens: a table of word hashes.
2. Each block sends its distinct words and bigrams, with their counts in training texts, to the segments that own them.
3. Each segment builds its part of the filter, as large as its bigrams need, and sums the words exactly. The filter is a
   table of segments that grows with the corpus; it is not broadcast, as no bound on its size could be kept.
4. Blocks get the levels and counts of what they asked for, and score their texts.

A segment has a bounded number of tokens, whatever the corpus; a word or bigram that every block has adds one entry for
each block to its segment. Words are told apart by 64 bits of hash, bigrams of one segment by 32 bits, which for two
million of them errs more seldom than the filter by far.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm.common import fresh_path, slices, split_hash, text_docs, words

START, END = np.uint64(0x53746172745F5F31), np.uint64(0x456E645F5F5F5F31)
BITS_PER_ENTRY, PROBES = 12, 5
LOW = np.uint64(0xFFFFFFFF)


@dataclass
class Settings:
    #: How many tokens of evidence the add-one share of a word weighs against its context's bigrams.
    strength: float = 256.0
    tokens_per_block: int = 1_000_000
    tokens_per_segment: int = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment of a hash by its upper half, so that sorted hashes have sorted segments."""
    return (h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)


def pair_keys(h: np.ndarray, segments: int) -> np.ndarray:
    """Segment and the lower half of the hash, in one number."""
    return segment_of(h, segments) << np.uint64(32) | h & LOW


def planes(x: np.ndarray) -> bytes:
    """The bytes of sorted or small numbers by place, which a shuffle then compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(data, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def positions(key: np.ndarray, level: int, width: int) -> np.ndarray:
    """PROBES bit positions below width for each key at a level."""
    h = mixed(key.astype(np.uint64) + np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    step = h >> np.uint64(32) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & LOW) * np.uint64(width) >> np.uint64(32)


class Filter:
    """The bits of one segment."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.width = bits, 8 * len(bits)

    @staticmethod
    def of(keys: np.ndarray, level: np.ndarray) -> Filter:
        """A filter of distinct keys, each held at all levels up to its own, with BITS_PER_ENTRY for each of these."""
        width = -(-max(int((level + 1).sum()), 1) * BITS_PER_ENTRY // 64) * 64
        bits = np.zeros(width, bool)
        for k in range(int(level.max(initial=-1)) + 1):
            bits[positions(keys[level >= k], k, width)] = True
        return Filter(np.packbits(bits, bitorder="little"))

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        at = positions(keys, level, self.width)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which all are present, -1 if none is."""
        out = np.full(len(keys), -1, np.int8)
        for lo in range(0, len(keys), 500_000):
            level, left = 0, np.arange(lo, min(lo + 500_000, len(keys)))
            while len(left) and level < 64:
                left = left[self.has(keys[left], level)]
                out[left] = level
                level += 1
        return out


def counts_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level; 0 for level -1."""
    return np.where(level < 0, 0.0, (3.0 * 2.0 ** level.astype(np.float64) - 1) / 2)


def tokenised(rows: DataFrame, tokens_per_block: int) -> DataFrame:
    """Blocks of rows (doc_id, text, held_out), as they are read: the table that all later steps read.

    words: the sorted hashes of a block's distinct words; at: each token's place among them, text after text; size: the
    words of each text; n_texts and n_words: how many are in texts that are not held out. A block ends with the text
    that makes it reach tokens_per_block.
    """

    def block(number: int, held: list[tuple], known: dict[bytes, int]) -> pa.RecordBatch:
        ids, out, size = (list(chain.from_iterable(h[i] for h in held)) for i in range(3))
        h = np.fromiter(map(word_hash, known), np.uint64, len(known))
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(h), np.uint32)
        rank[order] = np.arange(len(h), dtype=np.uint32)
        places = rank[np.concatenate([x[3] for x in held])]
        learned = [n for n, o in zip(size, out, strict=True) if not o]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([out], pa.list_(pa.bool_())), pa.array([size], pa.list_(pa.int64())),
                pa.array([h[order].tobytes()], pa.binary()), pa.array([places.tobytes()], pa.binary()), pa.array([len(learned)], pa.int64()), pa.array([sum(learned)], pa.int64()),
            ],
            ["block", "doc_id", "held_out", "size", "words", "at", "n_texts", "n_words"],
        )

    def run(batches):
        number, tokens, held, known = 0, 0, [], {}
        for b in batches:
            for first, texts in slices(b, "text", 1_000_000):
                cut = list(map(words, texts))
                for w in set(chain.from_iterable(cut)).difference(known):
                    known[w] = len(known)
                size = list(map(len, cut))
                at = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.uint32, sum(size))
                held.append((b.column("doc_id").slice(first, len(texts)).to_pylist(), b.column("held_out").slice(first, len(texts)).to_pylist(), size, at))
                tokens += len(at) + len(texts)
                if tokens >= tokens_per_block:
                    yield block(number, held, known)
                    number, tokens, held, known = number + 1, 0, [], {}
        if held:
            yield block(number, held, known)

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "block long, doc_id array<long>, held_out array<boolean>, size array<long>, words binary, at binary, n_texts long, n_words long")


class Block:
    """One row of the tokenised table: its texts as places among words, an end after each."""

    def __init__(self, row: pa.Table | pa.RecordBatch, i: int, segments: int):
        self.words = np.frombuffer(row.column("words")[i].as_py(), np.uint64)
        self.size = np.array(row.column("size")[i].as_py(), np.int64)
        self.held = np.array(row.column("held_out")[i].as_py(), bool)
        at = np.frombuffer(row.column("at")[i].as_py(), np.uint32).astype(np.int64)
        #: After the words: END, then START.
        self.end = len(self.words)
        self.stop = np.cumsum(self.size + 1)
        self.now = np.full(len(at) + len(self.size), self.end)
        self.now[np.delete(np.arange(len(self.now)), self.stop - 1)] = at
        self.before = np.concatenate([[self.end + 1], self.now[:-1]])
        self.before[self.stop[:-1]] = self.end + 1
        h = np.concatenate([self.words, [END, START]])
        self.pairs = pair_keys(pair_hash(h[self.before], h[self.now]), segments)
        self.learned = np.repeat(~self.held, self.size + 1)
        self.word_segments = segment_of(self.words, segments)

    def requests(self, segments: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
        """(segment, words, counts, bigrams, counts) of every segment that owns any: sorted gaps, and counts in training texts.

        Only these segments are visited, so a block's work follows its words, not the number of segments.
        """
        n = np.bincount(self.now[self.learned], minlength=self.end + 1)[: self.end].astype(np.uint32)
        pairs, where = np.unique(self.pairs, return_inverse=True)
        m = np.bincount(where[self.learned], minlength=len(pairs)).astype(np.uint32)
        pair_segments = pairs >> np.uint64(32)
        asked = np.union1d(self.word_segments, pair_segments)
        ends = [np.searchsorted(own, asked, side).tolist() for own in (self.word_segments, pair_segments) for side in ("left", "right")]
        low = (pairs & LOW).astype(np.uint32)
        return [(i, planes(gaps(self.words[a:b])), planes(n[a:b]), planes(gaps(low[c:d])), planes(m[c:d])) for i, a, b, c, d in zip(asked.tolist(), *ends, strict=True)]


def requested(tokens: DataFrame, segments: int) -> DataFrame:
    """(segment, block, words, word_counts, pairs, pair_counts): what each block asks of each segment, and tells it."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                found = Block(b, i, segments).requests(segments)
                cols = [pa.array([x[j] for x in found], pa.binary()) for j in range(1, 5)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([b.column("block")[i].as_py()] * len(found), pa.int64()), *cols], ["segment", "block", "words", "word_counts", "pairs", "pair_counts"])

    return tokens.select("block", "held_out", "size", "words", "at").mapInArrow(run, "segment long, block long, words binary, word_counts binary, pairs binary, pair_counts binary")


def keys_of(column, kind) -> list[np.ndarray]:
    return [np.cumsum(from_planes(x.as_buffer(), kind), dtype=kind) for x in column]


def filters(asked: DataFrame) -> DataFrame:
    """(segment, bits binary): the filter of the training texts' bigrams."""

    def build(rows: pa.Table) -> pa.Table:
        keys = np.concatenate(keys_of(rows.column("pairs"), np.uint32))
        n = np.concatenate([from_planes(x.as_buffer(), np.uint32) for x in rows.column("pair_counts")])
        keys, n = keys[n > 0], n[n > 0].astype(np.float64)
        distinct, where = np.unique(keys, return_inverse=True)
        level = np.frexp(np.bincount(where, weights=n, minlength=len(distinct)))[1] - 1
        return pa.table({"segment": rows.column("segment").slice(0, 1), "bits": pa.array([Filter.of(distinct, level).bits.tobytes()], pa.binary())})

    return asked.groupBy("segment").applyInArrow(build, "segment long, bits binary")


def answered(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(block, segment, counts, levels, distinct): totals of the words and levels of the bigrams that a block asked for.

    counts and levels are in the order of the request; distinct: how many words of training texts the segment has, once
    for each segment.
    """

    def answer(asks: pa.Table, own: pa.Table) -> pa.Table:
        asked_words = keys_of(asks.column("words"), np.uint64)
        n = np.concatenate([from_planes(x.as_buffer(), np.uint32) for x in asks.column("word_counts")])
        distinct, where = np.unique(np.concatenate(asked_words), return_inverse=True)
        totals = np.bincount(where, weights=n, minlength=len(distinct)).astype(np.int64)
        asked_pairs = keys_of(asks.column("pairs"), np.uint32)
        level = Filter(np.frombuffer(own.column("bits")[0].as_buffer(), np.uint8)).levels(np.concatenate(asked_pairs))
        counts = np.split(totals[where], np.cumsum([len(x) for x in asked_words])[:-1])
        levels = np.split(level, np.cumsum([len(x) for x in asked_pairs])[:-1])
        first = np.zeros(asks.num_rows, np.int64)
        first[0] = (totals > 0).sum()
        return pa.table({"block": asks.column("block"), "segment": asks.column("segment"), "counts": pa.array(map(planes, counts), pa.binary()), "levels": pa.array([x.tobytes() for x in levels], pa.binary()), "distinct": pa.array(first)})

    return asked.groupBy("segment").cogroup(held.groupBy("segment")).applyInArrow(answer, "block long, segment long, counts binary, levels binary, distinct long")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Texts whose crc32(doc_id) mod modulus is not remainder are learned from. Tokens are the words of a text and one end.
    base_score sums log10((c + 1) / (N + V + 1)), which is p(w); score sums log10((c(u w) + strength * p(w)) / (c(u) +
    strength)), u the token before (a start before the first) and c(u w) as the filter gives it. Null texts count as
    empty (one token, the end); a null doc_id hashes as the empty text; repeated rows are scored and counted each; an
    empty table gives no rows; columns other than doc_id and text are ignored.
    """
    s = settings or Settings()
    rows = text_docs(docs).withColumn("held_out", split_hash(F.col("doc_id")) % modulus == remainder)
    tokens = written(tokenised(rows, s.tokens_per_block), "tokens")
    size = tokens.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_texts", "n_words")), F.coalesce(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x) + F.size("size")), F.lit(0)).alias("all")).first()
    texts, total, segments = size["n_texts"], size["n_texts"] + size["n_words"], max(1, size["all"] // s.tokens_per_segment)
    asked = requested(tokens, segments).repartition(segments, "segment")
    replies = written(answered(asked, filters(asked)), "replies")
    distinct = replies.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("n")).first()["n"] + (texts > 0)
    below = float(total + distinct + 1)

    def scored(mine: pa.Table, got: pa.Table) -> pa.Table:
        block = Block(mine, 0, segments)
        got = got.sort_by("segment")
        c = np.concatenate([*(from_planes(x.as_buffer(), np.int64) for x in got.column("counts")), [texts, texts]])
        level = np.concatenate([np.frombuffer(x.as_buffer(), np.int8) for x in got.column("levels")])
        pairs = np.unique(block.pairs)
        single = (c[block.now] + 1) / below
        context = c[block.before]
        both = np.minimum(counts_of(level)[np.searchsorted(pairs, block.pairs)], context)
        p = (both + s.strength * single) / (context + s.strength)
        first = block.stop - block.size - 1
        sums = [np.add.reduceat(x, first) for x in ((c[block.now] > 0).astype(np.int64), np.log10(single), np.log10(p))]
        return pa.table({
            "doc_id": pa.array(mine.column("doc_id")[0].as_py(), pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.size + 1), "n_known": pa.array(sums[0]),
            "train_tokens": pa.array(np.full(len(first), total, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2]),
        })

    mine = tokens.select("block", "doc_id", "held_out", "size", "words", "at")
    return mine.groupBy("block").cogroup(replies.select("block", "segment", "counts", "levels").groupBy("block")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
