"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its words and their character n-grams, hashed into a fixed number of
buckets; a softmax layer over that average gives the classes. Training is stochastic gradient descent in numpy on a
bounded sample of labelled rows; scoring runs in the tasks that read the texts.

With two classes the softmax depends on the average only through one direction, so for scoring each bucket's vector is
reduced to one number, and each distinct word's numbers are summed once and remembered.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm.common import lean, slices, smallest, split_hash, text_docs


@dataclass
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    n_min: int = 3
    n_max: int = 4
    epochs: int = 8
    rate: float = 30.0
    #: At most so many labelled rows are learned from.
    max_rows: int = 3000
    seed: int = 7


def crc_table() -> np.ndarray:
    """What one byte does to a CRC-32, for each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = crc_table()
#: Bytes of marked words whose n-grams are hashed at once; a longer word is hashed in pieces of this size.
PIECE = 1 << 18


def grams(words: list[bytes], s: Settings):
    """(first word, words, owner, buckets) by piece: the n-grams of bytes of each word between < and >, and the word itself.

    owner numbers a piece's words from its first. Memory is a piece's, however long a word is.
    """
    mask = np.uint32(s.buckets - 1)

    def hashed(data: np.ndarray, ends: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, bucket) of the n-grams that begin in the first `starts` bytes and end with their word."""
        state, at, found = np.full(len(data), 0xFFFFFFFF, np.uint32), np.arange(len(data)), []
        for n in range(1, s.n_max + 1):
            if len(data) < n:
                break
            state = state[: len(data) - n + 1]
            state = CRC[(state ^ data[n - 1 :]) & np.uint32(255)] ^ (state >> np.uint32(8))
            if n >= s.n_min:
                fine = np.flatnonzero((at[: len(state)] + n <= ends[: len(state)]) & (at[: len(state)] < starts))
                found.append((fine, (~state[fine] & mask).astype(np.int64)))
        return tuple(np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))

    i = 0
    while i < len(words):
        k, size = i, 0
        while k < len(words) and (k == i or size + len(words[k]) + 2 <= PIECE):
            size, k = size + len(words[k]) + 2, k + 1
        own = np.arange(k - i), np.array([crc32(b"word " + w) & int(mask) for w in words[i:k]], np.int64)
        length = np.array([len(w) + 2 for w in words[i:k]])
        if size <= PIECE:
            data = np.frombuffer(b"<" + b"><".join(words[i:k]) + b">", np.uint8)
            owner = np.repeat(own[0], length)
            at, bucket = hashed(data, np.cumsum(length)[owner], size)
            yield i, k - i, np.concatenate([own[0], owner[at]]), np.concatenate([own[1], bucket])
        else:
            yield i, 1, *own
            for lo in range(0, size, PIECE):
                data = np.frombuffer(b"<" * (lo == 0) + words[i][max(0, lo - 1) : lo + PIECE + s.n_max] + b">", np.uint8)[: min(size - lo, PIECE + s.n_max)]
                at, bucket = hashed(data, np.full(len(data), size - lo), PIECE)
                yield i, 1, np.zeros(len(at), np.int64), bucket
        i = k


def tokens(text: str) -> list[bytes]:
    """White-space separated words in their own case, which is a sign of quality."""
    return text.encode("utf-8", "surrogatepass").split()


def bag(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, their shares of all features of the text)."""
    counts = Counter(tokens(text))
    times = np.array(list(counts.values()), float)
    ids, held = np.empty(0, np.int64), np.empty(0)
    for first, _, owner, buckets in grams(list(counts), s):
        ids, at = np.unique(np.concatenate([ids, buckets]), return_inverse=True)
        held = np.bincount(at, np.concatenate([held, times[first + owner]]), len(ids))
    return ids.astype(np.int32), (held / max(1.0, held.sum())).astype(np.float32)


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def direction(self) -> tuple[np.ndarray, float]:
        """A number for each bucket, and a constant: their average plus the constant is the log odds of class 1."""
        return self.vectors @ (self.output[1] - self.output[0]), float(self.bias[1] - self.bias[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Stochastic gradient descent on (buckets, shares, class) rows, in an order drawn from the seed.

    With no rows, or rows of one class, the model's scores are that class's share (a half for none).
    """
    rng = np.random.default_rng(settings.seed)
    m = Model(settings, rng.uniform(-1, 1, (settings.buckets, settings.dim)) / settings.dim, np.zeros((2, settings.dim)), np.zeros(2))
    kinds = np.bincount(np.array([y for _, _, y in rows], np.int64), minlength=2)
    m.bias = np.log(kinds + 1.0) - np.log(len(rows) + 2.0)
    if kinds.min() == 0:
        return m
    m.output = rng.uniform(-1, 1, (2, settings.dim))
    step, steps = 0, settings.epochs * len(rows)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            ids, share, y = rows[i]
            rate = settings.rate * (1 - step / steps)
            step += 1
            hidden = share @ m.vectors[ids] if len(ids) else np.zeros(settings.dim)
            z = m.output @ hidden + m.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ m.output
            m.output -= 0.02 * rate * np.outer(p, hidden)
            m.bias -= 0.001 * rate * p
            m.vectors[ids] -= rate * share[:, None] * back
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings | None = None, learn_from=None) -> Model:
    """A model of a 0/1 column of labels, from labelled rows for which learn_from (a condition on doc_id) holds.

    At most settings.max_rows labels are used, those with the smallest hashes of their ids; their texts are reduced to
    bags of buckets where they are read, and of an id that has several texts one is taken, that of the smallest hash, before
    anything is gathered. Null labels, ids without a text and texts without a label are left out; without any rows, as in
    an empty table, the model's scores are a half.
    """
    s = settings or Settings()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    if learn_from is not None:
        known = known.where(learn_from)
    sample = smallest(known, s.max_rows, "doc_id")

    def run(batches):
        for b in batches:
            held = [bag(t, s) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("hash"), pa.array([h[0] for h in held], pa.list_(pa.int32())), pa.array([h[1] for h in held], pa.list_(pa.float32()))], ["doc_id", "y", "hash", "ids", "share"])

    met = text_docs(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("hash"), "text")
    bags = met.mapInArrow(lean(run), "doc_id long, y int, hash long, ids array<int>, share array<float>")
    one = bags.groupBy("doc_id", "y").agg(F.min_by(F.struct("ids", "share"), "hash").alias("bag"))
    got = one.select("doc_id", "y", "bag.ids", "bag.share").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    ids, share = got.column("ids"), got.column("share")
    return fit([(ids[i].values.to_numpy(), share[i].values.to_numpy(), y) for i, y in enumerate(got.column("y").to_pylist())], s)


def scores(docs: DataFrame, model: Model, *more: str, memory: int = 200_000) -> DataFrame:
    """Every row's doc_id, text and named columns with a score: the probability of class 1.

    Null texts count as empty; a text without words has the score of the bias alone. Equal texts have equal scores;
    repeated rows give repeated rows, and a row with a null id is kept; an empty table gives no rows; columns that are not named are left out.
    """
    weight, bias = model.direction()
    held = docs.sparkSession.sparkContext.broadcast((weight, bias, model.settings))
    rows = text_docs(docs, *more)
    schema = rows.schema

    def run(batches):
        weight, bias, s = held.value
        known: dict[bytes, tuple[float, int]] = {}
        for b in batches:
            out = []
            for _, texts in slices(b, "text", 1_000_000):
                cut = [tokens(t) for t in texts]
                new = [w for w in set(chain.from_iterable(cut)) if w not in known]
                if len(known) + len(new) > memory:
                    known.clear()
                    new = list(set(chain.from_iterable(cut)))
                sums, size = np.zeros(len(new)), np.zeros(len(new), np.int64)
                for first, n, owner, buckets in grams(new, s):
                    sums[first : first + n] += np.bincount(owner, weight[buckets], n)
                    size[first : first + n] += np.bincount(owner, minlength=n)
                known.update(zip(new, zip(sums.tolist(), size.tolist(), strict=True), strict=True))
                for c in cut:
                    got = [known[w] for w in c]
                    n = sum(g[1] for g in got)
                    out.append(1 / (1 + np.exp(-np.clip((sum(g[0] for g in got) / n if n else 0.0) + bias, -700, 700))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])

    return rows.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", score double")


def held_out(modulus: int = 5, remainder: int = 0):
    """Rows not to learn from, by the crc32 of the id's decimal text."""
    return split_hash(F.col("doc_id")) % modulus == remainder
