"""Very long words and texts, many parts: linear time, bounded memory, the same results."""

import random
import re
import time
import zlib

import numpy as np

from axisloom.llm import pieces, quality, secrets
from axisloom.llm.queries import tokenizer_file


def plain_features(word: bytes, s: quality.Settings) -> list[int]:
    marked, mask = b"<" + word + b">", s.buckets - 1
    out = [zlib.crc32(b"word " + word) & mask]
    for n in range(s.n_min, s.n_max + 1):
        out += [zlib.crc32(marked[i : i + n]) & mask for i in range(len(marked) - n + 1)]
    return sorted(out)


def test_grams_are_those_of_each_word(monkeypatch):
    rng, s = random.Random(1), quality.Settings()
    for piece in (1 << 18, 40, 7):
        monkeypatch.setattr(quality, "PIECE", piece)
        words = [b"", b"a", b"ab", "é中".encode(), b"x" * 39, b"y" * 40, b"z" * 500] + [bytes(rng.randrange(33, 256) for _ in range(rng.randint(0, 60))) for _ in range(200)]
        got: list[list[int]] = [[] for _ in words]
        for first, n, owner, buckets in quality.grams(words, s):
            assert owner.max(initial=0) < n
            for i, b in zip(owner.tolist(), buckets.tolist(), strict=True):
                got[first + i].append(b)
        assert [sorted(g) for g in got] == [plain_features(w, s) for w in words]


def test_bag_of_one_word_of_many_megabytes_takes_little_memory():
    import tracemalloc

    text = "".join(random.Random(2).choices("abcdefghij", k=4_000_000))
    tracemalloc.start()
    began = time.perf_counter()
    ids, share = quality.bag(text, quality.Settings())
    assert time.perf_counter() - began < 20
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    assert abs(float(share.sum()) - 1) < 1e-3
    assert len(ids) > 10_000


def plain_spans(text, judge, base, shortest):
    found = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{shortest},}}", text):
        at, stop = m.start(), m.end()
        for s, _, e in base:
            if s < stop and e > at:
                found.append((at, min(s, stop)))
                at = max(at, e)
        found.append((at, stop))
    return [(a, 3, b) for a, b in found if b - a >= shortest and secrets.gain(text[a:b], judge.ratio) >= judge.least]


def test_runs_beside_base_spans_equal_the_plain_search():
    rng = random.Random(3)
    judge = secrets.Judge(np.random.default_rng(1).normal(size=secrets.K * secrets.K), -50.0)
    parts = ["token=", "secret: ", "AKIA", "abcdef0123456789" * 2, "x", " ", "Zz9_", "==", "-" * 9, "password", ":", "\n", "Q7" * 10]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 40)))
        base = secrets.base_spans(text)
        for shortest in (4, 16):
            assert secrets.scored_spans(text, judge, base, shortest) == plain_spans(text, judge, base, shortest), text


def test_a_long_text_of_many_secrets_takes_seconds():
    text = "token=abcdef123456 " * 80_000 + "AbCdEfGhIjKlMnOp12 " * 80_000
    judge = secrets.Judge(np.zeros(secrets.K * secrets.K), 1.0)
    began = time.perf_counter()
    base = secrets.base_spans(text)
    assert len(base) == 80_000
    assert secrets.scored_spans(text, judge, base) == []
    assert time.perf_counter() - began < 8


def test_blobs_hold_any_strings_and_cost_little_by_many_parts():
    rng = random.Random(4)
    words = ["", " ", "a\0b", "é中😀"] + ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(60_000)]
    assert pieces.from_strings(*pieces.unpacked(pieces.packed(*pieces.strings(words)))) == words
    assert pieces.from_strings(*pieces.unpacked(pieces.packed(*pieces.strings([])))) == []
    text = " ".join(words)
    size = {n: sum(len(pieces.packed(*pieces.strings(x))) for x in pieces.requests([text], n).values()) for n in (40, 400)}
    assert size[400] < 1.25 * size[40]


def test_few_or_many_parts_give_the_librarys_ids(spark):
    rng = random.Random(5)
    model = tokenizer_file("piece_bpe_32k.model")
    sp = pieces.processor(model)
    texts = [" ".join("".join(rng.choices("etaoinshr 中é", k=rng.randint(1, 9))) for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chars in (500, 1 << 30):
        got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode(docs, model, chars_per_block=3000, chars_per_part=chars).collect()}
        assert got == {i: (sp.encode(t), sp.decode(sp.encode(t))) for i, t in enumerate(texts)}
