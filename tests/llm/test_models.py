import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.llm import language_model, mixing, quality
from tests.llm.helpers import SF, awkward, documents, empty


def test_quality_learns_and_keeps_held_out_rows_apart(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, learn_from=~quality.held_out())
    got = quality.scores(docs, model).withColumn("out", quality.held_out()).join(labels, "doc_id").where("out").collect()
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in got)
    assert right / len(got) > 0.93
    kept = [r["score"] >= 0.3 for r in got if r["quality"] == 1]
    assert sum(kept) / len(kept) > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.train(docs, flipped, learn_from=~quality.held_out())
    assert np.array_equal(model.vectors, other.vectors)


def test_quality_score_is_the_softmax_of_the_average(spark):
    s = quality.Settings(buckets=1 << 10)
    model = quality.fit([(*quality.bag("good words here", s), 1), (*quality.bag("BAD!! JUNK!!", s), 0)] * 5, s)
    text = "good junk"
    ids, share = quality.bag(text, s)
    z = model.output @ (share.astype(float) @ model.vectors[ids]) + model.bias
    got = quality.scores(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["score"]
    assert math.isclose(got, np.exp(z[1]) / np.exp(z).sum(), rel_tol=1e-5)


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (99, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(awkward(spark), labels)
    got = quality.scores(awkward(spark), model).collect()
    assert len(got) == 11
    assert all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[3] == by_id[4] == by_id[5]
    assert quality.scores(empty(spark), model).count() == 0
    assert quality.scores(awkward(spark), quality.train(awkward(spark), labels.where("false"))).first()["score"] == 0.5


def brute_base(rows):
    learned = [t.encode().lower().split() for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for t in learned for w in t)
    n, v = sum(c.values()) + len(learned), len(c) + bool(learned)
    out = []
    for i, t in rows:
        w = t.encode().lower().split()
        total = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(learned) + 1) / (n + v + 1))
        out.append((i or 0, len(w) + 1, sum(c[x] > 0 for x in w) + bool(learned), n, round(total, 6)))
    return sorted(out)


def test_base_scores_equal_brute_force(spark):
    docs = documents(spark, 300)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    s = language_model.Settings(tokens_per_block=10_000, tokens_per_segment=20_000)
    got = language_model.score(docs, settings=s).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    out = [r for r in got if r["held_out"]]
    assert 0 < len(out) < len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)


def test_scores_of_awkward_rows(spark):
    got = language_model.score(awkward(spark)).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in awkward(spark).collect()]
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    assert language_model.score(empty(spark)).count() == 0


def test_filter_holds_every_count_and_errs_seldom():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**32, 200_000, dtype=np.uint64)).astype(np.uint32)
    inside, outside = keys[::2], keys[1::2]
    level = np.minimum(rng.geometric(0.8, len(inside)) - 1, 30)
    found = language_model.Filter.of(inside, level)
    got = found.levels(inside)
    assert (got >= level).all()
    assert (got > level).mean() < 0.01
    assert (found.levels(outside) >= 0).mean() < 0.01
    assert found.width <= language_model.BITS_PER_ENTRY * (level + 1).sum() + 64
    assert (language_model.Filter.of(inside[:0], level[:0]).levels(outside) == -1).all()


def test_counts_of_levels():
    assert language_model.counts_of(np.array([-1, 0, 1, 2])).tolist() == [0, 1, 2.5, 5.5]
    x = np.array([3, 9, 2**40], np.uint64)
    assert (language_model.from_planes(language_model.planes(language_model.gaps(x)), np.uint64).cumsum() == x).all()


def test_a_repeated_pair_is_likelier(spark):
    rows = [(i, "alpha beta gamma") for i in range(30)] + [(i, "gamma alpha delta") for i in range(30, 34)]
    got = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame([*rows, (100, "alpha beta"), (101, "beta alpha")], "doc_id long, text string")).collect()}
    assert got[100]["score"] > got[101]["score"]


def brute_scores(rows, strength, quantised=True):
    """{id: score} from dictionaries of exact counts, quantised as the filter does."""
    cut = [(i, (t or "").encode().lower().split()) for i, t in rows]
    learned = [w for i, w in cut if zlib.crc32(str(i).encode()) % 7 != 2]
    pairs, c = Counter(p for w in learned for p in zip(["<", *w], [*w, ">"], strict=True)), Counter(x for w in learned for x in w)
    c["<"] = c[">"] = len(learned)
    n, v = sum(map(len, learned)) + len(learned), len(c) - 1
    out = {}
    for i, w in cut:
        out[i] = 0.0
        for a, b in zip(["<", *w], [*w, ">"], strict=True):
            k = pairs[a, b]
            both = min(c[a], (3 * 2 ** int(math.log2(k)) - 1) / 2 if quantised else k) if k else 0
            out[i] += math.log10((both + strength * (c[b] + 1) / (n + v + 1)) / (c[a] + strength))
    return out


@pytest.mark.parametrize(("block", "segment"), [(1_000_000, 2_000_000), (5000, 3000)])
def test_scores_are_those_of_brute_force_within_the_filters_error(spark, block, segment):
    docs = documents(spark, 200)
    s = language_model.Settings(tokens_per_block=block, tokens_per_segment=segment)
    got = {r["doc_id"]: r for r in language_model.score(docs, settings=s).collect()}
    want = brute_scores([(r["doc_id"], r["text"]) for r in docs.collect()], s.strength)
    assert got.keys() == want.keys()
    # The filter only ever takes a pair for a more frequent one: of the tokens of a text, few.
    off = {i: got[i]["score"] - want[i] for i in want}
    assert min(off.values()) > -1e-6
    assert sum(off.values()) / sum(r["n_tokens"] for r in got.values()) < 0.01
    assert np.mean(np.array(list(off.values())) < 1e-6) > 0.1


def labelled(spark, docs):
    return docs.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))


def test_mixing_meets_its_targets(spark):
    docs, targets = documents(spark), {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    domains, rows = mixing.soft_mix(docs, labelled(spark, docs), targets)
    got = rows.join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert got.rate.min() >= 0
    assert len(got) == docs.count()
    totals = [(got.rate * got.tokens * got[f"p{i}"]).sum() for i in range(len(domains))]
    assert np.allclose(np.array(totals) / sum(totals), [targets[d] for d in domains], atol=1e-4)
    named = got[[f"p{i}" for i in range(len(domains))]].to_numpy().argmax(1)
    assert np.mean([domains[i] == x for i, x in zip(named, got.lang, strict=True)]) > 0.95


def test_rates_are_the_projected_least_squares_solution(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 1, 1], 40)
    n = rng.integers(1, 100, 40)
    members = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(40)], "doc_id long, tokens long, p0 double, p1 double, p2 double")
    got = mixing.rates(members, ["a", "b", "c"], {"a": 0.9, "b": 0.1}, rounds=60).toPandas().sort_values("doc_id")
    a = n[:, None] * p
    want = np.array([0.9, 0.1, 0.0]) * n.sum()
    m, r = np.linalg.pinv(a.T @ a), np.ones(40)
    for _ in range(60):
        r = np.maximum(0, r - a @ (m @ (a.T @ r - want)))
    assert np.allclose(got.rate, r, atol=1e-6)


def test_mixing_keeps_every_row_and_awkward_rows(spark):
    docs = awkward(spark)
    marks = spark.createDataFrame([(1, "x"), (7, "y"), (None, "x"), (3, None)], "doc_id long, domain string")
    got = mixing.mixed(docs, marks, {"x": 0.5, "y": 0.5}, least=1.0)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 4, 5, None, 7, 8, 9, 10}
    assert got.count() >= 11
    assert mixing.mixed(empty(spark), marks, {"x": 1.0}).count() == 0
    assert mixing.soft_mix(docs, marks.where("false"), {})[1].count() == 11


def test_mixing_tells_what_it_cannot_meet(spark):
    members = spark.createDataFrame([(i, 10, 1.0, 0.0) for i in range(5)] + [(9, 10, 0.0, 1.0)], "doc_id long, tokens long, p0 double, p1 double")
    with pytest.warns(UserWarning, match="no labelled document is of z"):
        mixing.rates(members, ["a", "b"], {"a": 0.5, "z": 0.5})
    with pytest.warns(UserWarning, match="from their targets"):
        got = mixing.rates(members, ["a", "b"], {"a": 0.5, "b": 0.5}, total=60.0, least=1.0).toPandas()
    assert (got.rate >= 1).all()
    with pytest.warns(UserWarning, match="after 1 rounds"):
        mixing.rates(members, ["a", "b"], {"a": 0.1, "b": 0.9}, total=100.0, least=1.0, rounds=1)


def test_an_id_with_many_texts_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(500)] + [(2, "another one"), (2, "another one")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    seen = []
    real, quality.fit = quality.fit, lambda rows, s: seen.extend(rows) or real(rows, s)
    try:
        quality.train(docs, labels)
    finally:
        quality.fit = real
    assert len(seen) == 2


def test_smallest_takes_few_rows_by_hash(spark):
    from axisloom.llm.common import smallest

    rows = spark.range(5000).selectExpr("id % 2500 AS a", "'x' AS b")
    got = smallest(rows, 40, "a").collect()
    assert len(got) == len({r["a"] for r in got}) == 40
    assert [r["a"] for r in smallest(rows.repartition(7), 40, "a").collect()] == [r["a"] for r in got]
    assert smallest(rows, 10_000, "a").count() == 2500
    assert smallest(rows.where("false"), 5, "a").count() == 0


def test_requests_visit_only_segments_that_own_something():
    """A block's requests are those of a loop over all segments, and a hundred million segments cost it no more."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 64, 500, dtype=np.uint64))
    at = rng.integers(0, len(h), 3000).astype(np.uint32)
    row = pa.table({"words": [h.tobytes()], "size": [[1000, 0, 2000]], "held_out": [[False, True, False]], "at": [at.tobytes()]})
    for segments in (1, 7, 300):
        block = language_model.Block(row, 0, segments)
        found = block.requests(segments)
        own = language_model.segment_of(h, segments)
        pairs = np.unique(block.pairs)
        assert [x[0] for x in found] == sorted({*own.tolist(), *(pairs >> np.uint64(32)).tolist()})
        for i, words, n, low, m in found:
            assert (np.cumsum(language_model.from_planes(words, np.uint64), dtype=np.uint64) == h[own == i]).all()
            assert language_model.from_planes(n, np.uint32).tolist() == [int((at == k).sum()) for k in np.flatnonzero(own == i)]
            assert (np.cumsum(language_model.from_planes(low, np.uint32), dtype=np.uint32) == (pairs[pairs >> np.uint64(32) == i] & language_model.LOW).astype(np.uint32)).all()
            assert len(m) == len(low)
    begun = time.perf_counter()
    language_model.Block(row, 0, 100_000_000).requests(100_000_000)
    assert time.perf_counter() - begun < 2
