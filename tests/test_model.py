"""The chain, its emissions and EM against plain sequential numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.operators import chain as ch
from axisloom.operators import em, emission, enrich
from axisloom.sources import files

K = 3


def some_chain(seed=0, k=K):
    rng = np.random.default_rng(seed)
    return ch.Chain(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k))


def likelihood(spark, ll):
    rows = [(t, i, float(ll[t, i])) for t in range(len(ll)) for i in range(ll.shape[1])]
    return spark.createDataFrame(rows, "ridx long, state int, ll double")


def sequential(ll, c):
    """(posteriors, log-likelihood, expected transitions) of one chain."""
    n, k = ll.shape
    a, b = np.empty((n, k)), np.empty((n, k))
    e = np.exp(ll)
    scale = np.empty(n)
    for t in range(n):
        a[t] = e[t] * (c.start if t == 0 else a[t - 1] @ c.trans)
        scale[t] = a[t].sum()
        a[t] /= scale[t]
    b[-1] = 1
    for t in range(n - 2, -1, -1):
        b[t] = c.trans @ (e[t + 1] * b[t + 1]) / scale[t + 1]
    p = a * b
    xi = sum(a[t - 1][:, None] * c.trans * (e[t] * b[t])[None] / scale[t] for t in range(1, n))
    return p / p.sum(1, keepdims=True), float(np.log(scale).sum()), xi


def best_path(ll, c):
    n, k = ll.shape
    v, back = np.log(c.start) + ll[0], np.zeros((n, k), int)
    for t in range(1, n):
        m = v[:, None] + np.log(c.trans)
        back[t], v = m.argmax(0), m.max(0) + ll[t]
    path = [int(v.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return path[::-1]


def passed(df, k=K):
    rows = df.collect()
    post = {(r["ridx"], r["state"]): r["p"] for r in rows if r["kind"] == "post"}
    n = max(t for t, _ in post) + 1
    xi = np.zeros((k, k))
    for r in rows:
        if r["kind"] == "trans":
            xi[r["state"], r["other"]] += r["p"]
    return np.array([[post[t, i] for i in range(k)] for t in range(n)]), sum(r["p"] for r in rows if r["kind"] == "score"), xi


@pytest.mark.parametrize("block_rows", [1, 37, 1000])
def test_blocked_scan_equals_the_sequential_one(spark, block_rows):
    ll, c = np.random.default_rng(1).normal(-4, 3, (150, K)), some_chain()
    post, score, xi = passed(ch.posteriors(ch.blocked(likelihood(spark, ll), K, block_rows), c))
    want = sequential(ll, c)
    assert np.allclose(post, want[0], atol=1e-10)
    assert math.isclose(score, want[1], rel_tol=1e-10)
    assert np.allclose(xi, want[2], atol=1e-9)
    path = {r["ridx"]: r["state"] for r in ch.decode(ch.blocked(likelihood(spark, ll), K, block_rows), c, "viterbi").collect()}
    assert [path[t] for t in range(150)] == best_path(ll, c)


def test_restart_runs_blocks_as_chains_of_their_own(spark):
    ll, c = np.random.default_rng(2).normal(-4, 3, (50, K)), some_chain(3)
    post, score, xi = passed(ch.posteriors(ch.blocked(likelihood(spark, ll), K, 20), c, "restart"))
    want = [sequential(ll[i : i + 20], c) for i in (0, 20, 40)]
    assert np.allclose(post, np.concatenate([w[0] for w in want]), atol=1e-10)
    assert math.isclose(score, sum(w[1] for w in want), rel_tol=1e-10)
    assert np.allclose(xi, sum(w[2] for w in want), atol=1e-9)


def test_several_chains_and_zero_probabilities(spark):
    ll = np.random.default_rng(4).normal(-2, 2, (60, 2))
    c = ch.Chain(np.array([1.0, 0.0]), np.array([[0.7, 0.3], [0.0, 1.0]]))
    names = spark.createDataFrame([(t, "x" if t < 25 else "y") for t in range(60)], "ridx long, chain string")
    post, score, xi = passed(ch.posteriors(ch.blocked(likelihood(spark, ll), 2, 10, names), c), 2)
    want = [sequential(ll[:25], c), sequential(ll[25:], c)]
    assert np.allclose(post, np.concatenate([w[0] for w in want]), atol=1e-10)
    assert math.isclose(score, sum(w[1] for w in want), rel_tol=1e-10)
    assert np.allclose(xi, sum(w[2] for w in want), atol=1e-9)


def test_unknown_decoders_and_bad_chains(spark):
    blocks = ch.blocked(likelihood(spark, np.zeros((2, K))), K, 10)
    with pytest.raises(ValueError, match="decoder"):
        ch.decode(blocks, some_chain(), "robust_map")
    with pytest.raises(ValueError, match="boundary"):
        ch.posteriors(blocks, some_chain(), "none")
    with pytest.raises(ValueError, match="sum to 1"):
        ch.Chain(np.array([0.5, 0.4]), np.eye(2)).check()
    with pytest.raises(ValueError, match="number of states"):
        ch.Chain(np.array([0.5, 0.5]), np.eye(3)).check()
    assert np.allclose((s := some_chain().stationary()) @ some_chain().trans, s)


def random_counts(seed=5, regions=200, cells=30, top=5):
    x = np.random.default_rng(seed).integers(0, top, (regions, cells))
    return x, [("a" if c % 2 else "b", int(r), f"c{c}", int(x[r, c])) for r, c in zip(*np.nonzero(x), strict=True)]


@pytest.mark.parametrize(("cap", "min_depth"), [(None, 0), (2, 0), (None, 28)])
def test_emission_equals_the_gamma_function(spark, cap, min_depth):
    x, rows = random_counts()
    counts = spark.createDataFrame(rows, "dataset string, ridx long, barcode string, cnt long")
    alpha = np.random.default_rng(6).uniform(0.01, 1, (K, x.shape[1]))
    table = spark.createDataFrame([("a" if c % 2 else "b", f"c{c}", k, float(alpha[k, c]), 0.0) for k in range(K) for c in range(x.shape[1])], "dataset string, barcode string, state int, suffstat double, prior double")
    got = emission.log_likelihood(counts, spark.range(x.shape[0] + 1).withColumnRenamed("id", "ridx"), table, K, cap, min_depth).collect()
    y = np.minimum(x, cap) if cap else x
    lg = np.vectorize(math.lgamma)
    want = np.zeros((x.shape[0] + 1, K))
    for k in range(K):
        for own in (slice(0, None, 2), slice(1, None, 2)):
            a, m = alpha[k, own], y[:, own]
            n = m.sum(1)
            ll = lg(a.sum()) - lg(n + a.sum()) + (lg(a + m) - lg(a)).sum(1)
            want[:-1, k] += np.where(n >= min_depth, ll, 0) if min_depth else ll
    assert len(got) == want.size
    assert all(math.isclose(r["ll"], want[r["ridx"], r["state"]], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def two_state_data(spark, n=240):
    rng, rows = np.random.default_rng(7), []
    for t in range(n):
        state = t // 40 % 2
        for c in range(12):
            m = rng.poisson(4.0 if (c < 6) == (state == 0) else 0.2)
            if m:
                rows.append(("d", t, f"c{c}", int(m)))
    regions = spark.range(n).select(F.col("id").alias("ridx"), F.lit("x").alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("stop"))
    return spark.createDataFrame(rows, "dataset string, ridx long, barcode string, cnt long"), regions


def test_em_recovers_two_states_and_is_stored(spark, tmp_path):
    counts, regions = two_state_data(spark)
    model = em.fit(counts, regions, 2, 6, options=em.Options(block_rows=50))
    calls = {r["ridx"]: r["state"] for r in em.predict(model, counts, regions).collect()}
    truth = np.array([t // 40 % 2 for t in range(240)])
    same = np.mean(np.array([calls[t] for t in range(240)]) == truth)
    assert max(same, 1 - same) > 0.98
    assert np.allclose(model.chain.trans.sum(1), 1)
    path = str(tmp_path / "model")
    files.write_model(model, path)
    back = files.read_model(spark, path)
    assert np.allclose(back.chain.trans, model.chain.trans)
    assert math.isclose(em.score(back, counts, regions), em.score(model, counts, regions), rel_tol=1e-9)
    with pytest.raises(ValueError, match="no model"):
        files.read_model(spark, str(tmp_path / "none"))


def test_m_step_keeps_zeros_of_the_model_and_only_those():
    """A parameter that is zero stays zero; one whose statistics vanish does not."""
    was = ch.Chain(np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.3, 0.3, 0.4], [0.0, 0.0, 1.0]]))
    c = em.m_step({("start", 0, 0): 1.0, ("trans", 0, 1): 3.0, ("trans", 1, 1): 2.0}, was, em.Options())
    assert np.allclose(c.start, np.array([1 + 1e-6, 1e-6, 0]) / (1 + 2e-6), rtol=1e-12)
    assert np.allclose(c.trans[0], np.array([1e-6, 3 + 1e-6, 0]) / (3 + 2e-6), rtol=1e-12)
    assert np.allclose(c.trans[1], np.array([1e-6, 2 + 1e-6, 1e-6]) / (2 + 3e-6), rtol=1e-12)
    assert c.trans[2].tolist() == [0, 0, 1]


def test_priors_of_a_dataset_sum_to_their_weight(spark):
    counts = spark.createDataFrame([("d", 0, "a", 3), ("d", 1, "b", 5), ("e", 0, "a", 1)], "dataset string, ridx long, barcode string, cnt long")
    states = spark.range(2).select(F.col("id").alias("ridx"), F.lit(0).alias("state"))
    rows = emission.emission_table(counts, emission.state_sums(counts, states), 2, 3.0).collect()
    assert {(r["dataset"], r["barcode"]): round(r["prior"], 12) for r in rows} == {("d", "a"): 1.2, ("d", "b"): 1.8, ("e", "a"): 3.0}


def test_log_gamma(spark):
    xs = [1e-9, 1e-3, 0.5, 1.0, 2.5, 8.0, 77.7, 1e4, 1e9]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", emission.log_gamma(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r["y"], math.lgamma(r["x"]), rel_tol=1e-13, abs_tol=2e-11) for r in rows)


def test_products_that_vanish_are_taken_in_logs():
    c = ch.Chain(np.array([1.0, 0.0]), np.array([[0.5, 0.5], [0.0, 1.0]]))
    ll = np.zeros((6, 2))
    ll[0, 0], ll[3, 1] = -2000.0, -5000.0
    got = ch._rescaled(ll, c, None, np.zeros(2))
    want = ch._in_logs(ll, c, None, np.zeros(2))
    assert np.allclose(got[0], want[0])
    assert np.allclose(got[1], want[1])
    assert math.isclose(got[2], want[2])
    rng = np.random.default_rng(3)
    ll, into, after = rng.normal(-4, 3, (40, K)), rng.normal(0, 2, K), rng.normal(0, 2, K)
    for a, b in zip(ch._rescaled(ll, some_chain(), into, after)[:2], ch._in_logs(ll, some_chain(), into, after)[:2], strict=True):
        assert np.allclose(a, b, atol=1e-12)


@pytest.mark.parametrize("length", [1, 2, 9, 300])
def test_null_distribution_equals_dynamic_programming(length):
    c, pi = some_chain(8), some_chain(8).stationary()
    for state in range(K):
        dp = np.zeros((K, length + 1))
        for i in range(K):
            dp[i, int(i == state)] = pi[i]
        for _ in range(length - 1):
            moved = c.trans.T @ dp
            dp = moved.copy()
            dp[state] = np.concatenate([[0], moved[state, :-1]])
        got = enrich.visits(c, length, state, frequencies=64)
        assert np.allclose(got, dp.sum(0), atol=1e-12)
        assert math.isclose(got.sum(), 1, rel_tol=1e-9)


def test_initial_states_do_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumnRenamed("id", "ridx")
    a = {r["ridx"]: r["state"] for r in emission.initial_states(rows, 4).collect()}
    b = {r["ridx"]: r["state"] for r in emission.initial_states(rows.repartition(7), 4).collect()}
    assert a == b
    assert set(a.values()) == {0, 1, 2, 3}


def test_seeds_keep_the_best_and_one_number_is_a_list_of_one(spark):
    counts, regions = two_state_data(spark, 80)
    best, scores = em.fit_seeds(counts, regions, 2, [1, 2], 1)
    assert best.score == max(scores.values())
    assert set(em.fit_seeds(counts, regions, 2, 7, 1)[1]) == {7}


def test_robust_posteriors_are_means_over_matrices(spark):
    counts, regions = two_state_data(spark, 80)
    twice = counts.unionByName(counts.withColumn("dataset", F.lit("e")))
    model = em.fit(twice, regions, 2, 1)
    got = em.robust_posterior(model, twice, regions).collect()
    assert len(got) == 160
    assert all(r["sd"] < 1e-9 for r in got)
    one = em.posterior(em.Model(2, model.chain, model.emission.where("dataset = 'd'")), counts, regions)
    want = {(r["ridx"], r["state"]): r["p"] for r in one.collect()}
    assert all(math.isclose(r["mean"], want[r["ridx"], r["state"]], abs_tol=1e-9) for r in got)


def test_depth_bins_start_uniform(spark):
    rows = emission.uniform_depth_bins(spark, 4, 2).collect()
    assert sorted((r["cntbin"], r["state"], r["p"]) for r in rows) == [(b, s, 0.25) for b in range(4) for s in range(2)]


def test_early_stop_needs_a_tolerance(spark):
    counts, regions = two_state_data(spark, 80)
    assert em.fit(counts, regions, 2, 3).iterations == 3
    assert em.fit(counts, regions, 2, 8, options=em.Options(tolerance=1e9)).iterations < 8


@pytest.mark.parametrize("algorithm", ["map", "viterbi"])
def test_tracks_run_beside_each_other_through_a_scan_of_many_levels(spark, algorithm, monkeypatch):
    monkeypatch.setattr(ch, "FAN", 3)
    rng = np.random.default_rng(11)
    lls, chains = {t: rng.normal(-3, 2, (100, K)) for t in "ab"}, {"a": some_chain(1), "b": some_chain(2)}
    rows = [(t, i, k, float(x[i, k])) for t, x in lls.items() for i in range(100) for k in range(K)]
    names = spark.createDataFrame([(t, "x" if t < 31 else "y") for t in range(100)], "ridx long, chain string")
    blocks = ch.blocked(spark.createDataFrame(rows, "track string, ridx long, state int, ll double"), K, 2, names)
    found = ch.decoded_viterbi(blocks, chains) if algorithm == "viterbi" else ch.posteriors(blocks, chains)
    for t, x in lls.items():
        own = found.where(F.col("track") == t)
        parts = [x[:31], x[31:]]
        if algorithm == "viterbi":
            path = {r["ridx"]: r["state"] for r in own.collect()}
            assert [path[i] for i in range(100)] == [s for p in parts for s in best_path(p, chains[t])]
        else:
            post, score, xi = passed(own)
            want = [sequential(p, chains[t]) for p in parts]
            assert np.allclose(post, np.concatenate([w[0] for w in want]), atol=1e-10)
            assert math.isclose(score, sum(w[1] for w in want), rel_tol=1e-10)
            assert np.allclose(xi, sum(w[2] for w in want), atol=1e-9)


def test_seeds_together_are_as_each_alone_and_stop_on_their_own(spark, monkeypatch):
    counts, regions = two_state_data(spark, 80)
    o = em.Options(block_rows=30, tolerance=5.0)
    alone = {s: em.fit(counts, regions, 2, 6, s, o) for s in (1, 2, 3)}
    for width in (96, 4):
        monkeypatch.setattr(em, "WIDTH", width)
        best, scores = em.fit_seeds(counts, regions, 2, [1, 2, 3], 6, o)
        assert scores == {s: pytest.approx(em.score(m, counts, regions, o), rel=1e-9) for s, m in alone.items()}
        assert np.allclose(best.chain.trans, alone[best.seed].chain.trans)
        assert best.iterations == alone[best.seed].iterations
    together = em._fitted(counts, regions, 2, 6, [1, 2, 3], o, None)
    assert {int(t): n for t, n in together.rounds.items()} == {s: m.iterations for s, m in alone.items()}


def test_a_fit_goes_on_from_its_last_whole_round(spark, tmp_path):
    counts, regions = two_state_data(spark, 80)
    store = str(tmp_path / "fit")
    straight = em.fit(counts, regions, 2, 4)
    em.fit(counts, regions, 2, 2, options=em.Options(store=store))
    assert sorted(p.name for p in (tmp_path / "fit").iterdir()) == ["cells-2", "state-2"]
    # A round that was ended while its cells were written.
    (tmp_path / "fit" / "cells-3").mkdir()
    resumed = em.fit(counts, regions, 2, 4, options=em.Options(store=store))
    assert sorted(p.name for p in (tmp_path / "fit").iterdir()) == ["cells-4", "state-4"]
    assert resumed.iterations == 4
    assert math.isclose(resumed.score, straight.score, rel_tol=1e-12)
    assert np.allclose(resumed.chain.trans, straight.chain.trans)
    a, b = ({(r["barcode"], r["state"]): r["suffstat"] for r in m.emission.collect()} for m in (resumed, straight))
    assert a == pytest.approx(b)
    with pytest.raises(ValueError, match="other seeds"):
        em.fit(counts, regions, 2, 4, seed=5, options=em.Options(store=store))


def test_no_counts_give_no_robust_posteriors(spark):
    counts, regions = two_state_data(spark, 20)
    model = em.initial_model(counts, regions, 2)
    assert em.robust_posterior(model, counts.where("false"), regions).count() == 0


def test_null_distributions_share_their_powers(spark):
    c = some_chain(8)
    lengths = [1, 2, 3, 4, 7, 8, 31, 32, 33, 150]
    rows = spark.createDataFrame([(n,) for n in [*lengths, 0, 8, 8]], "length long")
    got: dict = {}
    for r in enrich.null_distribution(rows, c, frequencies=16).collect():
        got.setdefault((r["length"], r["state"]), {})[r["visits"]] = r["p"]
    assert set(got) == {(n, s) for n in lengths for s in range(K)}
    for (n, s), p in got.items():
        assert np.allclose([p[v] for v in range(n + 1)], enrich.visits(c, n, s), atol=1e-12)
