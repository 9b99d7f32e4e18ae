"""Language identification, hard negatives and whitening."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.llm import hard_negatives, language_id, whitening
from axisloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import difference, duck
from tests.llm.helpers import SF, awkward, documents, empty

SHAPE = "vec_id long, embedding array<float>, label int, uid long, leaf string, n int, component string, w double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "l", 2, "c", 0.5) for i, v, y in rows], SHAPE)


def test_gradients_are_the_slopes_of_the_loss():
    s = language_id.Settings(hidden=3, window=7)
    m = language_id.fresh(["a", "b", "c"], s, np.float64)
    rng = np.random.default_rng(3)
    lengths = np.array([7, 7, 5, 2, 1])
    x, y = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    _, grads = language_id.gradients(m, x, lengths, y)
    for name, p in m.params.items():
        where = [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)]
        if name[0] == "T":
            where += [(i, int(x[t, 0])) for i in range(9) for t in (0, 3, 6)]
        for at in where:
            was, slope = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = was + step
                slope.append(language_id.gradients(m, x, lengths, y)[0])
            p[at] = was
            assert math.isclose((slope[0] - slope[1]) / 2e-6, grads[name][at], rel_tol=1e-4, abs_tol=1e-7), (name, at)


def brute_probabilities(m, text: bytes) -> np.ndarray:
    """Position by position and window by window."""
    p, k, total = m.params, m.settings.hidden, 0

    def states(d, window):
        h, out = np.zeros(k), []
        for b in window:
            u, t = p[f"U{d}"].astype(float) @ h, p[f"T{d}"][:, b].astype(float)
            r, z = (np.clip(t[i * k : i * k + k] + u[i * k : i * k + k], 0, 1) for i in (0, 1))
            n = t[2 * k :] + r * u[2 * k :]
            n = n / (1 + np.abs(n))
            h = n + z * (h - n)
            out.append(h)
        return out

    for at in range(0, len(text), m.settings.window):
        window = text[at : at + m.settings.window]
        for f, b in zip(states("f", window), states("b", window[::-1])[::-1], strict=True):
            e = np.exp(p["Of"] @ f + p["Ob"] @ b + p["b"][:, 0])
            total = total + e / e.sum()
    return total / len(text)


def test_pooled_probabilities_equal_those_of_single_positions():
    s = language_id.Settings(hidden=4, window=16, rows_per_language=50, side=3, epochs=20)
    m = language_id.fit([b"the cat and the dog", b"le chat et le chien"] * 40, ["en", "fr"] * 40, s)
    texts = [b"", b"t", b"the dog", b"le chien et le chat et le chien", b"x" * 16, bytes(range(256)), b"the " * 40]
    got = language_id.probabilities(m, texts)
    assert not got[0].any()
    for text, p in zip(texts[1:], got[1:], strict=True):
        assert np.allclose(p, brute_probabilities(m, text), atol=1e-4)
    assert got[2].argmax() == 0
    assert got[3].argmax() == 1


def test_language_of_held_out_rows_learned_from_others_alone(spark):
    docs = documents(spark)
    m = language_id.train(docs, learn_from=~language_id.held_out())
    got = language_id.predict(docs, m, "lang").withColumn("out", language_id.held_out()).collect()
    assert len(got) == docs.count()
    out = [r for r in got if r["out"]]
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    assert all(0 < r["score"] <= 1 for r in out)
    other = language_id.train(docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang"))), learn_from=~language_id.held_out())
    assert all(np.array_equal(m.params[k], other.params[k]) for k in m.params)


def test_language_of_awkward_rows(spark):
    docs = awkward(spark).withColumn("lang", F.when(F.col("doc_id") < 8, F.lit("en")).when(F.col("doc_id") == 9, F.lit("zz")))
    m = language_id.train(docs)
    assert m.languages == ["en", "zz"]
    got = language_id.predict(docs, m).collect()
    assert len(got) == 11
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by_id[3] == by_id[4] == by_id[5] == ("und", 0.0)
    assert by_id[7][0] == by_id[1][0] == "en"
    assert language_id.predict(empty(spark), m).count() == 0
    none = language_id.train(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "123 ²½ ٣"), (2, "1a"), (3, "é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language_id.predict(digits, m).orderBy("doc_id").collect()] == [True, False, False]


def brute_negatives(rows, modulus=50):
    """rows: (id, list of numbers, label), all usable."""
    data = [(i, [math.floor(256 * float(np.float32(c))) for c in v], y) for i, v, y in rows]
    out = []
    for a, x, y in data:
        if a % modulus:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), i, z) for i, v, z in data if i != a)
        for s, i, _ in [r for r in scored if r[2] == y][:5]:
            fit = [r for r in scored if r[2] != y and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, i, n, r[1], -s, -r[0]) for n, r in enumerate(fit, 1)]
    return sorted(out)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_hard_negatives_query_equals_its_sql(spark):
    assert difference(QUERIES["op12_hard_negatives"](spark, SF), duck(SF), ORACLE_SQL["op12_hard_negatives"]) == ""


@pytest.mark.parametrize("clusters", [0, 6])
def test_hard_negatives_equal_brute_force(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(max(1, clusters), 5)) * (1 if clusters else 0)
    v = centres[rng.integers(0, len(centres), 900)] + rng.normal(size=(900, 5)) * 0.2
    v[300:560] = v[17]  # a group of copies
    v[560:600] = v[18]
    rows = [(i, [float(np.float32(c)) for c in v[i]], int(rng.integers(0, 4)) if i % 3 else 1) for i in range(900)]
    s = hard_negatives.Settings(sample_rows=400, leaf_rows=60, part_rows=100, degree=4)
    assert tuples(hard_negatives.mined(vectors(spark, rows), modulus=10, settings=s)) == brute_negatives(rows, 10)


def test_hard_negatives_of_awkward_rows(spark):
    fine = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.4], 2), (3, [0.5, 0.4], 2), (4, [0.0, 0.0], 1), (50, [0.0, 0.0], 2), (100, [-1.0, 0.2], 3)]
    bad = [(5, None, 1), (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 2), (9, [1.0, 0.5], None), (None, [1.0, 0.5], 1), (10, [], 1), (11, [1.0], 1)]
    got = tuples(hard_negatives.mined(vectors(spark, fine + bad + fine[:3])))
    assert got == brute_negatives(fine)
    assert got
    assert hard_negatives.mined(vectors(spark, [])).count() == 0
    assert hard_negatives.mined(vectors(spark, bad[:5])).count() == 0
    assert hard_negatives.mined(vectors(spark, fine[:1])).count() == 0
    with pytest.raises(Exception, match="too long"):
        hard_negatives.mined(vectors(spark, [(0, [1e9, 0.0], 1)])).count()


def test_ranges_leave_out_subtrees_and_no_row():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.normal(size=(12, 6))[rng.integers(0, 12, 3000)] * 2 + rng.normal(size=(3000, 6)) * 0.05))
    t = hard_negatives.Tree.fitted(np.unique(x[:800], axis=0), 40, 6, 1)
    leaf = t.route(x, note=True)
    q = x[:200]
    p = q @ x.T
    lo, hi = 0.7 * (q**2).sum(1), 0.95 * (q**2).sum(1)
    who, what = t.visits(q, lo, hi)
    asked = set(zip(who.tolist(), what.tolist(), strict=True))
    r, c = np.nonzero((p >= lo[:, None]) & (p <= hi[:, None]))
    assert {(i, leaf[j]) for i, j in zip(r.tolist(), c.tolist(), strict=True)} <= asked
    assert len(asked) < 0.5 * 200 * t.leaves


def brute_whitening(v):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in row] for row in v]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[(n * c - t) / n for c, t in zip(row, s, strict=True)] for row in x])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    return [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x], y, e[::-1], u[:, ::-1], cov


@pytest.mark.parametrize("d", [1, 3, 12])
def test_whitening_equals_brute_force(spark, d):
    rng = np.random.default_rng(d)
    v = (rng.normal(size=(400, d)) @ rng.normal(size=(d, d))).astype(np.float32)
    v[100:200] = v[5]
    bad = [(1000, None, 0), (1001, [None] * d, 0), (1002, [float("nan")] * d, 0), (1003, [float("inf")] * d, 0), (1004, [], 0), (1005, [0.0] * (d + 1), 0)]
    rows = [(None if i == 7 else i, [float(c) for c in v[i]], None) for i in range(400)]
    got = whitening.whitened(vectors(spark, rows + bad)).collect()
    dev, y, e, u, cov = brute_whitening(v)
    c = min(8, d)
    assert len(got) == 400 * c
    assert {r["n"] for r in got} == {400}
    assert max(r["identity_error"] for r in got) < 1e-9
    by_id = {(7 if r["vec_id"] is None else r["vec_id"], r["component"]): r for r in got}
    for k in range(c):
        want, have = y @ u[:, k] / e[k] ** 0.5, np.array([by_id[i, k + 1]["whitened"] for i in range(400)])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-6
        assert math.isclose(by_id[0, k + 1]["explained"], e[k] / np.trace(cov), rel_tol=1e-9)
    assert all(by_id[i, 1]["deviation"] == dev[i] for i in range(400))


def test_polarised_covariance_is_exact_for_large_numbers(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 4)) * [1e-3, 1, 1e4, 1e6]
    rows = whitening.whole_vectors(spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>"))
    w = whitening.fit(rows)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r] for r in v], object)
    n, s = len(x), x.sum(axis=0)
    exact = (n * x - s).T.dot(n * x - s)
    assert all(w.covariance[i, j] == pytest.approx(exact[i, j] / n**3, rel=1e-15) for i in range(4) for j in range(4))
    far = whitening.whitened(spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).where("component = 1").collect()
    assert any(r["deviation"] is None for r in far)


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None, 0)])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0)])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0)] * 5)).count() == 0
    got = whitening.whitened(vectors(spark, [(i, [float(i), 1.0, 2.0 * i], 0) for i in range(9)])).collect()
    assert {r["component"] for r in got} == {1}
    assert got[0]["explained"] == pytest.approx(1)
