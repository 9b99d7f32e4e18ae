import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from axisloom.llm import neighbours, queries, winnowing
from tests.llm.helpers import SF, awkward, documents, empty


def brute_nearest(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_on_the_embeddings(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got, want = found(neighbours.nearest(e)), brute_nearest([(r["vec_id"], r["embedding"]) for r in e.collect()], 20)
    assert got.keys() == want.keys()
    assert all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def share_found(spark, x, **settings):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), settings=neighbours.Settings(**settings)))
    want = brute_nearest(rows, 20)
    assert got.keys() == want.keys()
    for q, hits in got.items():
        assert len({i for i, _ in hits}) == len(hits)
        assert all(abs(s - float((x[i] * x[q]).sum())) < 1e-9 for i, s in hits)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want))


def test_recall_where_lists_follow_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, 24))) * rng.uniform(0.8, 1.2, (6000, 1))
    assert share_found(spark, x, part_rows=500) >= 0.9


def test_recall_without_any_structure(spark):
    """Default settings; 110 lists of vectors that point anywhere."""
    rng = np.random.default_rng(12)
    assert share_found(spark, rng.normal(size=(12_000, 32))) >= 0.9


def test_a_fixed_ratio_prunes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    assert share_found(spark, x, ratio=1.0) < share_found(spark, x, ratio=1.2) <= share_found(spark, x, ratio=100.0) == 1


def test_widening_search_holds_all_lists_within_the_ratio():
    rng = np.random.default_rng(3)
    c, q = rng.normal(size=(300, 6)), rng.normal(size=(40, 6))
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    for ratio in (1.0, 1.3, 3.0, 99.0):
        r, i = neighbours.CentroidGraph(c).within(q, ratio)
        got, want = set(zip(r.tolist(), i.tolist(), strict=True)), {(a, b) for a in range(40) for b in np.flatnonzero(d[a] <= ratio * d[a].min() + 1e-12)}
        assert len(got & want) >= 0.97 * len(want)
        assert len(got) == len(r)


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(9)
    c, q = rng.normal(size=(400, 8)), rng.normal(size=(50, 8))
    ids, d = neighbours.CentroidGraph(c).search(q, 32)
    best = ((q[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert (ids[:, 0] == best).mean() >= 0.98
    assert (np.diff(d, axis=1) >= -1e-9).all()
    one, _ = neighbours.CentroidGraph(c[:1]).search(q, 4)
    assert (one[:, 0] == 0).all()


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(45)] + [(100, [2.0, 4.0, 4.0]), (60, [0.0, 0.0, 0.0]), (61, None), (62, [1.0, None, 1.0]), (63, [1.0, float("nan"), 1.0]), (64, [float("inf"), 0.0, 0.0]), (65, [1.0, 2.0]), (None, same), (20, same)]
    df = spark.createDataFrame([(i, v, 7, "s") for i, v in rows], "vec_id long, embedding array<double>, uid int, ids string")
    got = found(neighbours.nearest(df))
    assert set(got) == {0, 20, 40, 100}
    for q in (0, 20, 40):
        assert got[q] == [(100, 18.0), *[(i, 9.0) for i in range(45) if i != q][:19]]
    assert got[100] == [(i, 18.0) for i in range(20)]
    few = found(neighbours.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")))
    assert few == {0: [(1, 2.0)]}
    assert neighbours.nearest(df.where("false")).count() == 0


def brute_winnow(text, k, w):
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] or ([text] if text else [])
    h = [int(winnowing.kgram_hashes(g, k)[0]) for g in grams]
    w = min(w, len(h))
    picked = []
    for i in range(len(h) - w + 1 if h else 0):
        part = h[i : i + w]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if not picked or picked[-1] != at:
            picked.append(at)
    return [h[i] for i in picked], picked


@pytest.mark.parametrize(("k", "w"), [(1, 1), (5, 4), (24, 100), (7, 3), (6, 16)])
def test_winnowing_against_its_definition(k, w):
    rng = np.random.default_rng(k)
    for n in (0, 1, 5, 30, 200):
        text = "".join(rng.choice(list("ab é😀"), n))
        h, p = winnowing.winnow(text, k, w)
        assert (h.tolist(), p.tolist()) == brute_winnow(text, k, w)


def test_what_is_selected_again_is_what_winnowing_selects():
    rng = np.random.default_rng(2)
    for n in [*range(30), 60, 200]:
        for _ in range(20):
            text = "".join(rng.choice(list("abc"), n))
            kept = int(rng.integers(0, n + 1))
            other = text[:kept] + "".join(rng.choice(list("abc"), rng.integers(0, 12)))
            for k, window in ((3, 4), (1, 1), (8, 5), (2, 9)):
                hashes, positions, same = winnowing.reselected(other, kept, winnowing.selected(text, k, window), k, window)
                want = winnowing.winnow(other, k, window)
                assert positions.tolist() == want[1].tolist()
                assert hashes.tolist() == want[0].tolist()
                assert positions[:same].tolist() == winnowing.winnow(text, k, window)[1][:same].tolist()


def test_shared_runs_share_a_fingerprint():
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnop ")
    for _ in range(50):
        shared = "".join(rng.choice(letters, 24 + 100 - 1))
        a, b = ("".join(rng.choice(letters, 80)) + shared + "".join(rng.choice(letters, 60)) for _ in range(2))
        assert set(winnowing.winnow(a, 24, 100)[0].tolist()) & set(winnowing.winnow(b, 24, 100)[0].tolist())


@pytest.mark.parametrize("per_range", [2000, 30])
def test_edited_texts_and_likeness(spark, per_range):
    docs = documents(spark, 200)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in winnowing.edited_fingerprints(docs, rows_per_range=per_range).collect()}
    assert len(got) == len(rows)
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = (winnowing.winnow(t, 24, 100) for t in (text, edited, following))
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), winnowing.as_text(*a), winnowing.as_text(*b))
        assert r["near_edited"] == winnowing.likeness(a[0], b[0])
        assert r["near_next"] == winnowing.likeness(a[0], c[0])


@pytest.mark.parametrize("per_range", [2, 7, 500])
def test_ties_repeated_rows_and_null_ids_have_an_order(spark, per_range):
    rng = np.random.default_rng(per_range)
    texts = ["", "short", "a text that is long enough to hold some of the fingerprints", "another text, not quite so long", None, "é" * 40]
    ids = [None, 1, 1, 2, 3, 7, 7, 7, -5, 900_000_000_000]
    rows = [(ids[rng.integers(len(ids))], texts[rng.integers(len(texts))]) for _ in range(90)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), (r[1] or "").encode())
    order = sorted(rows, key=key, reverse=True)
    want = []
    for n, (i, text) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        want.append((i or 0, hashlib.sha256(edited.encode()).hexdigest(), round(winnowing.likeness(winnowing.winnow(text, 8, 5)[0], winnowing.winnow(following, 8, 5)[0]), 9)))
    got = winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8, 5, per_range).collect()
    assert sorted((r["doc_id"] or 0, r["edited_sha256"], round(r["near_next"], 9)) for r in got) == sorted(want)


def test_ranges_follow_the_order_of_keys(spark):
    rng = np.random.default_rng(6)
    ids = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)] + [5] * 200 + list(range(400))
    rows = [(i, f"t{n}") for n, i in enumerate(ids)] + [(None, f"n{n}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for per_range, quantiles in ((10, 4), (3, 16), (10_000, 4096)):
        found = winnowing.in_ranges(docs, per_range, quantiles).collect()
        known = sorted((r for r in found if r["doc_id"] is not None), key=lambda r: -r["doc_id"])
        unknown = sorted((r for r in found if r["doc_id"] is None), key=lambda r: -r["key"])
        places = [r["range"] for r in known + unknown]
        assert places == sorted(places)
        assert len(set(places)) > (0 if per_range > 1000 else 40)


def test_ranges_count_the_cuts_below(spark):
    cuts = sorted({int(x) for x in np.random.default_rng(1).integers(0, 5000, 300)})
    got = spark.range(-5, 5100, 7).select("id", winnowing.range_of(F.col("id"), cuts).alias("r")).collect()
    assert all(r["r"] == sum(c <= r["id"] for c in cuts) for r in got)


def test_fingerprints_of_awkward_rows(spark):
    got = winnowing.edited_fingerprints(awkward(spark), rows_per_range=3).collect()
    assert len(got) == 11
    empties = [r for r in got if r["doc_id"] in (3, 4)]
    assert all(r["fingerprint"] == "" and r["n_chars"] == 0 for r in empties)
    assert winnowing.edited_fingerprints(empty(spark)).count() == 0
    one = winnowing.edited_fingerprints(spark.createDataFrame([(5, "alone in the table")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    prints = winnowing.fingerprint(awkward(spark)).collect()
    assert all(len(r["hashes"]) == len(r["positions"]) for r in prints)


def shuffled(spark, df) -> int:
    """Bytes that the session's shuffles write while df is made."""

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in map(context.statusStore().executorList(False).apply, range(context.statusStore().executorList(False).size())))

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


def test_texts_are_shuffled_once_and_compressed(spark):
    docs = documents(spark).select("doc_id", "text").repartition(3).localCheckpoint()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert shuffled(spark, winnowing.edited_fingerprints(docs, 8, 5, 100)) < 0.5 * size
    # However few rows are compressed together.
    rows = lambda block: sorted(winnowing.edited_fingerprints(docs, 8, 5, 20, block=block).collect())
    assert rows(1) == rows(32_000_000)


def test_op10_sees_what_short_texts_keep(spark, tmp_path):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnop ")
    rows = [(n, "".join(rng.choice(letters, n))) for n in range(1, 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op10_winnowing(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert [n for n, r in got.items() if r["near_edited"] == 0] == []
    for n in (5, 20, 31, 200):
        k, window = winnowing.setting(n, 8, 5, 4)
        mine, following = (winnowing.winnow(dict(rows)[i], k, window) for i in (n, n - 1))
        assert got[n]["fingerprint"] == winnowing.as_text(*mine)
        assert got[n]["near_next"] == winnowing.likeness(mine[0], following[0])
