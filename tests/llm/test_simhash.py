from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from axisloom.llm import simhash
from axisloom.llm.common import components
from tests.llm.helpers import awkward, documents, empty


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius):
    """{key: least id} over links between fingerprints."""
    keys = sorted(prints)
    label = {k: prints[k] for k in keys}
    f = np.array(keys, np.uint64)
    pairs = [(keys[i], keys[j]) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize(("radius", "block_rows"), [(2, 16), (2, 8192), (0, 16), (3, 7), (6, 64)])
def test_groups_are_those_of_all_pairs(spark, radius, block_rows):
    docs = documents(spark, 400)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_groups(docs, radius=radius, block_rows=block_rows).collect()}
    want = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    least = defaultdict(lambda: 1 << 60)
    for i, f in want.items():
        least[f] = min(least[f], i)
    label = brute_groups(least, radius)
    assert {k: v[1] for k, v in got.items()} == {i: label[f] for i, f in want.items()}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_fingerprints_within_the_radius_share_a_tile(radius):
    rng = np.random.default_rng(radius)
    for n in (10, 10_000_000, 20_000_000_000):
        masks = simhash.runs_of_bits(radius, n)
        for _ in range(300):
            flips = sum({1 << int(b) for b in rng.choice(64, radius, replace=False)})
            assert any(flips & m == 0 for m in masks)


def test_near_pairs_are_all_pairs_within_the_radius():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 90)]))
    fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
    for r in (0, 2, 5):
        want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= r}
        assert {(int(i), int(j)) for a, b in simhash.near_pairs(fp, fp, r) for i, j in zip(a, b, strict=True)} == want
        assert {(int(i), int(j)) for a, b in simhash.near_pairs(fp, None, r) for i, j in zip(a, b, strict=True)} == {(i, j) for i, j in want if i < j}


def exact_classes(rows, similarity=0.8):
    """{position: least position} over links of exact Jaccard similarity of five-word shingle sets, and the pairs linked."""
    w = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or {()}:
            holders[g].append(i)
    common = defaultdict(int)
    for h in holders.values():
        for x, i in enumerate(h):
            for j in h[x + 1 :]:
                common[i, j] += 1
    pairs = [(i, j) for (i, j), n in common.items() if n >= similarity * (len(sets[i] | sets[j]) or 1) - 1e-9]
    root = list(range(len(rows)))
    for i, j in pairs:
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        root[max(i, j)] = min(i, j)
    for i in range(len(root)):
        root[i] = root[root[i]]
    return root, pairs


@pytest.mark.parametrize("block_rows", [5, 8192])
def test_classes_are_those_of_exact_similarity(spark, block_rows):
    docs = documents(spark, 600)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    root, pairs = exact_classes(rows)
    assert len(pairs) > 20
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in simhash.classes(docs, 5, 0.8, block_rows).collect()}
    assert got == {rows[i][0]: (rows[r][0], r == i) for i, r in enumerate(root)}


def test_a_large_group_of_near_copies_is_not_compared_pair_by_pair(spark):
    rng = np.random.default_rng(9)
    pool = [f"w{i}" for i in range(4000)]
    text = list(rng.choice(pool, 300))
    rows = [(0, " ".join(text))]
    for i in range(1, 300):
        copy = list(text)
        copy[rng.integers(300)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = simhash.shingle_sets(docs, 5)
    nodes = sets.select(F.col("row").alias("node"), "bands", "members")
    keys = nodes.select(F.explode("bands").alias("key"), "node")
    sent = []
    real = simhash.tile_jobs

    def seen(*args):
        jobs, edges = real(*args)
        sent.append(jobs.count())
        return jobs, edges

    simhash.tile_jobs = seen
    try:
        found = components(simhash.set_links(nodes, 0.8, block_rows=20)).collect()
    finally:
        simhash.tile_jobs = real
    assert len({r["component"] for r in found}) == 1
    assert len(found) == 300
    assert sent[0] < 0.1 * keys.count()


def test_classes_of_a_ladder_of_edits(spark):
    """Copies with ever more words changed: exactly those at 0.8 or more of some other copy hang together."""
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(40):
        text = list(rng.choice(pool, 200))
        for step in (0, 1, 3, 5, 8, 12):
            copy = list(text)
            for at in rng.choice(200, step, replace=False):
                copy[at] = str(rng.choice(pool))
            rows.append((10 * g + step % 10 + (step > 9) * 7, " ".join(copy)))
    root, pairs = exact_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = [got[rows[i][0]] == got[rows[j][0]] for i, j in pairs]
    assert np.mean(together) > 0.999
    apart = [(i, j) for i in range(len(rows)) for j in range(i) if root[i] != root[j] and got[rows[i][0]] == got[rows[j][0]]]
    assert not apart


def test_awkward_rows(spark):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_groups(awkward(spark)).collect()]
    assert len(got) == 11
    by_id = dict((i, (f, c)) for i, f, c in got)
    assert by_id[1][0] == by_id[2][0]
    assert by_id[2][1] == 1
    assert by_id[3] == by_id[4] == by_id[5] == (0, 3)
    assert by_id[None][1] is None
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.classes(awkward(spark)).count() == 11
    assert simhash.classes(empty(spark)).count() == 0


def test_repeated_ids_and_null_ids_keep_one_row_of_each_class(spark):
    a, b, x, y = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue cyan pink grey", "sun moon star sky sea land")
    rows = [(3, a), (5, a), (5, b), (7, x), (7, x), (None, a), (None, y), (None, y), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, hash int")
    got = [(r["doc_id"], r["text"]) for r in simhash.deduplicated(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (7, x), (None, y), (8, None)], key=str)
    assert simhash.deduplicated(docs).columns == docs.columns
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
    assert (5, 3) in near
    assert (None, 3) in near
    assert (None, None) in near


def test_a_dense_group_gives_a_forest_not_its_pairs(spark):
    fp = [0] + [1 << i for i in range(60)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fp], "fp long"), 2, 61, block_rows=8)
    assert edges.count() < 60 * 40
    assert {r["component"] for r in components(edges).collect()} == {0}


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 2), (None, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1}


def test_lines_that_repeat_inside_a_text_do_not_hide_near_copies(spark):
    rng = np.random.default_rng(11)
    pool = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(0, 240, 2):
        text, line = list(rng.choice(pool, 400)), list(rng.choice(pool, 12))
        if i % 4:
            other = list(rng.choice(pool, 12))
            pair = text + line * 10, text + other * 10
        else:
            pair = text + line, text + line * (10 + i % 3 * 15)
        rows += [(i + j, " ".join(t)) for j, t in enumerate(pair)]
    got = {r["doc_id"]: r["class_id"] for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(0, 240, 2) if got[i + 1] != i] == []
    assert all(got[i] == i for i in range(0, 240, 2))


@pytest.mark.parametrize(("size", "common"), [(5, 4), (9, 8), (36, 32), (90, 80), (450, 400)])
def test_radii_hold_pairs_at_the_least_similarity(size, common):
    rng = np.random.default_rng(size)
    other = common if size == 5 else size
    far = simhash.radii(0.8, simhash.size_class(size))
    apart = []
    for _ in range(1000):
        h = rng.integers(0, 2**63, size + other - common, dtype=np.uint64)
        a, b = simhash.wide_simhash(h[:size]), simhash.wide_simhash(h[-other:])
        n = np.bitwise_count(a ^ b)
        apart.append((int(n[0]), int(n.sum())))
    assert max(a for a, _ in apart) <= far[0] < 32
    assert max(b for _, b in apart) <= far[1] < 110
