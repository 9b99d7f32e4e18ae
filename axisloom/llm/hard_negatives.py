"""Hard negatives by exact search in a multiway hyperplane tree with distance ranges.

* A tree is fitted on a bounded sample: a node has a few split points, and a vector goes to the subtree of the nearest.
* Every row of the table is routed down the tree, and each node keeps, for each split point and each subtree, the least
  and the largest distance of that point to the subtree's rows, and the range of the rows' lengths; these are aggregated
  over all rows, so that pruning by them is exact.
* A query asks for scores within a window. With a subtree's range of lengths the window is an annulus of distances around
  the query; a subtree is left out if, for any split point, the distances that its range allows do not meet the annulus.
* The leaves that are left are compared exactly, in whole numbers. A first round searches a query's own leaf, which
  narrows its windows for the second.
* Rows with equal vectors and labels are one entry of the tree with its smallest ids: no list can hold more of them.

Leaves are searched in groups of bounded size, long ones in parts, each against the queries that ask for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisloom.llm.common import saved
from axisloom.plans.ship import shipped


@dataclass
class Settings:
    #: Distinct entries that the tree is fitted on, at most (about).
    sample_rows: int = 20_000
    #: Split points of a node.
    degree: int = 8
    #: A node of the tree has more than its share of so many rows of the whole table, and more than eight of the sample.
    leaf_rows: int = 4096
    #: Leaves are searched in groups of about so many entries, longer leaves in parts of this size.
    part_rows: int = 32_768
    seed: int = 5


class Tree:
    """points[k]: node k's split points; child[k][j]: a node if not negative, else leaf -1 - child.

    low, high[k][i, j]: distances of split point i to subtree j's rows; least, most[k][j]: their squared lengths.
    """

    def __init__(self) -> None:
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaves = 0

    @staticmethod
    def fitted(x: np.ndarray, leaf_rows: int, degree: int, seed: int) -> Tree:
        """x: distinct sample vectors. Split points of a node are far from each other, among a few times as many drawn."""
        t, rng = Tree(), np.random.default_rng(seed)

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf_rows:
                drawn = x[rng.choice(rows, min(len(rows), 4 * degree), replace=False)]
                far = distances(drawn, drawn[:1])[:, 0]
                picked = [0]
                while len(picked) < degree and far.max() > 0:
                    picked.append(int(far.argmax()))
                    far = np.minimum(far, distances(drawn, drawn[picked[-1:]])[:, 0])
                if len(picked) > 1:
                    k, p = len(t.points), drawn[picked]
                    t.points.append(p)
                    t.child.append([])
                    of = distances(x[rows], p).argmin(axis=1)
                    t.child[k] = [grow(rows[of == j]) for j in range(len(p))]
                    return k
            t.leaves += 1
            return -t.leaves

        if grow(np.arange(len(x))) < 0:  # all in one leaf: a node with one subtree
            t.points, t.child = [x[:1]], [[-1]]
        t.reset()
        return t

    def reset(self) -> None:
        size = [len(p) for p in self.points]
        self.low, self.high = [np.full((m, m), np.inf) for m in size], [np.full((m, m), -np.inf) for m in size]
        self.least, self.most = [np.full(m, np.inf) for m in size], [np.full(m, -np.inf) for m in size]

    def route(self, x: np.ndarray, note: bool = False) -> np.ndarray:
        """The leaf of each row; with note, the ranges on its way are widened to hold it."""
        leaf, norm, at = np.empty(len(x), np.int64), (x**2).sum(axis=1), [(0, np.arange(len(x)))]
        while at:
            k, rows = at.pop()
            d = distances(x[rows], self.points[k])
            of = d.argmin(axis=1)
            for j in np.unique(of).tolist():
                here = of == j
                if note:
                    self.low[k][:, j] = np.minimum(self.low[k][:, j], d[here].min(axis=0))
                    self.high[k][:, j] = np.maximum(self.high[k][:, j], d[here].max(axis=0))
                    self.least[k][j] = min(self.least[k][j], norm[rows[here]].min())
                    self.most[k][j] = max(self.most[k][j], norm[rows[here]].max())
                if self.child[k][j] < 0:
                    leaf[rows[here]] = -1 - self.child[k][j]
                else:
                    at.append((self.child[k][j], rows[here]))
        return leaf

    def visits(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for each leaf that may hold a row whose inner product with the query is from lo to hi."""
        found, norm, at = [(np.empty(0, np.int64),) * 2], (q**2).sum(axis=1), [(0, np.arange(len(q)))]
        while at:
            k, rows = at.pop()
            d = distances(q[rows], self.points[k])
            for j, child in enumerate(self.child[k]):
                if not np.isfinite(self.least[k][j]):
                    continue
                inner = np.sqrt((norm[rows] + self.least[k][j] - 2 * hi[rows]).clip(0))
                outer = norm[rows] + self.most[k][j] - 2 * lo[rows]
                live = outer >= 0
                outer = np.sqrt(outer.clip(0))
                nearest = np.maximum(d - self.high[k][:, j], self.low[k][:, j] - d).max(axis=1)
                farthest = (d + self.high[k][:, j]).min(axis=1)
                slack = 1e-9 * (1 + outer + np.where(np.isfinite(farthest), farthest, 0))
                live &= (nearest <= outer + slack) & (farthest >= inner - slack)
                if child < 0:
                    found.append((rows[live], np.full(int(live.sum()), -1 - child)))
                elif live.any():
                    at.append((child, rows[live]))
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of whole-numbered vectors: exact but for the root."""
    return np.sqrt(((x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * x @ p.T).clip(0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.int32).reshape(len(data), -1).astype(np.float64) if data else np.empty((0, 1))


def labelled_rows(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """(vec_id, label long, v binary of int32) of rows that take part: v is floor(scale * component), as doubles."""
    shipped(vectors.sparkSession)

    def run(batches):
        for b in batches:
            column = b.column("c")
            size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(column.offsets.to_numpy())) if len(b) else np.empty(0, np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size])).tolist()
            data = [np.floor(scale * flat[ends[i] - size[i] : ends[i]]) for i in fine]
            if any(x @ x >= 1 << 40 for x in data):
                raise ValueError("a vector is too long for exact scores")
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(fine, pa.int64())) for c in ("vec_id", "label")), pa.array([x.astype(np.int32).tobytes() for x in data], pa.binary())], ["vec_id", "label", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("c"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND c IS NOT NULL").mapInArrow(run, "vec_id long, label long, v binary")
    rows = saved(rows)
    length = rows.groupBy(F.length("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.length("v") == (length["d"] if length else 0))


def entries_of(rows: DataFrame, keep: int) -> DataFrame:
    """(uid, v, label, ids): one row for each distinct vector and label, with its `keep` smallest ids in order.

    Each task passes on a batch's smallest ids alone, so that a vector that many rows share moves a few times for a batch.
    """

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(["v", "label"]).aggregate([("vec_id", "distinct")])
            ids = [sorted(x)[:keep] for x in t.column("vec_id_distinct").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("v").combine_chunks().cast(pa.binary()), t.column("label").combine_chunks(), pa.array(ids, pa.list_(pa.int64()))], ["v", "label", "ids"])

    some = rows.mapInArrow(run, "v binary, label long, ids array<long>")
    one = some.groupBy("v", "label").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    return saved(one.select(F.monotonically_increasing_id().alias("uid"), "v", "label", "ids"))


def ranged(entries: DataFrame, tree: Tree) -> tuple[DataFrame, np.ndarray]:
    """Every entry with its leaf, stored, and the leaves' sizes; the tree gets its ranges, from all entries.

    What each task gives back for the ranges has the tree's size.
    """
    held = entries.sparkSession.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.route(matrix(b.column("v")))), *b.columns], ["leaf", *b.schema.names])

    def note(batches):
        t = held.value
        t.reset()
        for b in batches:
            for at in range(0, len(b), 4096):
                t.route(matrix(b.column("v").slice(at, 4096)), note=True)
        for k in range(len(t.points)):
            m = len(t.points[k])
            i, j = np.divmod(np.arange(m * m), m)
            cols = [np.full(m * m, k), i, j, t.low[k].ravel(), t.high[k].ravel(), t.least[k][j], t.most[k][j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "i", "j", "low", "high", "least", "most"])

    placed = saved(entries.mapInArrow(place, "leaf long, uid long, v binary, label long, ids array<long>"))
    found = placed.select("v").mapInArrow(note, "k long, i long, j long, low double, high double, least double, most double")
    for r in found.groupBy("k", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
        k, i, j = r["k"], r["i"], r["j"]
        tree.low[k][i, j], tree.high[k][i, j], tree.least[k][j], tree.most[k][j] = r["low"], r["high"], r["least"], r["most"]
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    return placed, sizes


class Search:
    """Queries against the leaves they ask for, by group of leaves and part."""

    def __init__(self, placed: DataFrame, tree: Tree, sizes: np.ndarray, part_rows: int):
        self.tree = placed.sparkSession.sparkContext.broadcast(tree)
        group, full = np.zeros(len(sizes), np.int64), sizes[0]
        for i in range(1, len(sizes)):
            new = full + sizes[i] > part_rows
            group[i], full = group[i - 1] + new, sizes[i] + (0 if new else full)
        parts = np.maximum(1, -(-np.bincount(group, weights=sizes).astype(np.int64) // part_rows))
        self.group, self.parts = group, parts
        of = F.element_at(F.array(*map(F.lit, group.tolist())), (F.col("leaf") + 1).cast("int"))
        cut = F.pmod(F.xxhash64("uid"), F.element_at(F.array(*map(F.lit, parts.tolist())), (F.col("group") + 1).cast("int")))
        self.rows = placed.withColumn("group", of).withColumn("part", cut)

    def hits(self, asks: DataFrame, same: bool, k: int, own: bool) -> DataFrame:
        """(uid, w, score, of, ids): for each query's window w, its k first entries of each leaf part among those of the same
        label, or of others; in its own leaf, or in all the others that the window may reach.

        asks: (uid, v, label, lo, hi), the last two arrays of doubles, a window for each position.
        """
        held, group, parts = self.tree, self.group, self.parts

        def probe(batches):
            for b in batches:
                for at in range(0, len(b), 2048):
                    piece = b.slice(at, 2048)
                    q = matrix(piece.column("v"))
                    home = held.value.route(q)
                    if own:
                        r, leaf = np.arange(len(q)), home
                    else:
                        lo, hi = np.array([min(x, default=np.inf) for x in piece.column("lo").to_pylist()]), np.array([max(x, default=-np.inf) for x in piece.column("hi").to_pylist()])
                        r, leaf = held.value.visits(q, lo, hi)
                        r, leaf = r[leaf != home[r]], leaf[leaf != home[r]]
                    order = np.lexsort((leaf, group[leaf], r))
                    r, leaf = r[order], leaf[order]
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(group[leaf]) != 0)])) if len(r) else np.empty(0, np.int64)
                    wanted = np.split(leaf, first[1:])
                    of = group[leaf[first]]
                    again = np.repeat(np.arange(len(first)), parts[of])
                    part = np.arange(len(again)) - np.repeat(np.cumsum(parts[of]) - parts[of], parts[of])
                    taken = piece.take(pa.array(r[first][again], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(of[again], pa.int64()), pa.array(part, pa.int64()), *taken.columns, pa.array([wanted[i] for i in again], pa.list_(pa.int64()))], ["group", "part", *taken.schema.names, "wanted"])

        def compare(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            asking = rows.column("wanted").is_valid().to_numpy()
            ask, data = rows.filter(pa.array(asking)), rows.filter(pa.array(~asking))
            first = data.column("ids").combine_chunks()
            first = first.flatten().to_numpy()[first.offsets.to_numpy()[:-1] - first.offsets[0].as_py()] if len(data) else np.empty(0, np.int64)
            data = data.take(pa.array(np.lexsort((first, data.column("leaf").to_numpy()))))
            x, label, leaf = matrix(data.column("v")), data.column("label").to_numpy(), data.column("leaf").to_numpy()
            q, own_label = matrix(ask.column("v")), ask.column("label").to_numpy()
            width = max([0, *map(len, ask.column("lo").to_pylist())])
            lo, hi = (np.array([[*w, *[empty] * (width - len(w))] for w in ask.column(c).to_pylist()]).reshape(len(q), width) for c, empty in (("lo", np.inf), ("hi", -np.inf)))
            wanted = [np.array(w, np.int64) for w in ask.column("wanted").to_pylist()]
            who, what = np.repeat(np.arange(len(q)), list(map(len, wanted))), np.concatenate([np.empty(0, np.int64), *wanted])
            found = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
            for i in np.unique(what).tolist():
                a = who[what == i]
                m = np.arange(np.searchsorted(leaf, i), np.searchsorted(leaf, i, "right"))
                for at in range(0, len(a) if len(m) else 0, 256):
                    c = a[at : at + 256]
                    scores = np.where((label[m] == own_label[c, None]) == same, q[c] @ x[m].T, -np.inf)
                    for w in range(width):
                        live = np.where((scores >= lo[c, w, None]) & (scores <= hi[c, w, None]), scores, -np.inf)
                        for row, col, score in firsts(live, k):
                            found.append((c[row], np.full(len(row), w), m[col], score))
            a, w, b, score = (np.concatenate([f[i] for f in found]) for i in range(4))
            return pa.table({"uid": ask.column("uid").take(pa.array(a)), "w": pa.array(w.astype(np.int32)), "score": pa.array(score.astype(np.int64)), "of": data.column("uid").take(pa.array(b)), "ids": data.column("ids").take(pa.array(b))})

        names = ["group", "part", "leaf", "uid", "v", "label", "ids"]
        probes = asks.select("uid", "v", "label", "lo", "hi").mapInArrow(probe, "group long, part long, uid long, v binary, label long, lo array<double>, hi array<double>, wanted array<long>")
        both = self.rows.select(*names).unionByName(probes, allowMissingColumns=True)
        return both.groupBy("group", "part").applyInArrow(compare, "uid long, w int, score long, of long, ids array<long>")


def firsts(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, scores) of each row's first, second, ... k-th largest; the first column of equals. Overwrites scores."""
    rows = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        col = scores.argmax(axis=1)
        best = scores[rows, col]
        live = np.isfinite(best)
        if not live.any():
            return
        yield rows[live], col[live], best[live]
        scores[rows, col] = -np.inf


def top(hits: DataFrame, k: int) -> DataFrame:
    """(uid, w, found): the k first ids of each query and window as (rank, id, score, of), in order; of is the id's entry."""
    best = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "id", "of")
    one = hits.select("uid", "w", "score", "of", F.explode("ids").alias("id")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return one.groupBy("uid", "w").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "of"))).alias("found"))


def mined(vectors: DataFrame, modulus: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, label: Column | None = None, settings: Settings | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of each anchor and positive.

    Scores are inner products of floor(scale * component), in whole numbers; higher ones come first, ties by smaller vec_id.
    Anchors are rows whose vec_id is divisible by modulus; an anchor's positives are its first other rows of the same label,
    and the negatives of both are the first rows of other labels with low * positive <= 100 * negative <= high * positive
    (so none for a positive score below zero). label: the label's column, `label` by default.

    Rows with a null id or label, or a vector that is null, empty, of another than the most frequent length, or that holds
    nulls or non-finite values, take no part; a zero vector does. Rows repeated whole count once; of different rows with one
    id each is a row of its own. An empty table gives no rows; other columns are ignored. Scores are exact; a vector whose
    scaled squared length is 2^40 or more is an error.
    """
    s, spark = settings or Settings(), vectors.sparkSession
    rows = labelled_rows(vectors, scale, F.col("label") if label is None else label)
    entries = entries_of(rows, positives + 1)
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    share = min(1.0, s.sample_rows / n)
    sample = entries if share == 1 else entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    fit_on = matrix(sample.select("v").distinct().orderBy("v").toArrow().column("v"))
    if not len(fit_on):
        fit_on = matrix(entries.select("v").limit(1).toArrow().column("v"))
    tree = Tree.fitted(fit_on, max(8, round(s.leaf_rows * len(fit_on) / n)), s.degree, s.seed)
    placed, sizes = ranged(entries, tree)
    search = Search(placed, tree, sizes, s.part_rows)
    anchors = rows.where(F.col("vec_id") % modulus == 0).distinct().join(entries.select("uid", "v", "label"), ["v", "label"]).select(F.col("vec_id").alias("anchor_id"), "uid")
    anchors = saved(anchors)
    asked = saved(entries.join(anchors.select("uid").distinct(), "uid", "left_semi").select("uid", "v", "label"))

    def both_rounds(asks: DataFrame, same: bool, k: int) -> DataFrame:
        own = saved(search.hits(asks, same, k, own=True))
        # A window that has k ids already need not look below the last of them.
        last = top(own, k).where(F.size("found") >= k).select("uid", F.struct("w", F.element_at("found", -1)["score"].cast("double").alias("s")).alias("x"))
        last = last.groupBy("uid").agg(F.map_from_entries(F.collect_list("x")).alias("last"))
        narrow = asks.join(last, "uid", "left").withColumn("lo", F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.element_at("last", i), x))))
        return top(own.unionByName(search.hits(narrow, same, k, own=False)), k)

    every = asked.withColumn("lo", F.array(F.lit(float("-inf")))).withColumn("hi", F.array(F.lit(float("inf"))))
    found = saved(both_rounds(every, True, positives + 1).select("uid", F.col("found").alias("positives")))
    p = F.array_sort(F.array_distinct(F.transform("positives", lambda x: x["score"])))
    bounds = F.transform(F.filter(p, lambda x: x >= 0), lambda x: F.struct(x.alias("p"), F.ceil(F.lit(low) * x / 100).cast("double").alias("lo"), F.floor(F.lit(high) * x / 100).cast("double").alias("hi")))
    windows = saved(found.select("uid", F.filter(bounds, lambda x: x["lo"] <= x["hi"]).alias("windows")).where(F.size("windows") > 0))
    asks = asked.join(windows, "uid").select("uid", "v", "label", F.col("windows.lo").alias("lo"), F.col("windows.hi").alias("hi"))
    mined_ = both_rounds(asks, False, negatives).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "found"))).alias("negatives"))
    result = saved(found.join(windows, "uid").join(mined_, "uid"))
    others = F.slice(F.filter("positives", lambda x: (x["of"] != F.col("uid")) | (x["id"] != F.col("anchor_id"))), 1, positives)
    out = anchors.join(result, "uid")
    out = out.select("anchor_id", "windows", "negatives", F.explode(others).alias("x"))
    out = out.select("anchor_id", F.col("x.id").alias("positive_id"), F.col("x.score").alias("positive_score"), "negatives", (F.array_position(F.col("windows.p"), F.col("x.score")) - 1).cast("int").alias("w"))
    out = out.where("w >= 0").select("anchor_id", "positive_id", "positive_score", F.explode(F.element_at("negatives", F.col("w"))).alias("y"))
    return out.select("anchor_id", "positive_id", F.col("y.rank").cast("int").alias("rank"), F.col("y.id").alias("negative_id"), "positive_score", F.col("y.score").alias("negative_score"))

