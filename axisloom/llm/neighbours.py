"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

* Centroids are fitted by k-means with a penalty on full lists, on a bounded sample of distinct vectors.
* Vectors get one more component, so that the largest inner product is the smallest distance (the component fills every
  vector up to the largest norm; a query's is zero).
* Centroids are searched through an in-memory graph (each one's nearest, and back) by beam search.
* A vector goes to its nearest list and, near a boundary, to a second one; a query searches the lists whose distance is
  within a ratio of its nearest, and scores the vectors of these lists alone.
* The ratio is fitted: a bounded sample of queries is held against all vectors, and it is the smallest ratio that finds
  the share `target` of their true neighbours. So recall does not fall as lists get finer; where vectors have no
  structure that lists could follow, the ratio is large and the work nears that of brute force.
* Equal vectors are one entry of the index, with the smallest ids among them: no list of top results can hold more of
  their ids than it has places, so a group of copies of any size costs one row and loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.llm.common import saved
from axisloom.plans.ship import shipped


@dataclass
class Settings:
    #: Distinct vectors that the centroids are fitted on, at most (about); lists are the root of all vectors, but no more
    #: than a quarter of these.
    sample_rows: int = 20_000
    #: A vector is also put into lists within this ratio of its nearest centroid's distance, `copies` lists at most.
    boundary: float = 1.005
    copies: int = 2
    #: The share of true neighbours that the ratio of a query's lists is fitted to find, on about so many queries.
    target: float = 0.925
    trials: int = 256
    #: The ratio itself, if it is not to be fitted.
    ratio: float | None = None
    #: Lists are searched in groups of about so many vectors, longer lists in parts of this size.
    part_rows: int = 20_000
    degree: int = 16
    rounds: int = 10


def fitted(x: np.ndarray, k: int, rounds: int, seed: int = 3) -> np.ndarray:
    """k-means centroids; each round raises the price of lists with more than their share."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    price = np.zeros(k)
    for _ in range(rounds):
        best = np.empty(len(x), np.int64)
        scale = 1e-12
        for i in range(0, len(x), 4096):
            d = ((x[i : i + 4096] ** 2).sum(1)[:, None] - 2 * x[i : i + 4096] @ c.T + (c**2).sum(1)).clip(0)
            scale = max(scale, float(np.median(d.min(1))))
            best[i : i + 4096] = (d + price).argmin(1)
        n = np.bincount(best, minlength=k)
        price = (price + 0.1 * scale * (n * k / len(x) - 1)).clip(0)
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


class CentroidGraph:
    """Beam search over a graph of each centroid's nearest ones, edges both ways."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.c, k = centroids, len(centroids)
        degree = min(degree, k - 1)
        edges: list[set[int]] = [set() for _ in range(k)]
        for i in range(k):
            near = np.argsort(((centroids - centroids[i]) ** 2).sum(1), kind="stable")
            for j in near[near != i][:degree]:
                edges[i].add(int(j))
                edges[int(j)].add(i)
        width = max(map(len, edges), default=0)
        self.edges = np.array([[*sorted(e), *[i] * (width - len(e))] for i, e in enumerate(edges)], np.int64).reshape(k, width)
        self.entry = np.unique(np.linspace(0, k - 1, min(k, max(8, int(k**0.5)))).astype(np.int64))

    def all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of all centroids for each query, nearest first."""
        cost = (self.c**2).sum(1) - 2 * q @ self.c.T
        found = np.argsort(cost, axis=1, kind="stable")
        return found, np.sqrt((np.take_along_axis(cost, found, 1) + (q**2).sum(1)[:, None]).clip(0))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of `beam` centroids near each query, nearest first."""
        k, n = len(self.c), len(q)
        beam = min(beam, k)
        norm = (self.c**2).sum(1)
        cost = norm[self.entry] - 2 * q @ self.c[self.entry].T
        found = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf)
        take = min(beam, len(self.entry))
        first = np.argsort(cost, axis=1, kind="stable")[:, :take]
        found[:, :take], far[:, :take] = self.entry[first], np.take_along_axis(cost, first, 1)
        seen = np.zeros((n, k), bool)
        seen[:, self.entry] = True
        opened = np.zeros((n, beam), bool)
        rows = np.arange(n)
        while True:
            ahead = np.where(opened | (found < 0), np.inf, far)
            at = ahead.argmin(1)
            live = np.isfinite(ahead[rows, at])
            if not live.any():
                break
            r = rows[live]
            opened[r, at[live]] = True
            around = self.edges[found[r, at[live]]]
            new = ~seen[r[:, None], around]
            seen[r[:, None], around] = True
            cost = np.where(new, norm[around] - 2 * np.einsum("rd,rwd->rw", q[r], self.c[around]), np.inf)
            same = np.concatenate([np.zeros((len(r), 1), bool), np.diff(np.sort(around, 1), axis=1) == 0], 1)
            if same.any():  # padding repeats a node that was seen already; keep the first of any that was not
                order = np.argsort(around, axis=1, kind="stable")
                back = np.empty_like(same)
                np.put_along_axis(back, order, same, 1)
                cost = np.where(back, np.inf, cost)
            ids, d = np.concatenate([found[r], around], 1), np.concatenate([far[r], cost], 1)
            was = np.concatenate([opened[r], np.zeros(around.shape, bool)], 1)
            best = np.argsort(d, axis=1, kind="stable")[:, :beam]
            far[r] = np.take_along_axis(d, best, 1)
            found[r] = np.where(np.isfinite(far[r]), np.take_along_axis(ids, best, 1), -1)
            opened[r] = np.take_along_axis(was, best, 1)
        return found, np.sqrt((far + (q**2).sum(1)[:, None]).clip(0))

    def within(self, q: np.ndarray, ratio: float, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(query, centroid) pairs whose distance is within the ratio of the query's nearest; the beam widens until it holds them all."""
        left, out = np.arange(len(q)), []
        while len(left):
            found, far = self.search(q[left], beam)
            near = (found >= 0) & (far <= ratio * far[:, :1])
            done = ~near[:, -1] | (beam >= len(self.c))
            r, c = np.nonzero(near & done[:, None])
            out.append((left[r], found[r, c]))
            left, beam = left[~done], 2 * beam
        return tuple(np.concatenate([np.empty(0, np.int64), *(o[i] for o in out)]) for i in (0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v binary, norm double): vectors with an id, without nulls, NaN or infinities, not all zero, of one length.

    v: the components as doubles, a negative zero as zero. That length is the most frequent one (the smaller of equals).
    """
    shipped(vectors.sparkSession)

    def run(batches):
        for b in batches:
            column = b.column("embedding")
            size = np.diff(column.offsets.to_numpy()) if len(b) else np.empty(0, np.int64)
            flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
            size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            any_ = np.concatenate([[0], np.cumsum(flat != 0)])
            fine = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]) & (any_[ends] > any_[ends - size])).tolist()
            held = [flat[ends[i] - size[i] : ends[i]] for i in fine]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(fine, pa.int64())), pa.array([x.tobytes() for x in held], pa.binary()), pa.array([float(x @ x) ** 0.5 for x in held], pa.float64())], ["vec_id", "v", "norm"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.mapInArrow(run, "vec_id long, v binary, norm double")
    length = rows.groupBy(F.length("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.length("v") == (length["d"] if length else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1) if data else np.empty((0, 1))


def filled(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt((top**2 - (x**2).sum(1)).clip(0))[:, None]], 1)


def asking(x: np.ndarray, top: float) -> np.ndarray:
    """Queries of the largest norm, with zero as the component that is filled up."""
    return np.concatenate([x * (top / np.sqrt((x**2).sum(1)))[:, None], np.zeros((len(x), 1))], 1)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores, and what equals the last of these up to rounding."""
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if k < scores.shape[1] else scores.min(axis=1)
    return np.nonzero(scores >= (least - 1e-9 * (1 + np.abs(least)))[:, None])


def fitted_ratio(entries: DataFrame, graph: CentroidGraph, top: float, k: int, s: Settings, post) -> float:
    """The ratio with which about `trials` sampled vectors find the share `target` of their k nearest others.

    Every task holds the sample against its vectors and passes on the best of each batch; the driver gets k rows a query.
    """
    n = entries.count()
    trial = entries.select("v").where(F.pmod(F.xxhash64("uid", F.lit(17)), F.lit(1 << 30)) <= int(min(1.0, s.trials / n) * (1 << 30))).orderBy("v").limit(4 * s.trials).toArrow()
    ask = entries.sparkSession.sparkContext.broadcast(matrix(trial.column("v")))
    if not len(ask.value) or len(graph.c) == 1:
        return 1.0

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 4096):
                x = matrix(b.column("v").slice(at, 4096))
                scores = ask.value @ x.T
                r, c = best_of(scores, min(k + 1, len(x)))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(scores[r, c]), b.column("uid").slice(at, 4096).take(pa.array(c))], ["q", "score", "uid"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "uid")
    best = entries.select("uid", "v").mapInArrow(run, "q long, score double, uid long").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    # k + 1 rows for each of 4 * trials queries at most.
    found = entries.select("uid", "v").join(F.broadcast(saved(best.select("q", "uid"))), "uid").select("q", "v").toArrow()
    q, x = found.column("q").to_numpy(), matrix(found.column("v"))
    other = np.any(ask.value[q] != x, axis=1)
    q, x = q[other], x[other]
    far = np.sqrt(((graph.c**2).sum(1) - 2 * asking(ask.value, top) @ graph.c.T + top**2).clip(0))
    row, lists = post(graph, filled(x, top))
    need = np.full(len(x), np.inf)
    np.minimum.at(need, row, far[q[row], lists] / np.maximum(far.min(1)[q[row]], 1e-300))
    return float(np.quantile(need, s.target, method="higher")) * (1 + 1e-9) if len(need) else 1.0


def nearest(vectors: DataFrame, modulus: int = 20, k: int = 20, settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row whose vec_id is divisible by modulus.

    Nearness is the inner product in double precision of the vectors as given; ties go to the smaller vec_id; a query's
    own id is no candidate; with fewer than k candidates in its lists these are given. Rows with a null id, or a vector
    that is null, zero, of another length or holds nulls or non-finite values, take no part; rows repeated whole count
    once; an empty table gives no rows; columns other than vec_id and embedding are ignored.
    """
    s = settings or Settings()
    spark, keep = vectors.sparkSession, k + 1
    rows = saved(usable(vectors))
    one = Window.partitionBy("v").orderBy("vec_id")
    fewest = rows.withColumn("rank", F.dense_rank().over(one)).where(F.col("rank") <= keep).groupBy("v", "vec_id").agg(F.lit(1).alias("x"))
    entries = saved(fewest.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("uid", F.col("ids")[0]))
    n, top = entries.count(), float(rows.agg(F.max("norm").alias("top")).first()["top"] or 0.0)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = min(1.0, s.sample_rows / n)
    sample = entries if part == 1.0 else entries.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(part * (1 << 30)))
    fit_on = filled(matrix(sample.select("uid", "v").toArrow().sort_by("uid").column("v")), top)
    graph = CentroidGraph(fitted(fit_on, max(1, min(round(n**0.5), len(fit_on) // 4)), s.rounds), s.degree)

    def posted(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that a vector goes to."""
        found, far = graph.search(x, 16)
        near = (far <= s.boundary * far[:, :1]) & (found >= 0)
        near[:, s.copies :] = False
        near[:, 0] = True
        r, c = np.nonzero(near)
        return r, found[r, c]

    ratio = s.ratio or fitted_ratio(entries, graph, top, k, s, posted)
    held = spark.sparkContext.broadcast(graph)

    def post(batches):
        for b in batches:
            for at in range(0, len(b), 2048):
                piece = b.slice(at, 2048)
                r, lists = posted(held.value, filled(matrix(piece.column("v")), top))
                yield pa.RecordBatch.from_arrays([pa.array(lists), *(x for x in piece.take(pa.array(r)).columns)], ["list", "uid", "v", "ids"])

    lists = saved(entries.select("uid", "v", "ids").mapInArrow(post, "list long, uid long, v binary, ids array<long>"))
    sizes = np.zeros(len(graph.c), np.int64)
    for r in lists.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    # Short lists are searched together, so that a query goes to a group once, however many of its lists it asks for.
    group, filled_to = np.zeros(len(sizes), np.int64), sizes[0]
    for i in range(1, len(sizes)):
        new = filled_to + sizes[i] > s.part_rows
        group[i], filled_to = group[i - 1] + new, sizes[i] + (0 if new else filled_to)
    parts = np.maximum(1, -(-np.bincount(group, weights=sizes).astype(np.int64) // s.part_rows))

    def probe(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                piece = b.slice(at, 512)
                r, c = held.value.within(asking(matrix(piece.column("v")), top), ratio)
                order = np.lexsort((c, group[c], r))
                r, c = r[order], c[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(group[c]) != 0)]))
                wanted = np.split(c, first[1:])
                of = group[c[first]]
                again = np.repeat(np.arange(len(first)), parts[of])
                segment = np.arange(len(again)) - np.repeat(np.cumsum(parts[of]) - parts[of], parts[of])
                taken = piece.take(pa.array(r[first][again]))
                yield pa.RecordBatch.from_arrays([pa.array(of[again]), pa.array(segment), taken.column("uid"), taken.column("v"), pa.array([wanted[i] for i in again], pa.list_(pa.int64()))], ["group", "part", "uid", "v", "wanted"])

    queries = rows.where(F.col("vec_id") % modulus == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = saved(queries.join(entries.select("v", "uid"), "v").select("query_id", "uid", "v"))
    probes = asked.select("uid", "v").dropDuplicates(["uid"]).mapInArrow(probe, "group long, part long, uid long, v binary, wanted array<long>")

    def place(batches):
        for b in batches:
            of = group[b.column("list").to_numpy()]
            uid = b.column("uid").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            cut = (uid % parts[of].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(cut), *b.columns], ["group", "part", *b.schema.names])

    placed = lists.mapInArrow(place, "group long, part long, list long, uid long, v binary, ids array<long>")

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        asks = rows.column("wanted").is_valid().to_numpy()
        uid, x = rows.column("uid").to_numpy(), matrix(rows.column("v"))
        q, here = np.flatnonzero(asks), np.flatnonzero(~asks)
        wanted = [np.array(w, np.int64) for w in rows.column("wanted").take(pa.array(q)).to_pylist()]
        who, what = np.repeat(q, list(map(len, wanted))), np.concatenate([np.empty(0, np.int64), *wanted])
        of = rows.column("list").fill_null(-1).to_numpy()[here]
        here, of = here[np.argsort(of, kind="stable")], np.sort(of)
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
        for i in np.unique(what).tolist():
            a = who[np.searchsorted(what, i) : np.searchsorted(what, i, "right")]
            m = here[np.searchsorted(of, i) : np.searchsorted(of, i, "right")]
            for at in range(0, len(a) if len(m) else 0, 1024):
                r, c = best_of(x[a[at : at + 1024]] @ x[m].T, min(keep, len(m)))
                found.append((a[at + r], m[c]))
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        score = np.concatenate([np.empty(0), *((x[a[i : i + 65536]] * x[b[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536))])
        order = np.lexsort((uid[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(uid[b]) != 0)]) if len(a) else np.empty(0, bool)
        a, b, score = a[new], b[new], score[new]
        start = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0])) if len(a) else np.empty(0, np.int64)
        top_k = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < keep
        a, b, score = a[top_k], b[top_k], score[top_k]
        return pa.table({"uid": pa.array(uid[a]), "ids": rows.column("ids").take(pa.array(b)), "score": pa.array(score)})

    both = placed.unionByName(probes, allowMissingColumns=True)
    hits = both.groupBy("group", "part").applyInArrow(search, "uid long, ids array<long>, score double").dropDuplicates(["uid", "score", "ids"])
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("ids")[0])
    hits = hits.withColumn("at", F.row_number().over(best)).where(F.col("at") <= keep).select("uid", "score", F.explode("ids").alias("vec_id"))
    answers = asked.select("query_id", "uid").join(hits, "uid").where("vec_id != query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
