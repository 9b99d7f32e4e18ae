"""Whitening of embeddings, with the covariance by polarisation.

Sums of squares are all that is aggregated: of every dimension's centred values, and of the centred values of the sum of
every pair of dimensions. As var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of variances give every covariance.
The components are integers, and so are all sums, which makes the covariance exact up to the last division; its
eigenvectors are numpy's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm.common import saved
from axisloom.plans.ship import shipped

#: Components become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Larger values than this cannot be squared and summed in whole numbers here, and are an error.
MOST = 1 << 40


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x binary of int64): vectors without nulls, NaN or infinities, of the most frequent length (the smaller of equals)."""
    shipped(vectors.sparkSession)

    def run(batches):
        for b in batches:
            column = b.column("c")
            size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(column.offsets.to_numpy())) if len(b) else np.empty(0, np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]))
            taken = [flat[ends[i] - size[i] : ends[i]] for i in fine.tolist()]
            if any(np.abs(x).max() >= MOST / SCALE for x in taken):
                raise ValueError(f"a component is {MOST // SCALE} or more, too large to be summed exactly")
            data = [(np.floor(SCALE * x).astype(np.int64) + SHIFT).tobytes() for x in taken]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(fine, pa.int64())), pa.array(data, pa.binary())], ["vec_id", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")).where("embedding IS NOT NULL")
    rows = saved(rows.mapInArrow(run, "vec_id long, x binary"))
    length = rows.groupBy(F.length("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.length("x") == (length["d"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.int64).reshape(len(data), -1)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, S): rows and each dimension's sum."""

    def run(batches):
        n, s = 0, [0] * d
        for b in batches:
            if len(b):
                n, s = n + len(b), [a + int(x) for a, x in zip(s, matrix(b.column("x")).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array(map(str, [n, *s]))], ["i", "s"])

    got = {r["i"]: int(r["s"]) for r in rows.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def squares(rows: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums of y_i^2 at (i, i), and of (y_i + y_j)^2 at (i, j) with i < j, for y = x - centre.

    Each task sums its own rows, in whole numbers; Spark adds the tasks' d * (d + 1) / 2 sums.
    """
    d = len(centre)
    mid = np.array(centre, np.int64)

    def run(batches):
        held = np.zeros((d, d), object)
        for b in batches:
            for at in range(0, len(b), 2048):
                y = np.ascontiguousarray((matrix(b.column("x").slice(at, 2048)) - mid).T)
                # A square must fit 64 bits, and so must the sum of a piece's squares; larger values are summed as Python's numbers.
                y = y if np.abs(y).max(initial=0) < 1 << 24 else y.astype(object)
                for i in range(d):
                    held[i, i] += int((y[i] * y[i]).sum())
                    pair = y[i + 1 :] + y[i]
                    held[i, i + 1 :] += (pair * pair).sum(axis=1).astype(object) if len(pair) else 0
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(str, held[i, j]))], ["i", "j", "s"])

    found = rows.select("x").mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in found.collect()}


@dataclass
class Whitening:
    """n rows with sums S, and the components: unit eigenvectors by falling eigenvalue, those with a variance alone."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def trace(self) -> float:
        return float(np.trace(self.covariance))


def fit(rows: DataFrame) -> Whitening:
    """rows: (x binary) of whole_vectors. The driver holds d * (d + 1) / 2 numbers."""
    first = rows.select("x").first()
    d = len(first["x"]) // 8 if first else 0
    n, s = sums(rows, d) if d else (0, [])
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    centre = [x // n for x in s]
    rest = [x - n * c for x, c in zip(s, centre, strict=True)]
    found = squares(rows, centre)
    # n^2 times the variance of y, or of a pair's sum: n * (sum of squares) - (sum)^2, in whole numbers.
    own = [n * found[i, i] - rest[i] ** 2 for i in range(d)]
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            pair = n * found[i, j] - (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (pair - own[i] - own[j]) / (2 * n**2)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0) * d * 1e-13
    return Whitening(n, s, v, values[real], vectors[:, real])


def whitened(vectors: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    The covariance V is that of all rows, divisor n. deviation: the row's exact sum over dimensions of (n * x - S)^2,
    null where that is no 64-bit number; whitened: (x - S / n) on the component, over the root of its eigenvalue e;
    explained: e / trace(V); identity_error: the largest absolute entry of the covariance of the whitened columns, taken
    from all their rows, minus the identity.

    Rows whose vector is null, empty, holds nulls or non-finite values, or has another than the most frequent length take no
    part; a null vec_id is kept. Repeated rows count as often as they come and give repeated rows. Components without a
    variance (all, for one row or equal rows) cannot be whitened and are left out; there are no more than dimensions. An
    empty table gives no rows; columns other than vec_id and embedding are ignored.
    """
    rows = whole_vectors(vectors)
    w = fit(rows)
    c = min(components, len(w.values))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not c:
        return vectors.sparkSession.createDataFrame([], schema)
    project = w.vectors[:, :c] / np.sqrt(w.values[:c])
    centre = [x // w.n for x in w.sums]
    part = np.array([(x - w.n * m) / w.n for x, m in zip(w.sums, centre, strict=True)])
    mid, n, total = np.array(centre, np.int64), w.n, list(w.sums)

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 4096):
                x = matrix(b.column("x").slice(at, 4096))
                y = x - mid
                scores = (y - part) @ project
                far = np.abs(n * y.astype(np.float64) - part * n)
                if far.size and (far**2).sum(axis=1).max() < 2.0**62:  # then all of it fits, and so do the products
                    dev = ((n * y - (np.array([s - n * m for s, m in zip(total, centre, strict=True)], np.int64))) ** 2).sum(axis=1).tolist()
                else:
                    dev = [sum((n * int(v) - s) ** 2 for v, s in zip(r, total, strict=True)) for r in x]
                    dev = [v if v < 1 << 63 else None for v in dev]
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(at, len(x)), pa.array(dev, pa.int64()), pa.array(scores.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    projected = saved(rows.mapInArrow(run, "vec_id long, deviation long, w array<double>"))

    def products(batches):
        held, mean = np.zeros((c, c)), np.zeros(c)
        for b in batches:
            x = np.array(b.column("w").to_pylist()).reshape(-1, c)
            held, mean = held + x.T @ x, mean + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([*(held / n).ravel(), *(mean / n)]), pa.array(range(c * c + c), pa.int32())], ["p", "at"])

    got = {r["at"]: r["p"] for r in projected.select("w").mapInArrow(products, "p double, at int").groupBy("at").agg(F.sum("p").alias("p")).collect()}
    mean = np.array([got[c * c + i] for i in range(c)])
    cov = np.array([got[i] for i in range(c * c)]).reshape(c, c) - np.outer(mean, mean)
    error = float(np.abs(cov - np.eye(c)).max())
    explained = F.element_at(F.array(*(F.lit(float(e / w.trace())) for e in w.values[:c])), F.col("component"))
    out = projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    return out.select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
