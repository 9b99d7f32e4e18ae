"""The hidden Markov chain along the regions, as a blocked scan.

A chain is cut into blocks of consecutive regions. Pass 1 gives each block's K x K transfer matrix; an associative scan
over these matrices, level by level as grouped Spark jobs, gives the exact vectors that come into each block from both
sides; pass 2 runs all blocks between their vectors. Nothing that grows with the axis is collected or broadcast. With
boundary="restart" each block is a chain of its own that begins with the start vector, and pass 1 falls away.

Several models run over one axis at once, each with its own likelihoods and chain: `track` names the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.plans.scratch import stored
from axisloom.plans.ship import shipped


@dataclass
class Chain:
    """Start vector and transition matrix; kept on the driver, K and K x K numbers."""

    start: np.ndarray
    trans: np.ndarray

    @staticmethod
    def uniform(n_states: int) -> Chain:
        return Chain(np.full(n_states, 1 / n_states), np.full((n_states, n_states), 1 / n_states))

    def stationary(self) -> np.ndarray:
        """The left eigenvector of eigenvalue 1, summing to 1."""
        values, vectors = np.linalg.eig(self.trans.T)
        v = np.real(vectors[:, np.argmin(np.abs(values - 1))])
        return v / v.sum()

    def check(self) -> None:
        k = len(self.start)
        if self.trans.shape != (k, k):
            raise ValueError("the transition matrix has another number of states than the start vector")
        for p in (self.start, *self.trans):
            if (p < 0).any() or not np.isclose(p.sum(), 1):
                raise ValueError("probabilities must not be negative and must sum to 1")


def log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def blocked(likelihood: DataFrame, n_states: int, block_rows: int, chain_of: DataFrame | None = None) -> DataFrame:
    """(track, chain, block, ridx, ll array): a row for each region of each track, states in order.

    likelihood: (ridx, ll array), or (ridx, state, ll) with a row for each state; and track, where there are several.
    chain_of: (ridx, chain) cuts the axis into chains, such as chromosomes; otherwise there is one, named "".
    """
    shipped(likelihood.sparkSession)
    wide = likelihood if "track" in likelihood.columns else likelihood.withColumn("track", F.lit(""))
    if "state" in wide.columns:
        wide = wide.groupBy("track", "ridx").agg(F.array_sort(F.collect_list(F.struct("state", "ll"))).alias("x")).select("track", "ridx", F.transform("x", lambda s: s["ll"]).alias("ll"))
    wide = wide.withColumn("chain", F.lit("")) if chain_of is None else wide.join(chain_of.select("ridx", "chain"), "ridx")
    return wide.select("track", "chain", F.expr(f"ridx div {block_rows}").alias("block"), "ridx", "ll")


def _ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ridx, likelihoods) in the order of the regions."""
    ridx, ll = rows.column("ridx").to_numpy(), rows.column("ll").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ridx, kind="stable")
    return ridx[order], ll.reshape(len(ridx), -1)[order]


def _numbers(x: np.ndarray | None) -> bytes | None:
    return None if x is None else np.ascontiguousarray(x, float).tobytes()


def _vector(x: bytes | None) -> np.ndarray | None:
    return None if x is None else np.frombuffer(x, float)


def _transfer(ll: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log of the product of trans @ diag(exp(ll)) over rows; rescaled linear products, scales kept in logs."""
    q, scale = np.eye(len(trans)), np.zeros(len(trans))
    for x in ll:
        top = x.max()
        q = (q @ trans) * np.exp(x - top)
        s = q.sum(1)
        s[s == 0] = 1
        q /= s[:, None]
        scale += np.log(s) + top
    return log(q) + scale[:, None]


def _max_transfer(ll: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The same with the best path in place of the sum over paths."""
    a, m = log(trans), log(np.eye(len(trans)))
    for x in ll:
        m = (m[:, :, None] + a[None]).max(1) + x
    return m


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.where(np.isfinite(m := x.max(axis=axis, keepdims=True)), m, 0)
    return np.squeeze(log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top, axis=axis)


#: Blocks, or groups of them, that one task folds: the fan-out of the scan.
FAN = 64
KEYS = ["track", "chain", "block"]
_PARTS = "track string, chain string, block long, m binary, v binary"
_ENDS = "track string, chain string, block long, into binary, after binary, whole double"
_PICKS = "track string, chain string, block long, before int, last int"


@dataclass
class Algebra:
    """How vectors and matrices of logarithms are multiplied: by sums over paths, or by the best path."""

    best: bool = False

    def along(self, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        x = v[:, None] + m
        return x.max(axis=0) if self.best else _logsumexp(x, 0)

    def back(self, m: np.ndarray, w: np.ndarray) -> np.ndarray:
        x = m + w[None]
        return x.max(axis=1) if self.best else _logsumexp(x, 1)

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([self.along(row, b) for row in a])

    def total(self, v: np.ndarray) -> float:
        return float(v.max() if self.best else _logsumexp(v, 0))


def of_track(chains: Chain | dict[str, Chain], track: str) -> Chain:
    return chains if isinstance(chains, Chain) else chains[track]


def transfers(blocks: DataFrame, chains: Chain | dict[str, Chain], best: bool) -> DataFrame:
    """(track, chain, block, m, v): log transfer matrix of each block, and the log vector after it if a chain begins with it."""
    algebra, fold = Algebra(best), _max_transfer if best else _transfer

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        track, name, block = (k.as_py() for k in key)
        c, (_, ll) = of_track(chains, track), _ordered(rows)
        first, rest = fold(ll[:1], c.trans), fold(ll[1:], c.trans)
        m, v = algebra.after(first, rest), algebra.along(log(c.start) + ll[0], rest)
        return pa.table({"track": [track], "chain": [name], "block": [block], "m": [_numbers(m)], "v": [_numbers(v)]}, schema=_arrow(_PARTS))

    return blocks.groupBy(*KEYS).applyInArrow(one, _PARTS)


def _arrow(shape: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in shape.split(", "))])


def _children(rows: pa.Table) -> tuple[list[dict], list[np.ndarray], list[np.ndarray]]:
    """Rows in order, their matrices and their first vectors."""
    rows = rows.select(["track", "chain", "block", "m", "v"]).sort_by("block").to_pylist()
    v = [_vector(r["v"]) for r in rows]
    return rows, [_vector(r["m"]).reshape(len(x), -1) for r, x in zip(rows, v, strict=True)], v


def _levels(parts: DataFrame, best: bool) -> list[DataFrame]:
    """parts, and from each level the products over runs of FAN blocks, until one run holds a chain."""
    algebra = Algebra(best)

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        kids, m, v = _children(rows)
        whole, into = m[0], v[0]
        for x in m[1:]:
            whole, into = algebra.after(whole, x), algebra.along(into, x)
        return pa.table({"track": [kids[0]["track"]], "chain": [kids[0]["chain"]], "block": [kids[0]["block"] // FAN], "m": [_numbers(whole)], "v": [_numbers(into)]}, schema=_arrow(_PARTS))

    levels = [stored(parts)]
    most = levels[0].agg(F.max("block").alias("x")).first()["x"]
    while most is not None and most >= FAN:
        levels.append(stored(levels[-1].groupBy("track", "chain", F.expr(f"block div {FAN}")).applyInArrow(fold, _PARTS)))
        most //= FAN
    return levels


def _down(levels: list[DataFrame], whole_chain, within, shape: str) -> DataFrame:
    """From whole chains to their blocks: whole_chain(rows) for the last level, within(rows, of the group) for those before."""
    found = levels[-1].groupBy("track", "chain").applyInArrow(whole_chain, shape)
    for parts in reversed(levels[:-1]):
        group = parts.withColumn("grp", F.expr(f"block div {FAN}"))
        above = found.withColumnRenamed("block", "grp")
        found = group.groupBy("track", "chain", "grp").cogroup(above.groupBy("track", "chain", "grp")).applyInArrow(within, shape)
    return found


def boundaries(blocks: DataFrame, chains: Chain | dict[str, Chain]) -> DataFrame:
    """(track, chain, block, into, after, whole): the log vectors that come into each block from both sides.

    into is null for a chain's first block, which has the chain's log-likelihood in whole; so has no other.
    """
    algebra = Algebra()

    def between(rows: pa.Table, into: np.ndarray | None, after: np.ndarray | None) -> pa.Table:
        kids, m, v = _children(rows)
        ends = np.zeros(len(v[0])) if after is None else after
        came, now = [], into
        for x, first in zip(m, v, strict=True):
            came.append(now)
            now = first if now is None else algebra.along(now, x)
        gone = [ends]
        for x in m[:0:-1]:
            gone.append(algebra.back(x, gone[-1]))
        whole = [algebra.total((first if now is None else algebra.along(now, x)) + w) if now is None else None for x, first, now, w in zip(m, v, came, gone[::-1], strict=True)]
        return pa.table({k: [r[k] for r in kids] for k in KEYS} | {"into": [_numbers(x) for x in came], "after": [_numbers(x) for x in gone[::-1]], "whole": whole}, schema=_arrow(_ENDS))

    def within(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        r = above.to_pylist()[0]
        return between(rows, _vector(r["into"]), _vector(r["after"]))

    return _down(_levels(transfers(blocks, chains, False), False), lambda key, rows: between(rows, None, None), within, _ENDS)


def picked(blocks: DataFrame, chains: Chain | dict[str, Chain]) -> DataFrame:
    """(track, chain, block, before, last): the best path's state before each block (null for a chain's first) and at its end."""
    algebra = Algebra(True)

    def between(rows: pa.Table, before: int | None, last: int | None) -> pa.Table:
        kids, m, v = _children(rows)
        at = None
        if before is not None:
            at = np.full(len(v[0]), -np.inf)
            at[before] = 0.0
        came = []
        for x, first in zip(m, v, strict=True):
            came.append(at)
            at = first if at is None else algebra.along(at, x)
        last = int(at.argmax()) if last is None else last
        ends, starts = [], []
        for x, now in zip(reversed(m), reversed(came), strict=True):
            ends.append(last)
            last = None if now is None else int((now + x[:, last]).argmax())
            starts.append(last)
        return pa.table({k: [r[k] for r in kids] for k in KEYS} | {"before": starts[::-1], "last": ends[::-1]}, schema=_arrow(_PICKS))

    def within(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        r = above.to_pylist()[0]
        return between(rows, r["before"], r["last"])

    return _down(_levels(transfers(blocks, chains, True), True), lambda key, rows: between(rows, None, None), within, _PICKS)


def _in_logs(ll: np.ndarray, chain: Chain, into: np.ndarray | None, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What _rescaled gives, in logarithms, where its products would vanish."""
    n, k = ll.shape
    la = log(chain.trans)
    forward, backward = np.empty((n, k)), np.empty((n, k))
    forward[0] = ll[0] + (log(chain.start) if into is None else _logsumexp(into[:, None] + la, 0))
    for t in range(1, n):
        forward[t] = ll[t] + _logsumexp(forward[t - 1][:, None] + la, 0)
    backward[-1] = after
    for t in range(n - 2, -1, -1):
        backward[t] = _logsumexp(la + (ll[t + 1] + backward[t + 1])[None], 1)
    total = float(_logsumexp(forward[-1] + after, 0))
    p = np.exp(forward + backward - total)
    xi = np.zeros((k, k))
    for t in range(0 if into is not None else 1, n):
        was = into if t == 0 else forward[t - 1]
        xi += np.exp(was[:, None] + la + (ll[t] + backward[t])[None] - total)
    return p / p.sum(1, keepdims=True), xi, total


def _rescaled(ll: np.ndarray, chain: Chain, into: np.ndarray | None, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(posteriors, expected transitions, log-likelihood) of a block between the log vectors that come in from both sides.

    Products are scaled to 1 at each region. The log-likelihood is a chain's that begins and ends with the block.
    """
    n, k = ll.shape
    top = ll.max(axis=1)
    e = np.exp(ll - top[:, None])
    forward, backward, scale = np.empty((n, k)), np.empty((n, k)), np.empty(n)
    first = None if into is None else np.exp(into - into.max())
    x = chain.start if first is None else first @ chain.trans
    for t in range(n):
        x = x * e[t]
        scale[t] = x.sum()
        if not scale[t] > 0:
            return _in_logs(ll, chain, into, after)
        forward[t] = x / scale[t]
        x = forward[t] @ chain.trans
    y = np.exp(after - after.max())
    for t in range(n - 1, -1, -1):
        backward[t] = y / y.sum()
        y = chain.trans @ (e[t] * backward[t])
        if not y.any():
            return _in_logs(ll, chain, into, after)
    p = forward * backward
    whole = p.sum(axis=1)
    if whole.min() < 1e-200:
        return _in_logs(ll, chain, into, after)
    ahead = e * backward / (scale * whole)[:, None]
    xi = (forward[:-1].T @ ahead[1:]) * chain.trans
    if first is not None:
        xi += first[:, None] * chain.trans * ahead[0][None]
    return p / whole[:, None], xi, float((np.log(scale) + top).sum())


def passes(blocks: DataFrame, chains: Chain | dict[str, Chain], boundary: str = "exact") -> DataFrame:
    """(track, kind, ridx, p array): rows of four kinds from one pass over the blocks.

    post: a region's posteriors, states in order; start and trans: expected first states, and transitions row by row, of a
    block; score: log-likelihoods that sum to the total's. Blocks are read twice with boundary="exact".
    """
    if boundary not in ("exact", "restart"):
        raise ValueError(f"unknown boundary {boundary!r}")

    def run(track: str, rows: pa.Table, into: np.ndarray | None, after: np.ndarray | None, whole: float | None) -> pa.Table:
        ridx, ll = _ordered(rows)
        p, xi, total = _rescaled(ll, of_track(chains, track), into, np.zeros(ll.shape[1]) if after is None else after)
        kinds, at, out = ["post"] * len(ridx), ridx.tolist(), list(p)
        if into is None:
            kinds, at, out = [*kinds, "start", "score"], [*at, -1, -1], [*out, p[0], [total if whole is None else whole]]
        return pa.table({"track": [track] * (len(out) + 1), "kind": [*kinds, "trans"], "ridx": pa.array([*at, -1], pa.int64()), "p": pa.array([*out, xi.ravel()], pa.list_(pa.float64()))})

    shape = "track string, kind string, ridx long, p array<double>"
    if boundary == "restart":
        return blocks.groupBy(*KEYS).applyInArrow(lambda key, rows: run(key[0].as_py(), rows, None, None, None), shape)

    def between(key: tuple, rows: pa.Table, ends: pa.Table) -> pa.Table:
        r = ends.to_pylist()[0]
        return run(r["track"], rows, _vector(r["into"]), _vector(r["after"]), r["whole"])

    return blocks.groupBy(*KEYS).cogroup(boundaries(blocks, chains).groupBy(*KEYS)).applyInArrow(between, shape)


def posteriors(blocks: DataFrame, chains: Chain | dict[str, Chain], boundary: str = "exact") -> DataFrame:
    """`passes` with a row for each number: (track, kind, ridx, state, other, p); other is the state that trans leads to."""
    trans, k = F.col("kind") == "trans", F.sqrt(F.size("p")).cast("int")
    rows = passes(blocks, chains, boundary).select("track", "kind", "ridx", k.alias("k"), F.posexplode("p").alias("at", "p"))
    state = F.when(trans, F.expr("at div k")).otherwise(F.col("at")).cast("int")
    return rows.select("track", "kind", "ridx", state.alias("state"), F.when(trans, F.col("at") % F.col("k")).otherwise(0).cast("int").alias("other"), "p")


def decoded_map(posterior: DataFrame) -> DataFrame:
    """(ridx, state): the likeliest state of each region; the lowest wins ties."""
    return posterior.groupBy("ridx").agg(F.max_by("state", F.struct("p", -F.col("state"))).alias("state"))


def decoded_viterbi(blocks: DataFrame, chains: Chain | dict[str, Chain]) -> DataFrame:
    """(track, ridx, state) of the likeliest path over each whole chain."""

    def one(key: tuple, rows: pa.Table, ends: pa.Table) -> pa.Table:
        r = ends.to_pylist()[0]
        c, (ridx, ll) = of_track(chains, r["track"]), _ordered(rows)
        n, k, la = len(ll), len(c.start), log(c.trans)
        back = np.zeros((n, k), int)
        if r["before"] is None:
            v = log(c.start) + ll[0]
        else:
            v = la[r["before"]] + ll[0]
        for t in range(1, n):
            m = v[:, None] + la
            back[t] = m.argmax(0)
            v = m.max(0) + ll[t]
        path = np.empty(n, np.int32)
        path[-1] = r["last"]
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t][path[t]]
        return pa.table({"track": [r["track"]] * n, "ridx": ridx, "state": path})

    return blocks.groupBy(*KEYS).cogroup(picked(blocks, chains).groupBy(*KEYS)).applyInArrow(one, "track string, ridx long, state int")


def decode(blocks: DataFrame, chain: Chain, algorithm: str = "map", boundary: str = "exact") -> DataFrame:
    """(ridx, state) of one track."""
    if algorithm == "map":
        best = F.array_position("p", F.array_max("p")) - 1
        return passes(blocks, chain, boundary).where("kind = 'post'").select("ridx", best.cast("int").alias("state"))
    if algorithm == "viterbi":
        return decoded_viterbi(blocks, chain).select("ridx", "state")
    raise ValueError(f"unknown decoder {algorithm!r}")
