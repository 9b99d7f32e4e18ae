"""Expectation maximisation as Spark jobs: emissions stay in DataFrames, start and transitions (K, K x K) on the driver.

Several models are fitted side by side over one reading of the counts: their states stand next to each other in one array
for each cell and each region, and the chain's passes know them by track. Every round is written whole before the one
before it is removed, so that a fit can be taken up again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.operators.chain import Chain, blocked, decode, passes, posteriors
from axisloom.operators.emission import alphas, cell_priors, dataset_likelihoods, emission_table, first_state, initial_states, likelihoods, state_sums, summed_likelihoods, weighted_sums
from axisloom.operators.packed import is_packed, packed
from axisloom.operators.slices import slices
from axisloom.plans.scratch import fresh_path, removed, stored, whole, written


@dataclass
class Model:
    """A fitted segmentation model. emission: (dataset, barcode, state, suffstat, prior)."""

    n_states: int
    chain: Chain
    emission: DataFrame
    score: float = float("-inf")
    seed: int = 32
    iterations: int = 0


@dataclass
class Options:
    prior_weight: float = 1.0
    #: Dirichlet priors of start and transitions; 1 is flat.
    start_prior: float = 1.0
    trans_prior: float = 1.0
    block_rows: int = 5000
    boundary: str = "exact"
    #: Stop early once the log-likelihood grows by less; None runs all iterations.
    tolerance: float | None = None
    #: Where rounds are kept; a fit that finds whole rounds of its own there goes on from the last. None: a fresh folder.
    store: str | None = None


#: Numbers of all models' states that one pass over the counts sums; more seeds than fit are taken in turns.
WIDTH = 96
#: Bytes of regions' weights up to which they go to the counts; those of a longer axis meet the counts by region.
NEAR = 8 << 20


def m_step(stats: dict[tuple[str, int, int], float], chain: Chain, o: Options) -> Chain:
    """Start and transitions from expected counts plus prior - 1 + 1e-6, normalised; what is zero in `chain` stays zero."""
    k = range(len(chain.start))
    start = np.array([stats.get(("start", i, 0), 0.0) for i in k])
    trans = np.array([[stats.get(("trans", i, j), 0.0) for j in k] for i in k])
    start = np.where(chain.start == 0, 0, np.maximum(start + o.start_prior - 1 + 1e-6, 0))
    trans = np.where(chain.trans == 0, 0, np.maximum(trans + o.trans_prior - 1 + 1e-6, 0))
    rows = trans.sum(1, keepdims=True)
    return Chain(start / start.sum(), np.where(rows > 0, trans / np.where(rows > 0, rows, 1), chain.trans))


def track_statistics(passed: DataFrame) -> dict[str, tuple[dict[tuple[str, int, int], float], float]]:
    """For each track the sums of a pass's small kinds, K + K x K + 1 numbers, and the log-likelihood. passed: of chain.passes."""
    sums = passed.where("kind != 'post'").select("track", "kind", F.size("p").alias("n"), F.posexplode("p").alias("at", "p")).groupBy("track", "kind", "n", "at").agg(F.sum("p").alias("p"))
    out: dict[str, dict[tuple[str, int, int], float]] = {}
    for r in sums.collect():
        i, j = divmod(r["at"], round(r["n"] ** 0.5)) if r["kind"] == "trans" else (r["at"], 0)
        out.setdefault(r["track"], {})[r["kind"], i, j] = r["p"]
    return {t: (x, x.get(("score", 0, 0), float("-inf"))) for t, x in out.items()}


def statistics(passed: DataFrame) -> tuple[dict[tuple[str, int, int], float], float]:
    """Sums of the small kinds of one track's pass, K + K x K + 1 rows, and the log-likelihood. passed: of chain.posteriors."""
    rows = passed.where("kind != 'post'").groupBy("kind", "state", "other").agg(F.sum("p").alias("p")).collect()
    sums = {(r["kind"], r["state"], r["other"]): r["p"] for r in rows}
    return sums, sums.get(("score", 0, 0), float("-inf"))


def initial_model(counts: DataFrame, regions: DataFrame, n_states: int, seed: int = 32, o: Options | None = None) -> Model:
    """A state for each region by hash, emissions summed by it, uniform start and transitions."""
    o = o or Options()
    sums = state_sums(counts, initial_states(regions, n_states, seed))
    return Model(n_states, Chain.uniform(n_states), emission_table(counts, sums, n_states, o.prior_weight), seed=seed)


def expectation(model: Model, counts: DataFrame, regions: DataFrame, o: Options, chain_of: DataFrame | None = None) -> DataFrame:
    blocks = blocked(likelihoods(counts, regions, model.emission, model.n_states), model.n_states, o.block_rows, chain_of)
    # The exact scan reads the likelihoods twice; one row a region is little against the counts that they come from.
    return posteriors(stored(blocks) if o.boundary == "exact" else blocks, model.chain, o.boundary)


@dataclass
class Fits:
    """Models of several seeds as they are after some rounds.

    cells: (dataset, barcode, prior, sums array), the sums of all seeds' states side by side.
    """

    n_states: int
    seeds: list[int]
    cells: DataFrame
    chains: dict[str, Chain]
    scores: dict[str, float]
    rounds: dict[str, int]
    done: set[str] = field(default_factory=set)
    #: Whether the weights of all regions take NEAR bytes at most.
    near: bool = False

    def of(self, seed: int) -> slice:
        i = self.seeds.index(seed)
        return slice(i * self.n_states, (i + 1) * self.n_states)

    def sums(self, seed: int, column: str = "sums"):
        return F.slice(column, self.of(seed).start + 1, self.n_states)

    def model(self, seed: int) -> Model:
        emission = self.cells.select("dataset", "barcode", F.posexplode(self.sums(seed)).alias("state", "suffstat"), "prior")
        t = str(seed)
        return Model(self.n_states, self.chains[t], emission.select("dataset", "barcode", "state", "suffstat", "prior"), self.scores[t], seed, self.rounds[t])

    def table(self, spark: SparkSession) -> DataFrame:
        """All but the cells: (track, kind, i, j, p)."""
        rows = []
        for t, c in self.chains.items():
            rows += [(t, "start", i, 0, float(p)) for i, p in enumerate(c.start)] + [(t, "trans", i, j, float(p)) for i, row in enumerate(c.trans) for j, p in enumerate(row)]
            rows += [(t, "score", 0, 0, self.scores[t]), (t, "rounds", 0, 0, float(self.rounds[t])), (t, "done", 0, 0, float(t in self.done))]
        return spark.createDataFrame(rows, "track string, kind string, i int, j int, p double")


def _near(regions: DataFrame, width: int) -> bool:
    return regions.count() * 8 * (width + 2) <= NEAR


def _first(counts: DataFrame, regions: DataFrame, n_states: int, seeds: list[int], o: Options, path: str) -> Fits:
    states = regions.select("ridx", F.array(*((first_state(n_states, s) == k).cast("double") for s in seeds for k in range(n_states))).alias("p"))
    width = n_states * len(seeds)
    near = _near(regions, width)
    cells = cell_priors(counts, o.prior_weight).join(weighted_sums(counts, F.broadcast(states) if near else states, width, path), ["dataset", "barcode"], "left")
    cells = cells.select("dataset", "barcode", "prior", F.coalesce("sums", F.array_repeat(F.lit(0.0), width)).alias("sums"))
    tracks = list(map(str, seeds))
    return Fits(n_states, seeds, cells, {t: Chain.uniform(n_states) for t in tracks}, dict.fromkeys(tracks, float("-inf")), dict.fromkeys(tracks, 0), near=near)


def _taken_up(spark: SparkSession, n_states: int, seeds: list[int], iterations: int, store: str) -> tuple[Fits | None, int]:
    """The last whole round of a store, and its number."""
    for i in range(iterations, 0, -1):
        if whole(spark, f"{store}/state-{i}") and whole(spark, f"{store}/cells-{i}"):
            rows = spark.read.parquet(f"{store}/state-{i}").collect()
            f = Fits(n_states, seeds, spark.read.parquet(f"{store}/cells-{i}"), {}, {}, {})
            held = {(r["track"], r["kind"], r["i"], r["j"]): r["p"] for r in rows}
            if {r["track"] for r in rows} != set(map(str, seeds)) or 1 + max(r["i"] for r in rows) != n_states:
                raise ValueError(f"{store} holds a fit of other seeds or states")
            k = range(n_states)
            for t in map(str, seeds):
                f.chains[t] = Chain(np.array([held[t, "start", x, 0] for x in k]), np.array([[held[t, "trans", x, y] for y in k] for x in k]))
                f.scores[t], f.rounds[t] = held[t, "score", 0, 0], int(held[t, "rounds", 0, 0])
                f.done |= {t} if held[t, "done", 0, 0] else set()
            return f, i
    return None, 0


def _passed(f: Fits, live: list[int], counts: DataFrame, regions: DataFrame, o: Options, chain_of: DataFrame | None, path: str) -> DataFrame:
    """chain.passes of the live seeds, each a track. The counts are read once for all of them."""
    k = f.n_states
    alpha = f.cells.select("dataset", "barcode", F.transform(F.flatten(F.array(*(f.sums(s) for s in live))), lambda x: x + F.col("prior")).alias("a"))
    found = summed_likelihoods(counts, regions, alpha, k * len(live), path=f"{path}-sums")
    tracks = F.array(*(F.struct(F.lit(str(s)).alias("track"), F.slice("ll", i * k + 1, k).alias("ll")) for i, s in enumerate(live)))
    rows = found.select("ridx", F.explode(tracks).alias("x")).select("x.track", "ridx", "x.ll")
    # The exact scan reads the likelihoods twice; a row for each region and seed is little against the counts behind it.
    return passes(written(blocked(rows, k, o.block_rows, chain_of), path), f.chains, o.boundary)


def _round(f: Fits, counts: DataFrame, regions: DataFrame, o: Options, chain_of: DataFrame | None, scratch: str) -> Fits:
    """One round of all seeds that are not done."""
    live = [s for s in f.seeds if str(s) not in f.done]
    k, spark = f.n_states, counts.sparkSession
    passed = written(_passed(f, live, counts, regions, o, chain_of, f"{scratch}/blocks"), f"{scratch}/passed")
    out = Fits(k, f.seeds, f.cells, dict(f.chains), dict(f.scores), dict(f.rounds), set(f.done), f.near)
    for t, (sums, score) in track_statistics(passed).items():
        grown = score - f.scores[t]
        out.chains[t], out.scores[t], out.rounds[t] = m_step(sums, f.chains[t], o), score, f.rounds[t] + 1
        if o.tolerance is not None and 0 <= grown < o.tolerance:
            out.done.add(t)
    order = F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*(F.lit(str(s)) for s in live)), F.col("track")).alias("at"), "p")))
    weights = passed.where("kind = 'post'").groupBy("ridx").agg(order.alias("x")).select("ridx", F.flatten(F.transform("x", lambda x: x["p"])).alias("p"))
    new = weighted_sums(counts, F.broadcast(weights) if f.near else weights, k * len(live), f"{scratch}/sums").withColumnRenamed("sums", "new")
    cells = f.cells.join(new, ["dataset", "barcode"], "left").withColumn("new", F.coalesce("new", F.array_repeat(F.lit(0.0), k * len(live))))
    parts = [F.slice("new", live.index(s) * k + 1, k) if s in live else f.sums(s) for s in f.seeds]
    out.cells = cells.select("dataset", "barcode", "prior", F.flatten(F.array(*parts)).alias("sums"))
    return out


def _fitted(counts: DataFrame, regions: DataFrame, n_states: int, iterations: int, seeds: list[int], o: Options, chain_of: DataFrame | None) -> Fits:
    spark = counts.sparkSession
    store = o.store or fresh_path(spark, "fit")
    f, at = _taken_up(spark, n_states, seeds, iterations, store) if o.store else (None, 0)
    if f is not None:
        f.near = _near(regions, n_states * len(seeds))
    else:
        f = _first(counts, regions, n_states, seeds, o, f"{store}/scratch-0")
        f.cells = written(f.cells, f"{store}/cells-0")
        removed(spark, f"{store}/scratch-0")
    for i in range(at + 1, iterations + 1):
        if len(f.done) == len(seeds):
            break
        scratch = f"{store}/scratch-{i}"
        f = _round(f, counts, regions, o, chain_of, scratch)
        f.cells = written(f.cells, f"{store}/cells-{i}")
        # Written last: a round whose state is whole has its cells.
        f.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{store}/state-{i}")
        removed(spark, scratch, f"{store}/cells-{i - 1}", f"{store}/state-{i - 1}")
    return f


def _inputs(counts: DataFrame, regions: DataFrame, chain_of: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    # Sliced counts are a table already, and a copy of it would lose its buckets; packed ones are the caller's to store.
    return counts if slices(counts) or is_packed(counts) else stored(packed(counts)), stored(regions.select("ridx")), chain_of if chain_of is None else stored(chain_of)


def fit(counts: DataFrame, regions: DataFrame, n_states: int, iterations: int = 10, seed: int = 32, options: Options | None = None, chain_of: DataFrame | None = None) -> Model:
    """EM from the seed's initial model. counts: (dataset, ridx, barcode, cnt); those of files.read_sliced are never shuffled.

    chain_of: (ridx, chain) starts a chain anew, for instance on every chromosome; by default the axis is one chain.
    With options.store a fit that was ended goes on from its last whole round; at most two rounds are kept on disk.
    """
    return _fitted(*_inputs(counts, regions, None)[:2], n_states, iterations, [seed], options or Options(), chain_of if chain_of is None else stored(chain_of)).model(seed)


def score(model: Model, counts: DataFrame, regions: DataFrame, o: Options | None = None, chain_of: DataFrame | None = None) -> float:
    """Total log-likelihood of the counts."""
    return statistics(expectation(model, counts, regions, o or Options(), chain_of))[1]


def fit_seeds(counts: DataFrame, regions: DataFrame, n_states: int, seeds: int | Sequence[int], iterations: int = 10, options: Options | None = None, chain_of: DataFrame | None = None) -> tuple[Model, dict[int, float]]:
    """The model with the best score over the seeds (the first of equals), and every seed's score.

    All seeds go through a round together: its jobs are as many as one seed's, and the counts are read once for as many
    seeds as have WIDTH states between them. Each seed stops on its own.
    """
    o = options or Options()
    seeds = [seeds] if isinstance(seeds, int) else list(dict.fromkeys(seeds))
    counts, regions, chain_of = _inputs(counts, regions, chain_of)
    step, spark = max(1, WIDTH // n_states), counts.sparkSession
    models: list[Model] = []
    for i in range(0, len(seeds), step):
        some = seeds[i : i + step]
        own = Options(**(vars(o) | {"store": o.store and f"{o.store}/seeds-{i}"}))
        f = _fitted(counts, regions, n_states, iterations, some, own, chain_of)
        path = fresh_path(spark, "last-pass")
        found = track_statistics(_passed(f, some, counts, regions, o, chain_of, path).where("kind = 'score'"))
        removed(spark, path, f"{path}-sums")
        for s in some:
            models.append(f.model(s))
            models[-1].score = found[str(s)][1]
    return max(models, key=lambda m: m.score), {m.seed: m.score for m in models}


def posterior(model: Model, counts: DataFrame, regions: DataFrame, o: Options | None = None, chain_of: DataFrame | None = None) -> DataFrame:
    """(ridx, state, p)."""
    return expectation(model, counts, regions, o or Options(), chain_of).where("kind = 'post'").select("ridx", "state", "p")


def predict(model: Model, counts: DataFrame, regions: DataFrame, algorithm: str = "map", o: Options | None = None, chain_of: DataFrame | None = None) -> DataFrame:
    """(ridx, state) by decoder: map or viterbi."""
    o = o or Options()
    blocks = stored(blocked(likelihoods(counts, regions, model.emission, model.n_states), model.n_states, o.block_rows, chain_of))
    return decode(blocks, model.chain, algorithm, o.boundary)


def robust_posterior(model: Model, counts: DataFrame, regions: DataFrame, o: Options | None = None, chain_of: DataFrame | None = None) -> DataFrame:
    """(ridx, state, mean, sd): posteriors of each dataset alone, their mean and population deviation over datasets.

    All datasets go through one pass, each a track of its own; without counts there are none, and no rows.
    """
    o, k = o or Options(), model.n_states
    each = dataset_likelihoods(counts, alphas(model.emission), k).withColumnRenamed("dataset", "track")
    grid = regions.select("ridx").join(F.broadcast(counts.select(F.col("dataset").alias("track")).distinct()), how="cross")
    rows = grid.join(each, ["track", "ridx"], "left").select("track", "ridx", F.coalesce("x", F.array_repeat(F.lit(0.0), k)).alias("ll"))
    blocks = blocked(rows, k, o.block_rows, chain_of)
    found = passes(stored(blocks) if o.boundary == "exact" else blocks, model.chain, o.boundary).where("kind = 'post'")
    return found.select("ridx", F.posexplode("p").alias("state", "p")).groupBy("ridx", "state").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("sd"))


def chain_tables(spark: SparkSession, chain: Chain) -> tuple[DataFrame, DataFrame]:
    """(state, p) and (i, j, p) of a chain."""
    k = len(chain.start)
    start = spark.createDataFrame([(i, float(chain.start[i])) for i in range(k)], "state int, p double")
    return start, spark.createDataFrame([(i, j, float(chain.trans[i, j])) for i in range(k) for j in range(k)], "i int, j int, p double")


def chain_of_tables(start: DataFrame, trans: DataFrame) -> Chain:
    p = {r["state"]: r["p"] for r in start.collect()}
    t = {(r["i"], r["j"]): r["p"] for r in trans.collect()}
    k = len(p)
    return Chain(np.array([p[i] for i in range(k)]), np.array([[t[i, j] for j in range(k)] for i in range(k)]))
