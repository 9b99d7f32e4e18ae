"""Dirichlet-multinomial emissions.

The gamma function is Stirling's series in column expressions. Gains of a cell are computed once for each of its distinct
counts, with the states of a count in one array, and joined to the counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisloom.operators.packed import is_packed, unpacked
from axisloom.operators.quantiles import percentiles
from axisloom.operators.slices import reduced, slice_of, slices, to_slices
from axisloom.plans.scratch import stored, written


def first_state(n_states: int, seed: int = 32) -> Column:
    """A state for each region from a multiplicative hash of its ridx, the same in any engine."""
    low = F.pmod(F.col("ridx"), F.lit(1 << 32))
    # By halves, so that no product leaves 64 bits.
    high = F.pmod(F.floor(low / 65536) * 2654435761, F.lit(1 << 32)) * 65536
    h = F.floor(F.pmod(high + low % 65536 * 2654435761 + seed * 40503, F.lit(1 << 32)) / 65536)
    return F.pmod(h, F.lit(n_states)).cast("int")


def initial_states(regions: DataFrame, n_states: int, seed: int = 32) -> DataFrame:
    """(ridx, state) of first_state."""
    return regions.select("ridx", first_state(n_states, seed).alias("state"))


def state_sums(counts: DataFrame, states: DataFrame) -> DataFrame:
    """(dataset, barcode, state, suffstat): counts summed by (weighted) state. states: (ridx, state[, p])."""
    weight = F.col("p") if "p" in states.columns else F.lit(1.0)
    return unpacked(counts).join(states, "ridx").groupBy("dataset", "barcode", "state").agg(F.sum(F.col("cnt") * weight).alias("suffstat"))


def weighted_sums(counts: DataFrame, weights: DataFrame, width: int, path: str | None = None) -> DataFrame:
    """(dataset, barcode, sums array): counts summed by each of the weights of their region. weights: (ridx, p array of width).

    Of sliced counts only the sums leave their tasks, and are written (to the path) at once; the weights go to the slices.
    """
    counts = unpacked(counts)
    n, on = slices(counts), ["ridx"]
    if n:
        weights, on = to_slices(weights.withColumn("slice", slice_of(counts.sparkSession, n)), n), ["slice", "ridx"]
    found = counts.join(weights, on).groupBy("dataset", "barcode").agg(*(F.sum(F.col("cnt") * F.get("p", F.lit(k))).alias(f"s{k}") for k in range(width)))
    sums = found.select("dataset", "barcode", F.array(*(F.col(f"s{k}") for k in range(width))).alias("sums"))
    return reduced(sums, path) if n else sums


def cell_priors(counts: DataFrame, prior_weight: float = 1.0) -> DataFrame:
    """(dataset, barcode, prior): (cell total + 1), normalised over the dataset's cells, times prior_weight.

    So a dataset's priors sum to prior_weight.
    """
    total = F.sum(F.col("cnt") * F.size("at") if is_packed(counts) else "cnt")
    cells = counts.groupBy("dataset", "barcode").agg((total + 1).alias("x"))
    whole = cells.groupBy("dataset").agg(F.sum("x").alias("whole"))
    return cells.join(whole, "dataset").select("dataset", "barcode", (F.col("x") / F.col("whole") * F.lit(float(prior_weight))).alias("prior"))


def emission_table(counts: DataFrame, sums: DataFrame, n_states: int, prior_weight: float = 1.0) -> DataFrame:
    """(dataset, barcode, state, suffstat, prior) for every cell and state; priors as in cell_priors."""
    every = cell_priors(counts, prior_weight).select("dataset", "barcode", "prior", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("state"))
    return every.join(sums, ["dataset", "barcode", "state"], "left").select("dataset", "barcode", "state", F.coalesce("suffstat", F.lit(0.0)).alias("suffstat"), "prior")


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number: Stirling's series at x + 8, less the factors between."""
    z = x + 8
    below = reduce(lambda a, i: a * (x + i), range(1, 8), x)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def rise(a: Column, m: Column) -> Column:
    """log_gamma(a + m) - log_gamma(a)."""
    return log_gamma(a + m) - log_gamma(a)


def by_state(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and an array of the values in the order of the states."""
    pairs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("state", value))).alias("x"))
    return pairs.select(*keys, F.transform("x", lambda p: p[value]).alias(value))


def alphas(emission: DataFrame) -> DataFrame:
    """(dataset, barcode, a array) of an emission table: suffstat + prior, states in order."""
    return by_state(emission.select("dataset", "barcode", "state", (F.col("suffstat") + F.col("prior")).alias("a")), ["dataset", "barcode"], "a")


def dataset_likelihoods(counts: DataFrame, alpha: DataFrame, width: int, cap: int | None = None, min_depth: int = 0, path: str | None = None) -> DataFrame:
    """(dataset, ridx, x array): the log-likelihood of every region that has counts. alpha: (dataset, barcode, a array of width).

    cap: counts are cut at it; min_depth: a region with a smaller depth is left out. No multinomial coefficient.
    Sliced counts are neither shuffled for the join with their cells nor for the sums of regions: the alphas of a slice's
    cells go there. The sums, a row for each region, are written (to the path) at once. Packed counts are joined with their
    cells as they are, and unpacked beside their gains.
    """
    n = slices(counts)
    if cap:
        counts = counts.withColumn("cnt", F.least("cnt", F.lit(cap)).cast("long"))
    of, cell = (["slice"] if n else []), ["dataset", "barcode"]
    near = alpha
    if n:
        # Written first, so that the plan of the slices holds no join but theirs.
        near = counts.select("slice", *cell).distinct().join(alpha, cell)
        near = to_slices(written(near, f"{path}/cells") if path else stored(near), n)
    gain = F.transform("a", lambda a: rise(a, F.col("cnt"))).alias("gain")
    if is_packed(counts):
        met = unpacked(counts.join(near, cell).select("dataset", "cnt", "at", gain))
    else:
        lut = counts.select(*of, *cell, "cnt").distinct().join(near, [*of, *cell]).select(*of, *cell, "cnt", gain)
        met = counts.join(lut, [*of, *cell, "cnt"])
    gains = met.groupBy(*of, "dataset", "ridx").agg(F.sum("cnt").alias("n"), *(F.sum(F.get("gain", F.lit(k))).alias(f"g{k}") for k in range(width)))
    if n:
        gains = reduced(gains.drop("slice"), path and f"{path}/gains")
    if min_depth:
        gains = gains.where(F.col("n") >= min_depth)
    alpha0 = alpha.groupBy("dataset").agg(*(F.sum(F.get("a", F.lit(k))).alias(f"a{k}") for k in range(width)))
    alpha0 = alpha0.select("dataset", F.array(*(f"a{k}" for k in range(width))).alias("a"))
    each = gains.join(alpha0, "dataset").withColumn("loss", F.transform("a", lambda a: rise(a, F.col("n"))))
    return each.select("dataset", "ridx", F.array(*(F.col(f"g{k}") - F.get("loss", F.lit(k)) for k in range(width))).alias("x"))


def summed_likelihoods(counts: DataFrame, regions: DataFrame, alpha: DataFrame, width: int, cap: int | None = None, min_depth: int = 0, path: str | None = None) -> DataFrame:
    """(ridx, ll array): dataset_likelihoods summed over datasets, for every region; regions without counts have 0."""
    each = dataset_likelihoods(counts, alpha, width, cap, min_depth, path)
    sums = each.groupBy("ridx").agg(*(F.sum(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(width)))
    return regions.select("ridx").join(sums, "ridx", "left").select("ridx", F.array(*(F.coalesce(f"x{k}", F.lit(0.0)) for k in range(width))).alias("ll"))


def likelihoods(counts: DataFrame, regions: DataFrame, emission: DataFrame, n_states: int, cap: int | None = None, min_depth: int = 0) -> DataFrame:
    """(ridx, ll array): the log-likelihood of every region in every state, states in order, summed over datasets.

    counts: (dataset, ridx, barcode, cnt). alpha = suffstat + prior. cap: counts are cut at it; min_depth: a dataset's
    region with a smaller depth counts 0. Regions without counts have 0. No multinomial coefficient.
    """
    return summed_likelihoods(counts, regions, alphas(emission), n_states, cap, min_depth)


def log_likelihood(counts: DataFrame, regions: DataFrame, emission: DataFrame, n_states: int, cap: int | None = None, min_depth: int = 0) -> DataFrame:
    """(ridx, state, ll): `likelihoods` with a row for each state."""
    return likelihoods(counts, regions, emission, n_states, cap, min_depth).select("ridx", F.posexplode("ll").alias("state", "ll"))


def depth_breaks(totals: DataFrame, step: float = 0.05) -> list[float]:
    """Read-depth quantiles at step, 2 * step, ... below 1; a bounded handful of numbers."""
    shares = [round(step * (i + 1), 6) for i in range(round(1 / step) - 1)]
    return [round(q, 6) for q in percentiles(totals, "total", shares).get(None, [])]


def depth_bins(totals: DataFrame, breaks: list[float]) -> DataFrame:
    """(ridx, cntbin): how many of the breaks lie strictly below the depth."""
    below = sum((F.when(F.col("total") > b, 1).otherwise(0) for b in breaks), F.lit(0))
    return totals.select("ridx", below.cast("int").alias("cntbin"))


def depth_bin_emission(bins: DataFrame, posterior: DataFrame) -> DataFrame:
    """(cntbin, state, n, p): posterior-weighted counts of depth bins, and their shares within a state."""
    sums = bins.join(posterior, "ridx").groupBy("cntbin", "state").agg(F.sum("p").alias("n"))
    return sums.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def depth_bin_loglik(bins: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(ridx, state, ll): log probability of a region's depth bin."""
    return bins.join(F.broadcast(probabilities.select("cntbin", "state", "p")), "cntbin").select("ridx", "state", F.log("p").alias("ll"))


def uniform_depth_bins(spark, n_bins: int, n_states: int) -> DataFrame:
    """(cntbin, state, p): the initial categorical emission."""
    return spark.range(n_bins * n_states).select((F.col("id") / n_states).cast("int").alias("cntbin"), (F.col("id") % n_states).cast("int").alias("state"), F.lit(1.0 / n_bins).alias("p"))
