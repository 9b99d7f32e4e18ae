"""Segments: state calls with probabilities and depths, and the queries over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.functions.columns import best_state, state_name
from axisloom.operators.packed import unpacked
from axisloom.operators.runs import merged_runs, run_members


def segments(regions: DataFrame, posterior: DataFrame, counts: DataFrame, n_states: int, calls: DataFrame | None = None) -> DataFrame:
    """Regions with Prob_state_<i>, Prob_max, state, name and depths: readdepth_<i> by dataset in name order, readdepth the last one's.

    calls: (ridx, state) of another decoder; by default the likeliest state.
    """
    wide = posterior.groupBy("ridx").pivot("state", list(range(n_states))).agg(F.first("p"))
    wide = wide.select("ridx", *(F.coalesce(str(i), F.lit(0.0)).alias(f"Prob_state_{i}") for i in range(n_states)))
    names = sorted(r["dataset"] for r in counts.select("dataset").distinct().collect())
    depth = unpacked(counts).groupBy("ridx").agg(*(F.sum(F.when(F.col("dataset") == n, F.col("cnt")).otherwise(0)).alias(f"readdepth_{i}") for i, n in enumerate(names)))
    top, state = best_state([f"Prob_state_{i}" for i in range(n_states)])
    out = regions.join(wide, "ridx").join(depth, "ridx", "left").withColumn("Prob_max", top)
    out = out.withColumns({f"readdepth_{i}": F.coalesce(f"readdepth_{i}", F.lit(0)) for i in range(len(names))})
    out = out.withColumn("readdepth", F.col(f"readdepth_{len(names) - 1}") if names else F.lit(0).cast("long"))
    out = out.withColumn("state", state) if calls is None else out.join(calls.select("ridx", "state"), "ridx")
    return out.withColumn("name", state_name())


def state_frequency(segments: DataFrame) -> DataFrame:
    """(name, n), rarest first."""
    return segments.groupBy("name").agg(F.count("*").alias("n")).orderBy("n", "name")


def islands(segments: DataFrame) -> DataFrame:
    """(chrom, state, ridx, run): run is the first ridx of the bin's island, neighbouring bins of one chromosome and state."""
    return run_members(segments, ["chrom", "state"])


def merged_islands(segments: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """(chrom, start, stop, state, n_bins, readdepth) with depths summed, and the mean of each other column."""
    found = merged_runs(segments, ["chrom", "state"], ["readdepth"], others)
    return found.select("chrom", "state", "start", "stop", F.col("n").alias("n_bins"), F.col("sum_readdepth").alias("readdepth"), *(F.col(f"mean_{c}").alias(c) for c in others))


def posterior_islands(segments: DataFrame, states: Sequence[int], threshold: float = 0.99, others: Sequence[str] = ("readdepth",)) -> DataFrame:
    """Islands of confident bins of the states, other columns averaged."""
    kept = segments.where(F.col("state").isin(list(states)) & (F.col("Prob_max") >= threshold))
    found = merged_runs(kept, ["chrom", "state"], means=others)
    return found.select("chrom", "state", "start", "stop", F.col("n").alias("n_bins"), *(F.col(f"mean_{c}").alias(c) for c in others))


def island_members(segments: DataFrame) -> DataFrame:
    """(ridx, region): region is the first ridx of the bin's island."""
    return islands(segments).select("ridx", F.col("run").alias("region"))


def regrouped_counts(counts: DataFrame, members: DataFrame) -> DataFrame:
    """(region, barcode, cnt): counts summed over the bins of each merged region."""
    return counts.join(members, "ridx").groupBy("region", "barcode").agg(F.sum("cnt").alias("cnt"))


def top_regions(segments: DataFrame, states: Sequence[int], n: int = 5000, threshold: float = 0.9, collapse: bool = True, min_reads: int = 0) -> DataFrame:
    """(chrom, start, stop, state, readdepth): the n deepest regions of each state (all if n < 0), intervals once."""
    kept = segments.where(F.col("state").isin(list(states)) & (F.col("Prob_max") >= threshold))
    found = merged_islands(kept) if collapse else kept
    found = found.where(F.col("readdepth") >= min_reads).select("chrom", "start", "stop", "state", "readdepth")
    if n >= 0:
        rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("readdepth"), "chrom", "start"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
    return found.dropDuplicates(["chrom", "start", "stop"])


def chosen_states(stationary: DataFrame, method: str, n: int | None = None, threshold: float | None = None, states: Sequence[int] | None = None, exclude: Sequence[int] = ()) -> DataFrame:
    """(state, p): the n rarest, those of at most the threshold, or the listed ones; without the excluded."""
    if method == "rarest":
        if n is None:
            raise ValueError("rarest needs n")
        found = stationary.orderBy("p", "state").limit(n)
    elif method == "abundancethreshold":
        if threshold is None:
            raise ValueError("abundancethreshold needs a threshold")
        found = stationary.where(F.col("p") <= threshold)
    elif method == "manual":
        if not states:
            raise ValueError("manual needs states")
        found = stationary.where(F.col("state").isin(list(states)))
    else:
        raise ValueError(f"unknown method {method!r}")
    return found.where(~F.col("state").isin(list(exclude))) if exclude else found


def length_distribution(lengths: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Share of each fragment length: overall (len, share), or within each state (name, len, share)."""
    if segments is None:
        sums = lengths.groupBy("len").agg(F.sum("cnt").alias("n"))
        return sums.join(F.broadcast(sums.agg(F.sum("n").alias("all"))), how="cross").select("len", (F.col("n") / F.col("all")).alias("share"))
    sums = lengths.join(segments.select("ridx", "name"), "ridx").groupBy("name", "len").agg(F.sum("cnt").alias("n"))
    return sums.select("name", "len", (F.col("n") / F.sum("n").over(Window.partitionBy("name"))).alias("share"))


def cell_state_counts(counts: DataFrame, segments: DataFrame | None = None, threshold: float = 0.0, posterior: DataFrame | None = None) -> DataFrame:
    """(barcode, state, n): accessible bins of each cell by called state, or by posterior weight."""
    seen = counts.where("cnt > 0").select("ridx", "barcode").distinct()
    if posterior is not None:
        return seen.join(posterior, "ridx").groupBy("barcode", "state").agg(F.sum("p").alias("n"))
    calls = segments.where(F.col("Prob_max") >= threshold).select("ridx", "state")
    return seen.join(calls, "ridx").groupBy("barcode", "state").agg(F.count("*").cast("double").alias("n"))


def depth_by_state(segments: DataFrame) -> DataFrame:
    """(state, n, q25, q50, q75) of log10(readdepth + 1)."""
    q = F.percentile(F.log10(F.col("readdepth") + 1), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return segments.groupBy("state").agg(F.count("*").alias("n"), q.alias("q")).select("state", "n", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))))
