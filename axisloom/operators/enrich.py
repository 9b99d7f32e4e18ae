"""Enrichment of states around features and in cells, against the chain's stationary distribution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.functions.columns import tss_window
from axisloom.operators.chain import Chain
from axisloom.operators.intervals import overlap_join
from axisloom.plans.ship import shipped


def windows(features: DataFrame, flank: int = 50_000, using_tss: bool = True) -> DataFrame:
    """Features with start and stop replaced by their window's; `feature` numbers them, so equal names stay apart."""
    start, stop = tss_window(flank, using_tss)
    if "feature" not in features.columns:
        features = features.withColumn("feature", F.xxhash64("chrom", "start", "stop", "name", "strand"))
    return features.select(*[c for c in features.columns if c not in ("start", "stop")], start.alias("start"), stop.alias("stop"))


def feature_state_counts(features: DataFrame, segments: DataFrame, flank: int = 50_000, using_tss: bool = True, width: int = 10_000) -> DataFrame:
    """(feature, name, state, n): bins of each state that a feature's window overlaps."""
    met = overlap_join(windows(features, flank, using_tss).select("feature", F.col("name").alias("feature_name"), "chrom", "start", "stop"), segments.select("chrom", "start", "stop", "state"), width)
    return met.groupBy("feature", F.col("feature_name").alias("name"), "state").agg(F.count("*").alias("n"))


def geneset_state_counts(features: DataFrame, segments: DataFrame, flank: int = 50_000, using_tss: bool = True, width: int = 10_000) -> DataFrame:
    """(geneset, state, n): bins that any window of a set overlaps, each once."""
    met = overlap_join(windows(features, flank, using_tss).select("geneset", "chrom", "start", "stop"), segments.select("chrom", "start", "stop", "ridx", "state"), width)
    return met.select("geneset", "ridx", "state").distinct().groupBy("geneset", "state").agg(F.count("*").alias("n"))


def completed(counts: DataFrame, keys: list[str], stationary: DataFrame) -> DataFrame:
    """Counts with zeros for the states that a key lacks, its total, and the state's stationary probability pi."""
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    every = totals.join(F.broadcast(stationary.select("state", F.col("p").alias("pi"))), how="cross")
    return every.join(counts, [*keys, "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def enrichment(counts: DataFrame, keys: list[str], stationary: DataFrame, mode: str = "logfold") -> DataFrame:
    """keys, state, value: observed against expected n * pi. No observation counts as none expected (fold 1).

    logfold, fold: log10 or plain ratio; chisqstat: the excess squared over the expectation squared.
    """
    rows = completed(counts, keys, stationary)
    n, expected = F.col("n"), F.col("total") * F.col("pi")
    if mode == "logfold":
        value = F.when(n == 0, 0.0).otherwise(F.log10(n) - F.log10(expected))
    elif mode == "fold":
        value = F.when(n == 0, 1.0).otherwise(n / expected)
    elif mode == "chisqstat":
        value = F.pow(F.greatest(n - expected, F.lit(0.0)), 2) / F.pow(expected, 2)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.select(*keys, "state", value.alias("value"))


def generating(chain: Chain, state: int, n: int, lo: int, hi: int, lengths: list[int]) -> np.ndarray:
    """(lengths x frequencies lo..hi-1) values of the generating functions of the state's visits, at the n-th roots of unity.

    lengths rise. A walk from stationarity goes on from each length to the next, by matrix powers from one ladder of squares.
    """
    k = len(chain.start)
    z = np.exp(-2j * np.pi * np.arange(lo, hi) / n)
    mark = np.ones((hi - lo, k), complex)
    mark[:, state] = z
    ladder = [chain.trans[None] * mark[:, None, :]]
    v, at, out = chain.stationary()[None] * mark, 1, np.empty((len(lengths), hi - lo), complex)
    for i, length in enumerate(lengths):
        left, j = length - at, 0
        while left >> j:
            if j == len(ladder):
                ladder.append(ladder[-1] @ ladder[-1])
            if left >> j & 1:
                v = (v[:, None, :] @ ladder[j])[:, 0]
            j += 1
        at, out[i] = length, v.sum(1)
    return out


def visits(chain: Chain, length: int, state: int, frequencies: int = 4096) -> np.ndarray:
    """P(visits = 0..length) of the state in `length` steps from stationarity, by the inverse transform."""
    n = length + 1
    parts = [generating(chain, state, n, lo, min(lo + frequencies, n), [length])[0] for lo in range(0, n, frequencies)]
    return np.fft.ifft(np.concatenate(parts)).real.clip(0)


def null_distribution(lengths: DataFrame, chain: Chain, frequencies: int = 512) -> DataFrame:
    """(length, state, visits, p) for each length above 0.

    Lengths between two powers of two share their roots of unity and one ladder of matrix powers; runs of `frequencies`
    roots are tasks of their own. Each (length, state) then takes one transform.
    """
    shipped(lengths.sparkSession)
    k = len(chain.start)
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("length") + 1.0))).cast("long")
    some = lengths.where("length > 0").select("length").distinct().withColumn("n", F.when(size > F.col("length"), size).otherwise(2 * size))
    runs = some.groupBy("n").agg(F.array_sort(F.collect_list("length")).alias("lengths"))
    runs = runs.withColumn("lo", F.explode(F.expr(f"sequence(0L, n - 1, {frequencies}L)"))).withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def at_roots(rows: pa.Table) -> pa.Table:
        out = []
        for r in rows.to_pylist():
            hi = min(r["lo"] + frequencies, r["n"])
            found = generating(chain, r["state"], r["n"], r["lo"], hi, r["lengths"])
            out += [{"length": length, "state": r["state"], "lo": r["lo"], "values": v.tobytes()} for length, v in zip(r["lengths"], found, strict=True)]
        return pa.Table.from_pylist(out, schema=pa.schema([("length", pa.int64()), ("state", pa.int32()), ("lo", pa.int64()), ("values", pa.binary())]))

    def inverse(key: tuple, rows: pa.Table) -> pa.Table:
        length, values = key[0].as_py(), rows.sort_by("lo").column("values").to_pylist()
        p = np.fft.ifft(np.frombuffer(b"".join(values), complex)).real[: length + 1].clip(0)
        at = np.arange(length + 1)
        return pa.table({"length": pa.array(np.full(len(at), length)), "state": pa.array(np.full(len(at), key[1].as_py(), np.int32)), "visits": pa.array(at), "p": pa.array(p)})

    found = runs.groupBy("n", "lo", "state").applyInArrow(at_roots, "length long, state int, lo long, values binary")
    return found.groupBy("length", "state").applyInArrow(inverse, "length long, state int, visits long, p double")


def pvalues(counts: DataFrame, keys: list[str], chain: Chain, stationary: DataFrame) -> DataFrame:
    """keys, state, value: -log10 P(visits >= observed) under the chain, 15 at most; 0 for features without bins."""
    rows = completed(counts, keys, stationary).select(*keys, "state", "n", F.col("total").alias("length"))
    null = null_distribution(rows.select("length"), chain)
    tail = F.sum("p").over(Window.partitionBy("length", "state").orderBy(F.desc("visits")))
    tails = null.select("length", "state", F.col("visits").alias("n"), tail.alias("tail"))
    met = rows.join(tails, ["length", "state", "n"], "left")
    value = F.when(F.col("length") < 1, 0.0).otherwise(F.least(-F.log10(F.greatest(F.least("tail", F.lit(1.0)), F.lit(1e-15))), F.lit(15.0)))
    return met.select(*keys, "state", value.alias("value"))


def top_features(enriched: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key): features among the n highest of any state; ties go to the smaller key."""
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("value"), key))
    return enriched.withColumn("rank", rank).where(F.col("rank") <= n).select(key).distinct()


def log_fold_emission(emission: DataFrame, states: list[int] | None = None) -> DataFrame:
    """(dataset, barcode, state, value): ln of a cell's share of its state's alpha over its share of all alpha."""
    alpha = emission.select("dataset", "barcode", "state", (F.col("suffstat") + F.col("prior")).alias("a"))
    by_state = alpha.groupBy("state").agg(F.sum("a").alias("of_state"))
    by_cell = alpha.groupBy("dataset", "barcode").agg(F.sum("a").alias("of_cell"))
    every = alpha.agg(F.sum("a").alias("of_all"))
    met = alpha.join(F.broadcast(by_state), "state").join(by_cell, ["dataset", "barcode"]).join(F.broadcast(every), how="cross")
    out = met.select("dataset", "barcode", "state", (F.log(F.col("a") / F.col("of_state")) - F.log(F.col("of_cell") / F.col("of_all"))).alias("value"))
    return out.where(F.col("state").isin(states)) if states is not None else out
