"""Contrast sets of bins for a state, and the ranking of feature columns against a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.operators.runs import with_neighbours


def state_scores(segments: DataFrame, state: int, smooth: bool = False) -> DataFrame:
    """Segments with pscore = probability * depth; smooth: half a neighbour's on each side, 0 at the ends of a chromosome."""
    scored = segments.withColumn("pscore", F.col(f"Prob_state_{state}") * F.col("readdepth"))
    if not smooth:
        return scored
    around = 0.5 * F.col("before") + F.col("pscore") + 0.5 * F.col("after")
    return with_neighbours(scored, "chrom", "pscore").withColumn("pscore", F.coalesce(around, F.lit(0.0))).drop("before", "after")


def top_scores(scored: DataFrame, n: int) -> DataFrame:
    """The n rows of the highest pscore (ties to the smaller ridx), with their rank. n is a bounded parameter."""
    best = scored.orderBy(F.desc("pscore"), "ridx").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pscore"), "ridx")))


def contrast_set(segments: DataFrame, state: int, top: int = 15_000, gap: int = 70_000, bottom: int = 15_000) -> DataFrame:
    """(chrom, start, stop, pscore): the top rows, and those `bottom` rows that follow after a gap."""
    ranked = top_scores(state_scores(segments, state), top + gap + bottom)
    return ranked.where((F.col("rank") <= top) | F.col("rank").between(top + gap + 1, top + gap + bottom)).select("chrom", "start", "stop", "pscore")


def between_states(segments: DataFrame, state: int, n_states: int, top: int = 15_000) -> DataFrame:
    """(chrom, start, stop, pscore): the state's top rows, and of every other state its top 2 * top div K, scored by this state's probability."""
    cols = ["chrom", "start", "stop", "pscore"]
    out = top_scores(state_scores(segments, state, smooth=True), top).select(*cols)
    for other in range(n_states):
        if other != state:
            rows = top_scores(state_scores(segments, other, smooth=True), 2 * top // n_states)
            out = out.unionByName(rows.withColumn("pscore", F.col("pscore") * F.col(f"Prob_state_{state}")).select(*cols))
    return out


def average_ranks(df: DataFrame, columns: Sequence[str], pieces: int = 256) -> DataFrame:
    """(column, row, r): ranks within each column, equal values sharing their mean rank; nulls have none. df has a `row` key.

    Ranks come from counts of distinct values, so equal values are summed before they are ordered. Values are ordered
    within pieces between approximate quantiles of the column, and the pieces before are added, so no task orders a column.
    """
    long = df.select("row", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("row", "v.*").where("x IS NOT NULL")
    values = long.groupBy("column", "x").agg(F.count("*").alias("n"))
    cuts = values.groupBy("column").agg(F.percentile_approx("x", F.array(*(F.lit(i / pieces) for i in range(1, pieces))), F.lit(20 * pieces)).alias("cuts"))
    placed = values.join(cuts, "column").select("column", "x", "n", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("piece"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = placed.groupBy("column", "piece").agg(F.sum("n").alias("n")).select("column", "piece", so_far(Window.partitionBy("column").orderBy("piece")).alias("before"))
    below = so_far(Window.partitionBy("column", "piece").orderBy("x")).alias("below")
    ranks = placed.select("column", "piece", "x", "n", below).join(before, ["column", "piece"])
    return long.join(ranks.select("column", "x", (F.col("before") + F.col("below") + (F.col("n") + 1) / 2).alias("r")), ["column", "x"]).select("column", "row", "r")


def spearman(df: DataFrame, score: str, columns: Sequence[str], n: int) -> DataFrame:
    """(column, rho): the n columns with the highest Spearman correlation with the score."""
    ranks = average_ranks(df, [score, *columns])
    own = ranks.where(F.col("column") == score).select("row", F.col("r").alias("s"))
    return ranks.where(F.col("column") != score).join(own, "row").groupBy("column").agg(F.corr("r", "s").alias("rho")).orderBy(F.desc("rho"), "column").limit(n)
