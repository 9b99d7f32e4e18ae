"""Runs of consecutive numbers and neighbours in an order, over pieces of the axis with carries at their edges.

No task holds a whole chromosome: a window sees one piece of one key, and what passes from piece to piece is a row or two
for each of them. Keys and ridx are never null, and a key has a ridx once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the axis in a piece.
PIECE = 65_536


def pieces(rows: DataFrame, piece: int) -> DataFrame:
    """rows with the number of their piece."""
    return rows.withColumn("piece", F.expr(f"ridx div {piece}"))


def _began(first: str, last: str, w) -> Column:
    """`first` where a run begins, as the row before does not end right before it; null elsewhere."""
    return F.when(F.coalesce(F.lag(last).over(w) != F.col(first) - 1, F.lit(True)), F.col(first))


def local_runs(rows: DataFrame, keys: Sequence[str], piece: int = PIECE) -> DataFrame:
    """rows with `piece` and `first`: the first ridx of the row's run within its piece."""
    w = Window.partitionBy(*keys, "piece").orderBy("ridx")
    rows = pieces(rows, piece).withColumn("first", _began("ridx", "ridx", w))
    return rows.withColumn("first", F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def joined_runs(parts: DataFrame, keys: Sequence[str], piece: int = PIECE) -> DataFrame:
    """parts (keys, piece, first, last, ...) with `run`: the first ridx of the whole run.

    Only parts at an edge of their piece can go on: these, two a piece at most, meet in one window for each key. The
    others stay in a window of their piece.
    """
    at_edge = (F.col("first") % piece == 0) | ((F.col("last") + 1) % piece == 0)
    w = Window.partitionBy(*keys, F.when(at_edge, F.lit(-1).cast("long")).otherwise(F.col("piece"))).orderBy("first")
    parts = parts.withColumn("run", _began("first", "last", w))
    return parts.withColumn("run", F.last("run", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def run_members(rows: DataFrame, keys: Sequence[str], piece: int = PIECE) -> DataFrame:
    """(keys, ridx, run) of every row: carries, one for each piece that a run enters from the one before, are joined to the pieces."""
    local = local_runs(rows.select(*keys, "ridx"), keys, piece)
    parts = local.groupBy(*keys, "piece", "first").agg(F.max("ridx").alias("last"))
    carried = joined_runs(parts, keys, piece).where(F.col("run") < F.col("first")).select(*keys, "piece", F.col("run").alias("carry"))
    run = F.when(F.col("first") % piece == 0, F.coalesce("carry", "first")).otherwise(F.col("first"))
    return local.join(carried, [*keys, "piece"], "left").select(*keys, "ridx", run.alias("run"))


def merged_runs(rows: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), means: Sequence[str] = (), piece: int = PIECE) -> DataFrame:
    """(keys, run, start, stop, n, sums, means) of every run: rows are added up within pieces, pieces to runs.

    Nulls count neither in sums nor in means; the mean of nulls alone is null.
    """
    parts = local_runs(rows, keys, piece).groupBy(*keys, "piece", "first").agg(
        F.max("ridx").alias("last"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"),
        *(F.sum(c).alias(f"sum_{c}") for c in sums), *(F.struct(F.sum(c).alias("sum"), F.count(c).alias("n")).alias(f"mean_{c}") for c in means),
    )
    return joined_runs(parts, keys, piece).groupBy(*keys, "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"),
        *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums), *(F.try_divide(F.sum(f"mean_{c}.sum"), F.sum(f"mean_{c}.n")).alias(f"mean_{c}") for c in means),
    )
    return found


def with_neighbours(rows: DataFrame, key: str, value: str, piece: int = PIECE) -> DataFrame:
    """rows with `before` and `after`: the value of the row before and behind in the order of ridx, null at the ends of a key.

    A window sees one piece; the outermost values of the pieces next to it that have rows are joined to it.
    """
    rows = pieces(rows, piece)
    ends = rows.groupBy(key, "piece").agg(F.min_by(value, "ridx").alias("head"), F.max_by(value, "ridx").alias("tail"))
    across = Window.partitionBy(key).orderBy("piece")
    ends = ends.select(key, "piece", F.lag("tail").over(across).alias("enters"), F.lead("head").over(across).alias("follows"))
    w = Window.partitionBy(key, "piece").orderBy("ridx")
    one = F.struct(F.col(value).alias("x"))
    met = rows.withColumns({"before": F.lag(one).over(w), "after": F.lead(one).over(w)}).join(ends, [key, "piece"], "left")
    pick = lambda own, other: F.when(F.col(own).isNotNull(), F.col(f"{own}.x")).otherwise(F.col(other))
    return met.withColumns({"before": pick("before", "enters"), "after": pick("after", "follows")}).drop("piece", "enters", "follows")
