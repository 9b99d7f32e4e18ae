"""Counting fragments as they come in: the tile arithmetic needs no state of its own, the sums are Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.operators.counting import binned


def tile_counts(fragments: DataFrame, width: int, event_time: str | None = None, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(chrom, bin, barcode, cnt) of a stream (or table) of fragments, for output mode update or complete.

    With event_time, a timestamp column, counts are those of time windows of length `every` (columns from, to), which close
    once `late` has passed: then the state of a window ends with it, and output mode append gives each window once.
    """
    keys = ["chrom", "bin", "barcode"]
    if event_time is None:
        return binned(fragments.select("chrom", "start", "stop", "barcode"), width).groupBy(*keys).agg(F.count("*").alias("cnt"))
    timed = fragments.select("chrom", "start", "stop", "barcode", F.col(event_time).alias("seen")).withWatermark("seen", late)
    counts = binned(timed, width).groupBy(F.window("seen", every).alias("w"), *keys).agg(F.count("*").alias("cnt"))
    return counts.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), *keys, "cnt")
