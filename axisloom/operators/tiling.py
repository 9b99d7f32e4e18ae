"""Chromosome sizes and the regular tiling of the axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chrom_sizes(fragments: DataFrame) -> DataFrame:
    """(chrom, size): the largest stop of each chromosome."""
    return fragments.groupBy("chrom").agg(F.max("stop").alias("size"))


def kept_chroms(sizes: DataFrame, remove: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """Chromosomes whose names hold none of the removed substrings and, if a list is kept, are on it (KeyError if absent)."""
    if keep is not None:
        there = {r["chrom"] for r in sizes.where(F.col("chrom").isin(list(keep))).select("chrom").distinct().collect()}
        if absent := [c for c in keep if c not in there]:
            raise KeyError(absent[0])
        sizes = sizes.where(F.col("chrom").isin(list(keep)))
    for part in remove:
        sizes = sizes.where(~F.contains("chrom", F.lit(part)))
    return sizes


def bin_offsets(sizes: DataFrame, width: int) -> DataFrame:
    """(chrom, size, offset): the number of bins of all chromosomes with smaller names. One row for each chromosome."""
    bins = F.ceil(F.col("size") / width)
    before = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.where("size > 0").select("chrom", "size", F.coalesce(F.sum(bins).over(before), F.lit(0)).cast("long").alias("offset"))


def tile(sizes: DataFrame, width: int, remove: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """(ridx, chrom, start, stop, name): bins of the width along every chromosome, the last one cut at its end."""
    if width <= 0:
        raise ValueError("width must be positive")
    at = bin_offsets(kept_chroms(sizes, remove, keep), width)
    rows = at.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / width) - 1)).alias("i"))
    rows = rows.select((F.col("offset") + F.col("i")).alias("ridx"), "chrom", (F.col("i") * width).alias("start"), F.least((F.col("i") + 1) * width, F.col("size")).alias("stop"))
    return rows.withColumn("name", F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("stop").cast("string")))


def indexed(regions: DataFrame) -> DataFrame:
    """Regions (chrom, start, stop) with their name and a dense ridx in the order of chrom, start, stop.

    Ranks are taken within chromosomes; only one row for each chromosome is ranked over all.
    """
    inside = Window.partitionBy("chrom").orderBy("start", "stop")
    before = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    n = regions.groupBy("chrom").agg(F.count("*").alias("n")).select("chrom", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = regions.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(n), "chrom")
    return ranked.select((F.col("offset") + F.col("rank") - 1).cast("long").alias("ridx"), "chrom", "start", "stop", F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("stop").cast("string")).alias("name"))
