"""Algebra of count matrices held as (ridx, barcode, cnt) rows without zeros, beside their regions and cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.functions.columns import NO_BARCODE


def binarized(counts: DataFrame) -> DataFrame:
    return counts.withColumn("cnt", F.least("cnt", F.lit(1)).cast("long"))


def trimmed(counts: DataFrame, most: int | None) -> DataFrame:
    """Counts cut at `most`, if that is above 0."""
    return counts.withColumn("cnt", F.least("cnt", F.lit(most)).cast("long")) if most else counts


def cell_totals(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(barcode, total); with a cell table also those with none."""
    return _totals(counts, "barcode", cells)


def region_totals(counts: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(ridx, total); with a region table also those with none."""
    return _totals(counts, "ridx", regions)


def _totals(counts: DataFrame, key: str, all_keys: DataFrame | None) -> DataFrame:
    sums = counts.groupBy(key).agg(F.sum("cnt").alias("total"))
    if all_keys is None:
        return sums
    return all_keys.select(key).distinct().join(sums, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"))


def within(totals: DataFrame, least: int | None, most: int | None) -> DataFrame:
    """Rows whose total is in the bounds, both included; None is no bound."""
    if least is not None:
        totals = totals.where(F.col("total") >= least)
    return totals if most is None else totals.where(F.col("total") <= most)


def quality_filtered(
    counts: DataFrame, regions: DataFrame, cells: DataFrame, min_cell: int | None = None, max_cell: int | None = None, min_region: int | None = None, max_region: int | None = None, binarize: bool = True, trim: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, regions, cells) that pass: binarize, trim, bound cells (never the missing barcode), bound regions by what is left."""
    counts = trimmed(binarized(counts) if binarize else counts, trim)
    good = within(cell_totals(counts, cells), min_cell, max_cell).where(F.col("barcode") != NO_BARCODE)
    counts = counts.join(good, "barcode", "left_semi")
    kept = within(region_totals(counts, regions), min_region, max_region)
    return counts.join(kept, "ridx", "left_semi"), regions.join(kept, "ridx", "left_semi"), cells.join(good, "barcode", "left_semi")


def pseudobulk(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(ridx, grp, cnt): counts summed over the cells of each group; cells without a group are left out."""
    return counts.join(groups.select("barcode", "grp").distinct(), "barcode").groupBy("ridx", "grp").agg(F.sum("cnt").alias("cnt"))


def group_totals(counts: DataFrame, groups: DataFrame, all_regions: bool = True) -> DataFrame:
    """(grp, cnt), or (ridx, grp, cnt) with all_regions false: feature totals of each group's own cells."""
    bulk = pseudobulk(counts, groups)
    return bulk.groupBy("grp").agg(F.sum("cnt").alias("cnt")) if all_regions else bulk


def bulk_cells(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, n_cells, cnt): the cell table of `pseudobulk`'s matrix, with every group; one without counts has a zero column."""
    of = groups.select("barcode", "grp").distinct()
    size = of.groupBy("grp").agg(F.count("barcode").alias("n_cells"))
    return size.join(group_totals(counts, groups), "grp", "left").select("grp", "n_cells", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def subset_cells(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    return counts.join(wanted.select("barcode").distinct(), "barcode", "left_semi")


def drop_chroms(counts: DataFrame, regions: DataFrame, chroms: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    kept = regions.where(~F.col("chrom").isin(list(chroms)))
    return counts.join(kept, "ridx", "left_semi"), kept


def merged(matrices: Sequence[DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """(sample, ridx, barcode, cnt) of matrices over the same regions; a cell is a (sample, barcode) pair."""
    names = names or [f"sample_{i}" for i in range(len(matrices))]
    if len(names) != len(matrices):
        raise ValueError("as many names as matrices are needed")
    return reduce(DataFrame.unionByName, (m.select(F.lit(n).alias("sample"), "ridx", "barcode", "cnt") for n, m in zip(names, matrices, strict=True)))


def merged_regions(tables: Sequence[DataFrame]) -> DataFrame:
    """The first table's regions that are in all the others."""
    return reduce(lambda a, b: a.join(b.select("chrom", "start", "stop"), ["chrom", "start", "stop"], "left_semi"), tables)


def concatenated_cells(tables: Sequence[DataFrame]) -> DataFrame:
    """Cell tables one after the other; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def normalized(counts: DataFrame, factors: DataFrame, scale: float = 1e4) -> DataFrame:
    """(ridx, barcode, value): counts times scale over the cell's size factor n; the factor is 1 where there is none."""
    met = counts.join(factors.select("barcode", "n"), "barcode", "left")
    return met.select("ridx", "barcode", (F.col("cnt") * scale / F.coalesce("n", F.lit(1))).alias("value"))


def multi_matrix(datasets: dict[str, DataFrame], min_cell: int | None = None, max_cell: int | None = None, trim: int | None = None, min_region: int = 0) -> DataFrame:
    """(dataset, ridx, barcode, cnt): each matrix trimmed and its cells bounded, then regions by their sum over all."""
    every = []
    for name, counts in datasets.items():
        counts = trimmed(counts, trim)
        good = within(cell_totals(counts), min_cell, max_cell).where(F.col("barcode") != NO_BARCODE)
        every.append(counts.join(good, "barcode", "left_semi").select(F.lit(name).alias("dataset"), "ridx", "barcode", "cnt"))
    rows = reduce(DataFrame.unionByName, every)
    return rows.join(rows.groupBy("ridx").agg(F.sum("cnt").alias("total")).where(F.col("total") >= min_region), "ridx", "left_semi") if min_region else rows


def group_tracks(fragments: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(grp, chrom, bin, cpm): fragment starts of each group in bins, for a million of the group's."""
    counts = fragments.join(groups, "barcode").groupBy("grp", "chrom", F.expr(f"start div {width}").alias("bin")).agg(F.count("*").alias("n"))
    whole = counts.groupBy("grp").agg(F.sum("n").alias("whole"))
    return counts.join(whole, "grp").select("grp", "chrom", "bin", (F.col("n") * 1e6 / F.col("whole")).alias("cpm"))


def group_profile(profile: DataFrame, groups: DataFrame, factors: DataFrame, scale: float = 1e4) -> DataFrame:
    """(grp, bin, mean, top): a locus profile normalised by cell and averaged over all cells of a group (zeros count); top is the largest mean of any group."""
    sizes = groups.groupBy("grp").agg(F.countDistinct("barcode").alias("n_cells"))
    value = F.col("cnt") * scale / F.coalesce("n", F.lit(1))
    sums = profile.join(factors, "barcode", "left").join(groups, "barcode").groupBy("grp", "bin").agg(F.sum(value).alias("x")).join(sizes, "grp")
    means = sums.select("grp", "bin", (F.col("x") / F.col("n_cells")).alias("mean"))
    return means.join(F.broadcast(means.agg(F.max("mean").alias("top"))), how="cross")
