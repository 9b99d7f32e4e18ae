"""Counts packed by cell: a row for each of a cell's distinct counts, with the regions that have it.

What a fit joins in every round are these rows, a few for each cell; a region's number is only unpacked where it is summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbouring regions whose numbers may stand in one row.
SPAN = 1 << 14
COLUMN = "at"


def packed(counts: DataFrame) -> DataFrame:
    """(dataset, barcode, cnt, at array) of (dataset, ridx, barcode, cnt); a list holds regions of one span."""
    cell = ["dataset", "barcode", "span"]
    rows = counts.select("dataset", "barcode", "cnt", "ridx", F.expr(f"ridx div {SPAN}").alias("span")).repartition(*cell)
    return rows.groupBy(*cell, "cnt").agg(F.collect_list("ridx").alias(COLUMN)).drop("span")


def is_packed(counts: DataFrame) -> bool:
    return COLUMN in counts.columns


def unpacked(counts: DataFrame) -> DataFrame:
    """A row for each region again; other counts as they are."""
    return counts.select(*(c for c in counts.columns if c != COLUMN), F.explode(COLUMN).alias("ridx")) if is_packed(counts) else counts
