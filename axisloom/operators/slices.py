"""Counts cut by region into slices that a bucketed table keeps apart, so that no round of a fit shuffles them.

Region ridx is of slice ridx modulo their number: regions next to each other, which are often alike in depth, go to
different slices, and a cell with a large part of all counts is spread over all of them. What is small against the
counts (a row for each cell of a slice, a row for each region) goes to the slices instead.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.plans.scratch import stored, written

COLUMN = "slice"
#: By default Spark shuffles both sides of a join of several keys that lie by one of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@lru_cache(maxsize=16)
def _keys(spark: SparkSession, n: int) -> tuple[int, ...]:
    """For each of n buckets the least number that Spark's hash puts there: with these as keys each slice has a bucket alone."""
    ids = spark.range(64 * n + 1024).select(F.pmod(F.hash("id"), F.lit(n)).alias("bucket"), "id")
    found = {r["bucket"]: r["least"] for r in ids.groupBy("bucket").agg(F.min("id").alias("least")).collect()}
    if len(found) < n:
        raise ValueError(f"no keys for {n} slices")
    return tuple(found[b] for b in range(n))


def slice_of(spark: SparkSession, n: int, ridx: str = "ridx") -> Column:
    """The slice's key of a region; n numbers stand in the expression."""
    if n < 1:
        raise ValueError("at least one slice is needed")
    return F.get(F.array(*map(F.lit, _keys(spark, n))), F.pmod(F.col(ridx), F.lit(n)).cast("int")).cast("long")


def marked(counts: DataFrame, n: int) -> DataFrame:
    """Counts whose slice column says how many slices there are."""
    return counts.withMetadata(COLUMN, {"slices": n})


def slices(counts: DataFrame) -> int:
    """How many slices the counts are cut into; 0 if they are not."""
    return counts.schema[COLUMN].metadata.get("slices", 0) if COLUMN in counts.columns else 0


def to_slices(rows: DataFrame, n: int) -> DataFrame:
    """Rows that hold their slice, each sent to the partition that reads that slice's bucket."""
    return rows.repartition(n, COLUMN)


@contextmanager
def _where_they_lie(spark: SparkSession):
    before = spark.conf.get(ALL_KEYS, "true")
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


def reduced(rows: DataFrame, path: str | None = None) -> DataFrame:
    """What joins and sums within slices come to, written at once (to the path, or as a checkpoint) by a plan that leaves slices in place.

    It is for plans in which all that is joined lies by slice alone: the setting is the session's, so it holds only while
    this is written; elsewhere it could gather a join in as many tasks as one of its keys has values.
    """
    with _where_they_lie(rows.sparkSession):
        return written(rows, path) if path else stored(rows)
