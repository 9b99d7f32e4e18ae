"""Annotation of bins by scored intervals, and summaries of annotations by state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.operators.intervals import overlap_join
from axisloom.operators.quantiles import percentiles


def annotated(segments: DataFrame, intervals: DataFrame, labels: Sequence[str], how: str = "max", width: int = 10_000) -> DataFrame:
    """Segments with one more column for each label: the max (or avg) score of its intervals that overlap, 0 for none.

    intervals: (chrom, start, stop, label, score).
    """
    if how not in ("max", "avg"):
        raise ValueError(f"unknown aggregate {how!r}")
    met = overlap_join(segments.select("ridx", "chrom", "start", "stop"), intervals.where(F.col("label").isin(list(labels))).select("chrom", "start", "stop", "label", "score"), width)
    wide = met.groupBy("ridx").pivot("label", list(labels)).agg(getattr(F, how)("score"))
    out = segments.join(wide, "ridx", "left")
    return out.withColumns({label: F.coalesce(F.col(f"`{label}`"), F.lit(0.0)) for label in labels})


def coverage(segments: DataFrame, counts: DataFrame, label: str) -> DataFrame:
    """Segments with ln(1 + reads) of each bin under the label. counts: (ridx, ..., cnt)."""
    depth = counts.groupBy("ridx").agg(F.log1p(F.sum("cnt")).alias(label))
    return segments.join(depth, "ridx", "left").withColumn(label, F.coalesce(F.col(label), F.lit(0.0)))


def state_means(segments: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(state, label, z): each label's z-score over all bins (population deviation; 0 if it is constant), averaged by state."""
    long = segments.select("state", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).cast("double").alias("x")) for x in labels))).alias("v")).select("state", "v.*")
    whole = long.groupBy("label").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("x") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return long.join(F.broadcast(whole), "label").groupBy("state", "label").agg(F.avg(z).alias("z"))


def state_label_counts(segments: DataFrame, label: str) -> DataFrame:
    """(state, label, n): bins by state and value of a categorical annotation."""
    return segments.groupBy("state", F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def state_boxes(segments: DataFrame, label: str) -> DataFrame:
    """(state, q25, q50, q75) of an annotation."""
    found = percentiles(segments, label, [0.25, 0.5, 0.75], "state")
    kind = segments.schema["state"].dataType.simpleString()
    return segments.sparkSession.createDataFrame([(state, *map(float, q)) for state, q in found.items()], f"state {kind}, q25 double, q50 double, q75 double")
