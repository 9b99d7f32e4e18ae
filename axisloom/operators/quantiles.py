"""Exact quantiles without a buffer of all values: a mergeable sketch narrows the range, a second pass decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.plans.scratch import stored

#: The sketch's rank error is a row in so many.
ACCURACY = 2000


def percentiles(df: DataFrame, value: str, shares: Sequence[float], by: str | None = None) -> dict:
    """{group: [quantile at each share]}, between neighbouring values in proportion; {None: [...]} without `by`.

    Groups are few, as states are. Values are doubles; nulls do not count, and a group without values has no entry. The
    second pass counts what lies below each narrow range and orders the range's distinct values alone, which are about
    one row in ACCURACY / 8.
    """
    rows = df.select((F.col(by) if by else F.lit(0)).alias("g"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    rows = stored(rows)  # two columns, read by each pass
    sizes = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    if not sizes:
        return {}
    # Wide enough for the sketch's error and for the neighbouring ranks.
    margin = 2 / ACCURACY + 2 / min(sizes.values())
    ends = [x for p in shares for x in (max(0.0, p - margin), min(1.0, p + margin))]
    bounds = rows.groupBy("g").agg(F.percentile_approx("x", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("ends"), F.min("x").alias("least"), F.max("x").alias("most"))
    narrow = F.array(*(
        F.struct(
            F.lit(i).alias("i"),
            (F.col("least") if ends[2 * i] == 0 else F.col("ends")[2 * i]).alias("lo"), (F.col("most") if ends[2 * i + 1] == 1 else F.col("ends")[2 * i + 1]).alias("hi"),
        )
        for i in range(len(shares))
    ))
    met = rows.join(F.broadcast(bounds.select("g", narrow.alias("r"))), "g")
    below = met.groupBy("g").agg(*(F.count_if(F.col("x") < F.col("r")[i]["lo"]).alias(f"b{i}") for i in range(len(shares)))).collect()
    below = {(r["g"], i): r[f"b{i}"] for r in below for i in range(len(shares))}
    inside = met.select("g", "x", F.explode(F.filter("r", lambda r: F.col("x").between(r["lo"], r["hi"]))).alias("r")).groupBy("g", F.col("r.i").alias("i"), "x").agg(F.count("*").alias("n"))
    ranks = [(g, i, k, int(p * (n - 1)) + k - below[g, i]) for g, n in sizes.items() for i, p in enumerate(shares) for k in (0, 1)]
    wanted = df.sparkSession.createDataFrame(ranks, f"g {rows.schema['g'].dataType.simpleString()}, i int, k int, rank long")
    so_far = F.sum("n").over(Window.partitionBy("g", "i").orderBy("x"))
    placed = inside.withColumn("upto", so_far)
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    found = {(r["g"], r["i"], r["k"]): r["x"] for r in placed.join(F.broadcast(wanted), ["g", "i"]).where(hit).select("g", "i", "k", "x").collect()}
    out = {}
    for g, n in sizes.items():
        out[g if by else None] = []
        for i, p in enumerate(shares):
            a, rest = found[g, i, 0], p * (n - 1) - int(p * (n - 1))
            out[g if by else None].append(a if rest == 0 else (1 - rest) * a + rest * found[g, i, 1])
    return out
