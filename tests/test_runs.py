"""Runs and neighbours by pieces with carries against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from axisloom.operators import runs


def axis(seed, n=400, states=2):
    """Rows with long runs, gaps and keys that alternate."""
    r, out, state = random.Random(seed), [], 0
    for i in range(n):
        state = r.randrange(states) if r.random() < 0.15 else state
        if r.random() > 0.03:
            out.append((f"c{i * 3 // n}", state, i, i * 10, i * 10 + 10, r.randrange(5) if r.random() > 0.1 else None))
    return out


def looped(rows):
    found, open_runs = {}, {}
    for c, s, i, *_ in sorted(rows, key=lambda r: r[2]):
        first, last = open_runs.get((c, s), (i, i - 1))
        open_runs[c, s] = (first if last == i - 1 else i, i)
        found[i] = open_runs[c, s][0]
    return found


SCHEMA = "chrom string, state int, ridx long, start long, stop long, x long"


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 100_000])
def test_members_and_sums_equal_a_loop(spark, piece):
    rows = [*axis(piece), *(("whole", 0, i, i * 10, i * 10 + 10, 1) for i in range(1000, 1300))]
    want = looped(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    keys = ["chrom", "state"]
    assert {r["ridx"]: r["run"] for r in runs.run_members(df, keys, piece).collect()} == want
    sums = {}
    for c, s, i, start, stop, x in rows:
        t = sums.setdefault((c, s, want[i]), [start, stop, 0, None, 0])
        t[0], t[1], t[2] = min(t[0], start), max(t[1], stop), t[2] + 1
        if x is not None:
            t[3], t[4] = (t[3] or 0) + x, t[4] + 1
    merged = runs.merged_runs(df, keys, ["x"], ["x"], piece).collect()
    got = {(r["chrom"], r["state"], r["run"]): (r["start"], r["stop"], r["n"], r["sum_x"], r["mean_x"]) for r in merged}
    assert got == {k: (*t[:4], t[3] / t[4] if t[4] else None) for k, t in sums.items()}


@pytest.mark.parametrize("piece", [1, 3, 50, 100_000])
def test_neighbours_equal_a_loop(spark, piece):
    rows = [r for r in axis(piece + 40) if r[2] % 17 < 11]
    got = {r["ridx"]: (r["before"], r["after"]) for r in runs.with_neighbours(spark.createDataFrame(rows, SCHEMA), "chrom", "x", piece).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[2])
        for k, r in enumerate(own):
            want[r[2]] = (own[k - 1][5] if k else None, own[k + 1][5] if k + 1 < len(own) else None)
    assert got == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert runs.run_members(empty, ["chrom", "state"]).count() == 0
    assert runs.merged_runs(empty, ["chrom", "state"], ["x"]).count() == 0
    assert runs.with_neighbours(empty, "chrom", "x").count() == 0


def test_no_window_spans_a_key(spark):
    """One run of 200,000 bins: no partition of the sums by piece holds more than a piece."""
    df = spark.range(200_000).select(F.lit("c").alias("chrom"), F.lit(0).alias("state"), F.col("id").alias("ridx"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("stop"), F.lit(1).alias("x"))
    local = runs.local_runs(df, ["chrom", "state"], 1000)
    parts = local.groupBy("chrom", "state", "piece", "first").agg(F.max("ridx").alias("last"), F.count("*").alias("n"))
    assert parts.agg(F.max("n"), F.count("*")).first()[:] == (1000, 200)
    assert [(r["run"], r["n"], r["stop"]) for r in runs.merged_runs(df, ["chrom", "state"], piece=1000).collect()] == [(0, 200_000, 2_000_000)]
