"""Interval joins and quantiles against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisloom.operators import counting, intervals, quantiles
from axisloom.operators.intervals import overlap_join


def some(rng, n, longest):
    out = []
    for i in range(n):
        start = rng.randrange(0, 200_000)
        out.append((i, rng.choice("xy"), start, start + rng.choice([0, 1, 2, 7, 100, 1024, 2048, 2049, rng.randrange(1, longest)])))
    return out


@pytest.mark.parametrize("width", [1, 64, 10_000])
def test_every_overlap_once_for_any_lengths(spark, width):
    rng = random.Random(width)
    a = [*some(rng, 150, 3000), (150, "x", 0, 100_000_000), (151, "y", 5, 5)]
    b = [*some(rng, 150, 100_000), (150, "y", 0, 100_000_000), (151, "x", 3, 4), (152, "x", 3, 4)]
    left = spark.createDataFrame(a, "i int, chrom string, start long, stop long")
    right = spark.createDataFrame(b, "j int, chrom string, start long, stop long")
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, width).collect())
    want = sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c == d and max(s, t) < min(e, f))
    assert got == want


def test_long_intervals_make_no_rows_for_their_length(spark):
    left = spark.createDataFrame([(0, "x", 0, 100_000_000)], "i int, chrom string, start long, stop long")
    right = spark.range(2000).select(F.col("id").alias("j"), F.lit("x").alias("chrom"), (F.col("id") * 40_000).alias("start"), (F.col("id") * 40_000 + 150).alias("stop"))
    from axisloom.operators import intervals

    assert overlap_join(left, right).count() == 2000
    one = right.withColumn("level", intervals.level("start", "stop", 10_000))
    assert intervals.asking(one, [0, 14], "start", "stop", 10_000, False).count() <= 6 * 2000
    assert overlap_join(left.where("false"), right).count() == overlap_join(left, right.where("false")).count() == 0


@pytest.mark.parametrize("accuracy", [20, 2000])
def test_percentiles_are_exact(spark, accuracy, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(accuracy)
    rows = [("a", float(x)) for x in rng.normal(size=3000)] + [("b", float(x)) for x in rng.integers(0, 4, 2000)] + [("c", 5.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.percentiles(df, "x", shares, "g")
    assert set(got) == {"a", "b", "c", "e"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([x for k, x in rows if k == g], shares), atol=1e-12)
    assert np.allclose(quantiles.percentiles(df, "x", shares)[None], np.quantile([x for _, x in rows if x is not None], shares), atol=1e-12)
    assert quantiles.percentiles(df.where("false"), "x", shares) == {}


@pytest.mark.parametrize(("width", "piece", "pairs"), [(1, 1 << 18, 1 << 20), (64, 5, 7), (10_000, 1 << 18, 50)])
def test_counts_of_overlaps_are_those_of_all_pairs(spark, monkeypatch, width, piece, pairs):
    monkeypatch.setattr(intervals, "PIECE", piece)
    monkeypatch.setattr(intervals, "PAIRS", pairs)
    rng = random.Random(width)
    a = [*some(rng, 120, 3000), (120, "x", 0, 100_000_000), (121, "y", 5, 5), (122, None, 0, 9)]
    b = [*some(rng, 200, 100_000), (200, "y", 0, 100_000_000), (201, "x", 3, 4), (202, "x", 3, 4), (203, None, 0, 9)]
    b = [(j % 50, rng.choice(["u", "v", "w", None]), c, s, e) for j, c, s, e in b]
    regions = spark.createDataFrame(a, "ridx long, chrom string, start long, stop long")
    records = spark.createDataFrame(b, "id long, barcode string, chrom string, start long, stop long")
    met = [(i, k, j) for i, c, s, e in a for j, k, d, t, f in b if c is not None and c == d and max(s, t) < min(e, f)]

    def counts(df):
        return sorted(((r["ridx"], r["barcode"], r["cnt"]) for r in df.collect()), key=str)

    assert counts(intervals.overlap_counts(regions, records, "barcode", width=width)) == sorted(((i, k, n) for (i, k), n in Counter((i, k) for i, k, _ in met).items()), key=str)
    assert counts(intervals.overlap_counts(regions, records, "barcode", "id", width)) == sorted(((i, k, n) for (i, k), n in Counter((i, k) for i, k, _ in set(met)).items()), key=str)
    assert counts(intervals.overlap_counts(regions, records.where("false"), "barcode")) == counts(intervals.overlap_counts(regions.where("false"), records, "barcode")) == []


def test_only_records_of_keys_that_a_region_meets_twice_are_sorted(monkeypatch):
    rng = np.random.default_rng(7)
    start = np.sort(rng.integers(0, 20_000, 3000))
    stop = start + rng.choice([1, 50, 9000], 3000, p=[0.5, 0.49, 0.01])
    keys = [f"u{i}" if i else None for i in rng.integers(0, 40_000, 3000)]
    keys[100:110] = ["same"] * 10
    first = rng.integers(0, 20_000, 200)
    last = first + rng.integers(1, 3000, 200)
    records = pa.record_batch({"side": np.zeros(3000, np.int32), "start": start, "stop": stop, "barcode": pa.array(keys, pa.string()), "ridx": pa.nulls(3000, pa.int64())})
    regions = pa.record_batch({"side": np.ones(200, np.int32), "start": first, "stop": last, "barcode": pa.nulls(200, pa.string()), "ridx": np.arange(200)})
    want = Counter((i, keys[j]) for i in range(200) for j in np.flatnonzero((start < last[i]) & (stop > first[i])))
    ordered, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **more: ordered.append(len(x)) or unique(x, **more))
    got = [r for b in intervals._counted(iter([records, regions]), "barcode", None, 5000) for r in b.to_pylist()]
    assert len(got) == len(want) and {(r["ridx"], r["barcode"]): r["cnt"] for r in got} == want
    assert sum(ordered) < len(got) / 10


def test_counts_in_regions_shuffle_no_pairs(spark):
    regions = spark.range(300).select(F.col("id").alias("ridx"), F.lit("x").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 4000).alias("stop"))
    fragments = spark.range(400).select(F.lit("x").alias("chrom"), (F.col("id") + 1000).alias("start"), (F.col("id") + 1050).alias("stop"), F.concat(F.lit("u"), "id").alias("barcode"))
    found = counting.fragments_in_regions(fragments, regions)
    assert found.count() == 300 * 400 and found.agg(F.sum("cnt")).first()[0] == 300 * 400
    # Nothing is gathered behind the tasks in which regions and fragments meet, and they meet after one shuffle of both.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("FlatMapGroupsInArrow")
    assert "Aggregate" not in above and "Join" not in above and below.count("RepartitionByExpression") == 1
