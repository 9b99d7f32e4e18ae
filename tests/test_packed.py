"""Counts packed by cell: same results as counts by region, and plans that join cells instead of counts."""

import re

import pytest
from pyspark.sql import functions as F

from axisloom import catalogue
from axisloom.operators import em, emission, packed
from axisloom.plans.scratch import stored
from tests.test_slices import made, near, shuffled


@pytest.fixture(scope="module")
def both(spark):
    counts = made(spark).union(spark.createDataFrame([("a", 5, "hot", 3), ("a", 5, "hot", 3), ("a", 40_000, "hot", 3)], "dataset string, ridx long, barcode string, cnt long"))
    return stored(counts), stored(packed.packed(counts)), spark.range(301).union(spark.range(40_000, 40_001)).withColumnRenamed("id", "ridx")


def test_packed_counts_are_the_counts(both):
    counts, few, _ = both
    keys = ["dataset", "ridx", "barcode", "cnt"]
    assert sorted(map(tuple, packed.unpacked(few).select(keys).collect())) == sorted(map(tuple, counts.select(keys).collect()))
    assert few.count() < counts.count() / 2 and packed.unpacked(counts) is counts
    assert few.where("array_max(at) div 16384 <> array_min(at) div 16384").count() == 0


@pytest.mark.parametrize("options", [{}, {"cap": 2}, {"min_depth": 3}])
def test_likelihoods_sums_and_priors_are_those_of_counts(both, options):
    counts, few, regions = both
    alpha = emission.alphas(em.initial_model(counts, regions, 2).emission)
    near(emission.dataset_likelihoods(few, alpha, 2, **options), emission.dataset_likelihoods(counts, alpha, 2, **options), ["dataset", "ridx"], "x")
    weights = regions.select("ridx", F.array(F.col("ridx") / 301, 1 - F.col("ridx") / 301).alias("p"))
    near(emission.weighted_sums(few, weights, 2), emission.weighted_sums(counts, weights, 2), ["dataset", "barcode"], "sums")
    near(emission.cell_priors(few), emission.cell_priors(counts), ["dataset", "barcode"], "prior")
    near(em.initial_model(few, regions, 2).emission, em.initial_model(counts, regions, 2).emission, ["dataset", "barcode", "state"], "suffstat")


@pytest.mark.parametrize("bytes_near", [0, 8 << 20])
def test_fits_are_the_same_with_weights_near_or_far(both, monkeypatch, bytes_near):
    counts, few, regions = both
    a = em.fit(counts, regions, 2, 2)
    monkeypatch.setattr(em, "NEAR", bytes_near)
    b = em.fit(few, regions, 2, 2)
    near(a.emission, b.emission, ["dataset", "barcode", "state"], "suffstat", 1e-6)
    assert a.score == pytest.approx(b.score, rel=1e-9)


def test_rounds_shuffle_no_counts(spark, both, monkeypatch):
    counts, few, regions = both
    seen = []
    monkeypatch.setattr(em, "written", lambda df, path: seen.append(shuffled(df)) or stored(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        em.fit(counts, regions, 2, 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Neither by a cell's count, to meet its gains, nor by region, to meet its weights, but what regions come to.
    keys = [re.sub(r"#\d+L?", "", s) for s in seen]
    assert len(keys) == 4 and not any("cnt" in k for k in keys)
    assert "ridx" not in keys[0] and keys[3].count("ridx") == 1


def test_what_a_fit_reads_again_is_stored(spark):
    """The segments of a fitted model are made from stored tables: the events are not read, nor counted, again."""
    plan = catalogue.segmentation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()
