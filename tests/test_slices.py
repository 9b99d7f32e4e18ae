"""The bucketed store of counts: same results as unsliced counts, and plans that leave the counts where they are."""

import re

import pytest
from pyspark.sql import functions as F

from axisloom.operators import em, emission
from axisloom.operators import slices as S
from axisloom.operators.slices import slices
from axisloom.plans.scratch import stored
from axisloom.sources import files


def made(spark, n=4000):
    """Two datasets; one cell has a third of all rows."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset"), (F.col("id") * 7 % 301).alias("ridx"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 41).cast("string"))).alias("barcode"),
    )
    return rows.groupBy("dataset", "ridx", "barcode").agg(F.count("*").alias("cnt"))


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    counts, path = made(spark), str(tmp_path_factory.mktemp("sliced") / "store")
    files.write_sliced(counts, path, 5)
    return counts, files.read_sliced(spark, path), spark.range(301).withColumnRenamed("id", "ridx"), path


def shuffled(df) -> str:
    """The keys of all hash exchanges of the plan as it was before it ran."""
    return " ".join(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString()))


def near(a, b, keys, value, within=1e-9):
    a, b = ({tuple(r[k] for k in keys): r[value] for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and a
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=within, abs=1e-9)


def test_store_holds_the_counts_in_even_slices(spark, stores):
    counts, sliced, _, path = stores
    keys = ["dataset", "ridx", "barcode", "cnt"]
    assert sorted(map(tuple, sliced.select(keys).collect())) == sorted(map(tuple, counts.select(keys).collect()))
    assert slices(sliced) == 5 and slices(counts) == 0
    per = sliced.groupBy("slice", F.pmod(F.hash("slice"), F.lit(5)).alias("bucket")).agg(F.count("*").alias("n")).collect()
    assert len({r["bucket"] for r in per}) == len(per) == 5
    assert max(r["n"] for r in per) < 1.3 * min(r["n"] for r in per)


def test_store_opens_in_a_session_that_does_not_know_it(spark, stores):
    counts, _, _, path = stores
    other = spark.newSession()
    name, _ = files._table(other, path, 5)
    other.sql(f"DROP TABLE {name}")
    again = files.read_sliced(other, path)
    assert again.count() == counts.count() and slices(again) == 5
    assert "Exchange" not in again.groupBy("slice", "dataset", "ridx").count()._jdf.queryExecution().executedPlan().toString()


def test_no_whole_store_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no whole sliced store"):
        files.read_sliced(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="at least one slice"):
        files.write_sliced(made(spark), str(tmp_path / "bad"), -1)


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "empty")
    files.write_sliced(made(spark).where("cnt < 0"), path, 3)
    empty = files.read_sliced(spark, path)
    assert empty.count() == 0 and slices(empty) == 3
    alpha = spark.createDataFrame([("a", "x", [1.0])], "dataset string, barcode string, a array<double>")
    assert emission.dataset_likelihoods(empty, alpha, 1).count() == 0


@pytest.mark.parametrize("options", [{}, {"cap": 2}, {"min_depth": 3}])
def test_likelihoods_are_those_of_unsliced_counts(stores, options):
    counts, sliced, regions, _ = stores
    alpha = emission.alphas(em.initial_model(counts, regions, 2).emission)
    near(emission.dataset_likelihoods(sliced, alpha, 2, **options), emission.dataset_likelihoods(counts, alpha, 2, **options), ["dataset", "ridx"], "x")


def test_sums_are_those_of_unsliced_counts(spark, stores):
    counts, sliced, regions, _ = stores
    weights = regions.select("ridx", F.array(F.col("ridx") / 301, 1 - F.col("ridx") / 301).alias("p"))
    near(emission.weighted_sums(sliced, weights, 2), emission.weighted_sums(counts, weights, 2), ["dataset", "barcode"], "sums")


def test_fit_leaves_no_sums_behind(stores, tmp_path):
    _, sliced, regions, _ = stores
    em.fit(sliced, regions, 2, 2, options=em.Options(store=str(tmp_path / "fit")))
    assert sorted(p.name for p in (tmp_path / "fit").iterdir()) == ["cells-2", "state-2"]


def test_fit_is_that_of_unsliced_counts(stores):
    counts, sliced, regions, _ = stores
    a, b = (em.fit(x, regions, 2, 2) for x in (sliced, counts))
    assert a.score == pytest.approx(b.score, rel=1e-9)
    near(a.emission, b.emission, ["dataset", "barcode", "state"], "suffstat", 1e-6)


def test_plans_shuffle_cells_and_regions_but_no_counts(spark, stores, monkeypatch):
    counts, sliced, regions, _ = stores
    alpha = stored(emission.alphas(em.initial_model(counts, regions, 2).emission))
    weights = stored(regions.select("ridx", F.array(F.lit(0.5), F.lit(0.5)).alias("p")))
    kept = []
    monkeypatch.setattr(S, "stored", lambda df: kept.append(shuffled(df)) or stored(df))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", S.ALL_KEYS)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert re.search(r"cnt#.*ridx#|ridx#.*cnt#", shuffled(emission.dataset_likelihoods(counts, alpha, 2)))
        assert "ridx#" in shuffled(emission.weighted_sums(counts, weights, 2))
        emission.dataset_likelihoods(sliced, alpha, 2)
        emission.weighted_sums(sliced, weights, 2)
        # One exchange sends the cells to their slices; the other plan sends the weights there, and then what cells come to.
        assert len(kept) == 2
        assert re.fullmatch(r"slice#\d+L, 5", kept[0])
        assert sorted(re.sub(r"#\d+L?", "", kept[1]).split()) == sorted("slice, 5 dataset, barcode, 4".split())
        assert spark.conf.get(S.ALL_KEYS) == before[S.ALL_KEYS] == "true"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before["spark.sql.autoBroadcastJoinThreshold"])
