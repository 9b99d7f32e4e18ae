"""One test for each place where a choice had to be made."""

import pytest
from pyspark.sql import functions as F

from axisloom.functions import columns as C
from axisloom.operators import contrast, counting, enrich, intervals, matrix, segments, tiling
from axisloom.sources import files
from axisloom.streaming.tiles import tile_counts


def sizes(spark):
    return spark.createDataFrame([("chr1", 25), ("chr10", 10), ("chrM", 5), ("chrZ", 0)], "chrom string, size long")


def test_tiles_are_numbered_by_chromosome_and_cut_at_its_end(spark):
    rows = sorted((r["ridx"], r["chrom"], r["start"], r["stop"]) for r in tiling.tile(sizes(spark), 10).collect())
    assert rows == [(0, "chr1", 0, 10), (1, "chr1", 10, 20), (2, "chr1", 20, 25), (3, "chr10", 0, 10), (4, "chrM", 0, 5)]


def test_removal_is_by_substring_and_keeping_by_name(spark):
    named = lambda df: {r["chrom"] for r in df.collect()}
    assert named(tiling.tile(sizes(spark), 10, remove=["chr1"])) == {"chrM"}
    assert named(tiling.tile(sizes(spark), 10, keep=["chr1", "chrM"], remove=["M"])) == {"chr1"}
    with pytest.raises(KeyError):
        tiling.tile(sizes(spark), 10, keep=["chr7"])


def test_overlap_pairs_come_once_and_touching_is_no_overlap(spark):
    a = spark.createDataFrame([("x", 0, 100, 1), ("x", 100, 101, 2), ("x", 5, 5, 3), ("y", 0, 9, 4)], "chrom string, start long, stop long, a int")
    b = spark.createDataFrame([("x", 50, 100, 1), ("x", 0, 500, 2), ("y", 9, 12, 3)], "chrom string, start long, stop long, b int")
    assert sorted((r["a"], r["b"]) for r in intervals.overlap_join(a, b, 7).collect()) == [(1, 1), (1, 2), (2, 2)]


READ = "qname string, rname string, mname string, pos long, mpos long, tlen long, rlen long, mapq int, flag int, barcode string"


def reads(spark):
    return spark.createDataFrame(
        [
            ("p:1", "c", "c", 100, 250, 200, 50, 60, 1 + 2 + 64, "a"),
            ("p:1", "c", "c", 250, 100, -200, 50, 60, 1 + 2 + 16 + 128, "a"),
            ("s:1", "c", None, 400, 0, 0, 50, 60, 16, "b"),
            ("u:1", "c", None, 500, 0, 0, 50, 60, 4, "b"),
            ("l:1", "c", "bad", 100, 5000, 4900, 50, 60, 1 + 64, "a"),
        ],
        READ,
    )


def bins(df):
    return sorted((r["ridx"], r["barcode"], r["cnt"]) for r in df.collect())


def test_counting_modes(spark):
    c = spark.createDataFrame([("c", 1000)], "chrom string, size long")
    assert bins(counting.reads_in_tile(reads(spark).where("flag & 4 = 0"), c, 100, "midpoint")) == [(2, "a", 1), (4, "b", 1)]
    assert bins(counting.reads_in_tile(reads(spark).where("flag & 4 = 0"), c, 100, "countboth")) == [(1, "a", 1), (2, "a", 1), (4, "b", 1)]
    assert bins(counting.reads_in_tile(reads(spark).where("flag = 67"), c, 100, "eitherend")) == [(1, "a", 1), (2, "a", 1)]
    assert bins(counting.reads_in_tile(reads(spark).where("flag = 67"), c, 1000, "eitherend")) == [(0, "a", 1)]
    regions = tiling.tile(c, 100)
    for mode in ("midpoint", "countboth", "eitherend"):
        assert bins(counting.reads_in_regions(reads(spark), regions, mode)) == bins(counting.reads_in_tile(reads(spark), c, 100, mode))
    with pytest.raises(ValueError, match="mode"):
        C.positions("none")


def test_unmapped_reads_and_bad_mates_go(spark):
    assert sorted(r["qname"] for r in counting.without_chroms(reads(spark), ["bad"]).collect()) == ["p:1", "p:1", "s:1"]


def test_read_fragments_end_at_start_plus_length(spark):
    assert [(r["start"], r["stop"]) for r in counting.read_fragments(reads(spark)).collect()] == [(100, 300)]


def test_only_repeats_of_the_last_read_go(spark):
    df = spark.createDataFrame([("1", "c", None, 5, 0, 0, 1, 60, 0, "a"), ("2", "c", None, 5, 0, 0, 1, 60, 0, "a"), ("3", "c", None, 5, 0, 0, 1, 60, 16, "a"), ("4", "c", None, 5, 0, 0, 1, 60, 0, "a"), ("5", "c", None, 5, 0, 0, 1, 60, 0, "b")], READ)
    assert sorted(r["qname"] for r in counting.deduplicated(df).collect()) == ["1", "3", "4", "5"]


def test_barcode_rules(spark):
    df = spark.createDataFrame([("ab:1.2", {"CB": "x"}), ("cd.7", {})], "qname string, tags map<string,string>")
    assert [r[0] for r in df.select(C.barcode("CB")).collect()] == ["x", "dummy"]
    assert [r[0] for r in df.select(C.barcode("prefix")).collect()] == ["ab", "cd"]
    assert [r[0] for r in df.select(C.barcode(F.upper)).collect()] == ["AB:1.2", "CD.7"]


def test_profiles(spark):
    frag = spark.createDataFrame([("c", 90, 110, "a", 1), ("c", 100, 150, "a", 1), ("d", 100, 150, "a", 1)], "chrom string, start long, stop long, barcode string, dup int")
    got = {(r["barcode"], r["bin"]): r["cnt"] for r in counting.fragment_profile(frag, "c", 100, 150, 20).collect()}
    assert got == {("a", 0): 2}
    with pytest.raises(ValueError, match="overlaps"):
        counting.fragment_profile(frag, "c", 1000, 1100)
    both = {r["bin"]: r["cnt"] for r in counting.read_profile(reads(spark), "c", 100, 450, 50).collect()}
    assert both == {0: 2, 4: 1, 7: 1}


def counts(spark):
    return spark.createDataFrame([(0, "a", 3), (0, "b", 1), (1, "a", 2), (2, "b", 1), (2, "dummy", 9)], "ridx long, barcode string, cnt long")


def test_quality_filter_recounts_regions_and_keeps_empty_ones_at_no_bound(spark):
    regions = spark.range(4).withColumnRenamed("id", "ridx")
    cells = spark.createDataFrame([("a",), ("b",), ("dummy",), ("none",)], "barcode string")
    c, r, b = matrix.quality_filtered(counts(spark), regions, cells, min_cell=2, min_region=1)
    assert bins(c) == [(0, "a", 1), (0, "b", 1), (1, "a", 1), (2, "b", 1)]
    assert sorted(x["ridx"] for x in r.collect()) == [0, 1, 2]
    assert sorted(x["barcode"] for x in b.collect()) == ["a", "b"]
    _, r, b = matrix.quality_filtered(counts(spark), regions, cells, binarize=False)
    assert r.count() == 4
    assert sorted(x["barcode"] for x in b.collect()) == ["a", "b", "none"]


def test_group_totals_use_the_group_only(spark):
    groups = files.checked_groups(["a", "b"], ["g", "h"], spark)
    assert {r["grp"]: r["cnt"] for r in matrix.group_totals(counts(spark), groups).collect()} == {"g": 5, "h": 2}
    with pytest.raises(ValueError, match="as many"):
        files.checked_groups(["a"], [], spark)


def test_missing_size_factors_count_as_one(spark):
    factors = spark.createDataFrame([("a", 10)], "barcode string, n long")
    got = {(r["ridx"], r["barcode"]): r["value"] for r in matrix.normalized(counts(spark), factors).collect()}
    assert got[0, "a"] == 3000
    assert got[0, "b"] == 10_000


SEG = "ridx long, chrom string, start long, stop long, state int, readdepth long, Prob_max double, Prob_state_0 double, Prob_state_1 double, name string"


def seg(spark):
    rows = [(0, "x", 0), (1, "x", 0), (2, "x", 1), (3, "x", 0), (4, "y", 0), (5, "y", 0)]
    return spark.createDataFrame([(i, c, 10 * i, 10 * i + 10, s, i + 1, 0.9, 0.9 - 0.8 * s, 0.1 + 0.8 * s, f"state_{s}") for i, c, s in rows], SEG)


def test_islands_end_with_the_chromosome(spark):
    got = sorted((r["chrom"], r["start"], r["stop"], r["state"], r["n_bins"], r["readdepth"]) for r in segments.merged_islands(seg(spark)).collect())
    assert got == [("x", 0, 20, 0, 2, 3), ("x", 20, 30, 1, 1, 3), ("x", 30, 40, 0, 1, 4), ("y", 40, 60, 0, 2, 11)]


def test_top_regions_are_never_padded(spark):
    got = segments.top_regions(seg(spark), [0, 1], n=2).collect()
    assert sorted((r["state"], r["readdepth"]) for r in got) == [(0, 4), (0, 11), (1, 3)]
    assert segments.top_regions(seg(spark), [0, 1], n=-1).count() == 4


def test_state_choice(spark):
    pi = spark.createDataFrame([(0, 0.5), (1, 0.2), (2, 0.3)], "state int, p double")
    chosen = lambda *a, **k: sorted(r["state"] for r in segments.chosen_states(pi, *a, **k).collect())
    assert chosen("rarest", n=2, exclude=[2]) == [1]
    assert chosen("abundancethreshold", threshold=0.3) == [1, 2]
    assert chosen("manual", states=[0, 9]) == [0]
    for method in ("rarest", "abundancethreshold", "manual", "nucfree"):
        with pytest.raises(ValueError, match=method):
            segments.chosen_states(pi, method)


def test_ties_go_to_the_lowest_state(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2)], "a double, b double, c double")
    top, state = C.best_state(["a", "b", "c"])
    assert tuple(df.select(top, state).first()) == (0.4, 0)


def test_windows_start_at_zero_and_follow_the_strand(spark):
    genes = spark.createDataFrame([("x", 5, 50, "g", "+"), ("x", 5, 50, "g", "-")], "chrom string, start long, stop long, name string, strand string")
    assert sorted((r["start"], r["stop"]) for r in enrich.windows(genes, 10).collect()) == [(0, 16), (40, 61)]
    assert {(r["start"], r["stop"]) for r in enrich.windows(genes, 10, using_tss=False).collect()} == {(0, 60)}
    assert enrich.feature_state_counts(genes, seg(spark), 20).select("feature").distinct().count() == 2


def test_pvalues_end_at_fifteen(spark):
    from axisloom.operators.chain import Chain
    import numpy as np

    chain = Chain(np.array([0.5, 0.5]), np.array([[0.999, 0.001], [0.9, 0.1]]))
    pi = spark.createDataFrame([(i, float(p)) for i, p in enumerate(chain.stationary())], "state int, p double")
    n = spark.createDataFrame([("g", 1, 40)], "name string, state int, n long")
    got = {r["state"]: r["value"] for r in enrich.pvalues(n, ["name"], chain, pi).collect()}
    assert got[1] == 15
    assert abs(got[0]) < 1e-9


def test_smoothed_scores_use_neighbours_of_the_chromosome(spark):
    got = {r["ridx"]: round(r["pscore"], 6) for r in contrast.state_scores(seg(spark), 0, smooth=True).collect()}
    assert got[0] == got[3] == got[4] == got[5] == 0
    assert got[1] == round(0.5 * 0.9 + 1.8 + 0.5 * 0.3, 6)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 3.0), (3, None)], "row long, x double")
    assert {r["row"]: r["r"] for r in contrast.average_ranks(df, ["x"]).collect()} == {0: 1.5, 1: 1.5, 2: 3}


def test_group_tables_by_ending_or_column(spark, tmp_path):
    cells = spark.createDataFrame([("a", "1")], "barcode string, cluster string")
    assert files.read_groups(spark, "cluster", cells).first()["grp"] == "1"
    (tmp_path / "g.csv").write_text("id,x,grp\na,0,k\n")
    assert files.read_groups(spark, str(tmp_path / "g.csv"), group_column=2).first()["grp"] == "k"
    with pytest.raises(ValueError, match="neither"):
        files.read_groups(spark, "absent", cells)
    with pytest.raises(ValueError, match="no chromosome sizes"):
        files.genome_sizes(spark, "x.txt")


def test_coordinate_text_with_comments(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n3 2 2\n1 1 5\n3 2 7\n")
    assert sorted(tuple(r) for r in files.read_coordinates(spark, str(tmp_path / "m.mtx")).collect()) == [(0, 0, 5), (2, 1, 7)]


def test_sources_skip_comments_and_gzip_is_read(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "f.tsv.gz", "wt") as f:
        f.write("# a comment\nc\t1\t5\tb\t2\nc\t9\t9\tb\t1\n")
    got = files.read_fragments(spark, str(tmp_path / "f.tsv.gz")).collect()
    assert [(r["chrom"], r["start"], r["stop"], r["barcode"], r["dup"]) for r in got] == [("c", 1, 5, "b", 2)]
    assert files.genome_sizes(spark, str(tmp_path / "f.tsv.gz")).first()["size"] == 5


def test_locus_strings():
    assert C.locus("chr1:1,000-2000", 1500) == ("chr1", 0, 3500)
    with pytest.raises(ValueError, match="locus"):
        C.locus("chr1")


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    frag = spark.createDataFrame([("c", 5, 25, "a"), ("c", 12, 13, "a"), ("c", 40, 41, "b")], "chrom string, start long, stop long, barcode string")
    frag.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = tile_counts(spark.readStream.schema(frag.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 10)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tiles").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.table("tiles")) == rows(tile_counts(frag, 10)) == [("c", 0, "a", 1), ("c", 1, "a", 2), ("c", 2, "a", 1), ("c", 4, "b", 1)]


def test_windows_of_a_stream_close_behind_the_watermark(spark, tmp_path):
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[("c", 0, 15, "a", at(1, 5)), ("c", 3, 4, "a", at(1, 50))], [("c", 2, 3, "b", at(3, 30))], [("c", 0, 1, "a", at(1, 1)), ("c", 5, 6, "b", at(5, 0))]]
    shape = "chrom string, start long, stop long, barcode string, ts timestamp"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        q = tile_counts(stream, 10, "ts").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["from"].hour, r["bin"], r["barcode"], r["cnt"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "a", 2), (1, 1, "a", 1), (3, 0, "b", 1)]


def test_ranks_do_not_depend_on_the_pieces(spark):
    import numpy as np

    x = np.random.default_rng(3).integers(0, 300, 2000).astype(float)
    df = spark.createDataFrame([(i, float(v), float(-v) if i % 7 else None) for i, v in enumerate(x)], "row long, a double, b double")
    for pieces in (2, 64, 1000):
        got = {(r["column"], r["row"]): r["r"] for r in contrast.average_ranks(df, ["a", "b"], pieces).collect()}
        assert all(got["a", i] == (x < v).sum() + ((x == v).sum() + 1) / 2 for i, v in enumerate(x))
        assert len(got) == 2000 + sum(i % 7 > 0 for i in range(2000))


def test_coordinate_text_in_parts_is_one_sequence(spark, tmp_path):
    rows = [(i * 7 % 50, i, i + 1) for i in range(300)]
    matrix = spark.createDataFrame(rows, "row long, col long, val long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_coordinates(matrix, str(tmp_path / "m"), 50, 300)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "m").glob("part-*"))
    text = "".join(p.read_text() for p in parts).split("\n")
    assert len(parts) > 1
    assert text[1] == "50 300 300"
    assert [tuple(map(int, x.split())) for x in text[2:-1]] == sorted((r + 1, c + 1, v) for r, c, v in rows)
    assert sorted(tuple(r) for r in files.read_coordinates(spark, str(tmp_path / "m")).collect()) == sorted(rows)
    (tmp_path / "plain.txt").write_text("2 2 1\n1 2 5\n")
    assert [tuple(r) for r in files.read_coordinates(spark, str(tmp_path / "plain.txt")).collect()] == [(0, 1, 5)]
