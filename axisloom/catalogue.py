"""Registered queries over the segmentation operators, and the DuckDB SQL that gives the same rows.

Floats are rounded to four digits on both sides, ties are broken explicitly, and every column has the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.functions import columns as C
from axisloom.operators import annotate, contrast, counting, em, emission, enrich, intervals, matrix, segments, tiling
from axisloom.operators.chain import Chain, blocked, decode, decoded_map
from axisloom.operators.packed import packed
from axisloom.plans.scratch import fresh_path, stored
from axisloom.plans.views import STATES, WIDTH, oracle, rule_segments, stationary, view
from axisloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


class Inputs:
    """The views of one folder and what most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.frag, self.aln, self.groups, self.genes = (view(spark, sf_dir, n) for n in ("frag", "aln", "cellgroup", "genes"))

    @property
    def sizes(self) -> DataFrame:
        return tiling.chrom_sizes(self.frag)

    @property
    def tile(self) -> DataFrame:
        return tiling.tile(self.sizes, WIDTH)

    @property
    def counts(self) -> DataFrame:
        return counting.fragments_in_tile(self.frag, self.sizes, WIDTH)

    @property
    def datasets(self) -> DataFrame:
        """Two matrices over the same regions: cells with even and with odd numbers."""
        return self.counts.withColumn("dataset", F.when(F.substring("barcode", 2, 20).cast("long") % 2 == 0, "a").otherwise("b"))

    @property
    def seg(self) -> DataFrame:
        return rule_segments(self.tile, matrix.region_totals(self.counts, self.tile))

    @property
    def posterior(self) -> DataFrame:
        return self.seg.select("ridx", F.posexplode(F.array(*(f"Prob_state_{i}" for i in range(STATES)))).alias("state", "p"))

    @property
    def reads(self) -> DataFrame:
        return self.aln.withColumn("barcode", C.barcode("CB", tags=""))

    @property
    def read_sizes(self) -> DataFrame:
        return self.reads.groupBy(F.col("rname").alias("chrom")).agg((F.max("pos") + 3000).alias("size"))


class Kept(Inputs):
    """The same for fits, which read them again and again: stored once, the counts packed by cell."""

    @cached_property
    def sizes(self) -> DataFrame:
        return stored(super().sizes)

    @cached_property
    def tile(self) -> DataFrame:
        return stored(super().tile)

    @cached_property
    def datasets(self) -> DataFrame:
        return stored(packed(super().datasets))


def r4(c: str | F.Column, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 4).alias(name)


# ---------------------------------------------------------------- axis, counting


@query(oracle("SELECT * FROM sizes", "sizes"))
def chrom_sizes(spark, sf):
    return Inputs(spark, sf).sizes


@query(oracle("SELECT ridx, chrom, start, stop, concat(chrom, '_', CAST(start AS VARCHAR), '_', CAST(stop AS VARCHAR)) AS name FROM tile", "tile"))
def tile(spark, sf):
    return Inputs(spark, sf).tile


@query(oracle("SELECT * FROM counts", "counts"))
def tile_counts(spark, sf):
    return Inputs(spark, sf).counts


_REGIONS = "SELECT row_number() OVER (ORDER BY chrom, start, stop) - 1 AS ridx, chrom, start, stop FROM genes"


@query(oracle("SELECT r.ridx AS ridx, f.barcode AS barcode, count(*) AS cnt FROM regions r JOIN frag f ON r.chrom = f.chrom AND r.start < f.stop AND f.start < r.stop GROUP BY ALL", "frag", "genes", regions=_REGIONS))
def region_counts(spark, sf):
    x = Inputs(spark, sf)
    return counting.fragments_in_regions(x.frag, tiling.indexed(x.genes.select("chrom", "start", "stop")))


_READS = {
    "reads": "SELECT *, coalesce(tag_cb, 'dummy') AS barcode, CASE WHEN flag & 16 <> 0 THEN pos + rlen - 1 ELSE pos END AS five FROM aln",
    "rsizes": "SELECT rname AS chrom, max(pos) + 3000 AS size FROM aln GROUP BY rname",
    "roff": "SELECT chrom, size, CAST(coalesce(sum(CAST(ceil(size / 5000.0) AS BIGINT)) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM rsizes",
}


def _read_counts(points: str) -> str:
    body = """SELECT off + bin AS ridx, barcode, count(*) AS cnt FROM points JOIN roff ON points.chrom = roff.chrom
    WHERE bin >= 0 AND bin < ceil(size / 5000.0) GROUP BY ALL"""
    return oracle(body, "aln", **_READS, points=points)


_FINE = "abs(tlen) <= 2000 AND mapq >= 30"


@query(_read_counts(f"""SELECT rname AS chrom, barcode, (CASE WHEN flag & 2 <> 0 AND flag & 64 <> 0 THEN least(pos, mpos) + abs(tlen) // 2 ELSE five END) // 5000 AS bin
    FROM reads WHERE {_FINE} AND ((flag & 2 <> 0 AND flag & 64 <> 0) OR flag & 1 = 0)"""))
def read_counts_midpoint(spark, sf):
    x = Inputs(spark, sf)
    return counting.reads_in_tile(x.reads, x.read_sizes, 5000, "midpoint")


@query(_read_counts(f"SELECT rname AS chrom, barcode, five // 5000 AS bin FROM reads WHERE {_FINE} AND barcode <> 'dummy'"))
def read_counts_countboth(spark, sf):
    x = Inputs(spark, sf)
    return counting.reads_in_tile(x.reads, x.read_sizes, 5000, "countboth", only_with_barcode=True)


@query(_read_counts(f"""SELECT rname AS chrom, barcode, five // 5000 AS bin FROM reads WHERE {_FINE}
    UNION ALL SELECT rname, barcode, mpos // 5000 FROM reads WHERE {_FINE} AND flag & 1 <> 0 AND mpos // 5000 <> five // 5000"""))
def read_counts_eitherend(spark, sf):
    x = Inputs(spark, sf)
    return counting.reads_in_tile(x.reads, x.read_sizes, 5000, "eitherend")


_RTILE = "SELECT off + i AS ridx, chrom, i * 5000 AS start, least((i + 1) * 5000, size) AS stop FROM (SELECT *, unnest(range(CAST(ceil(size / 5000.0) AS BIGINT))) AS i FROM roff)"


@query(oracle(
    "SELECT ridx, barcode, count(*) AS cnt FROM rtile t JOIN points p ON p.chrom = t.chrom AND p.x >= greatest(t.start - 100, 0) AND p.x < t.stop + 100 GROUP BY ALL", "aln", **_READS, rtile=_RTILE,
    points=f"SELECT rname AS chrom, barcode, CASE WHEN flag & 2 <> 0 AND flag & 64 <> 0 THEN least(pos, mpos) + abs(tlen) // 2 ELSE five END AS x FROM reads WHERE {_FINE} AND ((flag & 2 <> 0 AND flag & 64 <> 0) OR flag & 1 = 0)",
))
def read_region_counts(spark, sf):
    x = Inputs(spark, sf)
    return counting.reads_in_regions(x.reads, tiling.tile(x.read_sizes, 5000), "midpoint", flank=100, width=5000)


@query(oracle(
    "SELECT t.ridx AS ridx, least(f.stop - f.start, 1000) AS len, count(*) AS cnt FROM rtile t JOIN frags f ON f.chrom = t.chrom AND f.start < t.stop AND t.start < f.stop GROUP BY ALL", "aln", **_READS, rtile=_RTILE,
    frags="SELECT rname AS chrom, least(pos, mpos) AS start, least(pos, mpos) + abs(tlen) AS stop FROM aln WHERE flag & 2 <> 0 AND flag & 64 <> 0 AND mapq >= 30 AND tlen <> 0",
))
def read_frag_lengths(spark, sf):
    x = Inputs(spark, sf)
    return counting.region_lengths(counting.read_fragments(x.reads), tiling.tile(x.read_sizes, 5000), 1000)


@query(oracle("SELECT t.ridx AS ridx, least(f.stop - f.start, 200) AS len, count(*) AS cnt FROM tile t JOIN frag f ON t.chrom = f.chrom AND t.start < f.stop AND f.start < t.stop GROUP BY ALL", "tile", "frag"))
def frag_lengths(spark, sf):
    x = Inputs(spark, sf)
    return counting.region_lengths(x.frag, x.tile, 200)


_LENGTHS = "SELECT t.ridx AS ridx, least(f.stop - f.start, 200) AS len, count(*) AS cnt FROM tile t JOIN frag f ON t.chrom = f.chrom AND t.start < f.stop AND f.start < t.stop GROUP BY ALL"


@query(oracle("SELECT len, round(sum(cnt) / (SELECT sum(cnt) FROM lens), 4) AS share FROM lens GROUP BY len", "tile", "frag", lens=_LENGTHS))
def frag_length_dist(spark, sf):
    return segments.length_distribution(frag_lengths(spark, sf)).select("len", r4("share", "share"))


@query(oracle("SELECT name, len, round(n / sum(n) OVER (PARTITION BY name), 4) AS share FROM (SELECT concat('state_', CAST(s.state AS VARCHAR)) AS name, l.len AS len, sum(l.cnt) AS n FROM lens l JOIN seg s ON l.ridx = s.ridx GROUP BY ALL)", "seg", "frag", lens=_LENGTHS))
def frag_length_by_state(spark, sf):
    return segments.length_distribution(frag_lengths(spark, sf), Inputs(spark, sf).seg).select("name", "len", r4("share", "share"))


@query(oracle(f"SELECT rname AS chrom, least(pos, mpos) // 5000 AS bin, abs(tlen) // 100 AS len, count(*) AS cnt FROM aln WHERE flag & 2 <> 0 AND flag & 64 <> 0 AND mapq >= 30 AND tlen <> 0 AND abs(tlen) < 1500 GROUP BY ALL", "aln"))
def coarse_frag_lengths(spark, sf):
    return counting.coarse_lengths(Inputs(spark, sf).reads, 5000, 1500, 100)


_LOCUS = ("click", 100_000, 400_000, 5000)
_SITES = """SELECT barcode, site FROM (SELECT barcode, unnest([CASE WHEN start >= 100000 THEN start END, CASE WHEN stop < 400000 THEN stop END]) AS site
    FROM frag WHERE chrom = 'click' AND start < 400000 AND stop > 100000) WHERE site IS NOT NULL"""
_PROFILE = "SELECT barcode, (site - 100000) // 5000 AS bin, count(*) AS cnt FROM sites GROUP BY ALL"


@query(oracle("SELECT * FROM prof", "frag", sites=_SITES, prof=_PROFILE))
def locus_profile(spark, sf):
    return counting.fragment_profile(Inputs(spark, sf).frag, *_LOCUS)


@query(oracle("SELECT b.i AS bin, b.i * 5000 + 100000 AS start, (b.i + 1) * 5000 + 100000 AS stop, CAST(coalesce(sum(p.cnt), 0) AS BIGINT) AS cnt FROM range(60) b(i) LEFT JOIN prof p ON p.bin = b.i GROUP BY ALL", "frag", sites=_SITES, prof=_PROFILE))
def locus_depth(spark, sf):
    profile = counting.fragment_profile(Inputs(spark, sf).frag, *_LOCUS)
    bins = counting.profile_bins(*_LOCUS[1:], spark)
    return bins.join(profile.groupBy("bin").agg(F.sum("cnt").alias("cnt")), "bin", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


@query(oracle("SELECT barcode, (e - 100000) // 5000 AS bin, count(*) AS cnt FROM (SELECT coalesce(tag_cb, 'dummy') AS barcode, CASE WHEN flag & 16 <> 0 THEN pos + rlen ELSE pos END AS e FROM aln WHERE rname = 'chr1' AND mapq >= 10 AND flag & 4 = 0) WHERE e BETWEEN 100000 AND 400000 GROUP BY ALL", "aln"))
def read_locus_profile(spark, sf):
    return counting.read_profile(Inputs(spark, sf).reads, "chr1", *_LOCUS[1:])


_FACTORS = "SELECT barcode, count(*) AS n FROM frag GROUP BY barcode"
_MEANS = """SELECT p.grp AS grp, p.bin AS bin, p.x / s.k AS mean FROM (SELECT g.grp AS grp, q.bin AS bin, sum(q.cnt * 10000.0::DOUBLE / f.n) AS x FROM prof q JOIN fac f ON q.barcode = f.barcode JOIN cellgroup g ON q.barcode = g.barcode GROUP BY ALL) p
    JOIN (SELECT grp, count(*) AS k FROM cellgroup GROUP BY grp) s ON p.grp = s.grp"""


@query(oracle("SELECT grp, bin, round(mean, 4) AS mean, round((SELECT max(mean) FROM means), 4) AS top FROM means", "frag", "cellgroup", sites=_SITES, prof=_PROFILE, fac=_FACTORS, means=_MEANS))
def locus_group_mean(spark, sf):
    x = Inputs(spark, sf)
    found = matrix.group_profile(counting.fragment_profile(x.frag, *_LOCUS), x.groups, counting.size_factors(x.frag))
    return found.select("grp", "bin", r4("mean", "mean"), r4("top", "top"))


@query(oracle("SELECT DISTINCT coalesce(tag_cb, 'dummy') AS barcode FROM aln", "aln"))
def barcodes(spark, sf):
    return counting.cells(Inputs(spark, sf).reads)


@query(oracle("SELECT tag_cb AS barcode, count(*) AS n FROM aln WHERE mapq >= 10 AND tag_cb IS NOT NULL GROUP BY ALL", "aln"))
def size_factors(spark, sf):
    return counting.size_factors(Inputs(spark, sf).reads)


@query(oracle("SELECT qname, rname, pos FROM aln WHERE flag & 4 = 0 AND NOT contains(rname, 'r1') AND NOT contains(rname, 'r3')", "aln"))
def remove_chroms(spark, sf):
    return counting.without_chroms(Inputs(spark, sf).reads, ["r1", "r3"]).select("qname", "rname", "pos")


@query(oracle("""SELECT qname, barcode FROM (SELECT *, row_number() OVER w AS i, lag(rname) OVER w AS a, lag(pos) OVER w AS b, lag(flag & 16) OVER w AS c, lag(tlen) OVER w AS d
    FROM (SELECT *, coalesce(tag_cb, 'dummy') AS barcode FROM aln) WINDOW w AS (PARTITION BY barcode ORDER BY rname, pos, qname))
    WHERE i = 1 OR a <> rname OR b <> pos OR c <> flag & 16 OR d <> tlen""", "aln"))
def dedup_reads(spark, sf):
    return counting.deduplicated(Inputs(spark, sf).reads).select("qname", "barcode")


@query(oracle("SELECT split_part(qname, ':', 1) AS barcode, c.barcode IS NOT NULL AS grouped, count(*) AS n FROM aln LEFT JOIN cellgroup c ON c.barcode = concat('u', split_part(qname, ':', 1)) GROUP BY ALL", "aln", "cellgroup"))
def custom_barcode(spark, sf):
    x = Inputs(spark, sf)
    reads = x.aln.withColumn("barcode", C.barcode(lambda name: F.split(name, ":")[0], tags=""))
    met = reads.join(x.groups.select(F.expr("substring(barcode, 2)").alias("barcode"), F.lit(True).alias("grouped")), "barcode", "left")
    return met.groupBy("barcode", F.coalesce("grouped", F.lit(False)).alias("grouped")).agg(F.count("*").alias("n"))


def _tag_and_strand(reads):
    """Barcode and strand of a read, from its tag and its flag together."""
    return reads["tag_cb"] + (reads["flag"] & 16 != 0).map({True: "-", False: "+"})


@query(oracle("SELECT barcode, count(*) AS n, count(DISTINCT rname) AS chroms FROM (SELECT *, coalesce(concat(NULLIF(tag_cb, ''), CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END), 'dummy') AS barcode FROM (SELECT qname, rname, flag, coalesce(tag_cb, '') AS tag_cb FROM aln) WHERE tag_cb <> '') GROUP BY ALL UNION ALL SELECT 'dummy', count(*), count(DISTINCT rname) FROM aln WHERE tag_cb IS NULL HAVING count(*) > 0", "aln"))
def read_rule_barcode(spark, sf):
    reads = Inputs(spark, sf).aln.withColumn("barcode", C.barcode_of_read(_tag_and_strand, "tag_cb", "flag"))
    return reads.groupBy("barcode").agg(F.count("*").alias("n"), F.count_distinct("rname").alias("chroms"))


@query(oracle("SELECT kind, chrom, size FROM sizes CROSS JOIN (VALUES ('sizes'), ('tsv')) v(kind)", "sizes"))
def chrom_sizes_by_suffix(spark, sf):
    """From a list of sizes, and from fragments, by the file's suffix."""
    x, path = Inputs(spark, sf), fresh_path(spark, "suffix")
    x.sizes.write.csv(f"{path}/genome.sizes", sep="\t")
    x.frag.select("chrom", "start", "stop", "barcode", "dup").write.csv(f"{path}/fragments.tsv", sep="\t")
    found = [files.genome_sizes(spark, f"{path}/{name}").select(F.lit(name.split(".")[1]).alias("kind"), "chrom", "size") for name in ("genome.sizes", "fragments.tsv")]
    return found[0].unionByName(found[1])


# ---------------------------------------------------------------- matrices


@query(oracle("SELECT barcode, CAST(sum(cnt) AS BIGINT) AS total FROM counts GROUP BY barcode", "counts"))
def cell_totals(spark, sf):
    return matrix.cell_totals(Inputs(spark, sf).counts)


@query(oracle("SELECT ridx, readdepth AS total FROM depth", "depth"))
def region_totals(spark, sf):
    x = Inputs(spark, sf)
    return matrix.region_totals(x.counts, x.tile)


_FILTERED = """SELECT * FROM one WHERE barcode IN (SELECT barcode FROM one GROUP BY barcode HAVING sum(cnt) BETWEEN 20 AND 80)"""


@query(oracle("SELECT ridx, barcode, cnt FROM two WHERE ridx IN (SELECT ridx FROM two GROUP BY ridx HAVING sum(cnt) BETWEEN 2 AND 6)", "counts", one="SELECT ridx, barcode, CAST(1 AS BIGINT) AS cnt FROM counts", two=_FILTERED))
def filter_matrix(spark, sf):
    x = Inputs(spark, sf)
    return matrix.quality_filtered(x.counts, x.tile, counting.cells(x.frag), 20, 80, 2, 6)[0]


@query(oracle("SELECT ridx, barcode, CAST(1 AS BIGINT) AS bin, CAST(least(cnt, 2) AS BIGINT) AS cut FROM counts", "counts"))
def binarize_trim(spark, sf):
    x = Inputs(spark, sf).counts
    return matrix.binarized(x).withColumnRenamed("cnt", "bin").join(matrix.trimmed(x, 2).withColumnRenamed("cnt", "cut"), ["ridx", "barcode"])


@query(oracle("SELECT ridx, c.barcode AS barcode, cnt FROM counts c JOIN cellgroup g ON c.barcode = g.barcode WHERE grp = 'g3'", "counts", "cellgroup"))
def subset_cells(spark, sf):
    x = Inputs(spark, sf)
    return matrix.subset_cells(x.counts, x.groups.where("grp = 'g3'"))


@query(oracle("SELECT ridx, grp, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts c JOIN cellgroup g ON c.barcode = g.barcode GROUP BY ALL", "counts", "cellgroup"))
def pseudobulk(spark, sf):
    x = Inputs(spark, sf)
    return matrix.pseudobulk(x.counts, x.groups)


@query(oracle("SELECT g.grp AS grp, count(DISTINCT g.barcode) AS n_cells, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS cnt FROM cellgroup g LEFT JOIN counts c ON c.barcode = g.barcode AND g.grp <> 'g2' GROUP BY ALL", "counts", "cellgroup"))
def pseudobulk_cells(spark, sf):
    """Every group's column, that of a group of which no cell was counted too."""
    x = Inputs(spark, sf)
    counted = x.counts.join(x.groups.where("grp = 'g2'"), "barcode", "left_anti")
    return matrix.bulk_cells(counted, x.groups)


@query(oracle("SELECT grp, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts c JOIN cellgroup g ON c.barcode = g.barcode GROUP BY ALL", "counts", "cellgroup"))
def collapse_groups(spark, sf):
    x = Inputs(spark, sf)
    return matrix.group_totals(x.counts, x.groups)


@query(oracle("SELECT 'sample_0' AS sample, * FROM counts UNION ALL SELECT 'sample_1', ridx, barcode, CAST(1 AS BIGINT) FROM counts", "counts"))
def merge_samples(spark, sf):
    x = Inputs(spark, sf).counts
    return matrix.merged([x, matrix.binarized(x)])


@query(oracle("SELECT barcode, grp, NULL::BIGINT AS n FROM cellgroup UNION ALL SELECT barcode, NULL, count(*) FROM frag GROUP BY barcode", "cellgroup", "frag"))
def concat_cells(spark, sf):
    x = Inputs(spark, sf)
    return matrix.concatenated_cells([x.groups, counting.size_factors(x.frag)])


@query(oracle("SELECT c.ridx AS ridx, c.barcode AS barcode, round(c.cnt * 10000.0::DOUBLE / f.n, 4) AS value FROM counts c JOIN fac f ON c.barcode = f.barcode", "counts", "frag", fac=_FACTORS))
def normalize(spark, sf):
    x = Inputs(spark, sf)
    return matrix.normalized(x.counts, counting.size_factors(x.frag)).select("ridx", "barcode", r4("value", "value"))


@query(oracle(f"SELECT grp, chrom, bin, round(n * 1000000.0::DOUBLE / sum(n) OVER (PARTITION BY grp), 4) AS cpm FROM (SELECT grp, chrom, start // {WIDTH} AS bin, count(*) AS n FROM frag f JOIN cellgroup g ON f.barcode = g.barcode GROUP BY ALL)", "frag", "cellgroup"))
def cpm_track(spark, sf):
    x = Inputs(spark, sf)
    return matrix.group_tracks(x.frag, x.groups, WIDTH).select("grp", "chrom", "bin", r4("cpm", "cpm"))


@query(oracle("SELECT c.ridx AS ridx, barcode, cnt FROM counts c JOIN tile t ON c.ridx = t.ridx WHERE chrom NOT IN ('error', 'signup')", "counts", "tile"))
def drop_chroms(spark, sf):
    x = Inputs(spark, sf)
    return matrix.drop_chroms(x.counts, x.tile, ["error", "signup"])[0]


_DATASETS = "SELECT *, CASE WHEN CAST(substr(barcode, 2) AS BIGINT) % 2 = 0 THEN 'a' ELSE 'b' END AS dataset FROM counts"


@query(oracle("SELECT dataset, ridx, barcode, cnt FROM kept WHERE ridx IN (SELECT ridx FROM kept GROUP BY ridx HAVING sum(cnt) >= 3)", "counts", data=_DATASETS, kept="SELECT dataset, ridx, barcode, CAST(least(cnt, 1) AS BIGINT) AS cnt FROM data WHERE (dataset, barcode) IN (SELECT (dataset, barcode) FROM data GROUP BY dataset, barcode HAVING sum(least(cnt, 1)) >= 50)"))
def multi_load_filter(spark, sf):
    x = Inputs(spark, sf).datasets
    return matrix.multi_matrix({d: x.where(F.col("dataset") == d).drop("dataset") for d in "ab"}, min_cell=50, trim=1, min_region=3)


@query(oracle("SELECT ridx, CAST(len(list_filter((SELECT list_transform(quantile_cont(readdepth, [0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]), lambda x: round(x, 6)) FROM depth), lambda q: q < readdepth)) AS INT) AS cntbin FROM depth", "depth"))
def depth_bins(spark, sf):
    x = Inputs(spark, sf)
    totals = matrix.region_totals(x.counts, x.tile)
    return emission.depth_bins(totals, emission.depth_breaks(totals))


@query(oracle("SELECT c.barcode AS barcode, g.grp AS grp, count(*) AS n, CAST(sum(c.stop - c.start) AS BIGINT) AS bases FROM frag c JOIN cellgroup g ON c.barcode = g.barcode WHERE grp <> 'g0' GROUP BY ALL", "frag", "cellgroup"))
def split_by_group(spark, sf):
    x, path = Inputs(spark, sf), fresh_path(spark, "groups")
    files.write_by_group(x.frag, x.groups.where("grp <> 'g0'"), path)
    return spark.read.parquet(path).groupBy("barcode", "grp").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


# ---------------------------------------------------------------- the model

_INIT = {
    "data": _DATASETS,
    "init": f"SELECT ridx, CAST((((ridx * 2654435761 + 32 * 40503) % 4294967296) // 65536) % {STATES} AS INT) AS state FROM tile",
    "cells": "SELECT dataset, barcode, sum(cnt) + 1 AS x FROM data GROUP BY ALL",
    "prior": "SELECT dataset, barcode, x / sum(x) OVER (PARTITION BY dataset) AS prior FROM cells",
    "sums": "SELECT d.dataset AS dataset, d.barcode AS barcode, i.state AS state, sum(d.cnt)::DOUBLE AS suffstat FROM data d JOIN init i ON d.ridx = i.ridx GROUP BY ALL",
    "emi": f"SELECT p.dataset AS dataset, p.barcode AS barcode, CAST(k.i AS INT) AS state, coalesce(s.suffstat, 0) AS suffstat, prior FROM prior p CROSS JOIN range({STATES}) k(i) LEFT JOIN sums s ON s.dataset = p.dataset AND s.barcode = p.barcode AND s.state = k.i",
}
_LL = _INIT | {
    "alpha0": "SELECT dataset, state, sum(suffstat + prior) AS a FROM emi GROUP BY ALL",
    "n": "SELECT dataset, ridx, sum(cnt) AS n FROM data GROUP BY ALL",
    "gain": "SELECT d.dataset AS dataset, d.ridx AS ridx, e.state AS state, sum(lgamma(e.suffstat + e.prior + d.cnt) - lgamma(e.suffstat + e.prior)) AS g FROM data d JOIN emi e ON d.dataset = e.dataset AND d.barcode = e.barcode GROUP BY ALL",
    "each": "SELECT gain.ridx AS ridx, gain.state AS state, g + lgamma(a) - lgamma(n + a) AS x FROM gain JOIN n ON gain.dataset = n.dataset AND gain.ridx = n.ridx JOIN alpha0 ON gain.dataset = alpha0.dataset AND gain.state = alpha0.state",
    "ll": f"SELECT t.ridx AS ridx, CAST(k.i AS INT) AS state, coalesce(sum(x), 0) AS ll FROM tile t CROSS JOIN range({STATES}) k(i) LEFT JOIN each e ON e.ridx = t.ridx AND e.state = k.i GROUP BY ALL",
}
_POST = _LL | {"post": "SELECT ridx, state, exp(ll - max(ll) OVER w) / sum(exp(ll - m)) OVER w AS p FROM (SELECT *, max(ll) OVER (PARTITION BY ridx) AS m FROM ll) WINDOW w AS (PARTITION BY ridx)"}
_OPTIONS = em.Options(block_rows=500, boundary="restart")


def _initial(x: Inputs):
    return em.initial_model(x.datasets, x.tile, STATES)


@query(oracle("SELECT dataset, barcode, state, round(suffstat, 4) AS suffstat, round(prior, 4) AS prior FROM emi", "tile", "counts", **_INIT))
def init_model(spark, sf):
    return _initial(Inputs(spark, sf)).emission.select("dataset", "barcode", "state", r4("suffstat", "suffstat"), r4("prior", "prior"))


@query(oracle("SELECT ridx, state, round(ll, 4) AS ll FROM ll", "tile", "counts", **_LL))
def emission_loglik(spark, sf):
    x = Inputs(spark, sf)
    return emission.log_likelihood(x.datasets, x.tile, _initial(x).emission, STATES).select("ridx", "state", r4("ll", "ll"))


@query(oracle("SELECT ridx, state, round(p, 4) AS p FROM post", "tile", "counts", **_POST))
def em_first_posterior(spark, sf):
    x = Inputs(spark, sf)
    return em.posterior(_initial(x), x.datasets, x.tile, _OPTIONS).select("ridx", "state", r4("p", "p"))


@query(oracle(
    "SELECT i, j, round((x + 1e-6::DOUBLE) / sum(x + 1e-6::DOUBLE) OVER (PARTITION BY i), 4) AS p FROM xi", "tile", "counts", **_POST,
    xi="SELECT a.state AS i, b.state AS j, sum(a.p * b.p) AS x FROM post a JOIN post b ON b.ridx = a.ridx + 1 AND b.ridx // 500 = a.ridx // 500 GROUP BY ALL",
))
def em_first_trans(spark, sf):
    x = Inputs(spark, sf)
    sums, _ = em.statistics(em.expectation(_initial(x), x.datasets, x.tile, _OPTIONS))
    return em.chain_tables(spark, em.m_step(sums, Chain.uniform(STATES), _OPTIONS))[1].select("i", "j", r4("p", "p"))


@query(oracle("SELECT d.dataset AS dataset, d.barcode AS barcode, p.state AS state, round(sum(d.cnt * p.p), 4) AS suffstat FROM data d JOIN post p ON d.ridx = p.ridx GROUP BY ALL", "tile", "counts", **_POST))
def em_first_emission(spark, sf):
    x = Inputs(spark, sf)
    return emission.state_sums(x.datasets, em.posterior(_initial(x), x.datasets, x.tile, _OPTIONS)).select("dataset", "barcode", "state", r4("suffstat", "suffstat"))


def _by_chrom(x: Inputs) -> DataFrame:
    return x.tile.select("ridx", F.col("chrom").alias("chain"))


def _fitted(x: Inputs, iterations: int = 3) -> em.Model:
    return em.fit(x.datasets, x.tile, STATES, iterations, chain_of=_by_chrom(x))


@query(oracle("SELECT ridx, CAST(arg_max(state, p - state * 1e-12) AS INT) AS state FROM post GROUP BY ridx", "tile", "counts", **_POST))
def map_call(spark, sf):
    x = Inputs(spark, sf)
    return decoded_map(em.posterior(_initial(x), x.datasets, x.tile, _OPTIONS))


@query(oracle("""SELECT dataset, barcode, state, round(ln(a / sum(a) OVER (PARTITION BY state)) - ln(sum(a) OVER (PARTITION BY dataset, barcode) / sum(a) OVER ()), 4) AS value
    FROM (SELECT *, suffstat + prior AS a FROM emi)""", "tile", "counts", **_INIT))
def log_fold_emission(spark, sf):
    return enrich.log_fold_emission(_initial(Inputs(spark, sf)).emission).select("dataset", "barcode", "state", r4("value", "value"))


# ---------------------------------------------------------------- a fixed chain over whole chromosomes, region by region in SQL

_CHAIN = Chain(np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.25, 0.05, 0.7]]))
#: Many blocks to a chromosome, so that their boundaries are put to the test.
_BLOCKS = em.Options(block_rows=100)
_K = range(STATES)


def _a(i: int, j: int) -> str:
    return f"{_CHAIN.trans[i, j]}::DOUBLE"


def _listed(f: Callable[[int], str], sep: str = ", ") -> str:
    return sep.join(f(i) for i in _K)


def _forward_backward(ll: str, at: str = "", a: Callable[[int, int], str] = _a, start: Callable[[int], str] = lambda i: f"{_CHAIN.start[i]}::DOUBLE", held: str = "") -> dict[str, str]:
    """CTEs over (chain, ridx, l0, l1, ...): forward and backward vectors that sum to 1 at each region, posteriors and scores.

    a, start: the chain's numbers, or columns of `held`, a table of one row. at: what the CTEs' names end in.
    """
    norm = lambda xs: ", ".join(f"({x}) / ({' + '.join(xs)}) AS {{}}{i}" for i, x in enumerate(xs))
    into = [f"({' + '.join(f'f{i} * {a(i, j)}' for i in _K)}) * e{j}" for j in _K]
    first = [f"{start(j)} * e{j}" for j in _K]
    back = [" + ".join(f"{a(i, j)} * e{j} * b{j}" for j in _K) for i in _K]
    more = f" CROSS JOIN {held}" if held else ""
    return {
        f"obs{at}": f"SELECT chain, t, ridx, top, {_listed(lambda i: f'exp(l{i} - top) AS e{i}')} FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY ridx) AS t, greatest({_listed(lambda i: f'l{i}')}) AS top FROM ({ll}))",
        f"last{at}": f"SELECT chain, max(t) AS t FROM obs{at} GROUP BY chain",
        f"fw{at}": f"""SELECT chain, t, {norm(first).format(*['f'] * STATES)}, ln({' + '.join(first)}) + top AS s FROM obs{at}{more} WHERE t = 1
            UNION ALL SELECT o.chain, o.t, {norm(into).format(*['f'] * STATES)}, s + ln({' + '.join(into)}) + o.top FROM fw{at} fw JOIN obs{at} o ON o.chain = fw.chain AND o.t = fw.t + 1{more}""",
        f"bw{at}": f"""SELECT chain, t, {_listed(lambda i: f'1.0::DOUBLE / {STATES} AS b{i}')} FROM last{at}
            UNION ALL SELECT bw.chain, bw.t - 1, {norm(back).format(*['b'] * STATES)} FROM bw{at} bw JOIN obs{at} o ON o.chain = bw.chain AND o.t = bw.t{more} WHERE bw.t > 1""",
        f"prob{at}": f"SELECT o.ridx AS ridx, o.chain AS chain, o.t AS t, {_listed(lambda i: f'f{i} * b{i} / ({_listed(lambda j: f"f{j} * b{j}", " + ")}) AS p{i}')} FROM obs{at} o JOIN fw{at} fw ON fw.chain = o.chain AND fw.t = o.t JOIN bw{at} bw ON bw.chain = o.chain AND bw.t = o.t",
    }


_WIDE = "SELECT t.chrom AS chain, ll.ridx AS ridx, " + _listed(lambda i: f"max(CASE WHEN state = {i} THEN ll END) AS l{i}") + " FROM ll JOIN tile t ON t.ridx = ll.ridx GROUP BY ALL"
_BY_DATASET = (
    "SELECT concat(d.dataset, ':', t.chrom) AS chain, t.ridx AS ridx, " + _listed(lambda i: f"coalesce(max(CASE WHEN e.state = {i} THEN x END), 0) AS l{i}")
    + " FROM tile t CROSS JOIN (SELECT DISTINCT dataset FROM data) d LEFT JOIN each e ON e.ridx = t.ridx AND e.dataset = d.dataset GROUP BY ALL"
)
_LONG = " UNION ALL ".join(f"SELECT ridx, chain, CAST({i} AS INT) AS state, p{i} AS p FROM prob" for i in _K)


def _chained(query: str, ll: str = _WIDE, **more: str) -> str:
    each = _LL["each"].replace("SELECT gain.ridx", "SELECT gain.dataset AS dataset, gain.ridx")
    sql = _recursive(oracle(query, "tile", "counts", **(_LL | {"each": each} | _forward_backward(ll) | more)))
    return sql.replace(" obs AS (", " obs AS MATERIALIZED (").replace(" ll AS (", " ll AS MATERIALIZED (")


def _fixed(x: Inputs) -> em.Model:
    model = _initial(x)
    model.chain = _CHAIN
    return model


@query(_chained(f"SELECT ridx, state, round(p, 4) AS p FROM ({_LONG})"))
def chain_posterior(spark, sf):
    x = Inputs(spark, sf)
    return em.posterior(_fixed(x), x.datasets, x.tile, _BLOCKS, _by_chrom(x)).select("ridx", "state", r4("p", "p"))


@query(_chained("SELECT round(sum(s), 3) AS score FROM fw JOIN last ON fw.chain = last.chain AND fw.t = last.t"))
def chain_score(spark, sf):
    x = Inputs(spark, sf)
    passed = em.expectation(_fixed(x), x.datasets, x.tile, _BLOCKS, _by_chrom(x))
    return passed.where("kind = 'score'").agg(F.round(F.sum("p"), 3).alias("score"))


@query(_chained(
    "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(x), 3) AS n FROM pairs GROUP BY ALL",
    pairs=" UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, f{i} * {_a(i, j)} * e{j} * b{j} / ({' + '.join(f'f{k} * {_a(k, m)} * e{m} * b{m}' for k in _K for m in _K)}) AS x FROM fw JOIN obs o ON o.chain = fw.chain AND o.t = fw.t + 1 JOIN bw ON bw.chain = o.chain AND bw.t = o.t"
        for i in _K for j in _K
    ),
))
def chain_transitions(spark, sf):
    x = Inputs(spark, sf)
    passed = em.expectation(_fixed(x), x.datasets, x.tile, _BLOCKS, _by_chrom(x)).where("kind = 'trans'")
    return passed.groupBy(F.col("state").alias("i"), F.col("other").alias("j")).agg(F.round(F.sum("p"), 3).alias("n"))


def _viterbi(at: str = "", a: Callable[[int, int], str] = _a, start: Callable[[int], str] = lambda i: f"{_CHAIN.start[i]}::DOUBLE", held: str = "") -> dict[str, str]:
    more = f" CROSS JOIN {held}" if held else ""
    ahead = lambda j: _listed(lambda i: f"v{i} + ln({a(i, j)})")
    return {
        f"vit{at}": f"SELECT chain, t, {_listed(lambda j: f'ln({start(j)}) + ln(e{j}) + top AS v{j}, -1 AS q{j}')} FROM obs{at}{more} WHERE t = 1 UNION ALL SELECT o.chain, o.t, "
        + _listed(lambda j: f"greatest({ahead(j)}) + ln(e{j}) + o.top, list_position([{ahead(j)}], greatest({ahead(j)})) - 1")
        + f" FROM vit{at} vit JOIN obs{at} o ON o.chain = vit.chain AND o.t = vit.t + 1{more}",
        f"way{at}": f"SELECT v.chain AS chain, v.t AS t, list_position([{_listed(lambda i: f'v{i}')}], greatest({_listed(lambda i: f'v{i}')})) - 1 AS state FROM vit{at} v JOIN last{at} l ON l.chain = v.chain AND l.t = v.t"
        f" UNION ALL SELECT w.chain, w.t - 1, CASE w.state {_listed(lambda i: f'WHEN {i} THEN q{i}', ' ')} END FROM way{at} w JOIN vit{at} v ON v.chain = w.chain AND v.t = w.t WHERE w.t > 1",
    }


@query(_chained(
    "SELECT o.ridx AS ridx, CAST(w.state AS INT) AS state FROM way w JOIN obs o ON o.chain = w.chain AND o.t = w.t",
    **_viterbi(),
))
def chain_viterbi(spark, sf):
    x = Inputs(spark, sf)
    return em.predict(_fixed(x), x.datasets, x.tile, "viterbi", _BLOCKS, _by_chrom(x)).select("ridx", "state")


@query(_chained(f"SELECT ridx, state, round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS sd FROM ({_LONG}) GROUP BY ALL", _BY_DATASET))
def chain_robust(spark, sf):
    x = Inputs(spark, sf)
    return em.robust_posterior(_fixed(x), x.datasets, x.tile, _BLOCKS, _by_chrom(x)).select("ridx", "state", r4("mean", "mean"), r4("sd", "sd"))


_CALLED = "SELECT ridx, " + _listed(lambda i: f"p{i}") + f", list_position([{_listed(lambda i: f'p{i}')}], greatest({_listed(lambda i: f'p{i}')})) - 1 AS state FROM prob"


_SEGMENTED = (
    f"SELECT t.ridx AS ridx, t.chrom AS chrom, t.start AS start, t.stop AS stop, {_listed(lambda i: f'round(p{i}, 4) AS Prob_state_{i}')}, round(greatest({_listed(lambda i: f'p{i}')}), 4) AS Prob_max, CAST(state AS INT) AS state, concat('state_', state) AS name, "
    "CAST(coalesce(sum(CASE WHEN dataset = 'a' THEN cnt END), 0) AS BIGINT) AS readdepth_0, CAST(coalesce(sum(CASE WHEN dataset = 'b' THEN cnt END), 0) AS BIGINT) AS readdepth_1 FROM tile t JOIN called c ON c.ridx = t.ridx LEFT JOIN data d ON d.ridx = t.ridx GROUP BY ALL"
)


@query(_chained(
    _SEGMENTED,
    called=_CALLED,
))
def chain_segmentation(spark, sf):
    x = Inputs(spark, sf)
    found = segments.segments(x.tile, em.posterior(_fixed(x), x.datasets, x.tile, _BLOCKS, _by_chrom(x)), x.datasets, STATES)
    return found.select("ridx", "chrom", "start", "stop", *(r4(f"Prob_state_{i}", f"Prob_state_{i}") for i in _K), r4("Prob_max", "Prob_max"), "state", "name", "readdepth_0", "readdepth_1")


@query(_chained("SELECT concat('state_', state) AS name, count(*) AS n FROM called GROUP BY ALL", called=_CALLED))
def chain_frequency(spark, sf):
    return segments.state_frequency(chain_segmentation(spark, sf))


@query(" UNION ALL ".join(f"SELECT CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, round({_a(i, j)}, 4) AS p FROM (SELECT count(*) AS n FROM events) WHERE n > 0" for i in _K for j in _K))
def model_store_chain(spark, sf):
    path = fresh_path(spark, "model")
    files.write_model(_fixed(Inputs(spark, sf)), path)
    return em.chain_tables(spark, files.read_model(spark, path).chain)[1].select("i", "j", r4("p", "p"))


# ---------------------------------------------------------------- fitted models, round by round in SQL

_PAIR = [(i, j) for i in _K for j in _K]


def _held_chain(at: str) -> dict:
    return {"at": at, "a": lambda i, j: f"c.a{i}{j}", "start": lambda i: f"c.s{i}", "held": f"c{at} c"}


def _likelihood_ctes(at: str) -> dict[str, str]:
    """From the emissions emi{at}: likelihoods of datasets and of regions."""
    return {
        f"alpha0{at}": f"SELECT dataset, state, sum(suffstat + prior) AS a FROM emi{at} GROUP BY ALL",
        f"gain{at}": f"SELECT d.dataset AS dataset, d.ridx AS ridx, e.state AS state, sum(lgamma(e.suffstat + e.prior + d.cnt) - lgamma(e.suffstat + e.prior)) AS g FROM data d JOIN emi{at} e ON d.dataset = e.dataset AND d.barcode = e.barcode GROUP BY ALL",
        f"each{at}": f"SELECT g.dataset AS dataset, g.ridx AS ridx, g.state AS state, g + lgamma(a) - lgamma(n + a) AS x FROM gain{at} g JOIN n ON g.dataset = n.dataset AND g.ridx = n.ridx JOIN alpha0{at} z ON g.dataset = z.dataset AND g.state = z.state",
    }


def _rounds(rounds: int, seed: int = 32, name: str = "") -> dict[str, str]:
    """CTEs of EM by chromosome from a seed's initial model: emissions, chains and passes after 0, 1, ... rounds.

    After r rounds there are emi, c (one row: s0, ..., a00, ...), obs, last, fw, bw and prob, each with {name}_{r}.
    """
    first = f"{name}_0"
    out = {
        f"init{name}": _INIT["init"].replace("32 * 40503", f"{seed} * 40503"), f"sums{name}": _INIT["sums"].replace("JOIN init i", f"JOIN init{name} i"),
        f"emi{first}": _INIT["emi"].replace("LEFT JOIN sums s", f"LEFT JOIN sums{name} s"),
        f"c{first}": f"SELECT {_listed(lambda i: f'1.0::DOUBLE / {STATES} AS s{i}')}, {', '.join(f'1.0::DOUBLE / {STATES} AS a{i}{j}' for i, j in _PAIR)}",
    }
    for r in range(rounds + 1):
        at, after = f"{name}_{r}", f"{name}_{r + 1}"
        wide = f"SELECT t.chrom AS chain, t.ridx AS ridx, {_listed(lambda i: f'coalesce(sum(CASE WHEN e.state = {i} THEN x END), 0) AS l{i}')} FROM tile t LEFT JOIN each{at} e ON e.ridx = t.ridx GROUP BY ALL"
        out |= _likelihood_ctes(at) | _forward_backward(wide, **_held_chain(at))
        if r == rounds:
            break
        moved = lambda i, j: f"f{i} * c.a{i}{j} * e{j} * b{j}"
        every = " + ".join(moved(i, j) for i, j in _PAIR)
        out |= {
            f"xi{at}": f"SELECT {', '.join(f'sum({moved(i, j)} / ({every})) + 1e-6::DOUBLE AS x{i}{j}' for i, j in _PAIR)} FROM fw{at} f JOIN obs{at} o ON o.chain = f.chain AND o.t = f.t + 1 JOIN bw{at} b ON b.chain = o.chain AND b.t = o.t CROSS JOIN c{at} c",
            f"one{at}": f"SELECT {_listed(lambda i: f'sum(p{i}) + 1e-6::DOUBLE AS y{i}')} FROM prob{at} WHERE t = 1",
            f"c{after}": f"SELECT {_listed(lambda i: f'y{i} / ({_listed(lambda k: f"y{k}", " + ")}) AS s{i}')}, {', '.join(f'x{i}{j} / ({_listed(lambda k: f"x{i}{k}", " + ")}) AS a{i}{j}' for i, j in _PAIR)} FROM xi{at} CROSS JOIN one{at}",
            f"emi{after}": "SELECT p.dataset AS dataset, p.barcode AS barcode, state, suffstat, prior FROM prior p JOIN ("
            + " UNION ALL ".join(f"SELECT dataset, barcode, CAST({i} AS INT) AS state, sum(cnt * p{i}) AS suffstat FROM data d JOIN prob{at} q ON q.ridx = d.ridx GROUP BY ALL" for i in _K)
            + ") x ON x.dataset = p.dataset AND x.barcode = p.barcode",
        }
    return out


_DATA = {k: (_LL[k] if k == "n" else _INIT[k]) for k in ("data", "cells", "prior", "n")}


def _after(query: str, rounds: int, **more: str) -> str:
    ctes = _DATA | _rounds(rounds) | more
    sql = _recursive(oracle(query, "tile", "counts", **ctes))
    for name in ctes:
        sql = sql.replace(f" {name} AS (", f" {name} AS MATERIALIZED (")
    return sql


def _fitted(x: Inputs, iterations: int = 3) -> em.Model:
    return em.fit(x.datasets, x.tile, STATES, iterations, chain_of=_by_chrom(x))


_CALLED_3 = _CALLED.replace("FROM prob", "FROM prob_3")


@query(_after(_SEGMENTED, 3, called=_CALLED_3))
def segmentation(spark, sf):
    x = Kept(spark, sf)
    found = segments.segments(x.tile, em.posterior(_fitted(x), x.datasets, x.tile, chain_of=_by_chrom(x)), x.datasets, STATES)
    return found.select("ridx", "chrom", "start", "stop", *(r4(f"Prob_state_{i}", f"Prob_state_{i}") for i in _K), r4("Prob_max", "Prob_max"), "state", "name", "readdepth_0", "readdepth_1")


@query(_after("SELECT concat('state_', state) AS name, count(*) AS n FROM called GROUP BY ALL", 3, called=_CALLED_3))
def state_frequency(spark, sf):
    return segments.state_frequency(segmentation(spark, sf))


@query(_after("SELECT o.ridx AS ridx, CAST(w.state AS INT) AS state FROM way_2 w JOIN obs_2 o ON o.chain = w.chain AND o.t = w.t", 2, **_viterbi(**_held_chain("_2"))))
def viterbi_path(spark, sf):
    x = Kept(spark, sf)
    return em.predict(_fitted(x, 2), x.datasets, x.tile, "viterbi", chain_of=_by_chrom(x))


@query(_after("SELECT round(sum(s), 3) AS score FROM fw_2 f JOIN last_2 l ON f.chain = l.chain AND f.t = l.t", 2))
def score(spark, sf):
    x = Kept(spark, sf)
    found = em.score(_fitted(x, 2), x.datasets, x.tile, chain_of=_by_chrom(x))
    return spark.createDataFrame([(round(found, 3),)], "score double")


@query(_after(
    f"SELECT ridx, state, round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS sd FROM ({_LONG.replace('FROM prob', 'FROM prob_each')}) GROUP BY ALL", 1,
    **_forward_backward(_BY_DATASET.replace("concat(d.dataset, ':', t.chrom)", "d.dataset").replace("LEFT JOIN each e", "LEFT JOIN each_1 e"), **(_held_chain("_1") | {"at": "_each"})),
))
def robust_posterior(spark, sf):
    x = Kept(spark, sf)
    return em.robust_posterior(_fitted(x, 1), x.datasets, x.tile).select("ridx", "state", r4("mean", "mean"), r4("sd", "sd"))


_SEEDS = (32, 33)


@query(_after(
    "SELECT seed, score, score = max(score) OVER () AS best FROM (" + " UNION ALL ".join(
        f"SELECT CAST({seed} AS INT) AS seed, round(sum(s), 3) AS score FROM fw_s{seed}_1 f JOIN last_s{seed}_1 l ON f.chain = l.chain AND f.t = l.t" for seed in _SEEDS) + ")",
    0, **{k: v for seed in _SEEDS for k, v in _rounds(1, seed, f"_s{seed}").items()},
))
def fit_multi_seed(spark, sf):
    x = Kept(spark, sf)
    best, scores = em.fit_seeds(x.datasets, x.tile, STATES, _SEEDS, 1, chain_of=_by_chrom(x))
    return spark.createDataFrame([(k, round(v, 3), k == best.seed) for k, v in scores.items()], "seed int, score double, best boolean")


# ---------------------------------------------------------------- segments

_SEGP = f"""SELECT *, concat('state_', CAST(state AS VARCHAR)) AS name, 0.6::DOUBLE + 0.4::DOUBLE / (1 + readdepth) AS Prob_max,
    {', '.join(f'CASE WHEN state = {i} THEN 0.6::DOUBLE + 0.4::DOUBLE / (1 + readdepth) ELSE 0.2::DOUBLE - 0.2::DOUBLE / (1 + readdepth) END AS Prob_state_{i}' for i in range(STATES))} FROM seg"""
_ISL = "ridx - row_number() OVER (PARTITION BY chrom, state ORDER BY ridx)"


@query(oracle(f"SELECT chrom, state, min(start) AS start, max(stop) AS stop, count(*) AS n_bins, CAST(sum(readdepth) AS BIGINT) AS readdepth FROM (SELECT *, {_ISL} AS k FROM seg) GROUP BY chrom, state, k", "seg"))
def state_islands(spark, sf):
    return segments.merged_islands(Inputs(spark, sf).seg)


@query(oracle(
    "SELECT chrom, start, stop, state, readdepth FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY readdepth DESC, chrom, start) AS r FROM isl) WHERE r <= 50",
    "seg", segp=_SEGP, kept="SELECT * FROM segp WHERE state IN (0, 1) AND Prob_max >= 0.65::DOUBLE",
    isl=f"SELECT chrom, state, min(start) AS start, max(stop) AS stop, CAST(sum(readdepth) AS BIGINT) AS readdepth FROM (SELECT *, {_ISL} AS k FROM kept) GROUP BY chrom, state, k HAVING sum(readdepth) >= 1",
))
def top_regions(spark, sf):
    return segments.top_regions(Inputs(spark, sf).seg, [0, 1], 50, 0.65, min_reads=1)


_MEMBERS = f"SELECT ridx, min(ridx) OVER (PARTITION BY chrom, state, k) AS region FROM (SELECT *, {_ISL} AS k FROM seg)"


@query(oracle("SELECT region, barcode, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts c JOIN mem m ON c.ridx = m.ridx GROUP BY ALL", "seg", "counts", mem=_MEMBERS))
def island_counts(spark, sf):
    x = Inputs(spark, sf)
    return segments.regrouped_counts(x.counts, segments.island_members(x.seg))


@query(oracle("SELECT region, CAST(sum(cnt) AS BIGINT) AS cnt, count(DISTINCT barcode) AS n_cells FROM counts c JOIN mem m ON c.ridx = m.ridx GROUP BY ALL", "seg", "counts", mem=_MEMBERS))
def island_counts_legacy(spark, sf):
    return island_counts(spark, sf).groupBy("region").agg(F.sum("cnt").alias("cnt"), F.count_distinct("barcode").alias("n_cells"))


@query(oracle(f"SELECT chrom, state, min(start) AS start, max(stop) AS stop, count(*) AS n_bins, round(avg(readdepth), 4) AS readdepth FROM (SELECT *, {_ISL} AS k FROM segp WHERE state IN (1, 2) AND Prob_max >= 0.7::DOUBLE) GROUP BY chrom, state, k", "seg", segp=_SEGP))
def posterior_islands(spark, sf):
    return segments.posterior_islands(Inputs(spark, sf).seg, [1, 2], 0.7).withColumn("readdepth", F.round("readdepth", 4))


@query(oracle("SELECT state, round(p, 4) AS p FROM (SELECT state, count(*) / (SELECT count(*) FROM seg) AS p FROM seg GROUP BY state) ORDER BY p, state LIMIT 2", "seg"))
def rare_states(spark, sf):
    seg = Inputs(spark, sf).seg
    share = seg.groupBy("state").agg(F.count("*").alias("n")).join(seg.agg(F.count("*").alias("all")), how="cross")
    return segments.chosen_states(share.select("state", (F.col("n") / F.col("all")).alias("p")), "rarest", n=2).select("state", r4("p", "p"))


@query(oracle("SELECT barcode, state, count(*)::DOUBLE AS n FROM counts c JOIN segp s ON c.ridx = s.ridx WHERE Prob_max >= 0.7::DOUBLE GROUP BY ALL", "seg", "counts", segp=_SEGP))
def cell_state_counts(spark, sf):
    x = Inputs(spark, sf)
    return segments.cell_state_counts(x.counts, x.seg, 0.7)


@query(oracle("SELECT c.barcode AS barcode, p.state AS state, round(sum(p.p), 4) AS n FROM counts c JOIN post p ON c.ridx = p.ridx GROUP BY ALL", "tile", "counts", **_POST))
def cell_state_soft(spark, sf):
    x = Inputs(spark, sf)
    return segments.cell_state_counts(x.counts, posterior=em.posterior(_initial(x), x.datasets, x.tile, _OPTIONS)).select("barcode", "state", r4("n", "n"))


@query(oracle("SELECT state, count(*) AS n, round(quantile_cont(log10(readdepth + 1), 0.25), 4) AS q25, round(quantile_cont(log10(readdepth + 1), 0.5), 4) AS q50, round(quantile_cont(log10(readdepth + 1), 0.75), 4) AS q75 FROM seg GROUP BY state", "seg"))
def depth_by_state(spark, sf):
    return segments.depth_by_state(Inputs(spark, sf).seg).select("state", "n", *(r4(f"q{i}", f"q{i}") for i in (25, 50, 75)))


@query(oracle("SELECT ridx, chrom, start, stop, name, '.' AS strand, start AS \"thickStart\", stop AS \"thickEnd\", CASE state WHEN 0 THEN '255,0,0' WHEN 1 THEN '0,255,0' ELSE '0,0,255' END AS \"itemRgb\", CAST(floor(Prob_max * 1000) AS BIGINT) AS score FROM segp", "seg", segp=_SEGP))
def bed9_segments(spark, sf):
    return C.bed9(Inputs(spark, sf).seg, STATES).select("ridx", "chrom", "start", "stop", "name", "strand", "thickStart", "thickEnd", "itemRgb", "score")


_BINS = "SELECT ridx, len(list_filter((SELECT list_transform(quantile_cont(readdepth, [0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]), lambda x: round(x, 6)) FROM depth), lambda q: q < readdepth)) AS cntbin FROM depth"


@query(oracle(
    "SELECT CAST(cntbin AS INT) AS cntbin, state, round(n, 4) AS n, round(n / sum(n) OVER (PARTITION BY state), 4) AS p FROM (SELECT cntbin, l.state AS state, sum(l.p) AS n FROM bins b JOIN long l ON b.ridx = l.ridx GROUP BY ALL)",
    "seg", "depth", segp=_SEGP, bins=_BINS, long=" UNION ALL ".join(f"SELECT ridx, {i} AS state, Prob_state_{i} AS p FROM segp" for i in range(STATES)),
))
def depth_bin_emission(spark, sf):
    return emission.depth_bin_emission(depth_bins(spark, sf), Inputs(spark, sf).posterior).select("cntbin", "state", r4("n", "n"), r4("p", "p"))


@query(oracle(
    "SELECT b.ridx AS ridx, e.state AS state, round(ln(e.n / e.whole), 4) AS ll FROM bins b JOIN (SELECT *, sum(n) OVER (PARTITION BY state) AS whole FROM emi) e ON b.cntbin = e.cntbin",
    "seg", "depth", segp=_SEGP, bins=_BINS, long=" UNION ALL ".join(f"SELECT ridx, {i} AS state, Prob_state_{i} AS p FROM segp" for i in range(STATES)),
    emi="SELECT cntbin, l.state AS state, sum(l.p) AS n FROM bins b JOIN long l ON b.ridx = l.ridx GROUP BY ALL",
))
def depth_bin_loglik(spark, sf):
    bins = depth_bins(spark, sf)
    found = emission.depth_bin_loglik(bins, emission.depth_bin_emission(bins, Inputs(spark, sf).posterior))
    return found.select("ridx", "state", r4("ll", "ll"))


# ---------------------------------------------------------------- enrichment

_WINDOWS = """SELECT *, greatest((CASE WHEN strand = '-' THEN stop ELSE start END) - {f}, 0) AS a, (CASE WHEN strand = '-' THEN stop ELSE start END) + 1 + {f} AS b FROM genes"""


@query(oracle("SELECT name, chrom, a AS start, b AS stop FROM win", "genes", win=_WINDOWS.format(f=2000)))
def tss_windows(spark, sf):
    return enrich.windows(Inputs(spark, sf).genes, 2000).select("name", "chrom", "start", "stop")


_FEATURE = "SELECT w.name AS name, s.state AS state, count(*) AS n FROM win w JOIN seg s ON w.chrom = s.chrom AND w.a < s.stop AND s.start < w.b GROUP BY ALL"
_GENESET = "SELECT geneset, state, count(*) AS n FROM (SELECT DISTINCT w.geneset AS geneset, s.ridx AS ridx, s.state AS state FROM win w JOIN seg s ON w.chrom = s.chrom AND w.a < s.stop AND s.start < w.b) GROUP BY ALL"


@query(oracle("SELECT * FROM feat", "genes", "seg", win=_WINDOWS.format(f=2000), feat=_FEATURE))
def feature_state_counts(spark, sf):
    x = Inputs(spark, sf)
    return enrich.feature_state_counts(x.genes, x.seg, 2000).drop("feature")


@query(oracle("SELECT * FROM sets", "genes", "seg", win=_WINDOWS.format(f=200), sets=_GENESET))
def geneset_state_counts(spark, sf):
    x = Inputs(spark, sf)
    return enrich.geneset_state_counts(x.genes, x.seg, 200)


def _enriched(key: str, counts: str, value: str) -> dict[str, str]:
    full = f"SELECT t.{key} AS {key}, pi.state AS state, coalesce(c.n, 0) AS n, t.total * pi.p AS e FROM (SELECT {key}, sum(n) AS total FROM {counts} GROUP BY {key}) t CROSS JOIN pi LEFT JOIN {counts} c ON c.{key} = t.{key} AND c.state = pi.state"
    return {"full_counts": full, "enr": f"SELECT {key}, state, {value} AS value FROM full_counts"}


_VALUES = {"logfold": "CASE WHEN n = 0 THEN 0 ELSE log10(n) - log10(e) END", "fold": "CASE WHEN n = 0 THEN 1 ELSE n / e END", "chisqstat": "pow(greatest(n - e, 0), 2) / pow(e, 2)"}


def _geneset_enrichment(mode: str) -> str:
    return oracle("SELECT geneset, state, round(value, 4) AS value FROM enr", "genes", "seg", "pi", win=_WINDOWS.format(f=200), sets=_GENESET, **_enriched("geneset", "sets", _VALUES[mode]))


def _enrich(spark, sf, mode: str) -> DataFrame:
    return enrich.enrichment(geneset_state_counts(spark, sf), ["geneset"], stationary(spark), mode).select("geneset", "state", r4("value", "value"))


@query(_geneset_enrichment("logfold"))
def enrich_logfold(spark, sf):
    return _enrich(spark, sf, "logfold")


@query(_geneset_enrichment("fold"))
def enrich_fold(spark, sf):
    return _enrich(spark, sf, "fold")


@query(_geneset_enrichment("chisqstat"))
def enrich_chisq(spark, sf):
    return _enrich(spark, sf, "chisqstat")


@query(oracle("SELECT DISTINCT name FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY round(value, 6) DESC, name) AS r FROM enr) WHERE r <= 5", "genes", "seg", "pi", win=_WINDOWS.format(f=2000), feat=_FEATURE, **_enriched("name", "feat", _VALUES["logfold"])))
def top_features(spark, sf):
    found = enrich.enrichment(feature_state_counts(spark, sf), ["name"], stationary(spark)).withColumn("value", F.round("value", 6))
    return enrich.top_features(found, "name", 5)


@query(oracle("SELECT barcode, state, round(value, 4) AS value FROM enr", "seg", "counts", "pi", segp=_SEGP, cs="SELECT barcode, state, count(*) AS n FROM counts c JOIN segp s ON c.ridx = s.ridx WHERE Prob_max >= 0.7::DOUBLE GROUP BY ALL", **_enriched("barcode", "cs", _VALUES["logfold"])))
def cell_state_logfold(spark, sf):
    return enrich.enrichment(cell_state_counts(spark, sf), ["barcode"], stationary(spark)).select("barcode", "state", r4("value", "value"))


#: A fixed chain of two states, small enough for a recursive query to enumerate its paths.
_TWO = Chain(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]))
_PATHS = {
    "two": "SELECT name, state % 2 AS state, CAST(sum(n) AS BIGINT) AS n FROM feat GROUP BY ALL",
    "lens": "SELECT name, CAST(sum(n) AS BIGINT) AS length FROM feat GROUP BY name",
    "st": "SELECT * FROM (VALUES (0, 2.0::DOUBLE / 3), (1, 1.0::DOUBLE / 3)) v(s, p)",
    "tr": "SELECT * FROM (VALUES (0, 0, 0.9::DOUBLE), (0, 1, 0.1::DOUBLE), (1, 0, 0.2::DOUBLE), (1, 1, 0.8::DOUBLE)) v(i, j, p)",
    "dp": """SELECT 1 AS length, t.s AS target, c.s AS cur, CASE WHEN c.s = t.s THEN 1 ELSE 0 END AS visits, c.p AS p FROM st t, st c
    UNION ALL SELECT dp.length + 1, target, tr.j, visits + CASE WHEN tr.j = target THEN 1 ELSE 0 END, dp.p * tr.p FROM dp JOIN tr ON tr.i = dp.cur WHERE dp.length < (SELECT max(length) FROM lens)""",
    "nul": "SELECT length, target AS state, visits, sum(p) AS p FROM dp WHERE length IN (SELECT length FROM lens) GROUP BY ALL",
}


def _two_state_counts(spark, sf) -> DataFrame:
    x = Inputs(spark, sf)
    return enrich.feature_state_counts(x.genes, x.seg.withColumn("state", F.col("state") % 2), 9000).drop("feature")


@query(_recursive(oracle("SELECT CAST(length AS BIGINT) AS length, state, CAST(visits AS BIGINT) AS visits, round(p, 4) AS p FROM nul", "genes", "seg", win=_WINDOWS.format(f=9000), feat=_FEATURE, **_PATHS)))
def null_distribution(spark, sf):
    lengths = _two_state_counts(spark, sf).groupBy("name").agg(F.sum("n").alias("length"))
    return enrich.null_distribution(lengths, _TWO).select("length", "state", "visits", r4("p", "p"))


@query(_recursive(oracle(
    """SELECT l.name AS name, k.s AS state, round(least(-log10(greatest(least((SELECT sum(p) FROM nul WHERE nul.length = l.length AND nul.state = k.s AND nul.visits >= coalesce(t.n, 0)), 1), 1e-15::DOUBLE)), 15), 4) AS value
    FROM lens l CROSS JOIN (SELECT s FROM st) k LEFT JOIN two t ON t.name = l.name AND t.state = k.s""",
    "genes", "seg", win=_WINDOWS.format(f=9000), feat=_FEATURE, **_PATHS,
)))
def enrich_pvalue(spark, sf):
    pi = spark.createDataFrame([(i, float(p)) for i, p in enumerate(_TWO.stationary())], "state int, p double")
    return enrich.pvalues(_two_state_counts(spark, sf), ["name"], _TWO, pi).select("name", "state", F.round(F.col("value") + 0.0, 4).alias("value"))


# ---------------------------------------------------------------- annotation, contrast

_LABELS = "SELECT chrom, start, stop, CASE strand WHEN '-' THEN 'minus' ELSE 'plus' END AS label, CAST(stop - start AS DOUBLE) AS score FROM genes"
_ANNOTATED = """SELECT s.ridx AS ridx, s.state AS state, s.start AS start, s.readdepth AS readdepth, coalesce(max(CASE WHEN label = 'plus' THEN score END), 0) AS plus, coalesce(max(CASE WHEN label = 'minus' THEN score END), 0) AS minus
    FROM seg s LEFT JOIN lab l ON s.chrom = l.chrom AND s.start < l.stop AND l.start < s.stop GROUP BY ALL"""


def _annotated(x: Inputs) -> DataFrame:
    labels = x.genes.select("chrom", "start", "stop", F.when(F.col("strand") == "-", "minus").otherwise("plus").alias("label"), (F.col("stop") - F.col("start")).cast("double").alias("score"))
    return annotate.annotated(x.seg, labels, ["plus", "minus"])


@query(oracle("SELECT ridx, plus, minus FROM ann", "genes", "seg", lab=_LABELS, ann=_ANNOTATED))
def annotate_bins(spark, sf):
    return _annotated(Inputs(spark, sf)).select("ridx", "plus", "minus")


@query(oracle("SELECT t.ridx AS ridx, round(ln(1 + d.readdepth), 4) AS cover FROM tile t JOIN depth d ON t.ridx = d.ridx", "tile", "depth"))
def annotate_coverage(spark, sf):
    x = Inputs(spark, sf)
    return annotate.coverage(x.tile, x.counts, "cover").select("ridx", r4("cover", "cover"))


@query(oracle("""SELECT state, label, round(avg(z), 4) AS z FROM (SELECT state, 'plus' AS label, (plus - avg(plus) OVER ()) / stddev_pop(plus) OVER () AS z FROM ann
    UNION ALL SELECT state, 'minus', (minus - avg(minus) OVER ()) / stddev_pop(minus) OVER () FROM ann) GROUP BY ALL""", "genes", "seg", lab=_LABELS, ann=_ANNOTATED))
def state_annotation_z(spark, sf):
    return annotate.state_means(_annotated(Inputs(spark, sf)), ["plus", "minus"]).select("state", "label", F.round(F.col("z") + 0.0, 4).alias("z"))


@query(oracle("SELECT state, round(quantile_cont(plus, 0.25), 4) AS q25, round(quantile_cont(plus, 0.5), 4) AS q50, round(quantile_cont(plus, 0.75), 4) AS q75 FROM ann GROUP BY state", "genes", "seg", lab=_LABELS, ann=_ANNOTATED))
def state_annotation_boxes(spark, sf):
    return annotate.state_boxes(_annotated(Inputs(spark, sf)), "plus").select("state", *(r4(f"q{i}", f"q{i}") for i in (25, 50, 75)))


@query(oracle("SELECT state, chrom AS label, count(*) AS n FROM seg GROUP BY ALL", "seg"))
def state_label_counts(spark, sf):
    return annotate.state_label_counts(Inputs(spark, sf).seg, "chrom")


@query(oracle("SELECT chrom, start, stop, round(pscore, 4) AS pscore FROM (SELECT *, row_number() OVER (ORDER BY pscore DESC, ridx) AS r FROM (SELECT *, Prob_state_0 * readdepth AS pscore FROM segp)) WHERE r <= 50 OR r BETWEEN 151 AND 200", "seg", segp=_SEGP))
def contrast_sets(spark, sf):
    return contrast.contrast_set(Inputs(spark, sf).seg, 0, 50, 100, 50).select("chrom", "start", "stop", r4("pscore", "pscore"))


def _smoothed(i: int) -> str:
    return f"""SELECT *, coalesce(0.5::DOUBLE * lag(x) OVER w + x + 0.5::DOUBLE * lead(x) OVER w, 0) AS pscore FROM (SELECT *, Prob_state_{i} * readdepth AS x FROM segp) WINDOW w AS (PARTITION BY chrom ORDER BY ridx)"""


def _ranked(i: int, n: int, value: str) -> str:
    return f"SELECT chrom, start, stop, round({value}, 4) AS pscore FROM (SELECT *, row_number() OVER (ORDER BY pscore DESC, ridx) AS r FROM ({_smoothed(i)})) WHERE r <= {n}"


@query(oracle(" UNION ALL ".join([_ranked(0, 60, "pscore"), *(_ranked(i, 40, "pscore * Prob_state_0") for i in (1, 2))]), "seg", segp=_SEGP))
def between_states(spark, sf):
    return contrast.between_states(Inputs(spark, sf).seg, 0, STATES, 60).select("chrom", "start", "stop", r4("pscore", "pscore"))


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(oracle(
    'SELECT * FROM (SELECT \'plus\' AS "column", round(corr(a, s), 4) AS rho FROM rk UNION ALL SELECT \'minus\', round(corr(b, s), 4) FROM rk UNION ALL SELECT \'start\', round(corr(c, s), 4) FROM rk) ORDER BY rho DESC, 1 LIMIT 2',
    "genes", "seg", lab=_LABELS, ann=_ANNOTATED, rk=f"SELECT {_RANK.format(c='plus')} AS a, {_RANK.format(c='minus')} AS b, {_RANK.format(c='start')} AS c, {_RANK.format(c='readdepth')} AS s FROM ann",
))
def spearman_rank(spark, sf):
    rows = _annotated(Inputs(spark, sf)).withColumnRenamed("ridx", "row")
    return contrast.spearman(rows, "readdepth", ["plus", "minus", "start"], 2).select("column", r4("rho", "rho"))


# ---------------------------------------------------------------- sources and sinks: write, read back


@query(oracle("SELECT row_number() OVER (ORDER BY chrom, start, stop) - 1 AS ridx, chrom, start, stop FROM genes", "genes"))
def bed(spark, sf):
    path = fresh_path(spark, "bed")
    files.write_bed(Inputs(spark, sf).genes, path)
    return files.read_bed(spark, path).drop("name")


@query(oracle("SELECT chrom, start, stop, barcode, dup FROM frag", "frag"))
def fragments(spark, sf):
    path = fresh_path(spark, "fragments")
    files.write_fragments(Inputs(spark, sf).frag, path)
    return files.read_fragments(spark, path)


@query(oracle("SELECT chrom, start, stop, barcode, dup FROM frag", "frag"))
def fragments_block_gzip(spark, sf):
    """Written in compressed blocks and read by ranges of 64 KB."""
    path = fresh_path(spark, "fragments") + ".tsv.bgz"
    files.write_fragments(Inputs(spark, sf).frag, path, compressed=True)
    return files.read_fragments(spark, path, 1 << 16)


@query(oracle("SELECT qname, rname, pos, flag FROM aln", "aln"))
def alignments(spark, sf):
    path = fresh_path(spark, "alignments")
    files.write_alignments(Inputs(spark, sf).aln, path)
    return files.read_alignments(spark, path).select("qname", "rname", "pos", "flag")


@query(oracle("SELECT ridx AS \"row\", CAST(substr(barcode, 2) AS BIGINT) AS col, cnt AS val FROM counts", "counts"))
def coo_text(spark, sf):
    x, path = Inputs(spark, sf), fresh_path(spark, "coordinates")
    triplets = x.counts.select(F.col("ridx").alias("row"), F.substring("barcode", 2, 20).cast("long").alias("col"), F.col("cnt").alias("val"))
    files.write_coordinates(triplets, path, x.tile.count(), 1 << 20)
    return files.read_coordinates(spark, path)


@query(oracle("SELECT barcode, grp FROM cellgroup", "cellgroup"))
def cell_table(spark, sf):
    path = fresh_path(spark, "cells")
    files.write_cells(Inputs(spark, sf).groups.select(F.col("barcode").alias("cell"), "grp"), path)
    return files.read_cells(spark, path)


@query(oracle("SELECT barcode, grp FROM cellgroup", "cellgroup"))
def group_table(spark, sf):
    path = fresh_path(spark, "groups") + ".tsv"
    files.write_cells(Inputs(spark, sf).groups, path)
    return files.read_groups(spark, path)


@query(oracle("SELECT c.ridx AS ridx, barcode, cnt, chrom FROM counts c JOIN tile t ON c.ridx = t.ridx", "counts", "tile"))
def matrix_store(spark, sf):
    x, path = Inputs(spark, sf), fresh_path(spark, "matrix")
    files.write_matrix(x.counts, x.tile, counting.cells(x.frag), path)
    return files.read_matrix(spark, path)[0].select("ridx", "barcode", "cnt", "chrom")


def _sliced(x: Inputs) -> DataFrame:
    path = fresh_path(x.spark, "sliced")
    files.write_sliced(x.datasets, path)
    return files.read_sliced(x.spark, path)


@query(oracle("SELECT dataset, ridx, barcode, cnt FROM data", "counts", data=_INIT["data"]))
def sliced_store(spark, sf):
    return _sliced(Inputs(spark, sf)).select("dataset", "ridx", "barcode", "cnt")


@query(ORACLE_SQL["emission_loglik"])
def sliced_loglik(spark, sf):
    x = Inputs(spark, sf)
    return emission.log_likelihood(_sliced(x), x.tile, _initial(x).emission, STATES).select("ridx", "state", r4("ll", "ll"))


@query(ORACLE_SQL["score"])
def sliced_score(spark, sf):
    x = Inputs(spark, sf)
    counts = _sliced(x)
    found = em.score(em.fit(counts, x.tile, STATES, 2, chain_of=_by_chrom(x)), counts, x.tile, chain_of=_by_chrom(x))
    return spark.createDataFrame([(round(found, 3),)], "score double")


@query(oracle("SELECT dataset, barcode, state, round(suffstat, 4) AS suffstat, round(prior, 4) AS prior FROM emi", "tile", "counts", **_INIT))
def model_store(spark, sf):
    path = fresh_path(spark, "model")
    files.write_model(_initial(Inputs(spark, sf)), path)
    return files.read_model(spark, path).emission.select("dataset", "barcode", "state", r4("suffstat", "suffstat"), r4("prior", "prior"))


@query(oracle("SELECT ridx, chrom, start, stop FROM tile", "tile"))
def region_bed(spark, sf):
    path = fresh_path(spark, "regions")
    files.write_bed(Inputs(spark, sf).tile, path)
    return files.read_bed(spark, path).drop("name")


@query(oracle("SELECT ridx, name, round(Prob_max, 4) AS prob FROM segp WHERE Prob_max >= 0.65::DOUBLE", "seg", segp=_SEGP))
def segment_tsv(spark, sf):
    path = fresh_path(spark, "segments")
    files.write_segments(Inputs(spark, sf).seg.select("ridx", "name", "Prob_max"), path, 0.65)
    return spark.read.csv(path, sep="\t", header=True, schema="ridx long, name string, Prob_max double").select("ridx", "name", r4("Prob_max", "prob"))


@query(oracle("SELECT name, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases FROM segp GROUP BY name", "seg", segp=_SEGP))
def state_bed(spark, sf):
    path = fresh_path(spark, "bed9")
    files.write_bed9(C.bed9(Inputs(spark, sf).seg, STATES), path, by_state=True)
    rows = spark.read.csv(path, sep="\t", schema="chrom string, start long, stop long, name string, score long, strand string, thickStart long, thickEnd long, itemRgb string, state_name string")
    return rows.groupBy(F.col("state_name").alias("name")).agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


@query(oracle("SELECT concat('state_', CAST(state AS VARCHAR)) AS name, count(*) AS n FROM seg GROUP BY ALL", "seg"))
def small_results(spark, sf):
    path = fresh_path(spark, "small")
    files.write_small(segments.state_frequency(Inputs(spark, sf).seg), path)
    return spark.read.csv(path, header=True, schema="name string, n long")


@query(oracle("SELECT DISTINCT s.ridx AS ridx, w.geneset AS geneset FROM genes w JOIN seg s ON w.chrom = s.chrom AND w.start < s.stop AND s.start < w.stop", "genes", "seg"))
def overlapping_sets(spark, sf):
    x = Inputs(spark, sf)
    return intervals.overlapping(x.seg.select("ridx", "chrom", "start", "stop"), x.genes.select("chrom", "start", "stop", "geneset"), ["ridx", "geneset"]).select("ridx", "geneset")


@query(oracle("SELECT ridx, CAST(arg_max(state, (ll, -state)) AS INT) AS state FROM ll GROUP BY ridx", "tile", "counts", **_LL))
def decoded_restart(spark, sf):
    """Independent blocks, decoded by posterior: the form in which each block begins with the start vector."""
    x = Inputs(spark, sf)
    likelihood = emission.log_likelihood(x.datasets, x.tile, _initial(x).emission, STATES)
    return decode(blocked(likelihood, STATES, 500), Chain.uniform(STATES), "map", "restart")


