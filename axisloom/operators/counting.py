"""From fragments and reads to sparse counts (ridx, barcode, cnt); zeros are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.functions.columns import NO_BARCODE, UNMAPPED, flag, positions, usable_read
from axisloom.operators.intervals import overlap_counts
from axisloom.operators.tiling import bin_offsets


def binned(fragments: DataFrame, width: int) -> DataFrame:
    """(chrom, barcode, further columns, bin): a row for every bin that a fragment overlaps, by arithmetic."""
    keep = [c for c in fragments.columns if c not in ("start", "stop", "bin")]
    return fragments.where("stop > start").select(*keep, F.explode(F.expr(f"sequence(start div {width}, (stop - 1) div {width})")).alias("bin"))


def fragments_in_tile(fragments: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """A fragment counts once in every bin that it overlaps: arithmetic instead of a join. sizes: (chrom, size)."""
    counts = binned(fragments.select("chrom", "start", "stop", "barcode"), width).groupBy("chrom", "bin", "barcode").agg(F.count("*").alias("cnt"))
    return counts.join(F.broadcast(bin_offsets(sizes, width)), "chrom").where(F.col("bin") < F.ceil(F.col("size") / width)).select((F.col("offset") + F.col("bin")).alias("ridx"), "barcode", "cnt")


def fragments_in_regions(fragments: DataFrame, regions: DataFrame, width: int = 10_000) -> DataFrame:
    """The same for regions of any shape."""
    return overlap_counts(regions.select("ridx", "chrom", "start", "stop"), fragments.select("chrom", "start", "stop", "barcode"), "barcode", width=width)


def cells(records: DataFrame) -> DataFrame:
    """Every barcode that occurs, counted or not."""
    return records.select("barcode").distinct()


def reads_in_tile(reads: DataFrame, sizes: DataFrame, width: int, mode: str = "midpoint", min_mapq: int = 30, max_length: int = 2000, only_with_barcode: bool = False) -> DataFrame:
    """Reads (with a barcode column) counted at the bins of their positions; once in a bin with eitherend."""
    fine = reads.where(usable_read(min_mapq, max_length, only_with_barcode))
    points = F.transform(positions(mode), lambda p: F.floor(p / width))
    points = F.array_distinct(points) if mode == "eitherend" else points
    found = fine.select(F.col("rname").alias("chrom"), "barcode", F.explode(points).alias("bin")).groupBy("chrom", "bin", "barcode").agg(F.count("*").alias("cnt"))
    inside = (F.col("bin") >= 0) & (F.col("bin") < F.ceil(F.col("size") / width))
    return found.join(F.broadcast(bin_offsets(sizes, width)), "chrom").where(inside).select((F.col("offset") + F.col("bin")).alias("ridx"), "barcode", "cnt")


def reads_in_regions(reads: DataFrame, regions: DataFrame, mode: str = "midpoint", min_mapq: int = 30, max_length: int = 2000, only_with_barcode: bool = False, flank: int = 0, width: int = 10_000) -> DataFrame:
    """The same for regions of any shape, widened by flank; a read counts once in a region with eitherend."""
    fine = reads.where(usable_read(min_mapq, max_length, only_with_barcode)).withColumn("read", F.monotonically_increasing_id())
    points = fine.select(F.col("rname").alias("chrom"), "barcode", "read", F.explode(positions(mode)).alias("start")).withColumn("stop", F.col("start") + 1)
    wide = regions.select("ridx", "chrom", F.greatest(F.col("start") - flank, F.lit(0)).alias("start"), (F.col("stop") + flank).alias("stop"))
    return overlap_counts(wide, points, "barcode", "read" if mode == "eitherend" else None, width)


def region_lengths(fragments: DataFrame, regions: DataFrame, longest: int = 1000, width: int = 10_000) -> DataFrame:
    """(ridx, len, cnt): how many fragments of each length, cut at longest, overlap a region."""
    lengths = fragments.select("chrom", "start", "stop", F.least(F.col("stop") - F.col("start"), F.lit(longest)).alias("len"))
    return overlap_counts(regions.select("ridx", "chrom", "start", "stop"), lengths, "len", width=width)


def read_fragments(reads: DataFrame, min_mapq: int = 30) -> DataFrame:
    """The templates of proper pairs as fragments, one for each read 1: from the lower end, |tlen| long."""
    fine = reads.where(flag(2) & flag(64) & (F.col("mapq") >= min_mapq) & (F.col("tlen") != 0))
    return fine.select(F.col("rname").alias("chrom"), F.least("pos", "mpos").alias("start"), (F.least("pos", "mpos") + F.abs("tlen")).alias("stop"), "barcode")


def coarse_lengths(reads: DataFrame, width: int, longest: int, resolution: int, min_mapq: int = 30) -> DataFrame:
    """(chrom, bin, len, cnt) by the bin of the template's start; lengths in steps of resolution, longest and above dropped."""
    f = read_fragments(reads, min_mapq).where(F.col("stop") - F.col("start") < longest)
    return f.groupBy("chrom", F.expr(f"start div {width}").alias("bin"), F.expr(f"(stop - start) div {resolution}").alias("len")).agg(F.count("*").alias("cnt"))


def without_chroms(reads: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Mapped reads of which neither the chromosome nor the mate's holds one of the substrings."""
    kept = reads.where(~flag(UNMAPPED))
    for p in patterns:
        for c in ("rname", "mname"):
            kept = kept.where(~F.coalesce(F.contains(F.col(c), F.lit(p)), F.lit(False)))
    return kept


def deduplicated(reads: DataFrame, order: Sequence[str] = ("rname", "pos", "qname")) -> DataFrame:
    """Reads that differ in chromosome, position, strand or template length from the last one of their barcode.

    In an order that begins with chromosome and position, the last read at another place always differs, so places are
    told apart first and a barcode with very many reads is no single task.
    """
    place = 2 if tuple(order[:2]) == ("rname", "pos") else 0
    w = Window.partitionBy("barcode", *order[:place]).orderBy(*order[place:])
    last = F.lag(F.struct("rname", "pos", flag(16).alias("reverse"), "tlen")).over(w)
    now = F.struct("rname", "pos", flag(16).alias("reverse"), "tlen")
    return reads.withColumn("last", last).where(~now.eqNullSafe(F.col("last"))).drop("last")


def fragment_profile(fragments: DataFrame, chrom: str, start: int, stop: int, width: int = 50) -> DataFrame:
    """(barcode, bin, cnt): cut sites of fragments over a locus, in bins from its start. ValueError if none overlaps."""
    over = fragments.where((F.col("chrom") == chrom) & (F.col("start") < stop) & (F.col("stop") > start))
    if not over.take(1):
        raise ValueError(f"no fragment overlaps {chrom}:{start}-{stop}")
    sites = F.array(F.when(F.col("start") >= start, F.col("start")), F.when(F.col("stop") < stop, F.col("stop")))
    at = over.select("barcode", F.explode(sites).alias("at")).where("at IS NOT NULL")
    return at.groupBy("barcode", F.floor((F.col("at") - start) / width).alias("bin")).agg(F.count("*").alias("cnt"))


def read_profile(reads: DataFrame, chrom: str, start: int, stop: int, width: int = 50, min_mapq: int = 10) -> DataFrame:
    """(barcode, bin, cnt): 5' ends (one past the last base on the reverse strand) from start to stop, both included."""
    end = F.when(flag(16), F.col("pos") + F.col("rlen")).otherwise(F.col("pos"))
    at = reads.where((F.col("rname") == chrom) & (F.col("mapq") >= min_mapq) & ~flag(UNMAPPED)).withColumn("at", end).where(F.col("at").between(start, stop))
    return at.groupBy("barcode", F.floor((F.col("at") - start) / width).alias("bin")).agg(F.count("*").alias("cnt"))


def profile_bins(start: int, stop: int, width: int, spark) -> DataFrame:
    """(bin, start, stop) of a locus, for the outer join that brings the zeros."""
    return spark.range(0, -(-(stop - start) // width)).select(F.col("id").alias("bin"), (F.col("id") * width + start).alias("start"), ((F.col("id") + 1) * width + start).alias("stop"))


def size_factors(records: DataFrame, min_mapq: int | None = 10, selected: DataFrame | None = None) -> DataFrame:
    """(barcode, n): records of each barcode, with mapping quality min_mapq or more where they have one."""
    if min_mapq is not None and "mapq" in records.columns:
        records = records.where(F.col("mapq") >= min_mapq)
    if selected is not None:
        records = records.join(selected.select("barcode").distinct(), "barcode", "left_semi")
    return records.where(F.col("barcode") != NO_BARCODE).groupBy("barcode").agg(F.count("*").alias("n"))


