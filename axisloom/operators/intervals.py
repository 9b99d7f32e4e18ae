"""Interval joins on buckets of the intervals' own scale: equi-joins that Spark can shuffle, with the overlap as a condition.

An interval's level is the least one whose buckets, `width` * 2^level wide, are no shorter than it is. A pair meets at the
level of its longer interval: that one waits in the bucket in which it begins, the other one asks in each bucket in which
an interval that overlaps it may begin, three at most. So an interval of any length makes one row, and three more for each
coarser level that the other side has; no pair meets twice. Buckets that very many intervals share are left to AQE's skew
handling, as both joins are sort-merge joins whose sides it can split.

Counts of overlaps shuffle no pairs, as these may grow with the product of both sides: every record goes where the regions
that it may overlap are at home, and a region's counts are whole when they leave that task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from axisloom.plans.ship import shipped


def level(start: str, stop: str, width: int) -> Column:
    """The least level whose buckets are no shorter than the interval."""
    length = F.col(stop) - F.col(start)
    guess = F.ceil(F.log2(F.greatest(length / width, F.lit(1.0)))).cast("int")
    # A power of two may come out of the logarithm a little too small.
    return F.when(F.pow(F.lit(2.0), guess) * width < length, guess + 1).otherwise(guess)


def waiting(df: DataFrame, start: str, width: int) -> DataFrame:
    """Each interval in the bucket of its own level in which it begins."""
    return df.withColumn("bucket", F.floor(F.col(start) / (width * F.pow(F.lit(2.0), "level"))))


def asking(df: DataFrame, levels: list[int], start: str, stop: str, width: int, strictly: bool) -> DataFrame:
    """A row for each bucket, of the levels that are coarser than the interval's own (or as coarse), where a partner may begin."""

    def named(lv: int):
        return lambda b: F.struct(F.lit(lv).alias("level"), b.alias("bucket"))

    every = []
    for lv in levels:
        size = width << lv
        at = F.floor(F.col(start) / size)
        found = F.array_distinct(F.array(at - 1, at, F.floor((F.col(stop) - 1) / size)))
        coarser = F.col("level") < lv if strictly else F.col("level") <= lv
        every.append(F.when(coarser, F.transform(found, named(lv))).otherwise(F.expr("cast(array() as array<struct<level: int, bucket: bigint>>)")))
    return df.withColumn("at", F.explode(F.flatten(F.array(*every)))).withColumn("level", F.col("at.level")).withColumn("bucket", F.col("at.bucket")).drop("at")


def overlap_join(left: DataFrame, right: DataFrame, width: int = 10_000) -> DataFrame:
    """Pairs of left and right intervals of one chromosome that share at least one position, each once.

    Both have chrom, start and stop; right's come back as r_start and r_stop, and no other column may be in both, nor be
    called level or bucket. width: that of the finest buckets; results do not depend on it. Intervals without length
    overlap nothing.
    """
    a = left.where(F.col("stop") > F.col("start")).withColumn("level", level("start", "stop", width))
    b = right.withColumnsRenamed({"start": "r_start", "stop": "r_stop"}).where(F.col("r_stop") > F.col("r_start")).withColumn("level", level("r_start", "r_stop", width))
    # At most as many levels as a length has bits.
    present = {(r["side"], r["level"]) for r in a.select(F.lit(0).alias("side"), "level").union(b.select(F.lit(1), "level")).distinct().collect()}
    ours, theirs = (sorted(lv for s, lv in present if s == side) or [0] for side in (0, 1))
    overlap = (F.col("start") < F.col("r_stop")) & (F.col("r_start") < F.col("stop"))
    keys = ["chrom", "level", "bucket"]
    met = asking(a, theirs, "start", "stop", width, False).join(waiting(b, "r_start", width), keys).where(overlap).drop("level", "bucket")
    longer = [lv for lv in ours if lv > theirs[0]]
    if longer:
        coarse = waiting(a.where(F.col("level").isin(longer)), "start", width)
        met = met.unionByName(coarse.join(asking(b, longer, "r_start", "r_stop", width, True), keys).where(overlap).drop("level", "bucket"))
    return met


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = 10_000) -> DataFrame:
    """Left rows that overlap any right interval, once for each combination of keys (columns of either side)."""
    return overlap_join(left, right, width).select(*dict.fromkeys([*left.columns, *keys])).dropDuplicates(keys)


#: Records of a bucket that are counted together, unless one key has more there; and pairs that are held at once.
PIECE, PAIRS = 1 << 18, 1 << 17
HOME = ["chrom", "level", "bucket"]


def _homes(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """b's records, each in every bucket where a region of `a` that it overlaps may be waiting. Both have their level."""
    present = {(r["side"], r["level"]) for r in a.select(F.lit(0).alias("side"), "level").union(b.select(F.lit(1), "level")).distinct().collect()}
    ours, theirs = (sorted(lv for s, lv in present if s == side) or [0] for side in (0, 1))
    asked = asking(b, ours, "start", "stop", width, False)
    if theirs[-1] <= ours[0]:
        return asked
    # A record that is longer than a region's bucket goes to the buckets that hold regions alone, so to no more than it has partners, but for its ends.
    size = width * F.pow(F.lit(2.0), "level")
    taken = waiting(a.where(F.col("level") < theirs[-1]), "start", width).select(*HOME).distinct()
    spans = taken.select("chrom", (F.col("bucket") * size).cast("long").alias("start"), ((F.col("bucket") + 2) * size).cast("long").alias("stop"), F.struct("level", "bucket").alias("home"))
    far = overlap_join(b.where(F.col("level") > ours[0]).withColumnRenamed("level", "own"), spans, width).where("own > home.level")
    return asked.unionByName(far.select(*(F.col(f"home.{c}").alias(c) if c in ("level", "bucket") else c for c in asked.columns)))


def _same(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the last and the next record of the same key stand; -1 and the number of records if there is none."""
    order = np.argsort(code, kind="stable")
    at = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    last, following = np.full(len(code), -1), np.full(len(code), len(code))
    last[order[at + 1]] = order[at]
    following[order[at]] = order[at + 1]
    return last, following


def _counted(batches: Iterator[pa.RecordBatch], key: str, once: str | None, pairs: int) -> Iterator[pa.RecordBatch]:
    """Counts of one bucket: its records come first, then its regions, as many at a time as have `pairs` candidates.

    A record that is the only candidate of its key in a region makes a row as it is; only the others are sorted, or tallied
    where there are more of them than cells of regions and keys.
    """
    held = []
    for batch in batches:
        cut = int(np.searchsorted(batch.column("side").to_numpy(), 1))
        if cut:
            held.append(batch.slice(0, cut))
        if cut == batch.num_rows or not held:
            continue
        if isinstance(held, list):
            rows = pa.Table.from_batches(held).sort_by("start")
            start, stop = (rows.column(c).to_numpy() for c in ("start", "stop"))
            codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy().astype(np.int64)
            held = start, stop, np.maximum.accumulate(stop), code, _same(code), codes.dictionary, rows.column(once).to_numpy() if once else None
        start, stop, reach, code, (before, after), names, ids = held
        ridx, first, last = (batch.column(c).slice(cut).to_numpy() for c in ("ridx", "start", "stop"))
        low = np.searchsorted(reach, first, "right")
        n = np.maximum(np.searchsorted(start, last, "left") - low, 0)
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            done = ends[i] - n[i]
            j = max(i + 1, int(np.searchsorted(ends, done + pairs, "right")))
            shift, begin, least, most, of = (np.repeat(x[i:j], n[i:j]) for x in (low - ends + n + done, first, low, low + n, np.arange(len(n))))
            at = np.arange(len(of)) + shift
            meets = stop[at] > begin
            alone = meets & (before[at] < least) & (after[at] >= most)
            others = np.flatnonzero(meets & ~alone)
            pair = of[others] * len(names) + code[at[others]]
            if ids is not None:
                order = np.lexsort((ids[at[others]], pair))
                pair, own = pair[order], ids[at[others]][order]
                pair = pair[np.r_[True, (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])][: len(pair)]]
            if (j - i) * len(names) <= len(pair):
                tally = np.bincount(pair - i * len(names))
                found = np.flatnonzero(tally)
                cnt, found = tally[found], found + i * len(names)
            else:
                found, cnt = np.unique(pair, return_counts=True)
            region, cell = np.r_[of[alone], found // len(names)], np.r_[code[at[alone]], found % len(names)]
            cnt = np.r_[np.ones(len(region) - len(cnt), np.int64), cnt]
            yield pa.RecordBatch.from_arrays([pa.array(ridx[region]), names.take(pa.array(cell)), pa.array(cnt, pa.int64())], ["ridx", key, "cnt"])
            i = j


def overlap_counts(regions: DataFrame, records: DataFrame, key: str, once: str | None = None, width: int = 10_000) -> DataFrame:
    """(ridx, key, cnt): how many records of each key overlap a region. No zeros.

    regions: (ridx, chrom, start, stop), each with a ridx of its own; records: (chrom, start, stop, key). once: a whole
    number of records; those that share it count once in a region. A bucket with more than PIECE records is cut by key,
    and its regions go to every piece. What is shuffled grows with records and regions, and not with their pairs.
    """
    spark = regions.sparkSession
    shipped(spark)
    sides = [df.where(F.col("chrom").isNotNull() & (F.col("stop") > F.col("start"))).withColumns({c: F.col(c).cast("long") for c in ("start", "stop")}) for df in (regions, records)]
    a, b = (df.withColumn("level", level("start", "stop", width)) for df in sides)
    asked = _homes(a, b, width)
    # A row for every PIECE records at most.
    heavy = asked.groupBy(*HOME).agg(F.ceil(F.count("*") / PIECE).alias("pieces")).where("pieces > 1")
    pieces = F.coalesce("pieces", F.lit(1))
    asked = asked.join(F.broadcast(heavy), HOME, "left").withColumn("piece", F.pmod(F.xxhash64(key), pieces))
    home = waiting(a, "start", width).join(F.broadcast(heavy), HOME, "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    own = [key] + ([once] if once else [])
    rows = asked.select(*HOME, "piece", F.lit(0).alias("side"), "start", "stop", *own).unionByName(home.select(*HOME, "piece", F.lit(1).alias("side"), "start", "stop", "ridx"), allowMissingColumns=True)
    group, pairs = [*HOME, "piece"], PAIRS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, key, once, pairs)

    # A number of partitions of its own: what comes out may be many times what goes in, by which AQE would gather them.
    together = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group, "side", "start")
    shape = StructType().add("ridx", LongType()).add(key, records.schema[key].dataType).add("cnt", LongType())
    return together.groupBy(*group).applyInArrow(counted, shape)
