"""Sources and sinks. Readers declare their schemas; writers write folders of part files, as Spark does."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom import schema
from axisloom.operators.chain import Chain
from axisloom.operators.em import Model, chain_of_tables, chain_tables
from axisloom.operators.slices import marked, slice_of
from axisloom.operators.tiling import chrom_sizes, indexed
from axisloom.plans.scratch import qualified
from axisloom.sources.block_gzip import read_lines, write_lines


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Regions with ridx and name from the first three columns of a BED file; intervals without length are left out."""
    rows = spark.read.csv(path, sep="\t", schema=schema.BED3, comment="#")
    return indexed(rows.where("stop > start").select("chrom", "start", "stop"))


def write_bed(regions: DataFrame, path: str) -> None:
    regions.select("chrom", "start", "stop").write.csv(path, sep="\t")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, stop, name, score, strand) of a BED6 file."""
    return spark.read.csv(path, sep="\t", schema=schema.FEATURES, comment="#").where("stop > start")


def read_fragments(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Fragments of a TSV file, compressed or not. Block-compressed files (.gz, .bgz) are cut into ranges of split_bytes.

    An ordinary .gz file cannot be cut: one task reads it, many go on.
    """
    if path.endswith((".gz", ".bgz")):
        lines = read_lines(spark, path, split_bytes).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
        if lines.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            lines = lines.repartition(spark.sparkContext.defaultParallelism)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.FRAGMENTS)
        rows = lines.select(F.from_csv("value", F.lit(kinds), {"sep": "\t"}).alias("v")).select("v.*")
    else:
        rows = spark.read.csv(path, sep="\t", schema=schema.FRAGMENTS, comment="#")
    return rows.where("stop > start")


def write_fragments(fragments: DataFrame, path: str, compressed: bool = False) -> None:
    """TSV part files; compressed: in blocks, so that each can be read by many tasks."""
    columns = ["chrom", "start", "stop", "barcode", "dup"]
    if compressed:
        write_lines(fragments.select(F.to_csv(F.struct(*columns), {"sep": "\t"}).alias("value")), path)
    else:
        fragments.select(*columns).write.csv(path, sep="\t")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments as a Parquet table; see schema.ALIGNMENTS for the columns that operators use."""
    return spark.read.parquet(path)


def write_alignments(reads: DataFrame, path: str) -> None:
    reads.write.parquet(path)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val), 0-based, of a coordinate-matrix text: % comments, one line of sizes, then 1-based triplets.

    The line of sizes is the first one that is no comment, in a file that has comments (of a folder of part files the
    first), or in the first file if none has any. Files are read in pieces, so it is found by its place in the file: the
    least line offset that Spark's reader reports for that file.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"))
    comment = F.startswith("value", F.lit("%"))
    files = lines.groupBy("file").agg(F.max(comment).alias("told"), F.min(F.when(~comment & (F.trim("value") != ""), F.col("at"))).alias("at"))
    any_told = files.agg(F.max("told").alias("any"), F.min("file").alias("least"))
    heads = files.join(F.broadcast(any_told), how="cross").where(F.col("told") | (~F.col("any") & (F.col("file") == F.col("least")))).select("file", "at")
    lines = lines.where(~comment & (F.trim("value") != ""))
    part = F.split(F.trim("value"), r"\s+")
    body = lines.join(F.broadcast(heads), ["file", "at"], "left_anti")
    return body.select((part[0].cast("long") - 1).alias("row"), (part[1].cast("long") - 1).alias("col"), part[2].cast("long").alias("val"))


def write_coordinates(matrix: DataFrame, path: str, n_rows: int, n_cols: int) -> None:
    """Triplets (row, col, val), 0-based, as text: a folder of part files, sorted by row and column over all of them.

    The first part begins with the comment and the line of sizes, so the parts one after the other are one such file.
    """
    n = matrix.count()
    spark = matrix.sparkSession
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate integer general", -1, -1), (1, f"{n_rows} {n_cols} {n}", -1, -1)], "part int, value string, r long, c long")
    body = matrix.select(F.lit(2).alias("part"), F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("val").cast("string")).alias("value"), F.col("row").alias("r"), F.col("col").alias("c"))
    head.unionByName(body).repartitionByRange("part", "r", "c").sortWithinPartitions("part", "r", "c").select("value").write.text(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A cell table with a header; without a barcode column the first one is it."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows if "barcode" in rows.columns else rows.withColumnRenamed(rows.columns[0], "barcode")


def write_cells(cells: DataFrame, path: str) -> None:
    cells.write.csv(path, sep="\t", header=True)


def read_groups(spark: SparkSession, table: str, cells: DataFrame | None = None, barcode_column: int = 0, group_column: int = 1) -> DataFrame:
    """(barcode, grp): columns by position of a .csv, .tsv or .bct file; any other name is a column of the cell table."""
    for ending, sep in ((".csv", ","), (".tsv", "\t"), (".bct", "\t")):
        if table.endswith(ending):
            rows = spark.read.csv(table, sep=sep, header=True)
            return rows.select(F.col(f"`{rows.columns[barcode_column]}`").alias("barcode"), F.col(f"`{rows.columns[group_column]}`").alias("grp"))
    if cells is None or table not in cells.columns:
        raise ValueError(f"{table!r} is neither a .csv, .tsv or .bct file nor a column of the cell table")
    return cells.select("barcode", F.col(f"`{table}`").cast("string").alias("grp"))


def genome_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size): from a fragments file the largest stops; a .sizes file lists chromosomes and lengths."""
    if path.endswith(".sizes"):
        return spark.read.csv(path, sep="\t", schema="chrom string, size long")
    if path.endswith((".tsv", ".tsv.gz", ".tsv.bgz", ".bed", ".bed.gz", ".bed.bgz")):
        return chrom_sizes(read_fragments(spark, path))
    raise ValueError(f"no chromosome sizes in {path!r}")


def write_matrix(counts: DataFrame, regions: DataFrame, cells: DataFrame, path: str) -> None:
    """The matrix store: counts by chromosome, so that a chromosome's are read alone, beside regions and cells."""
    counts.join(regions.select("ridx", "chrom"), "ridx").write.partitionBy("chrom").parquet(f"{path}/counts")
    regions.write.parquet(f"{path}/regions")
    cells.write.parquet(f"{path}/cells")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts with chrom, regions, cells) of a matrix store."""
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("counts", "regions", "cells"))


def _table(spark: SparkSession, path: str, n: int) -> tuple[str, str]:
    """The name in the session's catalogue of the sliced counts at a path, and the path with its file system."""
    where = qualified(spark, f"{path}/counts")
    return f"sliced_{n}_{hashlib.sha256(where.encode()).hexdigest()[:24]}", where


def write_sliced(counts: DataFrame, path: str, slices: int | None = None) -> None:
    """Counts (dataset, ridx, barcode, cnt) as a table with a bucket for each slice of the regions; see operators.slices.

    Reading it, a task holds a slice, so slices are to be as many as make one fit for a task (a gigabyte, say); None takes
    spark.sql.shuffle.partitions. The table is external: dropping its name from the catalogue leaves the files.
    """
    spark = counts.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, where = _table(spark, path, n)
    rows = counts.select(slice_of(spark, n).alias("slice"), "dataset", "barcode", F.col("ridx").cast("long").alias("ridx"), F.col("cnt").cast("long").alias("cnt"))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows.repartition(n, "slice").write.bucketBy(n, "slice").sortBy("dataset", "barcode", "ridx").option("path", where).format("parquet").saveAsTable(name)
    # Written last, so a store that tells its slices is whole.
    spark.createDataFrame([(json.dumps({"slices": n}),)], "value string").write.text(f"{path}/parameters")


def read_sliced(spark: SparkSession, path: str) -> DataFrame:
    """The counts of a sliced store, in this or any later session; those that the store lacks its parameters for are a ValueError."""
    from pyspark.errors import AnalysisException

    try:
        n = json.loads(spark.read.text(f"{path}/parameters").first()["value"])["slices"]
    except AnalysisException as e:
        raise ValueError(f"no whole sliced store at {path}") from e
    name, where = _table(spark, path, n)
    columns = "slice BIGINT, dataset STRING, barcode STRING, ridx BIGINT, cnt BIGINT"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (slice) SORTED BY (dataset, barcode, ridx) INTO {n} BUCKETS LOCATION '{where}'")
    return marked(spark.table(name), n)


def write_model(model: Model, path: str, segments: DataFrame | None = None) -> None:
    """Start, transitions, emissions, parameters as JSON lines and, once there are any, segments."""
    spark = model.emission.sparkSession
    start, trans = chain_tables(spark, model.chain)
    start.write.parquet(f"{path}/start")
    trans.write.parquet(f"{path}/trans")
    model.emission.write.parquet(f"{path}/emission")
    parameters = {"n_states": model.n_states, "score": model.score if model.score > float("-inf") else None, "seed": model.seed, "iterations": model.iterations}
    spark.createDataFrame([(json.dumps(parameters),)], "value string").write.text(f"{path}/parameters")
    if segments is not None:
        segments.write.parquet(f"{path}/segments")


def read_model(spark: SparkSession, path: str) -> Model:
    """ValueError if there is no model at the path."""
    from pyspark.errors import AnalysisException

    try:
        p = json.loads(spark.read.text(f"{path}/parameters").first()["value"])
    except AnalysisException as e:
        raise ValueError(f"no model at {path}") from e
    chain: Chain = chain_of_tables(spark.read.parquet(f"{path}/start"), spark.read.parquet(f"{path}/trans"))
    score = float("-inf") if p["score"] is None else p["score"]
    return Model(p["n_states"], chain, spark.read.parquet(f"{path}/emission"), score, p["seed"], p["iterations"])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/segments")


def write_segments(segments: DataFrame, path: str, threshold: float = 0.99) -> None:
    """Segments whose highest probability reaches the threshold, as TSV with a header."""
    segments.where(F.col("Prob_max") >= threshold).write.csv(path, sep="\t", header=True)


def write_bed9(segments: DataFrame, path: str, by_state: bool = False) -> None:
    """Nine BED columns; by_state: a folder for each state's name."""
    rows = segments.select("chrom", "start", "stop", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb")
    if by_state:
        rows.withColumn("state_name", F.col("name")).write.partitionBy("state_name").csv(path, sep="\t")
    else:
        rows.write.csv(path, sep="\t")


def write_small(df: DataFrame, path: str, sep: str = ",") -> None:
    """Small results (state frequencies, scores, enrichment tables) with a header."""
    df.write.csv(path, sep=sep, header=True)


def write_by_group(records: DataFrame, groups: DataFrame, path: str) -> None:
    """Records in a folder for each group of their barcode; those without a group are left out."""
    by_group(records, groups).write.partitionBy("grp").parquet(path)


def by_group(records: DataFrame, groups: DataFrame) -> DataFrame:
    return records.join(groups.select("barcode", "grp"), "barcode")


def checked_groups(barcodes: Sequence[str], groups: Sequence[str], spark: SparkSession) -> DataFrame:
    """(barcode, grp) of two equally long lists."""
    if len(barcodes) != len(groups):
        raise ValueError("as many groups as barcodes are needed")
    return spark.createDataFrame(list(zip(barcodes, groups, strict=True)), "barcode string, grp string")
