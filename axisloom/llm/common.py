"""What the text operators share: reading, word splitting, checkpoints and connected components."""

from __future__ import annotations

import ctypes
import inspect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.plans.scratch import fresh_path
from axisloom.plans.scratch import stored as saved
from axisloom.plans.ship import shipped

__all__ = ["blob", "components", "fresh_path", "lean", "saved", "slices", "smallest", "split_hash", "table", "text_docs", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_docs(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as empty, and the named columns; any other columns are left out."""
    shipped(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def words(text: str) -> list[bytes]:
    """Runs of other characters than space and \\x09-\\x0D, A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000):
    """(first row, texts) pieces of a batch, each of about that many characters and one text at least."""
    values, at, size, held = batch.column(column), 0, 0, []
    for i in range(len(values)):
        text = values[i].as_py()
        if held and size + len(text) > chars:
            yield at, held
            at, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def smallest(df: DataFrame, n: int, *on: str) -> DataFrame:
    """At most n of df's distinct rows, those with the smallest hashes of the columns `on`; about n rows move.

    Rows are kept by a bound on the hash that leaves n of them with a margin of six deviations, before they are sorted.
    """
    share = min(1.0, (n + 6 * n**0.5 + 100) / max(df.count(), 1))
    hashed = df.withColumn("smallest_hash", F.pmod(F.xxhash64(*on), F.lit(1 << 62)))
    return hashed.where(F.col("smallest_hash") <= int(share * (1 << 62))).distinct().orderBy("smallest_hash", *df.columns).limit(n).drop("smallest_hash")


def split_hash(column) -> object:
    """crc32 of the decimal text of an id; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: pairs of ids, in any order, repeated or not; pairs with a null or with two equal ids join nothing. Returns
    (node, component): one row for each node of an edge, component being the smallest id reachable. Every round is a
    grouped minimum and a join on the node; the number of rounds grows with the logarithm of the longest path.
    """
    now = saved(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    )
    before = None
    while True:
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(now.select("lo", "hi"))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = both.join(least, "n").where(F.col("m") > F.col("n")).select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        held = large.join(least, "hi")
        small = held.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).union(held.select("hi", F.col("least").alias("lo")))
        now = saved(small.where(F.col("hi") != F.col("lo")).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if before == state:
            break
        before = state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


#: glibc's number for the size from which memory is mapped on its own, and so given back when it is freed.
MMAP_THRESHOLD = -3


def lean(work):
    """A task's function that gives its memory back to the system when it ends.

    Workers are used again by later tasks and stages, and would keep what the largest of them took.
    """

    def settle() -> None:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(MMAP_THRESHOLD, 1 << 20)
        pa.set_memory_pool(pa.system_memory_pool())

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    def whole(*given):
        settle()
        out = work(*given)
        give_back()
        return out

    def batches(given):
        settle()
        yield from work(given)
        give_back()

    if inspect.isgeneratorfunction(work):
        return batches
    # Spark counts a function's arguments.
    return (lambda a: whole(a)) if len(inspect.signature(work).parameters) == 1 else (lambda a, b: whole(a, b))


def blob(table: pa.Table) -> bytes:
    """A table as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()
