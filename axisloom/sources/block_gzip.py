"""Lines of block-compressed gzip files as a partitioned Spark data source, read by many tasks and written as part files.

Such a file is a row of small gzip members, each of which names its length in an extra field, so reading can begin at any
of them. A task owns the blocks that begin in its range of bytes, and the lines that follow a line end in these blocks;
it reads on into later blocks to finish the last one. Ordinary gzip files go through one task each.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from axisloom.plans.scratch import qualified
from axisloom.plans.ship import shipped

NAME = "block_gzip_lines"
#: Fixed values of the format: a member's first bytes, the extra field's name, the empty member that ends a file, and
#: how many bytes of data a block takes at most.
MAGIC = b"\x1f\x8b\x08\x04"
FIELD = b"BC\x02\x00"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65_280
#: Bytes that one read fetches, and text that one batch holds.
PIECE = 1 << 20
#: A block has 65,536 bytes at most, and so have two headers and what is between them.
LONGEST = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def head_of(data: bytes, at: int) -> tuple[int, int] | None:
    """(length of the header, length of the block) if a block begins there."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return None
    more = int.from_bytes(data[at + 10 : at + 12], "little")
    extra, i = data[at + 12 : at + 12 + more], 0
    while i + 6 <= len(extra):
        if extra[i : i + 4] == FIELD:
            return 12 + more, int.from_bytes(extra[i + 4 : i + 6], "little") + 1
        i += 4 + int.from_bytes(extra[i + 2 : i + 4], "little")
    return None


def first_block(file: pa.NativeFile, start: int, size: int) -> int | None:
    """Where the first block at or behind `start` begins; None if there is none.

    The bytes of a header may occur within a block by chance, so another block or the end of the file has to follow.
    """
    file.seek(start)
    data = file.read(3 * LONGEST)
    at = data.find(MAGIC)
    while at >= 0:
        found = head_of(data, at)
        if found and (start + at + found[1] == size or head_of(data, at + found[1])):
            return start + at
        at = data.find(MAGIC, at + 1)
    return None


def blocks(file: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, data) of the blocks from `at` on, checked by their sums."""
    file.seek(at)
    data = file.read(PIECE)
    i = 0
    while True:
        if len(data) - i < LONGEST:
            data, at, i = data[i:] + file.read(PIECE), at + i, 0
        if i == len(data):
            return
        found = head_of(data, i)
        if found is None or i + found[1] > len(data):
            raise ValueError(f"no whole block at byte {at + i}")
        body = zlib.decompress(data[i + found[0] : i + found[1] - 8], -15)
        told = data[i + found[1] - 8 : i + found[1]]
        if told != zlib.crc32(body).to_bytes(4, "little") + len(body).to_bytes(4, "little"):
            raise ValueError(f"the block at byte {at + i} is damaged")
        yield at + i, body
        i += found[1]


def plain(file: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """The data of an ordinary gzip file of one member or more, all at place 0."""
    unpack, fresh = zlib.decompressobj(31), True
    while data := file.read(PIECE):
        while data:
            out, fresh = unpack.decompress(data, PIECE), False
            if out:
                yield 0, out
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack, fresh = unpack.unused_data, zlib.decompressobj(31), True
    if not fresh:
        raise ValueError("the file ends within a member")


def owned(found: Iterator[tuple[int, bytes]], first: bool, stop: int) -> Iterator[bytes]:
    """Pieces of whole lines that begin in the blocks before `stop`; the line that goes on from earlier blocks is left out."""
    held: list[bytes] = []
    begun = first
    for at, data in found:
        if at >= stop:
            if not begun:
                return
            cut = data.find(b"\n")
            held.append(data if cut < 0 else data[:cut])
            if cut >= 0:
                yield b"".join(held)
                return
            continue
        if not begun:
            cut = data.find(b"\n")
            if cut < 0:
                continue
            begun, data = True, data[cut + 1 :]
        held.append(data)
        if sum(map(len, held)) >= PIECE and (cut := data.rfind(b"\n")) >= 0:
            held[-1] = data[:cut]
            yield b"".join(held)
            held = [data[cut + 1 :]]
    if begun and (rest := b"".join(held)):
        yield rest.removesuffix(b"\n")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    #: None: an ordinary gzip file, read whole.
    stop: int | None


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitbytes", 32 << 20))

    def partitions(self) -> list[Range]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith((".", "_"))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                cut = head_of(file.read(LONGEST), 0) is not None
            out += [Range(f.path, i, i + self.split) for i in range(0, f.size, self.split)] if cut else [Range(f.path, 0, None)] * (f.size > 0)
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as file:
            if partition.stop is None:
                found, stop = plain(file), 1
            else:
                start, stop = first_block(file, partition.start, file.size()), partition.stop
                if start is None or start >= stop:
                    return
                found = blocks(file, start)
            for text in owned(found, partition.start == 0, stop):
                lines = [x.removesuffix("\r") for x in text.decode("utf-8", "replace").split("\n")]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


@dataclass
class Part(WriterCommitMessage):
    hidden: str
    name: str


def block(data: bytes) -> bytes:
    """One block of at most BLOCK bytes of data."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return END[:16] + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


class LineWriter(DataSourceArrowWriter):
    """A part file for each task, hidden until all tasks are done; what failed tries leave is hidden for good."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        system, path = opened(self.path)
        system.create_dir(path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gz"
        with system.open_output_stream(f"{path}/.{name}", compression=None) as out:
            held = b""
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                held += "".join(f"{x}\n" for x in lines if x is not None).encode()
                whole = len(held) // BLOCK * BLOCK
                for i in range(0, whole, BLOCK):
                    out.write(block(held[i : i + BLOCK]))
                held = held[whole:]
            out.write((block(held) if held else b"") + END)
        return Part(f"{path}/.{name}", f"{path}/{name}")

    def commit(self, messages) -> None:
        system, path = opened(self.path)
        system.create_dir(path)
        for m in messages:
            if m is not None:
                system.move(m.hidden, m.name)
        with system.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.hidden)


class BlockGzipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    shipped(spark)
    spark.dataSource.register(BlockGzipLines)
    return spark


def read_lines(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(value) of a gzip file or of those in a folder; block-compressed ones are cut into ranges of split_bytes.

    Damaged or cut-off files are an error; an empty folder has no lines.
    """
    return registered(spark).read.format(NAME).option("splitBytes", split_bytes).load(qualified(spark, path))


def write_lines(lines: DataFrame, path: str) -> None:
    """The column `value` as block-compressed part files of a new folder; nulls are left out. Parts in the order of their names are one such file."""
    spark = registered(lines.sparkSession)
    system, where = opened(qualified(spark, path))
    if system.get_file_info(where).type != fs.FileType.NotFound:
        raise ValueError(f"{path} is there already")
    lines.select("value").write.format(NAME).mode("append").save(qualified(spark, path))
