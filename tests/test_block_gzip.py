"""Block-compressed lines: any cut gives the lines of the plain file, ordinary gzip files go through one task."""

import gzip
import random
import zlib

import pytest

from axisloom.sources import block_gzip as G
from axisloom.sources import files


def texts(seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh\tü") for _ in range(r.choice([0, 1, 30, 30, 30, 5000]))) for _ in range(400)]


def packed(data, sizes, seed=0):
    """Blocks of chosen sizes, so that lines end anywhere in them."""
    r, out, i = random.Random(seed), b"", 0
    while i < len(data):
        n = r.choice(sizes)
        out, i = out + G.block(data[i : i + n]), i + n
    return out + G.END


@pytest.mark.parametrize("sizes", [[1, 2, 3], [100, 7000], [G.BLOCK]])
@pytest.mark.parametrize("end", ["\n", ""])
def test_every_cut_gives_every_line_once(tmp_path, sizes, end):
    lines = texts(len(sizes))[: 40 if 1 in sizes else 400] + ["last"]
    path = tmp_path / "x.gz"
    path.write_bytes(packed(("\n".join(lines) + end).encode(), sizes))
    assert gzip.decompress(path.read_bytes()).decode() == "\n".join(lines) + end
    for split in (37, 1000, 5003, 1 << 25):
        reader = G.LineReader({"path": str(path), "splitbytes": str(split)})
        got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()]
        assert got == lines


def test_headers_within_a_block_are_no_blocks(tmp_path):
    fake = G.MAGIC + bytes(6) + b"\x06\x00" + G.FIELD + b"\x20\x00"
    body = b"".join(fake + bytes([i]) * 40 for i in range(200))
    stored = b"\x01" + len(body).to_bytes(2, "little") + (len(body) ^ 0xFFFF).to_bytes(2, "little") + body
    path = tmp_path / "x.gz"
    first = G.END[:16] + (len(stored) + 25).to_bytes(2, "little") + stored + zlib.crc32(body).to_bytes(4, "little") + len(body).to_bytes(4, "little")
    path.write_bytes(first + G.block(b"b\n") + G.END)
    with G.opened(str(path))[0].open_input_file(str(path)) as file:
        for at in (1, 30, 5000):
            assert G.first_block(file, at, file.size()) == len(first)


def test_damage_is_an_error(tmp_path):
    data = packed(b"some line\n" * 500, [1000])
    length = G.head_of(data, 0)[1]
    flipped = (data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :] for i in (20, length - 8, length - 1))
    for bad in (data[: len(data) - 40], *flipped):
        (tmp_path / "x.gz").write_bytes(bad)
        reader = G.LineReader({"path": str(tmp_path / "x.gz")})
        with pytest.raises((ValueError, zlib.error)):
            [list(reader.read(p)) for p in reader.partitions()]
    (tmp_path / "y.gz").write_bytes(gzip.compress(b"a\n" * 1000)[:-9])
    reader = G.LineReader({"path": str(tmp_path / "y.gz")})
    with pytest.raises(ValueError):
        [list(reader.read(p)) for p in reader.partitions()]


def test_written_in_parts_and_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(50_000).selectExpr("concat('c', id % 3) AS chrom", "id AS start", "id + 1 + id % 7 AS stop", "concat('b', id % 100) AS barcode", "CAST(1 AS INT) AS dup")
    path = str(tmp_path / "f.tsv.bgz")
    files.write_fragments(rows.repartition(2), path, compressed=True)
    with pytest.raises(ValueError):
        files.write_fragments(rows, path, compressed=True)
    lines = G.read_lines(spark, path, 20_000)
    assert lines.rdd.getNumPartitions() > 8
    assert lines.count() == 50_000
    got = files.read_fragments(spark, path, 20_000)
    assert got.exceptAll(rows).count() == 0 and rows.exceptAll(got).count() == 0


def test_plain_and_empty_files(spark, tmp_path):
    (tmp_path / "a.tsv.gz").write_bytes(gzip.compress(b"# head\nc\t1\t5\tx\t1\n\n") + gzip.compress(b"c\t2\t2\tx\t1\r\nc\t3\t9\ty\t2\n"))
    got = files.read_fragments(spark, str(tmp_path / "a.tsv.gz")).collect()
    assert sorted(map(tuple, got)) == [("c", 1, 5, "x", 1), ("c", 3, 9, "y", 2)]
    files.write_fragments(spark.createDataFrame([], files.schema.FRAGMENTS), str(tmp_path / "none.tsv.bgz"), compressed=True)
    assert files.read_fragments(spark, str(tmp_path / "none.tsv.bgz")).count() == 0
