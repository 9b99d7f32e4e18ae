"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers with the marks that follow it. Where no piece of the model has a marker after
another character, no piece crosses from one chunk into the next, so a text's ids are its chunks' ids in order, and the
decoded text is that of its chunks.

1. Texts form blocks of about `chars_per_block` where they are read.
2. Each block sends its distinct chunks, by the hash of the chunk, so equal ones of all blocks meet; each is segmented
   and decoded once.
3. The ids come back to every block that has the chunk, and are joined to the block's texts, which move once, compressed.

How many parts of the hash there are follows from the size of the texts, so no task holds more than a block's texts or a
part's chunks, and there are never more blobs than chunks. Nothing is broadcast or gathered by the driver. A reply says
which request it answers; a block that was read in another order meanwhile, which has other requests, segments those
chunks itself.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm.common import blob, lean, slices, text_docs

MARK = "▁"
CHUNK = re.compile(" *[^ ]+| +")


def processor(model: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


def chunkable(sp) -> bool:
    """Whether no piece has a marker after another character, and the model neither folds nor trims spaces.

    The second part is tried on texts, as the library does not show the model's settings.
    """
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    kept = all(sp.decode(sp.encode(x)) == x for x in ("a  b", " a", "a ", "  ", "a\tb\nc", "éＡ"))
    return kept and not any(MARK in p.lstrip(MARK) for p in pieces)


def chunks(text: str) -> list[str]:
    """The chunks of a text behind its dummy prefix, spaces standing for markers.

    None for an empty text, nor for one that holds the marker itself: that one is encoded as a whole.
    """
    return CHUNK.findall(" " + text) if text and MARK not in text else []


def segments(sp, distinct: list[str]) -> list[list[int]]:
    """Ids of chunks. The library puts a marker before what it gets, so a chunk goes in without its first one."""
    lone = sp.piece_to_id(MARK)
    return [[lone] if c == " " else ids for c, ids in zip(distinct, sp.encode([c[1:] for c in distinct], num_threads=1), strict=True)]


def inside(sp, ids: list[list[int]]) -> list[str]:
    """What chunks decode to behind another one, where no space is taken off."""
    first = segments(sp, [" a"])[0]
    cut = len(sp.decode(first))
    return [t[cut:] for t in sp.decode([first + x for x in ids], num_threads=1)]


def whole(sp, texts: list[str]) -> list[tuple[str, str]]:
    """(decimal ids, decoded text) of texts that go to the library whole."""
    ids = sp.encode(texts, num_threads=1)
    return [(",".join(map(str, x)), t) for x, t in zip(ids, sp.decode(ids, num_threads=1) if texts else [], strict=True)]


def opened(data: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def places(x: np.ndarray) -> bytes:
    """uint32 numbers by the place of their bytes, which compresses well."""
    return np.ascontiguousarray(np.asarray(x).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed(*sections: bytes) -> bytes:
    """Sections behind their lengths, compressed together: a few bytes more than what they hold, however small they are."""
    raw = b"".join(len(x).to_bytes(4, "little") + x for x in sections)
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(data: bytes) -> list[bytes]:
    raw = pa.Codec("zstd").decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def strings(x: list[str]) -> tuple[bytes, bytes]:
    """(lengths in bytes, bytes) of strings."""
    data = [t.encode("utf-8", "surrogatepass") for t in x]
    return places(np.fromiter(map(len, data), np.uint32, len(data))), b"".join(data)


def from_strings(sizes: bytes, data: bytes) -> list[str]:
    ends = [0, *np.cumsum(from_places(sizes), dtype=np.int64).tolist()]
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in itertools.pairwise(ends)]


def dealt(batches, chars_per_block: int):
    """(block, [(doc_ids, texts), ...]) of a task's rows as they come; a block ends with the text that fills it."""
    number, size, held = 0, 0, []
    for b in batches:
        for first, texts in slices(b, "text", 500_000):
            held.append((b.column("doc_id").slice(first, len(texts)), texts))
            size += sum(map(len, texts)) + 10 * len(texts)
            if size >= chars_per_block:
                yield TaskContext.get().partitionId() << 32 | number, held
                number, size, held = number + 1, 0, []
    if held:
        yield TaskContext.get().partitionId() << 32 | number, held


def requests(texts, parts: int) -> dict[int, list[str]]:
    """The distinct chunks of a block's texts by part of their hashes, in the order in which they appear."""
    found = dict.fromkeys(chain.from_iterable(map(chunks, texts)))
    by_part: dict[int, list[str]] = {}
    for c in found:
        by_part.setdefault(crc32(c.encode("utf-8", "surrogatepass")) % parts, []).append(c)
    return by_part


def named(asked: list[str]) -> bytes:
    """A digest of a request."""
    return hashlib.sha256("\0".join(asked).encode("utf-8", "surrogatepass")).digest()[:12]


def chunk_table(rows: DataFrame, model: str, parts: int, chars_per_block: int) -> DataFrame:
    """(block, part, request, reply): the number of ids of each chunk of a block's request, the ids, and what it decodes to.

    A block sends its chunks on in one blob for each part of the chunks' hashes that it has any of. A part sees all
    blocks' chunks, segments each distinct one once, and answers every block in the order of its request. Decoded text is
    left out where it is the chunk itself.
    """

    def ask(batches):
        for block, held in dealt(batches, chars_per_block):
            found = requests(chain.from_iterable(texts for _, texts in held), parts)
            blobs = [packed(*strings(x)) for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([block] * len(found), pa.int64()), pa.array(blobs, pa.binary())], ["part", "block", "data"])

    def answer(rows: pa.Table) -> pa.Table:
        sp = processor(model)
        asked = [from_strings(*unpacked(x.as_py())) for x in rows.column("data")]
        known = {c: i for i, c in enumerate(dict.fromkeys(chain.from_iterable(asked)))}
        distinct = list(known)
        ids = segments(sp, distinct)
        size = np.array(list(map(len, ids)), np.int64)
        flat, first = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), np.cumsum(size) - size
        text = inside(sp, ids)
        out = []
        for x in asked:
            at = np.fromiter(map(known.__getitem__, x), np.int64, len(x))
            n = size[at]
            take = np.arange(int(n.sum())) + np.repeat(first[at] - (np.cumsum(n) - n), n)
            other = [i for i, k in enumerate(at.tolist()) if text[k] != x[i]]
            out.append((named(x), packed(places(n), places(flat[take]), places(np.array(other, np.uint32)), *strings([text[at[i]] for i in other]))))
        return pa.table({"block": rows.column("block"), "part": rows.column("part"), **{c: pa.array([o[i] for o in out], pa.binary()) for i, c in enumerate(("request", "reply"))}})

    asked = rows.mapInArrow(lean(ask), "part long, block long, data binary")
    return asked.groupBy("part").applyInArrow(lean(answer), "block long, part long, request binary, reply binary")


def encode(docs: DataFrame, model: str, decoded: bool = True, digests: bool = False, chars_per_block: int = 6_000_000, chars_per_part: int = 12_000_000) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row of docs, as the library encodes and decodes.

    model: path of a sentencepiece model, the same on all workers. digests: (doc_id, n_tokens, ids_sha256,
    decoded_sha256) instead, so that ids need not leave the task. Null and empty texts have no ids and decode to the
    empty text; repeated rows give repeated rows; a null doc_id stays null; an empty table gives no rows; columns other
    than doc_id and text are ignored. Texts that hold the marker itself are encoded by the library as a whole, and so is
    everything with a model whose pieces cross markers.
    """
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"

    def results(ids: pa.Array, dec: list[str], back: list[str]) -> pa.RecordBatch:
        if digests:
            cols = [pa.array([x.count(",") + bool(x) for x in dec], pa.int64()), *(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string()) for xs in (dec, back))]
            return pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        lists = [list(map(int, x.split(","))) if x else [] for x in dec]
        return pa.RecordBatch.from_arrays([ids, pa.array(lists, pa.list_(pa.int32())), pa.array(back if decoded else [None] * len(back), pa.string())], ["doc_id", "ids", "decoded"])

    rows = text_docs(docs)
    if not chunkable(processor(model)):

        def plain(batches):
            sp = processor(model)
            for b in batches:
                for at, texts in slices(b, "text", 1_000_000):
                    found = whole(sp, texts)
                    yield results(b.column("doc_id").slice(at, len(texts)), [f[0] for f in found], [f[1] for f in found])

        return rows.mapInArrow(plain, shape)

    rows = rows.select("doc_id", "text")
    parts = max(1, (rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0) // chars_per_part)

    def pack(batches):
        for block, held in dealt(batches, chars_per_block):
            data = blob(pa.table({"doc_id": pa.chunked_array([i for i, _ in held]), "text": pa.array(chain.from_iterable(t for _, t in held), pa.string())}))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

    def joined(mine: pa.Table, got: pa.Table) -> pa.Table:
        sp, out = processor(model), []
        replies = {(p, r): i for i, (p, r) in enumerate(zip(got.column("part").to_pylist(), got.column("request").to_pylist(), strict=True))}
        for data in mine.column("data"):
            docs = opened(data)
            texts = docs.column("text").to_pylist()
            dec: dict[str, str] = {}
            mid: dict[str, str] = {}
            for part, asked in requests(texts, parts).items():
                i = replies.get((part, named(asked)))
                if i is None:
                    found = segments(sp, asked)
                    dec.update(zip(asked, (",".join(map(str, x)) for x in found), strict=True))
                    mid.update(zip(asked, inside(sp, found), strict=True))
                    continue
                size, ids, other, *text = unpacked(got.column("reply")[i].as_py())
                size, ids, other = map(from_places, (size, ids, other))
                digits, ends = list(map(str, ids.tolist())), np.cumsum(size).tolist()
                dec.update(zip(asked, (",".join(digits[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
                mid.update(zip(asked, asked, strict=True))
                mid.update((asked[k], t) for k, t in zip(other.tolist(), from_strings(*text), strict=True))
            heads: dict[str, str] = {}
            ids, back = [], []
            for t in texts:
                x = chunks(t)
                if not x:
                    one = whole(sp, [t])[0] if t else ("", "")
                    ids.append(one[0])
                    back.append(one[1])
                    continue
                # A text's first chunk loses its first space, as the library's decode takes it off.
                if x[0] not in heads:
                    heads[x[0]] = sp.decode(list(map(int, dec[x[0]].split(","))))
                ids.append(",".join(map(dec.__getitem__, x)))
                back.append(heads[x[0]] + "".join(map(mid.__getitem__, x[1:])))
            out.append(results(docs.column("doc_id").combine_chunks(), ids, back))
        return pa.Table.from_batches(out) if out else EMPTY[digests]

    replies = chunk_table(rows, model, parts, chars_per_block)
    return rows.mapInArrow(lean(pack), "block long, data binary").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lean(joined), shape)


#: What a block has that no task packed.
EMPTY = {
    False: pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32())), "decoded": pa.array([], pa.string())}),
    True: pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids_sha256": pa.array([], pa.string()), "decoded_sha256": pa.array([], pa.string())}),
}
