"""Token ids in binary files: fixed-size blocks cut into byte or bit planes, each compressed, with an index.

File format, integers little-endian:

    magic      8 bytes  b"IDPLANE1"
    planes     for each block, for each plane: zstandard frame
    index      zstandard frame of int64: for each block its number of ids, then the length of each plane's frame
    documents  zstandard frame of int64: ids without null (null: 0), whether null, ids' counts - three rows
    tail       5 x uint64: block size, planes a block, bytes of index, bytes of documents, bits in a plane (8 or 1)
    magic      8 bytes again

A plane holds one byte (or bit) of every id of a block; planes of high bits are nearly constant and almost vanish.
Files are written by the task that encodes a range of document ids, under a name of its own attempt, and only
those that a successful attempt reports are read. Ranges follow each other in ascending document id.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts_for, quiet_threads, shared_path, slices, small_batches

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
#: Bytes of the documents table for each file (as many files as shuffle partitions at least).
FILE_BYTES = 16 << 20
#: Words whose ids a worker keeps.
MOST_WORDS = 1_000_000


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block of uint32 ids: four of bytes, or 32 of bits; low ones first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, k].tobytes() for k in range(4)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4")[:, 0]
    flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.ascontiguousarray(np.packbits(flat, axis=1, bitorder="little")).view("<u4")[:, 0]


class Writer:
    """Writes one file to a binary stream; ids and documents are appended in order."""

    def __init__(self, stream, block: int = BLOCK, bits: int = 8, level: int = 3):
        if bits not in (1, 8):
            raise ValueError("bits must be 1 or 8")
        self.stream, self.block, self.bits = stream, block, bits
        self.pack = zstandard.ZstdCompressor(level=level)
        self.index: list[int] = []
        self.docs: list[np.ndarray] = []
        self.waiting, self.n_waiting, self.n_ids, self.n_docs = [], 0, 0, 0
        stream.write(MAGIC)

    def append(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        null = np.array([d is None for d in doc_ids], np.int64)
        self.docs.append(np.stack((np.array([d or 0 for d in doc_ids], np.int64), null, counts.astype(np.int64))))
        self.n_docs += len(doc_ids)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(joined[at : at + self.block])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole

    def _write(self, ids: np.ndarray) -> None:
        frames = [self.pack.compress(p) for p in to_planes(ids, self.bits)]
        self.index += [len(ids), *map(len, frames)]
        for f in frames:
            self.stream.write(f)

    def close(self) -> None:
        if self.n_waiting:
            self._write(np.concatenate(self.waiting))
        index = self.pack.compress(np.array(self.index, "<i8").tobytes())
        docs = np.concatenate(self.docs, axis=1) if self.docs else np.empty((3, 0), np.int64)
        table = self.pack.compress(docs.astype("<i8").tobytes())
        self.stream.write(index + table + struct.pack("<5Q", self.block, 32 // self.bits, len(index), len(table), self.bits) + MAGIC)


def read_file(stream, size: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, counts, ids) of each run of whole documents that a block ends. stream: seekable."""
    unpack = zstandard.ZstdDecompressor()
    stream.seek(size - 48)
    tail = stream.read(48)
    if tail[40:] != MAGIC:
        raise ValueError("not a file of id planes, or cut short")
    _, planes, index_size, docs_size, bits = struct.unpack("<5Q", tail[:40])
    stream.seek(size - 48 - docs_size - index_size)
    index = np.frombuffer(unpack.decompress(stream.read(index_size)), "<i8").reshape(-1, 1 + planes)
    docs = np.frombuffer(unpack.decompress(stream.read(docs_size)), "<i8").reshape(3, -1)
    ends = np.cumsum(docs[2])
    stream.seek(len(MAGIC))
    waiting, given, have = [], 0, 0  # blocks whose documents aren't whole yet are joined once, when they are
    for n, *lengths in index.tolist():
        waiting.append(from_planes([unpack.decompress(stream.read(k), max_output_size=n * 4) for k in lengths], n, bits))
        have += n
        until = int(np.searchsorted(ends, have, side="right"))
        if until > given:
            take = int(docs[2, given:until].sum())
            rest = np.concatenate(waiting)
            yield [None if z else d for d, z in zip(docs[0, given:until].tolist(), docs[1, given:until].tolist(), strict=True)], docs[2, given:until], rest[:take]
            waiting, given = [rest[take:]], until


class WordEncoder:
    """A tokenizer, as its file says, applied to each different word once; white space, which it drops, separates its
    pre-tokens. A special token's name in a text gives that token, as from the library."""

    def __init__(self, path: str):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of the texts, each with the end id behind it."""
        # The tokenizer reads lower case, but for the names of special tokens, which it takes for those tokens; lower
        # case first, where it is plain and no such name can be, makes for fewer different words.
        texts = [t.lower() if t.isascii() and "<|" not in t else t for t in texts]
        # str.split also cuts at four control characters that the tokenizer takes for symbols.
        words = [t.split(" ") if any(c in t for c in _CUTS) else t.split() for t in texts]
        known = self.known
        new = list(set().union(*words).difference(known))
        if new:
            found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, found, strict=True))
        last = array("I", (end,)).tobytes()
        rows = [b"".join(map(known.__getitem__, ws)) + last for ws in words]
        for w in new[max(0, len(new) - max(0, len(known) - MOST_WORDS)) :]:
            del known[w]
        return np.array([len(r) // 4 for r in rows], np.int64), np.frombuffer(b"".join(rows), np.uint32)


_CUTS = "\x1c\x1d\x1e\x1f"
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _open_store(uri: str):
    """File system and path of a URI of the shared folder (a bare path: the local file system)."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


def write_files(docs: DataFrame, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", bits: int = 8, block: int = BLOCK) -> DataFrame:
    """Encode texts and write files in ascending id; (part, path, n_docs, n_ids) of each file.

    Null text is empty: only the end id. Null ids come first. Rows of one id follow each other, ordered by text.
    An empty table gives no file.
    """
    folder = shared_path(docs.sparkSession, "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _open_store(folder)
        part = TaskContext.get().partitionId()
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.planes"
        writer, stream = None, None
        own = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, 1, 6 << 20):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    stream = store.open_output_stream(path)
                    writer = Writer(stream, block, bits)
                counts, ids = own.encode([t or "" for t in batch.column(1).to_pylist()], end)
                writer.append(batch.column(0).to_pylist(), counts, ids)
        if writer is not None:
            writer.close()
            stream.close()
            row = [[part], [folder + path[len(base) :]], [writer.n_docs], [writer.n_ids]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1]), pa.array(row[2]), pa.array(row[3])], ["part", "path", "n_docs", "n_ids"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(parts_for(docs, FILE_BYTES), "id").sortWithinPartitions("id", "text")
    return materialise(dealt.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "files")


def read_files(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, data) of each document in files written by write_files; data: ids as little-endian uint32.

    Only one row a file, with the ids before it, passes through the driver.
    """
    spark = files.sparkSession
    start, rows = 0, []
    for f in files.orderBy("part").collect():
        rows.append((f["path"], start))
        start += f["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _open_store(path)
                with store.open_input_file(name) as stream:
                    for docs, counts, ids in read_file(stream, stream.size()):
                        ends = np.cumsum(counts)
                        data = ids.astype("<u4").tobytes()
                        cells = [data[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at + ends - counts), pa.array(counts), pa.array(cells, pa.binary())], ["id", "start", "n_tokens", "data"])
                        at += int(counts.sum())

    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "id long, start long, n_tokens long, data binary")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The result of the registered query: positions, counts and checksums read back from the files."""
    read = read_files(write_files(docs, tokenizer))
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("data").alias("ids_crc32"))
