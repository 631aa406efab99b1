"""SentencePiece BPE encoding that keeps track of the bytes each piece comes from, and decoding.

Normalisation reads the longest prefix that the model's compiled character map has (a double-array trie), or one
character, and records for every byte it writes the byte of the text it comes from. Segmentation runs on what
normalisation gives, and each piece's ends are looked up in that record: its span in the original text.

No piece of a model for which `splits` holds has a space mark behind another character, so merges never cross such a
place: normalised text is cut there, and the pieces of a chunk are found once and kept. The pieces themselves come
from the library, with its own normalisation switched off. Spans of texts that normalisation only marks the spaces of
are sums of the pieces' lengths; the record is made for the others.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, quiet_threads, slices, small_batches

SPACE = "▁"
#: Chunks whose ids a worker keeps.
MOST_CHUNKS = 400_000
#: Characters of a chunk that it keeps.
MOST_CHARS = 60


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def _field(number: int, data: bytes) -> bytes:
    """A field of bytes, written."""
    size, out = len(data), bytearray((number << 3 | 2,))
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes((size,)) + data


#: Fixed values of the file format: numbers of fields, kinds of pieces, the kind of model, and defaults of the normaliser.
_PIECE, _TRAINER, _NORMALISER = 1, 2, 3
_NORMAL, _USER_DEFINED, _BYTE = 1, 4, 6
_BPE = 2
_MAP, _DUMMY_PREFIX, _FEWER_SPACES, _MARK_SPACES = 2, 3, 4, 5
_MODEL_TYPE, _SPACE_AS_SUFFIX = 3, 24


class CharacterMap:
    """A compiled character map: the bytes of a double-array trie, then what its keys become, each ended by a zero."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
        self.texts = data[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """What the longest key that data has at `at` becomes, and the key's length."""
        units = self.units
        if not units:
            return None
        found, node = None, self._children(units[0])
        for n in range(at, len(data)):
            node ^= data[n]
            unit = units[node]
            # Fixed format of a unit: label in the low byte, bit 8 for a value below, bit 31 set in values.
            if unit & 0x800000FF != data[n]:
                break
            node ^= self._children(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = self.texts[start : self.texts.index(b"\0", start)], n + 1 - at
        return found

    @staticmethod
    def _children(unit: int) -> int:
        """Fixed format: bits 10 up are the offset, by 256 where bit 9 is set."""
        return unit >> 10 << (8 if unit & 1 << 9 else 0)


class Model:
    """A BPE model file: its pieces by id, and how it normalises."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        fields = list(_fields(data))
        trainer = {k: v for n, x in fields if n == _TRAINER for k, v in _fields(x)}
        rules = {k: v for n, x in fields if n == _NORMALISER for k, v in _fields(x)}
        pieces = [dict(_fields(x)) for n, x in fields if n == _PIECE]
        self.texts = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, _NORMAL) for p in pieces]
        if trainer.get(_MODEL_TYPE) != _BPE or trainer.get(_SPACE_AS_SUFFIX) or _USER_DEFINED in self.kinds:
            raise ValueError("only BPE models without user-defined pieces, with spaces before words, are read")
        self.map = CharacterMap(rules.get(_MAP, b""))
        self.dummy_prefix, self.fewer_spaces, self.mark_spaces = (bool(rules.get(k, 1)) for k in (_DUMMY_PREFIX, _FEWER_SPACES, _MARK_SPACES))
        #: Nothing but spaces changes, and each is marked.
        self.plain = not self.map.units and not self.fewer_spaces and self.mark_spaces and self.dummy_prefix
        #: Merges can't cross from another character to a space mark.
        self.splits = self.mark_spaces and not any(re.search(f"[^{SPACE}]{SPACE}", t) for t, k in zip(self.texts, self.kinds, strict=True) if k == _NORMAL)
        #: The same pieces with normalisation off: an empty map, no prefix, no space removed or marked.
        off = b"".join(bytes((n << 3, 0)) for n in (_DUMMY_PREFIX, _FEWER_SPACES, _MARK_SPACES))
        self.bare = b"".join(_field(n, x) for n, x in fields if n in (_PIECE, _TRAINER)) + _field(_NORMALISER, off)
        #: Bytes that each piece stands for in normalised text, and in plain text where a marked space is one byte.
        self.sizes = np.array([1 if k == _BYTE else len(t.encode()) if k == _NORMAL else 0 for t, k in zip(self.texts, self.kinds, strict=True)], np.int64)
        self.plain_sizes = self.sizes - np.array([2 * t.count(SPACE) if k == _NORMAL else 0 for t, k in zip(self.texts, self.kinds, strict=True)], np.int64)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the text that it comes from."""
        data, mark = text.encode(), (SPACE if self.mark_spaces else " ").encode()
        out, source = bytearray(), array("q")
        at, behind_space, begun = 0, self.fewer_spaces, False
        while at < len(data):
            found = self.map.longest(data, at)
            size = found[1] if found else 1 + sum(data[at] >= lead for lead in (0xC0, 0xE0, 0xF0))
            piece = found[0] if found else data[at : at + size]
            if not begun and not (self.fewer_spaces and piece == b" "):
                begun = True
                if self.dummy_prefix:
                    out += mark
                    source.extend([at] * len(mark))
            if behind_space:
                piece = piece.lstrip(b" ")
            for k, byte in enumerate(piece):
                new = mark if byte == 0x20 else bytes((byte,))
                out += new
                source.extend([at if found else at + k] * len(new))
            if piece:
                behind_space = self.fewer_spaces and piece.endswith(b" ")
            at += size
        end = len(data)
        while self.fewer_spaces and out.endswith(mark):
            end = source[len(out) - len(mark)]
            del out[-len(mark) :], source[-len(mark) :]
        source.append(end)
        return out.decode(), np.frombuffer(source, np.int64)


class Codec:
    """Ids, spans and texts by one model."""

    def __init__(self, path: str):
        quiet_threads()
        from sentencepiece import SentencePieceProcessor

        self.model = Model(path)
        self.library = SentencePieceProcessor(model_file=path)
        self.bare = SentencePieceProcessor(model_proto=self.model.bare)
        self.end = self.library.eos_id()
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}  # by what stands behind the chunk's first space mark

    def _chunks(self, text: str) -> tuple[list[str], np.ndarray | None]:
        """Chunks of the normalised text without their first space mark, and the record of sources if sums won't do.
        A text that can't be cut is a chunk behind a character that no text has."""
        model = self.model
        if model.plain and model.splits and SPACE not in text:
            if "  " not in text and text[:1] != " " and text[-1:] != " ":
                return text.split(" "), None
            return [c[1:] for c in self.cut.findall(SPACE + text.replace(" ", SPACE))], None
        whole, source = model.normalise(text)
        chunks = self.cut.findall(whole) if model.splits else [whole]
        return [c[1:] if c[:1] == SPACE else "\ud800" + c for c in chunks if c], source

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids with the end id, and where each id's bytes start and stop."""
        known, cut = self.known, [self._chunks(t) if t else ([], None) for t in texts]
        new = list(set().union(*(c for c, _ in cut)).difference(known))
        if new:
            found = self.bare.encode([c[1:] if c[:1] == "\ud800" else SPACE + c for c in new], num_threads=1)
            known.update((c, array("i", ids).tobytes()) for c, ids in zip(new, found, strict=True))
        last = array("i", (self.end,)).tobytes()
        rows = []
        for text, (chunks, source) in zip(texts, cut, strict=True):
            ids = np.frombuffer(b"".join(map(known.__getitem__, chunks)) + last, np.int32)
            if source is None:
                stops = np.cumsum(self.model.plain_sizes[ids]) - 1  # the first space mark isn't in the text
                starts = np.concatenate(([0], stops[:-1]))
                starts[-1:] = stops[-1:] = max(0, stops[-1]) if len(ids) > 1 else 0
            else:
                ends = np.cumsum(self.model.sizes[ids])
                stops, starts = source[ends], source[np.concatenate(([0], ends[:-1]))]
                starts[-1:] = stops[-1:] = len(text.encode())
            rows.append((ids, starts, stops))
        room = MOST_CHUNKS - (len(known) - len(new))
        for c in [*new[max(0, room) :], *[c for c in new[: max(0, room)] if len(c) > MOST_CHARS]]:
            del known[c]
        return rows

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec of a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", pieces: str = "pieces", decoded: str = "decoded") -> DataFrame:
    """All columns of docs, the pieces of its texts - parallel arrays `ids`, `starts` and `stops` - and the text that
    the library decodes from the ids. starts and stops are offsets in the text's UTF-8 bytes.

    The end id stands behind all others, with an empty span at the text's end. The first piece's mark for the space
    that the model puts before a text has no bytes of its own. A byte piece stands for its one byte. A piece whose
    characters the map made of one sequence spans nothing but for the last of them, which spans all of it. Null text is
    empty: only the end id. Rows are independent, so repeated rows have equal results; there is no shuffle. Columns
    named like the new ones stay; the new ones then get underscores in front.
    """
    pieces, decoded = free_name(docs, pieces), free_name(docs, decoded)
    at, names = docs.columns.index(text_col), [*docs.columns, pieces, decoded]
    kind = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "starts", "stops")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for batch in slices(whole, at):
                rows = own.encode([t or "" for t in batch.column(at).to_pylist()])
                ends = pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32))) for k in range(3)]
                texts = pa.array([own.decode(r[0]) for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(lists, ["ids", "starts", "stops"]), texts], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(pieces, kind), T.StructField(decoded, T.StringType())])
    return small_batches(docs).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The result of the registered query: counts and hashes of ids and decoded text, and how many bytes the spans cover."""
    r = encode_and_decode(docs.select("doc_id", "text"), path)
    listed = F.array_join(F.col("pieces.ids").cast("array<string>"), " ")
    covered = F.element_at("pieces.stops", -1) - F.element_at("pieces.starts", 1)
    return r.select("doc_id", F.size("pieces.ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), covered.cast("long").alias("n_bytes"))
