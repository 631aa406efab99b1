"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

BPE is local: a sequence of tokens is the encoding of its bytes exactly if each token encodes itself and each
two neighbours encode to themselves. So, reading a piece byte by byte, the encoding of every prefix ends in one
certain token, and only prefixes from which some token still reaches beyond the current byte can be boundaries
of the final encoding. The transducer's state is the set of trie nodes of the bytes read since each of these; which
token each prefix ends in stands in a register beside it. A transition gives the next state and the tokens that end
with its byte, longest first: the first that fits behind the token in its start's register is the prefix's own.
Transitions are computed when first taken and kept, as is whether two tokens fit; when there are too many, all but the
present state are dropped, and encoding goes on from the same byte. Tokens that all prefixes in a state have in common
are emitted, so output lags by a bounded lookahead.

Decoding runs the bytes of each token through an incremental UTF-8 state machine, whose state is the beginning of a
character that is not yet whole; its moves over whole tokens are kept likewise.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices, small_batches

#: Transitions, and pairs of tokens, that a worker keeps.
MOST_STATES = 400_000
#: Chunks between single spaces whose ids a worker keeps.
MOST_CHUNKS = 400_000
#: The same where other stages have left their memory in executors and workers: (transitions or pairs, chunks).
SMALL_TABLES = (400_000, 100_000)
#: Registers after which common tokens are emitted.
LOOKAHEAD = 4096
#: Moves of the decoder that a worker keeps.
MOST_MOVES = 500_000


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.most_states = most_states
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        self.depth: list[int] = [0]
        for text, rank in ranks.items():
            node = 0
            for depth, b in enumerate(text, 1):
                step = node << 8 | b
                found = self.child.get(step)
                if found is None:
                    found = self.child[step] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.depth.append(depth)
                    self.inner[node] = True
                node = found
            self.token[node] = rank
        self.n_ids = max(self.bytes_of, default=0) + 1
        self.sizes = [len(self.bytes_of.get(r, b"")) for r in range(self.n_ids)]
        self._split: dict[int, tuple[int, int]] = {}
        self._whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = (0,)
        self.states = [start]
        self.number = {start: 0}
        self.steps: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}  # a state and a byte: the next state, and sizes and tokens that end
        self.fits: dict[int, bool] = {}  # a token and the one before it

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition: join the neighbours of least rank, leftmost first, until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens that a token is last merged from; itself twice for a token of one byte."""
        found = self._split.get(token)
        if found is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                i = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self._split[token] = (token, token) if len(parts) < 2 else (self.ranks[parts[0]], self.ranks[parts[1]])
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that make left and right.

        The two are taken apart in the reverse of the order in which merging made them; at each point the
        tokens that face each other must not join sooner than the merge that was just taken back.
        """
        most = 1 << 60
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < most:
                return False
            inner_left, inner_right = self._halves(left)[1], self._halves(right)[0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or (left > right and inner_left != left):
                most, left = left, inner_left
            else:
                most, right = right + 1, inner_right

    def _encodes_itself(self, token: int) -> bool:
        whole = self._whole.get(token)
        if whole is None:
            whole = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return whole

    def _keep_only(self, state: int) -> int:
        """Drops all states, transitions and pairs but the start and this state; its new number."""
        kept = self.states[state]
        self._reset()
        if kept not in self.number:
            self.number[kept] = len(self.states)
            self.states.append(kept)
        return self.number[kept]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        nodes, ends = [], []
        for node in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                nodes.append(node)
            token = self.token[node]
            if token >= 0 and self._encodes_itself(token):
                ends.append((self.sizes[token], token))
        if not ends or ends[-1][0] > 1:
            raise ValueError(f"byte {byte} has no token of its own")
        key = (*nodes, 0)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        made = self.steps[state << 8 | byte] = (to, tuple(ends))
        return made

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        out: list[int] = []
        state, last, most = 0, [-1], LOOKAHEAD
        steps, fits, n_ids = self.steps, self.fits, self.n_ids
        for byte in piece:
            step = steps.get(state << 8 | byte)
            if step is None:
                if len(steps) > self.most_states or len(fits) > self.most_states:
                    state = self._keep_only(state)
                    steps, fits = self.steps, self.fits
                step = self._step(state, byte)
            state, ends = step
            for size, token in ends:
                left = last[-size]
                if size == 1 or left < 0:  # one token fits, so the shortest does if no other
                    break
                pair = left * n_ids + token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self._fit(left, token)
                if fit:
                    break
            last.append(token)
            if len(last) > most:
                done = self._common(state, last)
                out += self._back(last, done)
                del last[:done]
                most = max(LOOKAHEAD, 2 * len(last))
        return out + self._back(last, len(last) - 1)

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens of the prefix that ends at register `at`."""
        sizes, found = self.sizes, []
        while at:
            found.append(last[at])
            at -= sizes[last[at]]
        found.reverse()
        return found

    def _common(self, state: int, last: list[int]) -> int:
        """The greatest register that the encodings of all prefixes in the state go through."""
        at = {len(last) - 1}
        for node in self.states[state]:
            at.add(len(last) - 1 - self.depth[node])
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - self.sizes[last[far]])
        return at.pop()


#: Fixed values of UTF-8: first bytes of a character, how many bytes it has, and the range of its second byte.
_FIRST = (
    (0xC2, 0xDF, 2, 0x80, 0xBF), (0xE0, 0xE0, 3, 0xA0, 0xBF), (0xE1, 0xEC, 3, 0x80, 0xBF), (0xED, 0xED, 3, 0x80, 0x9F),
    (0xEE, 0xEF, 3, 0x80, 0xBF), (0xF0, 0xF0, 4, 0x90, 0xBF), (0xF1, 0xF3, 4, 0x80, 0xBF), (0xF4, 0xF4, 4, 0x80, 0x8F),
)
_LEADS = {b: (size, low, high) for first, last, size, low, high in _FIRST for b in range(first, last + 1)}


class Utf8Machine:
    """Text from bytes that come one after the other. `held` is the state: the bytes of a character that isn't whole
    yet. A beginning that its next byte can't continue, or the end, becomes one U+FFFD, as does any other wrong byte."""

    def __init__(self) -> None:
        self.held = b""

    def step(self, byte: int) -> str:
        if self.held:
            size, low, high = _LEADS[self.held[0]]
            if (low <= byte <= high) if len(self.held) == 1 else (0x80 <= byte <= 0xBF):
                self.held += bytes((byte,))
                if len(self.held) < size:
                    return ""
                whole, self.held = self.held, b""
                return whole.decode()
            self.held = b""
            return "\ufffd" + self.step(byte)
        if byte < 0x80:
            return chr(byte)
        if byte in _LEADS:
            self.held = bytes((byte,))
            return ""
        return "\ufffd"

    def feed(self, data: bytes) -> str:
        return "".join([self.step(b) for b in data])

    def finish(self) -> str:
        held, self.held = self.held, b""
        return "\ufffd" if held else ""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Chunks(dict):
    """Ids (as int32 bytes) of chunks behind `lead`; unknown ones are encoded, and kept while there is room.

    By PATTERN a piece ends before a full stop or comma that follows a letter, and a line feed between two characters
    that aren't white space is a piece of its own, so chunks are put together from what stands around these. ASCII letters
    alone are one piece with the lead.
    """

    def __init__(self, encode, word, lead: str, most: int = MOST_CHUNKS):
        self.encode, self.word, self.lead, self.bare, self.most = encode, word, lead, self, most
        self.marks = {c: encode(c) for c in ".,\n"}

    def __missing__(self, chunk: str) -> bytes:
        if self.lead and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
            raise _Beside(chunk)
        return self.make(chunk)

    def make(self, chunk: str, keep: bool = True) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            ids = self.word((self.lead + chunk).encode())
        elif len(chunk) > 1 and chunk[-1] in ".," and chunk[-2].isalpha():
            return self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            head, *lines = _LONE_FEED.split(chunk)
            if lines:
                *inner, last = lines
                return self.marks["\n"].join([self[head], *map(self.bare.__getitem__, inner), self.bare.get(last) or self.bare.make(last, keep)])
            ids = self.encode(self.lead + chunk)
        if keep and len(self) < self.most and len(chunk) < 200:
            self[chunk] = ids
        return ids


class _Beside(Exception):
    """White space stands beside the space at one of a chunk's ends."""


_LONE_FEED = re.compile(r"(?<=\S)\n(?=\S)")


class Codec:
    """A text's pieces and ids. Chunks between single spaces are encoded once and kept, up to a number; by another
    pattern than PATTERN, texts are encoded piece by piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, tables: tuple[int, int] = (MOST_STATES, MOST_CHUNKS)):
        self.transducer = Transducer(ranks, tables[0])
        self.pieces = regex.compile(pattern)
        self.cuts = pattern == PATTERN
        self.after_space = _Chunks(self._encode, self._word, " ", tables[1])
        self.after_space.bare = _Chunks(self._encode, self._word, "", tables[1])
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    def _encode(self, text: str) -> bytes:
        encode = self.transducer.encode_piece
        return array("i", chain.from_iterable([encode(p.encode()) for p in self.pieces.findall(text)])).tobytes()

    def _word(self, piece: bytes) -> bytes:
        return array("i", self.transducer.encode_piece(piece)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 bytes."""
        if not self.cuts:
            return self._encode(text)
        head, *chunks = text.split(" ")
        if not chunks:
            return self.after_space.bare[head]
        last = chunks.pop()
        # A cut at a space is safe where no white space is beside it: no piece goes on over such a space. Behind the last
        # chunk there is none, so it may end in white space.
        if head[-1:].isspace() or last[:1].isspace():
            return self._encode(text)
        open_end = not last or last[-1].isspace()
        try:
            known = self.after_space
            ids = [known.bare[head] if head else b"", *map(known.__getitem__, chunks), known.make(last, False) if open_end else known[last]]
        except _Beside:
            return self._encode(text)
        return b"".join(ids)

    def decode(self, ids: list[int], block: int = 4096) -> Iterator[str]:
        """The text of ids, in blocks of so many ids: each id moves the state machine as its bytes would."""
        moves, held = self.moves, b""
        for at in range(0, len(ids), block):
            texts = []
            for token in ids[at : at + block]:
                move = moves.get((held, token))
                if move is None:
                    move = self._move(held, token)
                held, text = move
                texts.append(text)
            yield "".join(texts)
        yield "\ufffd" if held else ""

    def _move(self, held: bytes, token: int) -> tuple[bytes, str]:
        machine = Utf8Machine()
        machine.held = held
        text = machine.feed(self.transducer.bytes_of[token])
        if len(self.moves) >= MOST_MOVES:
            self.moves.clear()
        move = self.moves[held, token] = (machine.held, text)
        return move


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, tables: tuple[int, int] = (MOST_STATES, MOST_CHUNKS)) -> Codec:
    """This process's codec of a rank file, with tables of so many states and chunks."""
    if (path, pattern, tables) not in _codecs:
        _codecs[path, pattern, tables] = Codec(read_ranks(path), pattern, tables)
    return _codecs[path, pattern, tables]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded", tables: tuple[int, int] = (MOST_STATES, MOST_CHUNKS)) -> DataFrame:
    """All columns of docs, the token ids of its texts (array of int) and the text that decoding them gives.

    Null text is empty: no ids, and empty decoded text. Rows are independent, so repeated rows have equal results;
    there is no shuffle. tables: what a worker keeps; ids don't depend on it. A very long text is held in memory with its ids: an array's cell is made whole.
    """
    ids, decoded = free_name(docs, ids), free_name(docs, decoded)
    at, names = docs.columns.index(text_col), [*docs.columns, ids, decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, tables)
        for whole in batches:
            for batch in slices(whole, at):
                rows = [own.encode(t.as_py() or "") for t in batch.column(at)]
                texts = ["".join(own.decode(np.frombuffer(r, np.int32).tolist())) for r in rows]
                ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(texts, pa.string())], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return small_batches(docs).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str, tables: tuple[int, int] = (MOST_STATES, MOST_CHUNKS)) -> DataFrame:
    """The result of the registered query: counts and hashes of the ids and of the decoded text."""
    r = encode_and_decode(docs.select("doc_id", "text"), path, pattern, tables=tables)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return r.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
