"""Groups of tokens of two tokenizers that cover the same bytes, and how often their ids are linked in a corpus.

Each byte of a text gets a label: whether a token of A, of B, of both, or none ends there. A regular expression scans
the string of labels for spans up to each both-label; the labels that a span holds are counted, and these counts say
how many tokens of A and of B the group has. Tokens of a group are linked, each of A with each of B.

Both tokenizers begin anew at a space behind a character that isn't white space, so texts are cut into chunks there,
and a worker keeps what it found for a chunk. A corpus's table of linked ids has a row for each pair of ids, not for
each occurrence; it is used in parts of a fixed size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentence_piece
from .common import free_name, materialise, quiet_threads, slices, small_batches

#: Chunks that a worker keeps; when there are more, it begins anew.
MOST_CHUNKS = 300_000
#: Tokens in these, for chunks may be long.
MOST_HELD = 4_000_000
#: Chunks that go to the tokenizers as one text.
RUN = 64
#: Links of a group that are made one by one; in larger groups equal ids are counted first.
PLAIN_LINKS = 256
#: Pairs of ids in a part of the table of counts (16 bytes each) that is sent to each worker.
PART_PAIRS = 4_000_000

_SCAN = re.compile(rb"[^#]*#")
_LABELS = bytes.maketrans(bytes(range(4)), b".ab#")
_CUT = re.compile(r"(?<=\S)(?= )")


def _byte_alphabet() -> dict[str, int]:
    """Fixed by the format: the printable characters of Latin-1 stand for themselves, other bytes for those from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights[order], first)


class Aligner:
    """A is a byte-level BPE of the tokenizers library, B a SentencePiece BPE."""

    def __init__(self, path_a: str, path_b: str):
        quiet_threads()
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentence_piece.codec(path_b)
        model = self.b.model
        alphabet, entries = _byte_alphabet(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.a_bytes[number] = bytes([alphabet[c] for c in entry]) if all(c in alphabet for c in entry) else entry.encode()
        self.b_bytes = [bytes((int(t[1:-1], 16),)) if k == sentence_piece._BYTE else t.replace(sentence_piece.SPACE, " ").encode() for t, k in zip(model.texts, model.kinds, strict=True)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        words = lambda n, behind: np.array([f"{i}{behind}" for i in range(n)], object)
        self.shown_a, self.last_a = (words(len(self.a_bytes), x) for x in ",|")
        self.shown_b, self.last_b = (words(len(self.b_bytes), x) for x in ",;")
        self.n_b, self.n_pairs = len(self.b_bytes), len(self.a_bytes) * len(self.b_bytes)
        with open(path_a, encoding="utf-8") as f:
            rules = json.load(f)
        before = rules.get("pre_tokenizer") or {}
        self.cuts = model.plain and model.splits and not rules.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self._begin_anew()

    def _begin_anew(self) -> None:
        self.number: dict[str, int] = {}
        self.listed: list[str] = []
        self.held = 0
        self.facts = np.empty((0, 5), np.int64)  # tokens of A, of B, groups, links, whether the bytes differ
        self.pairs, self.times, self.starts = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        """What stands behind the space that each chunk of space + text begins with."""
        if not self.cuts:
            return [text]
        whole = " " + text
        return text.split(" ") if not re.search(r"\s ", whole) else [c[1:] for c in _CUT.split(whole)]

    def _ids(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of texts that begin with a space."""
        a = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        if self.cuts:
            return a, self.b.bare.encode([r.replace(" ", sentence_piece.SPACE) for r in runs], num_threads=1)
        return a, self.b.library.encode([r[1:] for r in runs], num_threads=1)

    def _same_bytes(self, a, b, data: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))

    def _learn(self, new: list[str]) -> None:
        """Aligns chunks that aren't known yet, all in one go. Chunks that don't end in white space go to the tokenizers
        in runs, as they would in a text."""
        ends_well = [self.cuts and c[-1:] != sentence_piece.SPACE and c[-1:].strip() != "" for c in new]
        well = [c for c, e in zip(new, ends_well, strict=True) if e]
        new = well + [c for c, e in zip(new, ends_well, strict=True) if not e]
        texts = [" " + c for c in new]
        raw = [t.encode() for t in texts]
        runs = ["".join(texts[i : min(i + RUN, len(well))]) for i in range(0, len(well), RUN)] + texts[len(well) :]
        a, b = self._ids(runs)
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        bad = np.zeros(len(new), bool)
        if not self._same_bytes(flat_a, flat_b, b"".join(raw)):
            a, b = self._ids(texts)
            bad[:] = [not self._same_bytes(x, y, r) for x, y, r in zip(a, b, raw, strict=True)]
            flat_a, flat_b = (list(chain.from_iterable(x for x, out in zip(ids, bad, strict=True) if not out)) for ids in (a, b))
            raw = [b"" if out else r for r, out in zip(raw, bad, strict=True)]
        of_a, of_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        sizes = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(sizes)
        marks = np.zeros(int(ends[-1]), np.uint8)
        marks[np.cumsum(self.a_sizes[of_a]) - 1] += 1
        marks[np.cumsum(self.b_sizes[of_b]) - 1] += 2
        labels = marks.tobytes().translate(_LABELS)
        spans = _SCAN.findall(labels)
        stops = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        firsts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
        in_a, in_b = (np.add.reduceat((marks & bit) // bit, firsts, dtype=np.int64) if len(stops) else stops for bit in (1, 2))
        owner = np.searchsorted(ends, stops - 1, side="right")
        self._keep(new, bad, of_a, of_b, in_a, in_b, owner)

    def _keep(self, new, bad, of_a, of_b, in_a, in_b, owner) -> None:
        n = len(new)
        end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)
        # The ids in order of their groups, A's before B's, each with what stands behind it.
        shown = np.empty(len(of_a) + len(of_b), object)
        at_a = np.arange(len(of_a)) + np.repeat(end_b - in_b, in_a)
        at_b = np.arange(len(of_b)) + np.repeat(end_a, in_b)
        shown[at_a], shown[at_b] = self.shown_a[of_a], self.shown_b[of_b]
        shown[end_a + end_b - in_b - 1] = self.last_a[of_a[end_a - 1]]
        shown[end_a + end_b - 1] = self.last_b[of_b[end_b - 1]]
        shown = shown.tolist()
        n_groups = np.bincount(owner, minlength=n)
        self.held += len(shown)
        stop = np.bincount(owner, in_a + in_b, n).astype(np.int64).cumsum().tolist()
        self.listed += ["".join(shown[i:j]) for i, j in zip([0, *stop[:-1]], stop, strict=True)]
        links = in_a * in_b
        per = lambda x: np.bincount(owner, x, n).astype(np.int64)  # noqa: E731  exact: far below 2^53
        self.facts = np.concatenate((self.facts, np.stack((per(in_a), per(in_b), n_groups, per(links), bad.astype(np.int64)), axis=1)))
        plain = np.flatnonzero(links <= PLAIN_LINKS)
        width, size = in_b[plain], links[plain]
        place = _ragged(np.zeros(len(plain), np.int64), size)
        left = of_a[np.repeat((end_a - in_a)[plain], size) + place // np.repeat(width, size)]
        right = of_b[np.repeat((end_b - in_b)[plain], size) + place % np.repeat(width, size)]
        keys, weights = [np.repeat(owner[plain], size) * self.n_pairs + left * self.n_b + right], [np.ones(len(place), np.int64)]
        for g in np.flatnonzero(links > PLAIN_LINKS).tolist():
            x, times_x = np.unique(of_a[end_a[g] - in_a[g] : end_a[g]], return_counts=True)
            y, times_y = np.unique(of_b[end_b[g] - in_b[g] : end_b[g]], return_counts=True)
            keys.append((owner[g] * self.n_pairs + x[:, None] * self.n_b + y).ravel())
            weights.append((times_x[:, None] * times_y).ravel())
        keys, times = _summed(np.concatenate(keys), np.concatenate(weights))
        chunk = keys // self.n_pairs
        self.pairs, self.times = np.concatenate((self.pairs, keys - chunk * self.n_pairs)), np.concatenate((self.times, times))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.bincount(chunk, minlength=n))))
        self.number.update(zip(new, range(len(self.number), len(self.number) + n), strict=True))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Facts of each text (tokens of A, of B, groups, links), its groups in words, and its different linked pairs
        with their numbers: flat, and how many each text has."""
        if len(self.number) > MOST_CHUNKS or self.held > MOST_HELD:
            self._begin_anew()
        cut = [self.chunks(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.number))
        if new:
            self._learn(new)
        rows = [np.fromiter(map(self.number.__getitem__, c), np.int64, len(c)) for c in cut]
        n_chunks = np.array([len(r) for r in rows], np.int64)
        of, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), n_chunks)
        facts = np.stack([np.bincount(owner, self.facts[of, k], len(rows)).astype(np.int64) for k in range(5)], axis=1)
        good = facts[:, 4] == 0
        facts[~good] = 0
        listed = ["".join(map(self.listed.__getitem__, r.tolist()))[:-1] if g else "" for r, g in zip(rows, good.tolist(), strict=True)]
        # Chunks that a text repeats are counted before their pairs are fetched.
        each, times = _summed((owner * len(self.number) + of)[good[owner]], np.ones(int(n_chunks[good].sum()), np.int64))
        owner, of = np.divmod(each, max(1, len(self.number)))
        size = self.starts[of + 1] - self.starts[of]
        at = _ragged(self.starts[of], size)
        keys, times = _summed(np.repeat(owner, size) * self.n_pairs + self.pairs[at], np.repeat(times, size) * self.times[at])
        owner = keys // self.n_pairs
        return facts[:, :4], listed, keys - owner * self.n_pairs, times, np.bincount(owner, minlength=len(rows))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This process's aligner of two tokenizer files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", out: str = "alignment") -> DataFrame:
    """All columns of docs and a struct `alignment` (with underscores in front where docs has that name): n_a, n_b,
    n_groups, n_links; groups (`a1,a2|b1;a3|b2,b3`: ids of A and of B, in order); and of the different linked pairs of
    ids, a * size of B's vocabulary + b in `pairs`, ascending, and how often each occurs in `times`.

    A reads space + text, B text, to which it adds the space; names of special tokens in a text are plain text. A null
    or empty text, or one whose tokens' bytes differ from space + text (U+2581 in it, say), has no tokens: zeros, no
    groups, no pairs. Rows are independent, so repeated rows have equal results; there is no shuffle. A group is held
    as its different ids of A times those of B.
    """
    out = free_name(docs, out)
    at, names = docs.columns.index(text_col), [*docs.columns, out]
    inner = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    kind = "struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups: string, pairs: array<long>, times: array<long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for whole in batches:
            for batch in slices(whole, at):
                facts, listed, pairs, times, sizes = own.align([t or "" for t in batch.column(at).to_pylist()])
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, times)]
                cells = [*(pa.array(facts[:, k]) for k in range(4)), pa.array(listed, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(cells, inner)], names=names)

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(kind))]))


def link_counts(rows: DataFrame, size_b: int, pairs: str = "pairs") -> DataFrame:
    """(pair, a, b, n_docs, best): in how many rows each pair of ids is linked, and whether no pair of its A id is in
    more. Pairs are counted inside tasks first; the table has at most a row for each pair of ids of the vocabularies,
    and a window's group at most B's vocabulary. No rows: no pairs."""
    counted = rows.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = counted.select("pair", (F.col("pair") / size_b).cast("long").alias("a"), (F.col("pair") % size_b).alias("b"), "n_docs")
    return counted.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def add_link_sums(rows: DataFrame, counts: DataFrame, part_pairs: int = PART_PAIRS, best: str = "n_best", total: str = "count_sum") -> DataFrame:
    """rows (with `pairs` and `times`) and two sums over their links: how many are of a best pair, and of n_docs.

    counts is sent to the workers in parts of at most about part_pairs pairs, each in a pass over rows of its own; rows
    aren't shuffled. Several parts: what is summed so far is written between them."""
    spark = rows.sparkSession
    names = [*rows.columns, best, total]
    at_pairs, at_times = rows.columns.index("pairs"), rows.columns.index("times")
    parts = max(1, -(-counts.count() // part_pairs))

    def adding(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n_docs, is_best = shared.value
            for batch in batches:
                lists = batch.column(at_pairs)
                keys, times = lists.flatten().to_numpy(), batch.column(at_times).flatten().to_numpy()
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                place = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
                here = pair[place] == keys if len(pair) else np.zeros(len(keys), bool)
                place, times, owner = place[here], times[here], owner[here]
                new = [np.zeros(len(lists), np.int64) for _ in range(2)]
                np.add.at(new[0], owner, times * is_best[place])
                np.add.at(new[1], owner, times * n_docs[place])
                old = [batch.column(k).to_numpy() for k in (-2, -1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(a + b) for a, b in zip(old, new, strict=True))], names=names)

        return run

    summed = rows.withColumns({best: F.lit(0).cast("long"), total: F.lit(0).cast("long")})
    for part in range(parts):
        own = counts if parts == 1 else counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part)
        table = own.select("pair", "n_docs", "best").toArrow()
        columns = [table.column(c).to_numpy() for c in ("pair", "n_docs", "best")]
        order = np.argsort(columns[0])
        shared = spark.sparkContext.broadcast([c[order] for c in columns])
        summed = summed.mapInArrow(adding(shared), summed.schema)
        if part + 1 < parts:
            summed = materialise(summed, "links")
    return summed


def digest(docs: DataFrame, path_a: str, path_b: str, part_pairs: int = PART_PAIRS) -> DataFrame:
    """The result of the registered query: counts, sums over links and the groups' hash."""
    size_b = len(sentence_piece.Model(path_b).texts)
    found = align(docs.select("doc_id", "text"), path_a, path_b).select("doc_id", "alignment.*")
    hashed = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = materialise(found.withColumn("groups_sha256", hashed).drop("groups"), "aligned")
    counts = materialise(link_counts(rows, size_b), "counts")
    return add_link_sums(rows, counts, part_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
