"""SimHash near-duplicate groups, linked through an index of masked bit patterns in Gray order.

The index is a hierarchy of masked bit patterns. Fingerprints that differ in at most `bits` of 64 bits agree wholly
in two of `bits + 2` bands. Each pair of bands is a mask; the fingerprints that share the masked pattern are one upper
node, dealt over the cluster by its pattern. A node with more than NODE different fingerprints is replaced by nodes
below it, whose masks take in two of the bands of the remaining bits as well; after three such steps 8 bits are free,
so a node then holds at most 256. No node is cut short, and no link is lost.

In a node, fingerprints are sorted by Gray rank of their free bits, so that neighbours share most of them, and the
hierarchy goes on: FAN neighbours form a node, FAN of these the next one above, up to one root. Each node keeps the
bits that all below it share. The search descends from the root's pair with itself. At each level it adds, for a pair
of nodes, the differences in the bits that both have fixed now and hadn't before; a pair whose sum exceeds `bits` goes
with all that is below. What reaches the single fingerprints is linked. A node reports, for each linked fingerprint,
the least document of those it reaches inside the node; star steps join these over nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import free_name, materialise, slices, small_batches
from .components import components

NODE = 4096
FAN = 8
#: Pairs of nodes that are taken apart at once.
PAIRS = 1 << 14
#: Rows of one fingerprint from which on its component is sent to all executors: at most one in so many rows is.
HOT_ROWS = 100_000
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included (no word, or null: 0; few words: one shingle)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): each document's fingerprint as the long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _bands(free: int, count: int) -> list[int]:
    """The set bits of free in count masks of consecutive set bits, sizes as equal as can be."""
    places = [i for i in range(64) if free >> i & 1]
    cuts = [len(places) * k // count for k in range(count + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks_below(mask: int, bits: int) -> list[int]:
    """The masks that take in two more bands of the bits free in mask."""
    return [mask | a | b for a, b in combinations(_bands(~mask & (2**64 - 1), bits + 2), 2)]


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def _gray_rank(bits):
    """The rank of a column's bit pattern in the reflected Gray sequence: each bit xor all bits above it."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def _children(parents: DataFrame, bits: int, masks: list[int]) -> DataFrame:
    """Rows (mask, key, fp, rep) for all masks below those of parents."""
    below = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in masks_below(m, bits)]))])
    rows = parents.select(F.explode(below[F.col("mask")]).alias("mask"), "fp", "rep")
    return rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")


@dataclass(frozen=True)
class _Level:
    """The nodes of one level, in order: where their children start and end in the level below, and the bits that all
    below a node share (`fixed`) with their values (`pattern`)."""

    first: np.ndarray
    end: np.ndarray
    fixed: np.ndarray
    pattern: np.ndarray


def _hierarchy(group: np.ndarray, fp: np.ndarray) -> list[_Level]:
    """Levels from the fingerprints up, until each group has one node, its root."""
    n = len(fp)
    levels = [_Level(np.arange(n), np.arange(1, n + 1), np.full(n, ~np.uint64(0)), fp)]
    both = some = fp
    while len(group) > 1 and (group[1:] == group[:-1]).any():
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        inner = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        first = np.flatnonzero(inner % FAN == 0)
        both, some, group = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(some, first), group[first]
        levels.append(_Level(first, np.append(first[1:], len(inner)), ~(both ^ some), both))
    return levels


def _descend(levels: list[_Level], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different fingerprints within `bits`, found by adding differences from level to level."""
    roots = np.arange(len(levels[-1].first))
    waiting = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), np.uint64))]
    lefts, rights = [roots[:0]], [roots[:0]]
    while waiting:
        level, one, two, sums, counted = waiting.pop()
        if len(one) > PAIRS:
            waiting += [(level, *(x[at : at + PAIRS] for x in (one, two, sums, counted))) for at in range(0, len(one), PAIRS)]
            continue
        nodes = levels[level]
        fixed = nodes.fixed[one] & nodes.fixed[two]
        sums = sums + np.bitwise_count((nodes.pattern[one] ^ nodes.pattern[two]) & fixed & ~counted)
        near = sums <= bits
        one, two, sums, fixed = one[near], two[near], sums[near], fixed[near]
        if not level:
            other = one != two
            lefts.append(one[other])
            rights.append(two[other])
            continue
        # Each pair of children; of a node with itself, each once.
        n_one, n_two = nodes.end[one] - nodes.first[one], nodes.end[two] - nodes.first[two]
        times = n_one * n_two
        of = np.repeat(np.arange(len(one)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        a, b = nodes.first[one][of] + nth // n_two[of], nodes.first[two][of] + nth % n_two[of]
        once = (one[of] != two[of]) | (a <= b)
        waiting.append((level - 1, a[once], b[once], sums[of][once], fixed[of][once]))
    return np.concatenate(lefts), np.concatenate(rights)


def node_links(group: np.ndarray, fp: np.ndarray, rep: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, least rep reached) inside each node. group: ascending numbers; rows of a node in Gray order."""
    n = len(fp)
    a, b = _descend(_hierarchy(group, fp), bits)
    # label: the row of least rep reached; rows are compared by the rank of their rep.
    order = np.argsort(rep, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[order[label]]
        if np.array_equal(before, label):
            break
    moved = label != rank
    return rep[moved], rep[order[label[moved]]]


def _search(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 4

        def found(rows):
            mask, key, fp, rep = rows
            group = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
            u, v = node_links(group, fp.view(np.uint64), rep, bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            rows = [np.concatenate((r, c.to_numpy(zero_copy_only=False))) for r, c in zip(rest, batch.columns, strict=True)]
            n = len(rows[0])
            if not n:
                continue
            whole = int(np.flatnonzero(np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))))[-1])
            rest = [r[whole:] for r in rows]  # the last node may go on in the next batch
            if whole:
                yield found([r[:whole] for r in rows])
        if len(rest[0]):
            yield found(rest)

    return run


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(u, v): links that connect what pairs within `bits` connect. prints: (fp, rep), each fp once, rep not null."""
    level, masks = prints.select(F.lit(0).cast("long").alias("mask"), "fp", "rep"), [0]
    found = None
    while masks:
        rows = _children(level, bits, masks)
        size = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = materialise(rows.join(size, ["mask", "key"]), "nodes")
        small = rows.where(F.col("n") <= NODE)
        dealt = small.repartition("mask", "key").withColumn("gray", _gray_rank(F.col("fp").bitwiseAND(F.bitwise_not("mask"))))
        here = dealt.sortWithinPartitions("mask", "key", "gray").select("mask", "key", "fp", "rep").mapInArrow(_search(bits), "u long, v long")
        found = here if found is None else found.unionByName(here)
        level = rows.where(F.col("n") > NODE).select("mask", "fp", "rep")
        masks = [r[0] & (2**64 - 1) for r in level.select("mask").distinct().collect()]  # a few masks, not rows
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """(id, fp, component): component is the smallest id that links reach, the row's own included.

    Documents link if their fingerprints differ in at most `bits` bits. Null and empty texts have fingerprint 0
    and link like any other. Rows with a null id get the component of their fingerprint, or null if no row with
    an id has it; they connect nothing. Rows that repeat an id are separate rows of one document.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, width), "prints")
    held = rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    prints = materialise(held, "distinct")
    roots = components(links(prints.select("fp", "rep"), bits))
    known = materialise(prints.join(roots, prints["rep"] == roots["u"], "left").select("fp", F.coalesce("v", "rep").alias("component"), "n"), "roots")
    hot = F.broadcast(known.where(F.col("n") > HOT_ROWS).select("fp", "component"))
    rest = rows.join(hot.select("fp"), "fp", "left_anti").join(known, "fp", "left")
    return rows.join(hot, "fp").unionByName(rest.select("id", "fp", "component")).select("id", "fp", "component")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """The result of the registered query."""
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2, similarity: float | None = None) -> DataFrame:
    """All columns of docs for one row of each group: that of its smallest id (of rows with that id, the least as JSON).

    Of rows with a null id one for each fingerprint that no row with an id has stays (the least as JSON). With a similarity, documents are compared by their sets of shingles of five words: what the index
    links by the fingerprints of these sets, and, as two bits are few for such pairs, what agrees in a band of minima, is
    compared by whole sets (near_copies.keep_first).
    """
    if similarity is not None:
        if (width, similarity) != (near_copies.WIDTH, near_copies.SIMILARITY):
            raise ValueError("similarities are compared at five words and 0.8")
        return near_copies.keep_first(docs, id_col, text_col, lambda prints: components(links(prints, bits)).select(F.col("u").alias("rep"), F.col("v").alias("component")))
    found = near_duplicates(docs, id_col, text_col, width, bits)
    ids = found.where("id = component").select(F.col("id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(ids, id_col, "left_semi").select(docs.columns)
    row = free_name(docs, "row")
    rows = named.select(id_col, F.struct(*docs.columns).alias(row))
    first = rows.groupBy(id_col).agg(F.min_by(row, F.to_json(row)).alias(row)).select(f"{row}.*")
    nameless = docs.where(F.col(id_col).isNull()).select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("n"), F.col(text_col).alias("text"))
    nameless = materialise(nameless, "nameless")  # so numbers stay
    alone = fingerprints(nameless, "n", "text", width).join(found.where("id IS NOT NULL").select("fp").distinct(), "fp", "left_anti")
    rest = nameless.join(alone.select(F.col("id").alias("n"), "fp"), "n").groupBy("fp").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return first.unionByName(rest.select("row.*"))
