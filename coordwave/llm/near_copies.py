"""Near copies by exact Jaccard similarity of word shingles, with candidates from banded MinHash.

Exact copies are one content each. Contents that agree in one of BANDS bands of ROWS minima meet in a bucket: of
pairs with a similarity of 0.8, 1 - (1 - 0.8 ** 6) ** 30 = 99.99 % do. So do contents that an index of fingerprints
links, where it is given. In each round the first contents of a bucket
are its centres: one at first, by which most copies go; then 8, and four times as many each round up to FAN, as what
is left must be told apart. A content whose similarity to an earlier centre, counted over whole sets of
shingles, is at least the threshold goes. What is left after a bucket's centres meets again in the next round, until
no bucket has two. So no two contents that stay and meet in a bucket are similar, and each that goes is similar to
an earlier one. The first round makes a row for each different content and centre that meet. Later rounds make none:
centres and parts of their bucket meet with their sets in one task, which tells what goes.

Texts stay where they are: hashes, bands and, of contents that have a candidate, sets of shingles are moved. Lists
that mark rows are sent to all executors up to BROADCAST_ROWS rows, which are counted first, and joined beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, slices, small_batches

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 6
FAN = 512
#: Rows (40 bytes each) of a list that is sent to all executors.
BROADCAST_ROWS = 100_000
#: Pairs of one centre that a task compares, and contents of a bucket that a task holds; those beyond are dealt.
CENTRE_PAIRS = 1000
PART = 1000
_BLOCK = 1 << 10
_draw = np.random.default_rng(20261126)
_FACTOR = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the different runs of `width` words in lower case (fewer words, or none: one shingle of all)."""
    words = (text or "").encode().lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of hashes: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def buckets(hashes: np.ndarray) -> list[int]:
    """The bucket of each band of a set of shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        mixed = hashes[at : at + _BLOCK, None] * _FACTOR + _ADD
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            found = np.array([buckets(s) for s in sets], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(found))
            prints = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), lists, prints], ["id", "content", "n", "buckets", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            found = [shingles(t.as_py()).astype(np.uint32).view(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["k", "shingles"])


def _small(rows: DataFrame) -> DataFrame:
    """rows (a materialised table), marked to be sent to all executors where there are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The contents of pairs (k, centre) that are at least SIMILARITY like their centre. A centre with very many
    pairs is dealt over tasks, with its set."""
    parts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / CENTRE_PAIRS).alias("parts"))
    dealt = pairs.join(parts, "centre").withColumn("salt", F.pmod(F.xxhash64("k"), F.col("parts"))).drop("parts")
    two = sets.join(parts, F.col("k") == F.col("centre")).select("centre", F.col("shingles").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    one = sets.select("k", F.col("shingles").alias("a"))
    both = F.size(F.array_intersect("a", "b"))
    found = dealt.join(two, ["centre", "salt"]).join(one, "k").where(both >= SIMILARITY * (F.size("a") + F.size("b") - both))
    return materialise(found.select("k").distinct(), "similar")


def _crowded(met: DataFrame) -> DataFrame:
    """The rows of buckets that have two contents at least, with the bucket's first place and their number."""
    size = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.min("place").alias("first")).where("many > 1")
    return materialise(met.join(size, "bucket"), "buckets")


def _tell(key, members: pa.Table, centres: pa.Table) -> pa.Table:
    """The members of a part of a bucket that are like a centre before them."""

    def read(rows, place, shingles):
        places = rows.column(place).to_pylist()
        place = [np.array([x[n] or 0 for x in places], np.int64) for n in ("last", "id", "k")]
        lists = rows.column(shingles).combine_chunks()
        return place, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)

    gone = np.zeros(members.num_rows, bool)
    if members.num_rows and centres.num_rows:
        (last, ids, k), size, flat = read(members, "place", "shingles")
        (c_last, c_ids, c_k), c_size, c_flat = read(centres, "centre", "own")
        starts = np.cumsum(size) - size
        known, at = np.unique(flat, return_inverse=True)
        held = np.zeros(len(known) + 1, bool)
        ends = np.cumsum(c_size)
        for c in range(len(c_k)):
            own = c_flat[ends[c] - c_size[c] : ends[c]]
            place = np.searchsorted(known, own)
            place = np.where(known[np.minimum(place, len(known) - 1)] == own, place, len(known))
            held[place] = True
            both = np.add.reduceat(held[at].astype(np.int64), starts)
            held[place] = False
            later = (last > c_last[c]) | (last == c_last[c]) & ((ids > c_ids[c]) | (ids == c_ids[c]) & (k > c_k[c]))
            gone |= later & (both >= SIMILARITY * (size + c_size[c] - both))
        return pa.table({"k": k[gone]})
    return pa.table({"k": np.empty(0, np.int64)})


def _gone_by_parts(left: DataFrame, centres: DataFrame, sets: DataFrame) -> DataFrame:
    """(k) of the contents in `left` that are like a centre of their bucket before them. A large bucket is dealt in parts."""
    parts = F.ceil(F.col("many") / PART)
    one, two = sets.select(F.col("k").alias("of"), "shingles"), sets.select(F.col("k").alias("whose"), F.col("shingles").alias("own"))
    members = left.select("bucket", "place", F.pmod(F.xxhash64("place.k"), parts).alias("part")).join(one, F.col("place.k") == F.col("of")).drop("of")
    dealt = centres.select(F.col("bucket").alias("of_bucket"), "centre", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("of_part"))
    heads = dealt.join(two, F.col("centre.k") == F.col("whose")).drop("whose")
    told = members.groupBy("bucket", "part").cogroup(heads.groupBy("of_bucket", "of_part")).applyInArrow(_tell, "k long")
    return materialise(told, "similar").distinct()


def _pairs(met: DataFrame) -> DataFrame:
    """(k, centre) of contents and earlier centres whose sets aren't too different in size to be similar."""
    a, b = F.col("place.n"), F.col("centre.n")
    fit = met.where((F.col("centre") < F.col("place")) & (F.least(a, b) >= SIMILARITY * F.greatest(a, b)))
    return materialise(fit.select(F.col("place.k").alias("k"), F.col("centre.k").alias("centre")).distinct(), "pairs")


def _gone(contents: DataFrame, rows: DataFrame) -> DataFrame:
    """(k) of the contents that are like an earlier one. contents: (k, id, content, n, buckets); rows: (id, content, text)."""
    place = F.struct(F.col("id").isNull().alias("last"), "id", "k", "n").alias("place")
    without = lambda met, out: met.join(_small(out.select(F.col("k").alias("out"))), F.col("place.k") == F.col("out"), "left_anti")
    left = _crowded(contents.select(F.explode("buckets").alias("bucket"), place))
    pairs = _pairs(left.select("place", F.col("first").alias("centre")))
    gone = _similar(pairs, _sets_of(pairs.select("k").union(pairs.select("centre")).distinct(), contents, rows))
    left = _crowded(without(left.where("place > first").select("bucket", "place"), gone))
    if left.isEmpty():
        return gone
    sets = _sets_of(left.select("place.k").distinct(), contents, rows)
    nth, fan = F.row_number().over(Window.partitionBy("bucket").orderBy("place")), 8
    while not left.isEmpty():
        centres = left.select("bucket", "place", "many", nth.alias("nth")).where(F.col("nth") <= fan)
        centres = materialise(centres.select("bucket", "many", F.col("place").alias("centre")), "centres")
        new = _gone_by_parts(left, centres, sets)
        gone = gone.unionByName(new)
        last = centres.groupBy("bucket").agg(F.max("centre").alias("centre"))
        left = _crowded(without(left.join(last, "bucket").where("place > centre").select("bucket", "place"), new))
        fan = min(4 * fan, FAN)
    return gone


def _in_groups(contents: DataFrame, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """contents with one more bucket for those whose fingerprint the index has linked to another, or that share theirs."""
    prints = materialise(contents.groupBy("fp").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("many")), "distinct")
    linked = groups(prints.select("fp", "rep")).select(F.col("rep").alias("u"), "component")
    own = prints.join(linked, F.col("rep") == F.col("u"), "left").select("fp", "many", F.coalesce("component", "rep").alias("component"))
    whole = own.groupBy("component").agg(F.sum("many").alias("size"))
    of = materialise(own.join(whole.where("size > 1"), "component").select(F.col("fp").alias("same_fp"), F.xxhash64(F.lit("simhash"), "component").alias("group")), "groups")
    met = contents.join(_small(of), F.col("fp") == F.col("same_fp"), "left")
    found = F.when(F.col("group").isNull(), F.col("buckets")).otherwise(F.concat("buckets", F.array("group")))
    return materialise(met.withColumn("buckets", found).drop("same_fp", "group"), "contents")


def _sets_of(wanted: DataFrame, contents: DataFrame, rows: DataFrame) -> DataFrame:
    """(k, shingles) of the wanted contents (k), each made from one row that has it."""
    keys = materialise(contents.join(wanted, "k", "left_semi").select("k", F.col("id").alias("own"), F.col("content").alias("same")), "wanted")
    texts = rows.join(_small(keys), (F.col("content") == F.col("same")) & F.col("id").eqNullSafe(F.col("own"))).select("k", "text")
    made = texts.mapInArrow(_sets, "k long, shingles array<int>")
    return materialise(made, "sets").dropDuplicates(["k"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All columns of docs for one row of each content that stays: that of its smallest id (of rows that repeat this
    id, the least as JSON). Contents come in order of their smallest id.

    Null and empty texts are one content. Contents that only rows with a null id have come last, and one such row of
    each that stays is kept. Rows that repeat an id with different texts are different documents.

    groups: from fingerprints (fp, rep) of contents, each fp once, to (rep, component) of those that an index links; what it
    links are candidates as well.
    """
    docs = small_batches(docs)
    content = free_name(docs, "content")
    marked = docs.withColumn(content, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    rows = marked.select(F.col(id_col).cast("long").alias("id"), F.col(content).alias("content"), F.col(text_col).alias("text"))
    signed = materialise(rows.mapInArrow(_in_buckets, "id long, content binary, n long, buckets array<long>, fp long"), "signed")
    held = materialise(signed.groupBy("content", "id").agg(F.count(F.lit(1)).alias("times")), "held")
    first = held.groupBy("content").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "times")).alias("f"))
    about = signed.groupBy("content").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("fp").alias("fp"))
    contents = first.select("content", "f.id", "f.times").join(about, "content").withColumn("k", F.monotonically_increasing_id())
    contents = materialise(contents, "contents")
    if groups is not None:
        contents = _in_groups(contents, groups)
    gone = _gone(contents, rows)
    # Rows that don't stay as they are: those of contents that go, of later ids, and repeats of one row.
    stay = contents.join(gone.distinct(), "k", "left_anti").select("content", F.col("id").alias("own"), F.col("times").alias("n"))
    fate = held.join(stay, "content", "left").withColumn("one_of", F.col("n").isNotNull() & F.col("id").eqNullSafe(F.col("own")))
    fate = materialise(fate.where(~F.col("one_of") | (F.col("n") > 1)).select(F.col("content").alias("same"), F.col("id").alias("own"), "one_of"), "fate")
    named = fate.toDF(*(free_name(marked, c) for c in fate.columns))
    same, own, one_of = named.columns
    met = marked.join(_small(named), (F.col(content) == F.col(same)) & F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left")
    kept = met.where(F.col(one_of).isNull()).select(docs.columns)
    row = free_name(marked, "row")
    several = met.where(F.col(one_of)).select(content, F.struct(*docs.columns).alias(row)).groupBy(content).agg(F.min_by(row, F.to_json(row)).alias(row))
    return kept.unionByName(several.select(f"{row}.*"))
