"""Removal of byte strings that repeat across documents, by suffix arrays over shards.

A byte goes if it is covered by a `span`-byte string that also starts in a document with a smaller id. Three
passes over the documents, each dealt into the same parts by a hash of the whole row:

1. Each `span`-byte string is filed under the least hash of its `gram`-byte substrings. Strings in a row with
   the same least hash form one run. A part reports the hashes it has, once each; a shard of hashes answers
   which of them occur in more than one document. Runs of other hashes can't repeat and are left out. Where the
   different contents under one hash exceed HOT_BYTES, as around a very common word, each of its strings is filed
   under a hash of its own instead, so that they are dealt over all shards.
2. The bytes of the remaining runs go to the shard of their hash, each different content once per part, with
   the smallest document id that has it. Equal strings have equal least hashes, so they meet in one shard.
   The shard sorts the suffixes of its different contents by induced sorting, computes permuted common
   prefixes, and so finds for every string the smallest document that has it.
3. Each part marks its documents' strings that a smaller document has, and cuts the marked bytes out.

No message grows with the number of documents that share a string: a part sends a hash or content once, however
many of its rows have it. Nothing is collected on the driver.

Null text is empty. Rows with a null id are returned whole and take no part in others' matches. Rows that
repeat an id do not cut each other. Texts shorter than `span` are returned whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches
from .suffix_sort import common_prefixes, suffix_array

#: Bytes of texts in a part (as many parts as shuffle partitions at least) and for each shard.
PART_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
LEAST_SHARDS = 32
#: There is a message for each part and shard. Beyond ROOT_BYTES of texts, parts and shards grow with the root of the
#: texts' bytes, so that messages grow as the texts do, up to MOST_TIMES the bytes above, which workers have memory for.
ROOT_BYTES = 1 << 30
MOST_TIMES = 2
#: Bytes of different contents under one hash beyond which it is split.
HOT_BYTES = 256 << 10
#: Bytes of the substrings whose hashes file strings; results don't depend on it. Of 16 bytes, unrelated texts share so
#: many that the suffix arrays grow faster than the corpus; longer ones leave more, shorter runs.
GRAM = 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC4CEB9FE1A85EC53)
_BIT = np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram-byte substring, made from hashes of halves."""
    level = (data.astype(np.uint64) + _BIT) * _MIX
    whole, covered, width, rest = None, 0, 1, gram
    while rest:
        if rest & 1:
            if whole is None:
                whole, covered = level, width
            else:
                tail = level[covered:]
                whole = whole[: len(tail)] * _ODD + tail
                whole ^= whole >> np.uint64(31)
                covered += width
        rest >>= 1
        if rest:
            level = level[:-width] * _ODD + level[width:]
            level ^= level >> np.uint64(31)
            width *= 2
    whole = whole * _MIX
    return whole ^ (whole >> np.uint64(33))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def runs_of(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least hash, first start and number of starts of each run of span-byte strings under one least hash, and a
    number that tells the contents of its runs apart well enough to estimate their size."""
    grams = gram_hashes(data, gram)
    least = sliding_min(grams, span - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.append(first, len(least)))
    return least[first] | _BIT, first, count, grams[first] * _ODD + grams[first + count - 1 + span - gram]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def pack40(values: np.ndarray) -> bytes:
    """The low 40 bits of each value. Inside a shard, whose size is bounded, they tell hashes apart well enough:
    two that are taken for one only let some runs through to the suffix arrays, which decide."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8")[:, 0]


def pack_rows(*rows: np.ndarray) -> bytes:
    """Rows of integers of one length, as compressed byte planes of the differences along each row."""
    steps = np.diff(np.stack(rows).astype("<i8"), axis=1, prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_rows(data: bytes, rows: int = 3) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(flat.T).view("<i8").reshape(rows, -1), axis=1)


def _filed(hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """One number for a hash's shard and its low 40 bits."""
    return shard.astype(np.uint64) << np.uint64(40) | hashes & np.uint64((1 << 40) - 1)


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _texts(table: pa.Table, id_col: str, text_col: str) -> tuple[list[int | None], list[bytes]]:
    ids = table.column(id_col).to_pylist()
    texts = table.column(text_col).cast(pa.large_binary()).to_pylist()
    return ids, [t or b"" for t in texts]


def _order(ids: list, texts: list[bytes]) -> list[int]:
    """An order of a part's rows that is the same in each pass."""
    return sorted((i for i, x in enumerate(ids) if x is not None), key=lambda i: (ids[i], texts[i]))


def _part_runs(ids, texts, span, gram):
    """Runs of all rows of a part that can match: row, hash, start, count, sign, in order of row and start."""
    rows, found = [], []
    for row in _order(ids, texts):
        if len(texts[row]) >= span:
            found.append(runs_of(np.frombuffer(texts[row], np.uint8), span, gram))
            rows.append(np.full(len(found[-1][0]), row, np.int64))
    if not rows:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    return np.concatenate(rows), *(np.concatenate(x) for x in zip(*found, strict=True))


def _strings_of(texts, rows, starts, counts, span):
    """Runs taken apart into their strings: row, hash of the whole string, start."""
    of, at = np.repeat(rows, counts), np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    hashes = np.empty(len(of), np.uint64)
    for row, own in _split(of):  # rows stand together
        hashes[own] = gram_hashes(np.frombuffer(texts[row], np.uint8), span)[at[own]]
    return of, hashes | _BIT, at


def _split(keys: np.ndarray):
    """(key, slice) for each run of equal sorted keys."""
    if len(keys):
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(keys[a]), slice(a, b)


REPORT = "shard bigint, part bigint, data binary, sizes binary"
REPLY = "part bigint, kind int, data binary, more binary"
CONTENT = "shard bigint, part bigint, data binary, more binary"


def _report(shards, span, gram, id_col, text_col):
    """A part's hashes for each shard, and the sizes of those with several contents (place among them, bytes)."""

    def run(key, table):
        ids, texts = _texts(table, id_col, text_col)
        rows, hashes, _, counts, signs = _part_runs(ids, texts, span, gram)
        order = np.argsort(hashes, kind="stable")
        hashes, rows, counts, signs = hashes[order], rows[order], counts[order], signs[order]
        out = {"shard": [], "part": [], "data": [], "sizes": []}
        if len(hashes):
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            last = np.append(first[1:], len(hashes)) - 1
            # The lowest bit of a hash, always set, is cleared where two rows of the part have it.
            told = hashes[first] - (rows[first] != rows[last]).astype(np.uint64)
            size = np.zeros(len(first), np.int64)
            place = np.repeat(np.arange(len(first)), last - first + 1)
            some = np.flatnonzero(np.repeat(last > first, last - first + 1))  # runs that share their hash
            if len(some):
                some = some[np.lexsort((signs[some], place[some]))]
                at, sign = place[some], signs[some]
                new = np.concatenate(([True], (at[1:] != at[:-1]) | (sign[1:] != sign[:-1])))
                size = np.bincount(at[new], (counts[some] + span - 1)[new], len(first)).astype(np.int64)
            shard = shard_of(told | _BIT, shards)
            by = np.argsort(shard, kind="stable")
            for s, at in _split(shard[by]):
                own = by[at]
                several = np.flatnonzero(size[own] >= 2 * span)
                out["shard"].append(s)
                out["part"].append(key[0].as_py())
                out["data"].append(pack40(told[own]))
                out["sizes"].append(pack_rows(several, size[own][several]) if len(several) else b"")
        return pa.table(out, schema=pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("data", pa.binary()), ("sizes", pa.binary())]))

    return run


def _answer(span, hot):
    """To each part, which of its hashes occur in more than one document (kind 0), and which of these are hot (3)."""

    def run(table):
        parts, shards, told, listed = (table.column(c).to_pylist() for c in ("part", "shard", "data", "sizes"))
        told = [unpack40(b) for b in told]
        sizes = [np.full(len(x), 2 * span, np.int64) for x in told]  # at most, for a hash with one content
        for size, b in zip(sizes, listed, strict=True):
            if b:
                at, bytes_ = unpack_rows(b, 2)
                size[at] = bytes_
        from_row = np.repeat(np.arange(len(told)), [len(x) for x in told])
        told, sizes = np.concatenate(told), np.concatenate(sizes)
        hashes = told | _BIT
        order = np.argsort(hashes, kind="stable")
        hashes, many, from_row, sizes = hashes[order], (told[order] & _BIT) == 0, from_row[order], sizes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        n = np.diff(np.append(first, len(hashes)))
        shared = np.repeat((n > 1) | np.logical_or.reduceat(many, first), n)
        split = np.repeat(np.add.reduceat(sizes, first) > hot, n)
        out = {"part": [], "kind": [], "data": [], "more": []}
        for kind, wanted in ((0, shared), (3, shared & split)):
            some, to = hashes[wanted], from_row[wanted]
            by = np.argsort(to, kind="stable")
            for r, at in _split(to[by]):
                out["part"].append(parts[r])
                out["kind"].append(kind)
                out["data"].append(pack40(some[by[at]]))
                out["more"].append(np.int64(shards[r]).tobytes())
        return pa.table(out, schema=_reply_schema())

    return run


def _reply_schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])


def _contents(shards, span, gram, id_col, text_col):
    """Contents for a shard (data) with minimal ids, numbers and lengths (more); and, under the negative shard
    -1 - part, where they occur, for the part itself."""

    def run(key, table, replies):
        out = {"shard": [], "part": [], "data": [], "more": []}
        schema = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])
        told = list(zip(*(replies.column(c).to_pylist() for c in ("kind", "data", "more")), strict=True))
        if not table.num_rows or not told:
            return pa.table(out, schema=schema)
        part = key[0].as_py()
        none = [np.empty(0, np.uint64)]
        known, hot = (np.sort(np.concatenate(none + [_filed(unpack40(b), np.frombuffer(h, np.int64)) for k, b, h in told if k == kind])) for kind in (0, 3))
        ids, texts = _texts(table, id_col, text_col)
        rows, hashes, starts, counts, _ = _part_runs(ids, texts, span, gram)
        filed = _filed(hashes, shard_of(hashes, shards))
        live = _among(known, filed)
        rows, hashes, starts, counts, filed = rows[live], hashes[live], starts[live], counts[live], filed[live]
        apart = _among(hot, filed)
        del known, filed
        if apart.any():
            of, own, at = _strings_of(texts, rows[apart], starts[apart], counts[apart], span)
            rows, hashes, starts, counts = (np.concatenate((x[~apart], y)) for x, y in ((rows, of), (hashes, own), (starts, at), (counts, np.ones(len(of), np.int64))))
            rank = np.empty(len(ids), np.int64)
            rank[_order(ids, texts)] = np.arange(sum(x is not None for x in ids))
            by = np.lexsort((starts, rank[rows]))
            rows, hashes, starts, counts = rows[by], hashes[by], starts[by], counts[by]
        number: dict[bytes, int] = {}
        least: list[int] = []
        shard: list[int] = []
        which = np.empty(len(rows), np.int64)
        for i, (row, start, count, to) in enumerate(zip(rows.tolist(), starts.tolist(), counts.tolist(), shard_of(hashes, shards).tolist(), strict=True)):
            content = texts[row][start : start + count + span - 1]
            n = number.setdefault(content, len(least))
            if n == len(least):
                least.append(ids[row])  # rows come in order of id
                shard.append(to)
            which[i] = n
        contents, pack = list(number), zstandard.ZstdCompressor(level=1)
        shard_a, least_a = np.array(shard, np.int64), np.array(least, np.int64)
        lengths = np.array([len(c) for c in contents], np.int64)
        by = np.argsort(shard_a, kind="stable")
        for s, cut in _split(shard_a[by]):
            own = by[cut]
            out["shard"].append(s)
            out["part"].append(part)
            out["data"].append(pack.compress(b"".join([contents[i] for i in own.tolist()])))
            out["more"].append(pack_rows(least_a[own], own, lengths[own]))
        if len(rows):
            out["shard"].append(-1 - part)
            out["part"].append(part)
            out["data"].append(pack_rows(rows_rank(ids, texts, rows), starts, which, counts))
            out["more"].append(b"")
        return pa.table(out, schema=schema)

    return run


def rows_rank(ids, texts, rows: np.ndarray) -> np.ndarray:
    """Rows by their rank in _order, which, unlike row numbers, is the same in each pass."""
    rank = np.full(len(ids), -1, np.int64)
    order = _order(ids, texts)
    rank[order] = np.arange(len(order))
    return rank[rows]


def smallest_holders(contents: list[bytes], least: np.ndarray, span: int) -> np.ndarray:
    """For each byte of the contents, one after the other each with a 0 behind it, the least id of a content that
    has the span-byte string starting there (the largest integer where none starts)."""
    lengths = np.array([len(c) for c in contents], np.int64)
    joined = np.zeros(int(lengths.sum()) + len(lengths) + 1, np.uint16)
    stops = np.cumsum(lengths + 1) - 1
    body = np.ones(len(joined) - 1, bool)
    body[stops] = False
    data = np.frombuffer(b"".join(contents), np.uint8)
    # The bytes that occur, from 2 up in their order.
    joined[:-1][body] = (np.cumsum(np.bincount(data, minlength=256) > 0).astype(np.uint16) + 1)[data]
    joined[:-1][~body] = 1
    order = suffix_array(joined)
    prefix = common_prefixes(joined, order)
    holder = np.full(len(joined), np.iinfo(np.int64).max)
    whole = np.repeat(least, lengths + 1)
    room = np.repeat(stops, lengths + 1) - np.arange(len(joined) - 1)
    starts = np.flatnonzero(room >= span)
    holder[starts] = whole[starts]
    first = np.flatnonzero(prefix[order] < span)
    ordered = holder[order]
    lowest = np.repeat(np.minimum.reduceat(ordered, first), np.diff(np.append(first, len(order))))
    result = np.empty_like(holder)
    result[order] = lowest
    result[holder == np.iinfo(np.int64).max] = np.iinfo(np.int64).max
    return result


def _in_company(contents: list[bytes], span: int, gram: int) -> np.ndarray:
    """Which contents may share a string with another one: a shared string has its least gram at a place of both, and
    at least half of the rest of its bytes stands on one side of that; so do the grams `side` bytes away."""
    lengths = np.array([len(c) for c in contents], np.int64)
    stops = np.cumsum(lengths)
    begins = stops - lengths
    hashes = gram_hashes(np.frombuffer(b"".join(contents), np.uint8), gram)
    # The least hash is that of any of a content's strings, so of its first.
    least = np.repeat(hashes[begins[:, None] + np.arange(span - gram + 1)].min(axis=1), lengths)[: len(hashes)]
    places = np.flatnonzero(hashes == least)
    owner = np.searchsorted(stops, places, side="right")
    side, found = (span - gram + 1) // 2, np.zeros(len(contents), bool)
    for away in (-side, side):
        inside = (places + away >= begins[owner]) & (places + away + gram <= stops[owner]) & (places + gram <= stops[owner])
        at, own = places[inside], owner[inside]
        _, key, count = np.unique(hashes[at] * _ODD + hashes[at + away], return_inverse=True, return_counts=True)
        found[own[count[key] > 1]] = True
    return found


def _holders(span, gram):
    """Per part and content: (number, first start, least id) wherever the least id changes along a content (kind 2).
    What a part tells itself is handed on (kind 1)."""

    def run(key, table):
        parts = table.column("part").to_pylist()
        if key[0].as_py() < 0:
            n = len(parts)
            return pa.table({"part": parts, "kind": [1] * n, "data": table.column("data"), "more": [b""] * n}, schema=_reply_schema())
        blobs, heads = table.column("data").to_pylist(), table.column("more").to_pylist()
        own: dict[bytes, int] = {}
        least: list[int] = []
        sent, kind_of, number = [], [], []
        for r, (blob, head) in enumerate(zip(blobs, heads, strict=True)):
            low, n, length = unpack_rows(head)
            stop = np.cumsum(length)
            blob = zstandard.decompress(blob)
            for a, b, x in zip((stop - length).tolist(), stop.tolist(), low.tolist(), strict=True):
                c = blob[a:b]
                g = own.setdefault(c, len(least))
                if g == len(least):
                    least.append(x)
                elif x < least[g]:
                    least[g] = x
                kind_of.append(g)
            sent.append(np.full(len(n), r))
            number.append(n)
        contents, low = list(own), np.array(least, np.int64)
        # Most contents share no string with another one of the shard: these hold all of their own.
        some = np.flatnonzero(_in_company(contents, span, gram))
        of, at, who = np.arange(len(contents)), np.zeros(len(contents), np.int64), low.copy()
        if len(some):
            shared = [contents[i] for i in some.tolist()]
            holder = smallest_holders(shared, low[some], span)[:-1]
            lengths = np.array([len(c) for c in shared], np.int64)
            begin = np.cumsum(lengths + 1) - lengths - 1
            # Starts along each content at which the least id changes.
            is_start = holder != np.iinfo(np.int64).max
            change = np.zeros(len(holder), bool)
            change[begin] = True
            change[1:] |= (holder[1:] != holder[:-1]) & is_start[1:]
            places = np.flatnonzero(change & is_start)
            owner = np.searchsorted(begin, places, side="right") - 1
            alone = np.ones(len(contents), bool)
            alone[some] = False
            of, at, who = np.concatenate((of[alone], some[owner])), np.concatenate((at[alone], places - begin[owner])), np.concatenate((who[alone], holder[places]))
            by = np.argsort(of, kind="stable")
            of, at, who = of[by], at[by], who[by]
        count = np.bincount(of, minlength=len(contents))
        first = np.cumsum(count) - count
        kind_of, sent, number = np.array(kind_of, np.int64), np.concatenate(sent), np.concatenate(number)
        n = count[kind_of]
        item = np.repeat(first[kind_of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = np.repeat(sent, n)
        triples = np.stack((np.repeat(number, n), at[item], who[item]))
        out = {"part": [], "kind": [], "data": [], "more": []}
        for r, cut in _split(rows):
            out["part"].append(parts[r])
            out["kind"].append(2)
            out["data"].append(pack_rows(*triples[:, cut]))
            out["more"].append(b"")
        return pa.table(out, schema=_reply_schema())

    return run


def marked_spans(rank, starts, which, counts, triples, id_of_rank, span):
    """Marked byte ranges (rank, start, end), merged, from occurrences and the shards' answers."""
    number, offset, holder = triples
    order = np.lexsort((offset, number))
    number, offset, holder = number[order], offset[order], holder[order]
    first = np.searchsorted(number, which)
    last = np.searchsorted(number, which, side="right")
    n = last - first
    occurrence = np.repeat(np.arange(len(which)), n)
    item = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    begin = starts[occurrence] + offset[item]
    follows = np.append(number[1:] == number[:-1], False)
    until = np.where(follows[item], starts[occurrence] + np.append(offset[1:], 0)[item], (starts + counts)[occurrence])
    hit = holder[item] < id_of_rank[rank[occurrence]]
    r, a, b = rank[occurrence][hit], begin[hit], until[hit] + span - 1
    if not len(r):
        return r, a, b
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (a[1:] > b[:-1])))
    firsts = np.flatnonzero(new)
    return r[firsts], a[firsts], b[np.append(firsts[1:], len(r)) - 1]


def _cut(span, id_col, text_col, out, schema_names):
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])

    def run(key, table, messages):
        ids, texts = _texts(table, id_col, text_col)
        spans: dict[int, list[tuple[int, int]]] = {}
        kinds, blobs = messages.column("kind").to_pylist(), messages.column("data").to_pylist()
        where = [unpack_rows(b, 4) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        told = [unpack_rows(b) for k, b in zip(kinds, blobs, strict=True) if k == 2]
        if where and told and table.num_rows:
            rank, starts, which, counts = where[0]
            order = _order(ids, texts)
            id_of_rank = np.array([ids[i] for i in order], np.int64)
            for r, a, b in zip(*(x.tolist() for x in marked_spans(rank, starts, which, counts, np.concatenate(told, axis=1), id_of_rank, span)), strict=True):
                spans.setdefault(order[r], []).append((a, b))
        found = []
        for i, text in enumerate(texts):
            own = spans.get(i, [])
            kept, at = [], 0
            for a, b in own:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            found.append({"n_bytes": len(text), "n_removed": sum(b - a for a, b in own), "spans": [{"start": a, "stop": b} for a, b in own], "kept": b"".join(kept)})
        return table.select(schema_names).append_column(out, pa.array(found, kind))

    return run


def parts_and_shards(text_bytes: int, floor: int) -> tuple[int, int]:
    """Numbers of parts, floor at least, and of shards for so many bytes of texts."""
    times = min(MOST_TIMES, max(1.0, math.sqrt(text_bytes / ROOT_BYTES)))
    return max(floor, math.ceil(text_bytes / (PART_BYTES * times))), max(LEAST_SHARDS, math.ceil(text_bytes / (SHARD_BYTES * times)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, gram: int | None = None, out: str = "repeats", hot: int = HOT_BYTES) -> DataFrame:
    """All rows and columns of docs, and a struct `out`: n_bytes, n_removed, spans (array of start, stop; ascending,
    not touching) and kept (the remaining bytes, which may split a character). gram: GRAM, or span if that is
    shorter. hot: see HOT_BYTES."""
    gram = min(GRAM, span) if gram is None else gram
    if not 1 <= gram <= span:
        raise ValueError("gram must be from 1 to span")
    docs = small_batches(docs)
    # Files' bytes say little about texts: other columns count in them, and copies are compressed.
    text_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts, shards = parts_and_shards(text_bytes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part, out = free_name(docs, "part"), free_name(docs, out)
    # One shuffle of the documents serves all three passes.
    dealt = docs.withColumn(part, F.pmod(F.xxhash64(id_col, text_col), F.lit(parts))).groupBy(part)
    reports = dealt.applyInArrow(_report(shards, span, gram, id_col, text_col), REPORT)
    replies = reports.groupBy("shard").applyInArrow(_answer(span, hot), REPLY)
    messages = dealt.cogroup(replies.groupBy("part")).applyInArrow(_contents(shards, span, gram, id_col, text_col), CONTENT)
    told = messages.groupBy("shard").applyInArrow(_holders(span, gram), REPLY)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StructType.fromDDL("n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"))])
    return dealt.cogroup(told.groupBy("part")).applyInArrow(_cut(span, id_col, text_col, out, docs.columns), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query: sizes and a hash of what stays of each document."""
    r = remove_repeats(docs.select("doc_id", "text"))
    return r.select("doc_id", "repeats.n_bytes", "repeats.n_removed", F.size("repeats.spans").cast("long").alias("n_spans"), F.sha2("repeats.kept", 256).alias("kept_sha256"))
