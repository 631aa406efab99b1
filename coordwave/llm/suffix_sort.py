"""Suffix arrays by induced sorting, at every level of the recursion, and permuted common prefixes.

Induced sorting scans the suffix array once to the right and once to the left; each entry tells the place of its
left neighbour. What a scan does inside one bucket depends on buckets it has passed and on runs of the bucket's own
symbol alone. So a scan takes as many buckets at once as don't induce into each other, as whole-array numpy steps:
a few hundred batches for the many different names of a deep level, and a bucket each for bytes. Of n symbols in
which neighbours fall at random, about the root of n batches are needed; each bucket is one at worst.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour (S-type). The last symbol must be the unique least."""
    n = len(text)
    here = np.arange(n, dtype=np.int64)
    differs = np.empty(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    differs[-1] = True
    nearest = np.minimum.accumulate(np.where(differs, here, n)[::-1])[::-1]
    rises = np.empty(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    rises[-1] = True
    return rises[nearest]


def _batches(highest: np.ndarray, present: np.ndarray) -> list[int]:
    """First buckets of batches: a batch ends before a bucket that a bucket of the batch induces into. highest: for
    each bucket the greatest smaller symbol that follows its own somewhere (-1: none)."""
    cuts, first = [0], 0
    for c, d in zip(present.tolist(), highest[present].tolist(), strict=True):
        if d >= first and c > first:
            cuts.append(c)
            first = c
    return cuts


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class _Scan:
    """A scan to the right of suffixes of one text: places those marked mine, which are greater than their right
    neighbours, behind what is placed already (at the ends of buckets; -1: nothing), in order."""

    def __init__(self, text: np.ndarray, mine: np.ndarray, size: int):
        changes = np.flatnonzero(text[1:] != text[:-1])
        first, last = np.append(0, changes + 1), np.append(changes, len(text) - 1)
        long = last > first
        self.run = np.zeros(len(text), np.int32 if len(text) < 1 << 31 else np.int64)
        self.run[last[long]] = (last - first)[long]  # at a run's end: how many of its symbol stand before
        self.start = np.append(0, np.cumsum(np.bincount(text, minlength=size)))
        total = np.bincount(text[mine], minlength=size)
        inner = mine[:-1] & (text[1:] == text[:-1])
        more = np.bincount(text[:-1][inner], minlength=size)
        self.base_slots, self.more_slots = _ranges(self.start[:-1], total - more), _ranges(self.start[:-1] + total - more, more)
        self.base_at, self.more_at = np.append(0, np.cumsum(total - more)), np.append(0, np.cumsum(more))
        falls = np.flatnonzero(text[:-1] > text[1:])
        highest = np.full(size, -1, np.int64)
        np.maximum.at(highest, text[falls], text[falls + 1].astype(np.int64))
        self.left = np.append(text[-1:], text[:-1])  # the symbol before a position
        self.larger = np.zeros(len(text) + 1, bool)  # whether that one is larger; the last place answers for -1, nothing
        self.larger[falls + 1] = True
        cuts = _batches(highest, np.flatnonzero(self.start[1:] > self.start[:-1]))
        self.batches = list(zip(cuts, [*cuts[1:], size], strict=True))

    def __call__(self, order: np.ndarray) -> None:
        start, base_at, more_at, left, larger = self.start, self.base_at, self.more_at, self.left, self.larger
        heads = start[:-1].copy()
        fresh, count = np.empty(len(order), bool), np.arange(len(order))
        for low, high in self.batches:
            if more_at[low] < more_at[high]:
                # Suffixes that begin with one more of the bucket's symbol follow all that begin with one less.
                base = order[self.base_slots[base_at[low] : base_at[high]]]
                times = self.run[base]
                base, times = base[times > 0], times[times > 0]
                more = np.repeat(base, times)
                if times.max() > 1:
                    nth = _ranges(np.ones(len(base), np.int64), times)
                    more = (more - nth)[np.lexsort((nth, left[more]))]
                else:
                    more -= 1
                order[self.more_slots[more_at[low] : more_at[high]]] = more
            entries = order[start[low] : start[high]]
            entries = entries[larger[entries]]
            if not len(entries):
                continue
            symbols = left[entries]
            by = symbols.argsort(kind="stable")
            symbols = symbols[by]
            fresh[0] = True
            new = np.not_equal(symbols[1:], symbols[:-1], out=fresh[1 : len(symbols)])
            first = fresh[: len(new) + 1].nonzero()[0]
            found = symbols[first]
            ends = np.empty_like(first)
            ends[:-1], ends[-1] = first[1:], len(symbols)
            slots = (heads[found] - first).repeat(ends - first) + count[: len(symbols)]
            order[slots] = entries[by] - 1
            heads[found] = slots[ends - 1] + 1


class _Induction:
    """Induced sorting of one text: all suffixes in the order that its leftmost-smaller ones imply."""

    def __init__(self, text: np.ndarray, small: np.ndarray, size: int):
        self.text, self.size = text, size
        self.ends = np.cumsum(np.bincount(text, minlength=size))
        self.n_small = np.bincount(text[small], minlength=size)
        rest = small.copy()
        rest[-1] = False
        self.right = _Scan(text, ~small, size)
        # The scan to the left is the same one on mirrored symbols and places.
        self.mirrored = _Scan((size - 1 - text.astype(np.int64)).astype(text.dtype), rest, size)

    def __call__(self, seeds: np.ndarray) -> np.ndarray:
        """seeds: the leftmost-smaller suffixes, in order within a bucket."""
        order = np.full(len(self.text), -1, np.int64)
        seeds = seeds[np.argsort(self.text[seeds], kind="stable")]
        n_seeds = np.bincount(self.text[seeds], minlength=self.size)
        order[_ranges(self.ends - n_seeds, n_seeds)] = seeds
        self.right(order)
        order[_ranges(self.ends - self.n_small, self.n_small)] = -1
        order[0] = len(self.text) - 1
        self.mirrored(order[::-1])
        return order


def name_substrings(text: np.ndarray, small: np.ndarray, ordered: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names (from 0, equal for equal substrings) of the leftmost-smaller substrings, given in order."""
    n = len(text)
    lengths = np.zeros(n, np.int64)
    lengths[starts] = np.append(starts[1:], n - 1) - starts
    length = lengths[ordered]
    new = np.ones(len(ordered), bool)
    live = np.flatnonzero(length[1:] == length[:-1]) + 1
    offset = 0
    while len(live):
        one, two = ordered[live] + offset, ordered[live - 1] + offset
        live = live[(text[one] == text[two]) & (small[one] == small[two])]
        ended = length[live] == offset
        new[live[ended]] = False
        live = live[~ended]
        offset += 1
    return np.cumsum(new) - 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols of which the last is the unique least.

    Empty and one-symbol inputs are their own order. Substrings between leftmost-smaller positions are sorted by
    one induction and named; if names are equal, this calls itself on the string of names, and a second induction
    places all suffixes.
    """
    n = len(text)
    if n < 3:
        return np.arange(n, dtype=np.int64)[::-1].copy()
    size = int(text.max()) + 1
    # Narrow symbols are sorted by radix.
    text = text.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.int64)
    small = classify(text)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _Induction(text, small, size)
    rough = induce(starts)
    if len(starts) < 2:
        return rough
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    ordered = rough[is_start[rough]]
    names = name_substrings(text, small, ordered, starts)
    if names[-1] + 1 < len(starts):
        place = np.empty(n, np.int64)
        place[ordered] = names
        ordered = _resolve(place[starts], starts, ordered, names)
    return induce(ordered)


def _resolve(string: np.ndarray, starts: np.ndarray, ordered: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The substrings of `ordered` in the order of their suffixes, by the suffix array of the string of names. No
    comparison goes beyond a name that occurs once, so of such names in a row only the first (and the last of all,
    which ends the string) are kept in it."""
    once = np.bincount(string) == 1
    alone = once[string]
    kept = np.ones(len(string), bool)
    kept[1:] = ~(alone[1:] & alone[:-1])
    kept[-1] = True
    kept = np.flatnonzero(kept)
    used = np.zeros(len(once), bool)
    used[string[kept]] = True
    deeper = kept[suffix_array((np.cumsum(used) - 1)[string[kept]])]
    result = ordered.copy()
    result[~once[names]] = starts[deeper[~alone[deeper]]]
    return result


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each text position, the symbols its suffix shares with the suffix before it in order (permuted LCP).

    Only positions whose preceding symbol differs from that of their neighbour are compared, by widening blocks;
    every other value is one less than the value to its left.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    here = np.arange(n)
    direct = np.ones(n, bool)
    direct[1:] = (before[1:] <= 0) | (text[here[1:] - 1] != text[before[1:] - 1])
    # Where the left neighbour has no predecessor in order, its value (0) says nothing about this one.
    direct[1:] |= before[:-1] < 0
    shared = np.zeros(n, np.int64)
    live = here[direct & (before >= 0)]
    other = before[live]
    # Four symbols at a time as one number; suffixes part at the last symbol, which is unique, at the latest.
    narrow = np.concatenate((text, np.zeros(4, text.dtype))).astype("<u2" if text.max() < 1 << 16 else "<u8")
    per = 8 // narrow.itemsize
    words = np.ndarray((n + 4 - per + 1,), "<u8", buffer=narrow, strides=(narrow.itemsize,))
    done = np.zeros(len(live), np.int64)
    while len(live):
        differ = words[live + done] ^ words[other + done]
        ends = np.flatnonzero(differ)
        last = differ[ends]
        extra = np.zeros(len(ends), np.int64)
        for k in range(1, per):
            extra += (last & np.uint64((1 << 16 * k) - 1)) == 0
        shared[live[ends]] = done[ends] + extra
        on = differ == 0
        live, other, done = live[on], other[on], done[on] + per
    base = np.maximum.accumulate(np.where(direct, here, 0))
    return np.maximum(shared[base] - (here - base), 0)
