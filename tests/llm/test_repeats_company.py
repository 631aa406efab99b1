"""Which contents of a shard go to its suffix array."""

import random

import pytest

from coordwave.llm import suffix_dedup


def share(a, b, span):
    return bool({a[i : i + span] for i in range(len(a) - span + 1)} & {b[i : i + span] for i in range(len(b) - span + 1)})


def runs(texts, span, gram):
    """The contents of all runs by least hash."""
    import numpy as np

    found = {}
    for t in texts:
        hashes, first, count, _ = suffix_dedup.runs_of(np.frombuffer(t, np.uint8), span, gram)
        for h, a, n in zip(hashes.tolist(), first.tolist(), count.tolist()):
            found.setdefault(h, set()).add(t[a : a + n + span - 1])
    return found


@pytest.mark.parametrize(("span", "gram", "letters"), [(9, 4, "ab"), (9, 1, "ab"), (9, 9, "ab"), (50, 16, "abc"), (50, 24, "a b"), (12, 5, "abcdef")])
def test_no_shared_string_is_left_out(span, gram, letters):
    rng = random.Random(span + gram)
    make = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()
    pieces = [make(span + rng.randint(0, 20)) for _ in range(5)]
    texts = [make(rng.randint(0, 40)) + rng.choice(pieces) + make(rng.randint(0, 40)) for _ in range(40)]
    contents = sorted({c for own in runs(texts, span, gram).values() for c in own})
    found = suffix_dedup._in_company(contents, span, gram)
    for i, a in enumerate(contents):
        assert found[i] or not any(share(a, b, span) for j, b in enumerate(contents) if i != j)


def test_a_common_gram_alone_is_no_company():
    rng = random.Random(4)
    make = lambda n: bytes(rng.choices(range(97, 123), k=n))
    common = make(24)
    found = runs([make(60) + common + make(60) for _ in range(200)], 50, 24)
    several = [own for own in found.values() if len(own) > 1]
    contents = [c for own in several for c in own]
    assert len(contents) > 1  # under one least hash, without a string of 50 bytes in common
    assert not suffix_dedup._in_company(contents, 50, 24).any()
