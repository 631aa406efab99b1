"""The transducer's states are sets of trie nodes: new words hardly need new transitions, so small tables suffice."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from coordwave.llm import byte_bpe

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_new_words_take_known_transitions(ranks, library):
    rng = random.Random(3)
    syllables = [a + b for a in "bcdfghlmnrst" for b in ("a", "e", "in", "on", "er")]
    words = [" " + "".join(rng.choices(syllables, k=rng.randint(3, 6))) for _ in range(6000)]
    own, taken = byte_bpe.Transducer(ranks), []
    step = own._step
    own._step = lambda *a: taken.append(a) or step(*a)
    for w in words[:3000]:
        own.encode_piece(w.encode())
    before = len(taken)
    assert [own.encode_piece(w.encode()) for w in words[3000:]] == library.encode_ordinary_batch(words[3000:])
    assert len(taken) - before < 1500  # one for every second word


def test_a_long_piece_is_emitted_on_the_way(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LOOKAHEAD", 4)
    rng, own, most = random.Random(4), byte_bpe.Transducer(ranks), []
    common = own._common
    own._common = lambda state, last: most.append(len(last)) or common(state, last)
    for piece in ("a" * 3000, "".join(rng.choices("abeghinorst", k=3000)), "漢字かな" * 300):
        assert own.encode_piece(piece.encode()) == library.encode_ordinary(piece)
    assert len(most) > 20 and max(most) < 1000


def test_white_space_beside_spaces_and_at_the_ends(ranks, library):
    rng, own = random.Random(5), byte_bpe.Codec(ranks, PATTERN)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "word", "Wörter", "a,", "b.", "x.\ny", "\ny", "it's", "12"]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        assert np.frombuffer(own.encode(text), np.int32).tolist() == library.encode_ordinary(text), repr(text)
