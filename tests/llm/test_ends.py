"""Texts, ids and targets at which corpus operators once ended early."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from coordwave.llm import byte_bpe, mixing, simhash

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\p{L}+|\s|."])
def test_many_lines_without_a_space(pattern):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(BYTE_BPE), pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.transducer.ranks, special_tokens={})
    texts = ["word\n" * 1500, "\n".join(f"w{i % 977}.," for i in range(10**6 if pattern == public_tokenizers.PATTERN else 2000)), "a\n\nb\nc,\n.d\n", "x.\n\ty\nz " * 50, "\n" * 50 + "a\nb"]
    for text in texts:
        assert memoryview(codec.encode(text)).cast("i").tolist() == library.encode_ordinary(text)


def test_unique_text_with_a_null_id_stays(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (None, "quite another text, of its own"), (None, "one two three four"), (None, "quite another text, of its own")], "doc_id long, text string")
    assert sorted(map(repr, simhash.keep_first(docs).collect())) == sorted(["Row(doc_id=1, text='one two three four')", "Row(doc_id=None, text='quite another text, of its own')"])


def soft(spark, rows):
    return spark.createDataFrame(rows, "id long, tokens long, p array<double>").select("id", F.struct("tokens", "p").alias("soft"))


def test_a_target_out_of_reach_is_told(spark):
    """All documents are half of either domain, so no rates make one three times as large as the other."""
    with pytest.warns(UserWarning, match="miss"):
        rated, goal, totals = mixing.fit_rates(soft(spark, [(i, 100, [0.5, 0.5]) for i in range(10)]), 2, [3, 1])
    assert goal == [750.0, 250.0] and totals[0] == pytest.approx(totals[1])
    assert {round(r.soft.miss, 3) for r in rated.collect()} == {0.5}


def test_many_domains(spark):
    n = 40
    rows = [(i, 50 + i % 7, [0.9 if k == i % n else 0.1 / (n - 1) for k in range(n)]) for i in range(400)]
    rated, goal, totals = mixing.fit_rates(soft(spark, rows), n, [1 + k % 3 for k in range(n)])
    assert max(abs(a - b) / b for a, b in zip(totals, goal)) < 1e-3 and rated.select("soft.miss").first()[0] < 1e-3
