"""The pipeline's near-copy stage takes candidates from the SimHash index."""

import corpus_pipeline
from coordwave.llm import byte_bpe, near_copies, simhash


def test_index_alone_finds_near_copies(spark, monkeypatch):
    """Without a band of minima in common, what the index links is still compared, and only like contents go."""
    monkeypatch.setattr(near_copies, "_in_buckets", _no_bands(near_copies._in_buckets))
    base = [f"word{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join(base).upper(), "something else altogether that nothing is like at all", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {simhash.fingerprint(t, 5) for t in texts[:2]}
    assert len(prints) == 1 or bin(prints.pop() ^ prints.pop()).count("1") <= 2
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == [0, 3, 4]


def _no_bands(run):
    import numpy as np
    import pyarrow as pa

    def apart(batches):
        for b in run(batches):
            unique = np.arange(b.num_rows * near_copies.BANDS, dtype=np.int64) + b.column(0).to_numpy().repeat(near_copies.BANDS) * 10**6
            lists = pa.ListArray.from_arrays(b.column(3).offsets, pa.array(unique))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists, *b.columns[4:]], b.schema.names)

    return apart


def test_ids_do_not_depend_on_tables(tmp_path):
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    text = "Some words, then more words; unüblich, und\nwords 1234 again. " * 3
    large, small = byte_bpe.Codec(ranks, public_tokenizers.PATTERN), byte_bpe.Codec(ranks, public_tokenizers.PATTERN, (3, 2))
    assert large.encode(text) == small.encode(text) and len(small.after_space) <= 2
