"""The pipeline's stages in order, each against what its operator says, on a small table with planted cases."""

import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken
from coordwave.llm import byte_bpe
from coordwave.llm.common import materialise, table
from pyspark.sql import functions as F


def test_stages(spark, small):
    base = table(spark, small, "documents")
    again = base.where("length(text) > 400").orderBy("doc_id").limit(5).withColumn("doc_id", F.col("doc_id") + 10**6)
    docs = base.unionByName(again).withColumn("extra", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "mixing to target weights", "byte-level bpe"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], small), "test"))
    assert all(s.columns == docs.columns for s in seen[:-1])
    good, alone, cut, mixed, last = seen[1:]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(good) <= ids(docs) and ids(alone) <= ids(good) and ids(cut) == ids(alone) == ids(mixed)
    assert not {i for i in ids(alone) if i >= 10**6}  # exact copies of smaller ids are gone
    texts = {r.doc_id: r.text for r in good.collect()}
    runs = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [(t or "").lower().split()]}
    like = lambda a, b: 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b])
    assert not [(a, b) for a in ids(alone) for b in ids(alone) if a < b and like(a, b)]
    assert all(any(b < a and like(a, b) for b in runs) for a in ids(good) - ids(alone))
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (alone, cut))
    assert all(len(after[i]) <= len(before[i]) for i in after)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = sorted((r.doc_id, len(x := library.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in last.collect()) == wanted


def test_cuts_take_whole_characters_and_leave_others_alone(spark):
    """Only a cut's edges change a text: U+FFFD of its own stays, in texts with and without cuts."""
    shared = "passage é that many documents share, of well over fifty bytes € 😀😀"
    texts = [shared + "é keep \ufffd this", "keep \ufffd this one", "\ufffd" + shared + "è\ufffd tail", "𝟘" + shared[3:] + "é", None, "€" * 30, "€" * 30 + "₭"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_stage(spark, docs, "").collect()}
    seen = set()
    for i, text in enumerate(texts):
        data = (text or "").encode()
        marked = [False] * len(data)
        for k in range(len(data) - 49):
            if data[k : k + 50] in seen:
                marked[k : k + 50] = [True] * 50
        seen |= {data[k : k + 50] for k in range(len(data) - 49)}
        at, kept = 0, []
        for c in text or "":
            n = len(c.encode())
            if not any(marked[at : at + n]):
                kept.append(c)
            at += n
        assert got[i] == (None if text is None else "".join(kept))
