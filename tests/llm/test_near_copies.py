"""The pipeline's near-duplicate stage against similarities of whole sets of five-word shingles."""

import random

import corpus_pipeline
from coordwave.llm import near_copies


def similarity(a, b):
    def runs(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y)


def edited(rng, text, edits):
    w = text.split()
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"edit{rng.randrange(10**9)}"
    return " ".join(w)


def test_stage_drops_near_copies_and_keeps_others(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(rng, t, 1 + i % 3)) for i, t in enumerate(base)]  # similarity 0.86 and more
    rows += [(200 + i, edited(rng, t, 15)) for i, t in enumerate(base)]  # far below 0.8
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    text = dict(rows)
    ids = sorted(text)
    assert kept == set(range(20)) | set(range(200, 220))
    assert not [(a, b) for a in kept for b in kept if a < b and similarity(text[a], text[b]) >= 0.8]
    assert all(any(b < a and similarity(text[a], text[b]) >= 0.8 for b in ids) for a in ids if a not in kept)


def test_one_bucket_of_many_different_contents(spark, monkeypatch):
    """Contents that all share their bands, by a passage most of them consist of, but aren't similar: several rounds."""
    rng = random.Random(2)
    shared = " ".join(f"s{k}" for k in range(300))
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    rows += [(100 + i, edited(rng, t, 1)) for i, t in rows]
    text = dict(rows)
    got = {r.doc_id for r in near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(near_copies, "PART", 7)  # buckets in many parts
    assert got == {r.doc_id for r in near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = {(a, b) for a in text for b in text if a < b and similarity(text[a], text[b]) >= 0.8}
    assert got == set(range(60)) == {b for b in text if not any((a, b) in alike for a in text)}


def test_telling_equals_plain_sets():
    import pyarrow as pa

    rng = random.Random(5)
    base = rng.sample(range(10**6), 30)
    rows = [({"last": i % 9 == 0, "id": None if i % 9 == 0 else i, "k": i, "n": 0}, sorted(set(rng.sample(base, 28) + rng.sample(range(10**6), rng.randrange(8))))) for i in range(40)]
    centres, members = rows[10:18], rows
    made = lambda r, *names: pa.table([pa.array([p for p, _ in r], pa.struct([("last", pa.bool_()), ("id", pa.int64()), ("k", pa.int64()), ("n", pa.int64())])), pa.array([s for _, s in r], pa.list_(pa.int32()))], names=names)
    key = lambda p: (p["last"], p["id"] or 0, p["k"])
    wanted = [p["k"] for p, s in members if any(key(c) < key(p) and len(set(s) & set(t)) >= 0.8 * len(set(s) | set(t)) for c, t in centres)]
    assert wanted and near_copies._tell(None, made(members, "place", "shingles"), made(centres, "centre", "own")).column("k").to_pylist() == wanted
    assert near_copies._tell(None, made(members, "place", "shingles"), made([], "centre", "own")).num_rows == 0 and len(wanted) < 40
