"""Documents with a null id in the pipeline's near-duplicate stage."""

import random

import corpus_pipeline


def test_unique_document_with_a_null_id_survives(spark):
    rng = random.Random(3)
    one, two, three = (" ".join(f"w{rng.randrange(3000)}" for _ in range(100)) for _ in range(3))
    rows = [(1, one, 0), (None, one, 1), (None, two, 2), (None, two, 3), (None, three + " end", 4), (2, three, 5), (None, None, 6)]
    got = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), "").collect()
    assert sorted(r.n for r in got) == [0, 2, 5, 6]
