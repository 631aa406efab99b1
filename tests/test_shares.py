"""Blends of two scores by decimal shares."""

from coordwave.operators import evaluation


def test_share_is_decimal(spark):
    """0.7 and 0.3 of scores whose sum in doubles lies just under the threshold: 1 - 0.7 in doubles would lift it."""
    rows = [(formula / 1000, overlap / 1000) for formula in range(400, 1000) for overlap in range(1000)]
    lifted = [(f, o) for f, o in rows if 0.7 * f + (1 - 0.7) * o >= 0.65 > 0.7 * f + 0.3 * o]
    assert lifted
    pairs = spark.createDataFrame([(k, "test", 1, 1, 1, f, o) for k, (f, o) in enumerate(lifted)], "example_id long, split string, expected long, region_id long, representative_id long, formula double, overlap double")
    found = evaluation.predict(pairs, 0.7, 0.65).collect()
    assert len(found) == len(lifted) and all(r.predicted is None and r.score < 0.65 for r in found)
