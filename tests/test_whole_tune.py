"""Tuning tries every threshold, however many there are."""

import random

from coordwave.operators import evaluation


def brute(rows, thresholds):
    def rank(t):
        taken = [(e, r if s >= t else None) for e, r, s in rows]
        known, strange = [x for x in taken if x[0]], [x for x in taken if not x[0]]
        hits, merges = sum(e == r for e, r in known), sum(r is not None for _, r in strange)
        return -round((hits / len(known) + (len(strange) - merges) / len(strange)) / 2, 12), merges, abs(t - 0.5), t

    return min(thresholds, key=rank)


def test_tune_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["a", "b"]), rng.randrange(40) / 40) for _ in range(300)]
    scored = spark.createDataFrame(rows, "expected string, region string, score double")
    grid = evaluation.threshold_grid(scored)
    assert evaluation.tune(scored, grid).first()["threshold"] == brute(rows, [r.threshold for r in grid.collect()])


def test_best_of_many_thresholds(spark):
    # Only the midpoint under the greatest of 30,000 scores is best.
    scored = spark.range(30_000).selectExpr("IF(id = 29999, 'a', NULL) AS expected", "'a' AS region", "CAST(id AS DOUBLE) AS score")
    best = evaluation.tune(scored, evaluation.threshold_grid(scored)).first()
    assert (best["threshold"], best["accuracy"], best["false_merges"]) == (29998.5, 1.0, 0)
