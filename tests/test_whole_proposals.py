"""Merge proposals whose scores follow from ids."""

import random

import pytest

from coordwave.operators import policy


@pytest.mark.parametrize("block", [5000, 2])
def test_scored_proposals_equal_given_scores(spark, monkeypatch, block):
    monkeypatch.setattr(policy, "BLOCK", block)
    rng = random.Random(5)
    rows = [(i, rng.randrange(9)) for i in rng.sample(range(1000), 40)]
    members = spark.createDataFrame(rows, "id long, group_id long")
    heads = spark.createDataFrame([(min(i for i, h in rows if h == g), g) for g in {g for _, g in rows}], "id long, group_id long")
    plain = lambda a, b: (a * 7 + b * 3) % 40 / 100.0 + 0.6
    scores = spark.createDataFrame([(a, b, plain(a, b)) for a, g in rows for b, h in rows if a < b and abs(g - h) == 1], "a long, b long, score double")
    beside = spark.createDataFrame([(g, g + 1) for g in range(9)], "group_a long, group_b long")
    for threshold in (0.6, 0.62, 0.65):
        got = policy.scored_proposals(members, heads, beside, plain, threshold)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, policy.merge_proposals(members, heads, scores, threshold).collect()))
    assert policy.scored_proposals(members, heads, beside, plain, 0.6 - policy.CORE).count() > 0


def test_pairs_meet_no_further_join(spark, small):
    """Pairs are counted where they arise: two joins deal members, one pairs them, one takes the sums of groups."""
    from coordwave.plans import library_queries

    plan = library_queries.c16_merge_proposals(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 4
