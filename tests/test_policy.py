"""Group policy against worked examples."""

import numpy as np
from pyspark.sql import functions as F

from coordwave.operators import policy


def test_merge_needs_every_pair(spark):
    members = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "id long, group_id long")
    scores = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (2, 3, 0.8), (1, 4, 0.9), (3, 4, 0.7)], "a long, b long, score double")
    heads = members.where("id <> 2")
    assert [tuple(r) for r in policy.merge_proposals(members, heads, scores, 0.75).collect()] == [(10, 20, 0.8)]
    assert policy.merge_proposals(members, heads, scores, 0.85).count() == 0


def test_components_and_threshold(spark):
    d = spark.createDataFrame([(1, 2, 0.001), (2, 3, 0.004), (4, 5, 0.2)], "a long, b long, distance double")
    nodes = spark.range(1, 6)
    assert {r.id: r.component for r in policy.near_duplicate_components(nodes, d).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    wide = spark.range(100).select((F.col("id") / 100).alias("distance"))
    assert abs(policy.novelty_threshold(wide).first()[0] - 1.5 * 0.95) < 1e-12


def test_placement():
    xy = np.array([[0.0, 0], [3, 0], [0, 4]])
    matrix = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    assert policy.place(matrix[1], xy).tolist() == [3, 0]
    assert np.allclose(policy.place(np.array([1.0, 1.0]), xy[:2]), [1.5, 0])
