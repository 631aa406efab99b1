"""Boxes that all meet in a few cells."""

import random

import pytest
from pyspark.sql import functions as F

from coordwave.operators import layout


def near(p, q, gap):
    return p[3] + gap > q[1] and q[3] + gap > p[1] and p[4] + gap > q[2] and q[4] + gap > p[2]


@pytest.mark.parametrize(("block", "wide"), [(2000, 3000), (7, 3000), (7, 200)])
def test_crowded_cells_are_dealt(spark, monkeypatch, block, wide):
    monkeypatch.setattr(layout, "BLOCK", block, raising=False)
    rng = random.Random(block + wide)
    rows = [(i, x := rng.uniform(-wide, wide), y := rng.uniform(-wide, wide), x + rng.uniform(0, 900), y + rng.uniform(0, 500)) for i in range(150)]
    found = layout.overlaps(spark.createDataFrame(rows, "box_id long, left double, top double, right double, bottom double"), 48.0)
    placed = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in placed) == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and near(p, q, 48.0))
    assert block == 2000 or len({r.task for r in placed}) > 4  # a cell's boxes are not one task


def test_no_boxes(spark):
    assert layout.overlaps(spark.createDataFrame([], "box_id long, left double, top double, right double, bottom double")).count() == 0
