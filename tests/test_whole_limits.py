"""Sizes and numbers at which operators once ended: partitions, groups, ids of a store."""

import random

import pytest
from pyspark.sql import functions as F

from coordwave.functions import scalar
from coordwave.operators import evaluation, review


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_setting(rows, thresholds):
    known, strange = sum(e is not None for e, _, _ in rows), sum(e is None for e, _, _ in rows)

    def rank(t):
        hits = sum(e is not None and e == r and s >= t for e, r, s in rows)
        merged = sum(e is None and r is not None and s >= t for e, r, s in rows)
        return -round((hits / known + (strange - merged) / strange) / 2, 12), merged, abs(t - 0.5), t

    return min(map(rank, thresholds))


@pytest.mark.parametrize("n", [1, 2000])
def test_thresholds_at_any_number_of_partitions(spark, partitions, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), round(rng.random(), 2)) for _ in range(300)]
    scored = spark.createDataFrame(rows, "expected long, region long, score double").coalesce(1)
    different = sorted({s for _, _, s in rows})
    wanted = [(a + b) / 2 for a, b in zip(different, different[1:])]
    partitions(n)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    grid = evaluation.threshold_grid(scored.select("score").unionByName(spark.sql("SELECT CAST('NaN' AS DOUBLE) AS score UNION ALL SELECT NULL")))
    assert sorted(r.threshold for r in grid.collect()) == pytest.approx(wanted)
    best = evaluation.tune(scored, spark.createDataFrame([(t,) for t in wanted], "threshold double")).first()
    accuracy, merged, _, threshold = plain_setting(rows, wanted)
    assert (best.threshold, best.accuracy, best.false_merges) == pytest.approx((threshold, -accuracy, merged))


def test_no_thresholds(spark):
    assert evaluation.threshold_grid(spark.createDataFrame([(0.5,), (0.5,), (None,)], "score double")).count() == 0
    assert evaluation.threshold_grid(spark.createDataFrame([], "score double")).count() == 0


@pytest.mark.parametrize("names", [["a"], ["a", "b"], [f"n{i}." for i in range(32)]])
def test_names_of_any_group(spark, names):
    def plain(index):
        name = ""
        while index >= 0:
            name, index = names[index % len(names)] + name, index // len(names) - 1
        return name

    wanted = [0, 1, 31, 32, 84, 1055, 1056, 33_823, 33_824, 10**6] + ([] if len(names) == 1 else [2**40 + 7, 2**62 + 12345, 2**63 - 1])
    rows = spark.createDataFrame([(i,) for i in wanted], "i long").select("i", scalar.group_name(F.col("i"), names).alias("name")).collect()
    assert {r.i: r.name for r in rows} == {i: plain(i) for i in wanted}


def test_rules_of_a_review_store(spark):
    groups = spark.createDataFrame([("region-a b", "x", "Vega"), ("foo", "y", "n"), ("split-" + "é" * 195, "z", ""), ("region-𝄞", "prototype", None), ("region-q", "x", "𝄞" * 100), (None, "w", "𝄞" * 101)], "group_id string, anchor_id string, name string")
    placements = spark.createDataFrame([("e", "region-q"), ("", "__proto__")], "entry_id string, group_id string")
    found = {(r.rule, r.subject) for r in review.store_violations(groups, placements, spark.createDataFrame([("t",), ("constructor",)], "token string")).collect()}
    assert found == {
        ("group_id without region- or split-", "foo"), ("group_id without region- or split-", None), ("group_id is no id", None), ("group_id is no id", "split-" + "é" * 195), ("anchor_id is no id", "prototype"), ("name is no id", ""),
        ("name is no id", None), ("name is no id", "𝄞" * 101), ("anchor_id named twice", "x"), ("placed entry is no id", ""), ("placed group is no id", "__proto__"), ("acknowledged is no id", "constructor"),
    }
    many = spark.range(10_001).select(F.concat(F.lit("e"), F.col("id")).alias("entry_id"), F.lit("region-q").alias("group_id"))
    assert [tuple(r) for r in review.store_violations(groups.limit(0), many, many.select(F.col("entry_id").alias("token"))).collect()] == [("too many placements", "10001"), ("too many acknowledged", "10001")]
