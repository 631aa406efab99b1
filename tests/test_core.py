"""Operators over recordings and cycles, against SQL on the driver's tables and against plain Python."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from coordwave.functions import scalar
from coordwave.operators import cycles, evaluation, linkage, matching, periods, review, windows
from coordwave.plans.queries import ORACLE_SQL, QUERIES
from coordwave.sources.tables import recordings, table


def rows(names, values):
    def plain(v):
        return round(float(v), 6) if isinstance(v, float) else v

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, small), con.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_linkage_worked_examples():
    score = {(0, 1): 0.9, (0, 2): 0.6, (1, 2): 0.95}
    assert over(3, score, 0.8) == [[0], [1, 2]]
    assert over(3, score, 0.6) == [[0, 1, 2]]
    assert over(3, score, 0.951) == [[0], [1], [2]]


def over(n, score, threshold):
    return linkage.agglomerate(n, {p: x for p, x in score.items() if x + 1e-12 >= threshold})


def naive(n, score, threshold):
    """Merging by definition: the best pair of clusters by its worst pair of members, first ones first."""
    own = [[i] for i in range(n)]
    while True:
        best = None
        for i, j in itertools.combinations(range(len(own)), 2):
            worst = min(score.get((min(a, b), max(a, b)), -math.inf) for a in own[i] for b in own[j])
            if worst + 1e-12 >= threshold and (best is None or (-worst, own[i][0], own[j][0]) < best[0]):
                best = ((-worst, own[i][0], own[j][0]), i, j)
        if best is None:
            return [sorted(m) for m in sorted(own, key=min)]
        own[best[1]] += own.pop(best[2])
        own[best[1]].sort()
        own.sort(key=min)


def test_linkage_equals_naive():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(3, 14)
        score = {p: round(rng.random(), 1) for p in itertools.combinations(range(n), 2) if rng.random() < 0.8}
        assert over(n, score, 0.4) == naive(n, score, 0.4)


def test_groups_by_component(spark):
    rng = random.Random(2)
    score = {(a, b): round(rng.random(), 2) for a, b in itertools.combinations(range(20), 2) if rng.random() < 0.15}
    nodes = spark.range(20)
    found = linkage.groups(nodes, spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "a long, b long, score double"), 0.3)
    got = {}
    for r in found.collect():
        got.setdefault(r["group_id"], []).append(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(over(20, score, 0.3))


def view(n, f=lambda i: math.sin(i / 3), shift=0.0, missing=()):
    data = [[i, i * 10.0 + shift, f(i), 10.0 + math.cos(i), float(i % 7) if i not in missing else math.nan, 0, 0, 0] for i in range(n)]
    return np.array(data)


def test_matcher_identity_and_parts():
    v = matching.Views([1, 2, 3], [64, 64, 32], [view(64), view(64, shift=500.0), view(64)[16:48]])
    s = matching.Settings()
    got = matching.whole(v, 0, v, np.array([0, 1]), s)
    assert np.allclose(got["score"], 1) and got["complete"].all()
    part = matching.match_pair(v, 2, v, 0, s)
    assert part["kind"] == "partial" and part["score"] > 0.99
    back = matching.match_pair(v, 0, v, 2, s)
    assert back["kind"] == "query-partial" and not back["weak"]
    few = matching.Views([1, 2], [64, 64], [view(64), view(64, missing=range(10, 64))])
    assert matching.match_pair(few, 0, few, 1, s)["kind"] == "partial-channel"


def test_matcher_needs_sixteen_events():
    v = matching.Views([1, 2], [12, 64], [view(12), view(64)])
    assert np.isnan(matching.whole(v, 0, v, np.array([1]), matching.Settings())["score"]).all()
    with pytest.raises(ValueError):
        matching.Settings(least=8)


def test_symmetric_scores_cover_all_pairs(spark, small):
    rec = recordings(table(spark, small, "events"))
    packed = matching.pack(windows.resample(windows.decimate(rec)), windows.summary(rec)).cache()
    one = {(r.a, r.b): r.score for r in matching.symmetric_scores(packed).collect()}
    many = {(r.a, r.b): r.score for r in matching.symmetric_scores(packed, block=4).collect()}
    assert one == many
    n = packed.count()
    assert len(one) <= n * (n - 1) // 2 and all(a < b for a, b in one)


def test_resample_long_views(spark):
    points = spark.range(300).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("event_idx"))
    got = {r.point: r.event_idx for r in windows.resample(points).collect()}
    assert got == {i: math.floor(i * 299 / 127 + 0.5) for i in range(128)}


def test_queries_need_one_measured_quantity(spark):
    """A recording of 20 events with 15 values of each quantity asks for nothing, but can be found."""
    rows = [(r, i, float(i), *[float(i * 7 % 11) if r or i < 15 else None] * 3) for r in (0, 1) for i in range(20)]
    rec = spark.createDataFrame(rows, "recording_id long, event_idx long, t double, frequency double, pri double, pw double")
    packed = matching.pack(windows.resample(windows.decimate(rec)), windows.summary(rec))
    assert [(r.query_id, r.target_id) for r in matching.directed_scores(packed).collect()] == [(1, 0)]


def test_combined_distances():
    assert cycles.combine(0.5, 0.0, 1.0, 0.0, (1, 0, 0, 0)) == 0.5  # an infinite term of weight 0
    assert abs(cycles.combine(0.3, 2.0, 4.0, 0.5, (0.65, 0.2, 0.15, 0.0)) - math.sqrt(0.65 * 0.09 + 0.2 + 0.6)) < 1e-12


def test_fnv_of_wide_characters(spark):
    def plain(text):
        h, data = 2166136261, text.encode("utf-16-be")
        for k in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[k : k + 2], "big")) * 16777619) % 2**32
        return f"{h:08x}"

    texts = ["region-a", "", "é", "了😀x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.fnv1a(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: plain(t) for t in texts}


def test_align_finds_shift():
    rng = np.random.default_rng(0)
    a = rng.normal(size=128)
    rms, shift = cycles.align(a, np.stack((np.roll(a, 5), a, a + 1)))
    assert np.allclose(rms, [0, 0, 1], atol=1e-7) and shift.tolist()[:2] == [5, 0]
    assert abs(cycles.overlap(a / 4, np.roll(a / 4, 9)) - 1) < 1e-9
    assert cycles.canonical_shape(a) == cycles.canonical_shape(np.roll(a, 31))


def test_embedding():
    x = np.array([[0, 0], [0, 1], [0, 0.4], [9, 9], [9, 8], [9, 8.6]], float)
    matrix = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    xy = cycles.embed(matrix)
    assert np.allclose(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)), matrix)


def test_period_search():
    t = 100 + np.arange(601) / 100
    found = periods.suggest(t, 6 + np.sin(2 * np.pi * np.arange(601) / 100), np.empty(0))
    assert found and abs(found[0][0] - 1) < 0.002
    assert periods.suggest(t, np.full(601, 2.0), np.empty(0)) == []
    assert periods.suggest(t, np.arange(601.0), np.empty(0)) == []
    assert periods.suggest(t, np.random.default_rng(1).normal(size=601), np.empty(0)) == []


def test_calibration():
    score, y = np.array([0.1, 0.2, 0.3, 0.7, 0.8, 0.9]), np.array([0, 0, 0, 1, 1, 1])
    mean, scale, slope, _ = evaluation.fit_logistic(score, y)
    assert abs(mean - 0.5) < 1e-9 and scale > 0.01 and slope > 1


def test_tune_prefers_accuracy_then_middle(spark):
    scored = spark.createDataFrame([("a", "a", 0.9), ("b", "b", 0.8), (None, "a", 0.3), (None, "b", 0.2)], "expected string, region string, score double")
    best = evaluation.tune(scored, evaluation.threshold_grid(scored)).first()
    assert abs(best["threshold"] - 0.55) < 1e-9 and best["false_merges"] == 0


def test_scalars(spark):
    r = spark.sql("SELECT 'region-a' AS x, 2.5D AS h, -800D AS z").select(scalar.fnv1a(F.col("x")).alias("f"), scalar.half_up(F.col("h")).alias("h"), scalar.sigmoid(F.col("z")).alias("s"), scalar.identifier_ok(F.col("x")).alias("i")).first()
    assert (r.f, r.h, r.i) == ("a0e3d943", 3, True) and 0 <= r.s < 1e-300
