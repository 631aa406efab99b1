"""Validators and generators."""

from pyspark.sql import functions as F

from coordwave.operators import cycles, validation, windows
from coordwave.sources import generators

CYCLE = "cycle_id string, period double, t array<double>, f array<double>, missing_times array<double>, sampling string, interpolation string, quantity string"


def test_cycles(spark):
    t, f = [k / 10 for k in range(10)], [float(k % 4) + 1 for k in range(10)]
    rows = [
        ("good", 1.0, t, f, [], "uniform-open", None, "frequency"), ("closed", 1.0, [*t, 1.0], [*f, 1.0], None, "closed-endpoint", None, "frequency"),
        ("short", 1.0, t[:4], f[:4], [], "sparse-periodic", "linear", "frequency"), ("order", 1.0, [*t[:9], 0.1], f, [], "sparse-periodic", "hold", "frequency"),
        ("flat", 1.0, t, [2.0] * 10, [], "uniform-open", None, "frequency"), ("gap", 3.0, t, f, [], "sparse-periodic", "hold", "frequency"),
        ("negative", 1.0, t, [-1.0, *f[1:]], [], "uniform-open", None, "pri"), ("clash", 1.0, t, f, [0.1], "sparse-periodic", None, "frequency"), ("none", None, None, None, None, None, None, None),
    ]
    got = {}
    for r in validation.cycle_violations(spark.createDataFrame(rows, CYCLE)).collect():
        got.setdefault(r.cycle_id, set()).add(r.rule)
    assert "good" not in got and "closed" not in got
    assert "sample_count" in got["short"] and "order" in got["order"] and got["flat"] == {"excursion"} and got["gap"] == {"gap"}
    assert got["negative"] == {"positive"} and got["clash"] == {"interpolation", "missing_times"} and {"period", "sample_count"} <= got["none"]


def test_raw_and_corpus(spark):
    good = [("g", float(k), float(k % 3), "frequency") for k in range(10)]
    bad = [("b", 0.0, -1.0, "pri"), ("b", 0.0, None, "pri")]
    got = validation.raw_violations(spark.createDataFrame(good + bad, "recording_id string, t double, f double, quantity string")).collect()
    assert {(r.recording_id, r.rule) for r in got} == {("b", "positive"), ("b", "few_samples"), ("b", "repeated_time"), ("b", "no_span")}
    rows = [(f"s{k}", "a", "c", "train", "x") for k in range(6)] + [("u", "b", "c", "test", "y")]
    found = validation.corpus_violations(spark.createDataFrame(rows, "signal_id string, source_id string, leakage_group_id string, split string, sha256 string"), spark.createDataFrame([("v",)], "signal_id string")).collect()
    assert {(r.rule, r.key) for r in found} == {("component in several splits", "c"), ("source without six views", "b"), ("labels and test rows differ", "u"), ("labels and test rows differ", "v")}


def test_generators(spark):
    made = generators.catalogue(spark, 3)
    assert made.count() == 24 and made.where(F.exists("f", lambda x: x.isNull() | F.isnan(x))).count() == 0
    full = made.withColumn("centre", F.lit(6.0)).withColumn("excursion", F.lit(1.0))
    assert cycles.phase_grid(full).where(F.size("grid") == 128).count() == 24
    assert generators.paired_intervals(made).where("f[0] <= 0").count() == 0
    work = generators.event_workload(spark, 5, 1000)
    assert work.groupBy("recording_id").count().where("count = 200").count() == 5 and windows.violations(work).count() == 0
