"""Generated fixtures: families of synthetic cycles, and event workloads of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("sine", "triangle", "sawtooth", "square", "skewed", "double", "pulse", "chirp")
SAMPLES = 256


def wave(family: Column, phase: Column, form: Column) -> Column:
    """A family's value at a phase from 0 to 1; form, 0 to 1, bends it."""
    turn = 2 * F.pi() * phase
    skew = 0.3 + 0.4 * form
    tri = F.when(phase < skew, phase / skew).otherwise((1 - phase) / (1 - skew)) * 2 - 1
    cases = {
        "sine": F.sin(turn), "triangle": tri, "sawtooth": 2 * F.pow(phase, 0.7 + form) - 1, "square": F.tanh(F.sin(turn) * (3 + 5 * form)),
        "skewed": F.sin(turn + (0.2 + 0.5 * form) * F.sin(turn)), "double": (F.sin(turn) + (0.4 + form) * F.sin(2 * turn)) / (1.4 + form),
        "pulse": 2 * F.exp(-F.pow((phase - 0.5) / (0.06 + 0.1 * form), 2)) - 1, "chirp": F.sin(turn * (1 + (0.5 + form) * phase)),
    }
    value = F.lit(None).cast("double")
    for name, x in cases.items():
        value = F.when(family == name, x).otherwise(value)
    return value


def catalogue(spark: SparkSession, per_family: int = 124) -> DataFrame:
    """Uniform cycles (cycle_id, family, period, t, f), the same for the same arguments."""
    n = per_family * len(FAMILIES)
    rows = spark.range(n).select(F.col("id").alias("cycle_id"), F.get(F.array(*[F.lit(x) for x in FAMILIES]), (F.col("id") % len(FAMILIES)).cast("int")).alias("family"), (F.floor(F.col("id") / len(FAMILIES)) / per_family).alias("form"))
    period = F.col("form") * 1.5 + 0.5
    grid = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: i / SAMPLES)
    return rows.select("cycle_id", "family", "form", period.alias("period"), F.transform(grid, lambda p: p * period).alias("t"), F.transform(grid, lambda p: 6 + wave(F.col("family"), p, F.col("form"))).alias("f"))


def paired_intervals(cycles: DataFrame) -> DataFrame:
    """For each cycle one of intervals: ten times the period, a fiftieth of the excursion, around 0.08 of the centre."""
    return cycles.select("cycle_id", "family", "form", (F.col("period") * 10).alias("period"), F.transform("t", lambda x: x * 10).alias("t"), F.transform("f", lambda x: (x - 6) * 0.02 + 6 * 0.08).alias("f"))


def event_workload(spark: SparkSession, recordings: int = 50, events: int = 1_000_000, template: int = 64) -> DataFrame:
    """Events dealt to recordings in turn, each repeating a template of values with a slow drift."""
    idx = F.floor(F.col("id") / recordings)
    place = F.pmod(idx, F.lit(template))
    return spark.range(events).select(
        F.pmod(F.col("id"), F.lit(recordings)).alias("recording_id"), idx.alias("event_idx"), (idx * 10 + F.pmod(place * 7, F.lit(5))).cast("double").alias("t"),
        (100 + F.sin(place * 2 * F.pi() / template) * 10 + idx / 10000).alias("frequency"), (10 + F.pmod(place * 3, F.lit(7))).cast("double").alias("pri"), F.when(place % 9 != 0, (1 + place % 4).cast("double")).alias("pw"),
    )
