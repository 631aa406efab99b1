"""Validation of cycles and raw recordings: (id, rule) for each broken rule, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_GAP = 0.2


def _listed(checked: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return checked.select(key, F.posexplode(names).alias("rule_order", "rule"))


def _gaps(t: Column, period: Column) -> Column:
    """Gaps between neighbouring times, the one around the period's end included."""
    n = F.size(t)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < n - 1, F.get(t, i + 1)).otherwise(F.get(t, F.lit(0)) + period) - F.get(t, i))


def cycle_violations(cycles: DataFrame) -> DataFrame:
    """V2: cycles (cycle_id, period, t, f, missing_times, sampling, interpolation, quantity) against their rules.

    sampling is closed-endpoint, uniform-open or sparse-periodic; null arrays count as empty.
    """
    t = F.coalesce("t", F.array().cast("array<double>"))
    f = F.coalesce("f", F.array().cast("array<double>"))
    missing = F.coalesce("missing_times", F.array().cast("array<double>"))
    n = F.size(t)
    inner = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(t, i) - F.get(t, i - 1))).otherwise(F.array().cast("array<double>"))
    span = (F.array_max(f) - F.array_min(f)) / 2
    last = F.get(t, n - 1)
    # A closed cycle's last sample stands at the period; its gaps are those without it.
    gaps = F.when(n > 0, F.array_max(_gaps(F.when(F.col("sampling") == "closed-endpoint", F.slice(t, 1, F.greatest(n - 1, F.lit(1)))).otherwise(t), F.col("period"))))
    uniform = F.exists(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.abs(F.get(t, i) - i * F.col("period") / n) > 1e-9 * F.col("period"))
    rules = {
        "period": ~(F.col("period") > 0) | F.col("period").isNull(),
        "sampling": ~F.col("sampling").isin("closed-endpoint", "uniform-open", "sparse-periodic"),
        "interpolation": (F.col("sampling") == "sparse-periodic") & F.col("interpolation").isNull(),
        "sample_count": ~n.between(8, 8193),
        "value_count": n != F.size(f),
        "start": (F.col("sampling") != "sparse-periodic") & (F.get(t, F.lit(0)) != 0),
        "order": F.exists(inner, lambda x: x <= 0),
        "missing_times": (F.size(F.array_distinct(missing)) != F.size(missing)) | F.arrays_overlap(missing, t) | F.exists(missing, lambda x: (x < 0) | (x >= F.col("period"))),
        "gap": gaps > MOST_GAP * F.col("period") + 1e-12,
        "positive": (F.col("quantity") == "pri") & F.exists(f, lambda x: x <= 0),
        "excursion": ~(span > 1e-12),
        "endpoint": (F.col("sampling") == "closed-endpoint") & ((F.abs(last - F.col("period")) > 1e-9 * F.col("period")) | (F.abs(F.get(f, n - 1) - F.get(f, F.lit(0))) > F.greatest(F.lit(1e-10), 1e-6 * span))),
        "grid": (F.col("sampling") == "uniform-open") & uniform,
    }
    return _listed(cycles, "cycle_id", rules)


def raw_violations(samples: DataFrame) -> DataFrame:
    """V3: raw recordings (recording_id, t, f, quantity; f null where missing) against their rules."""
    by = samples.groupBy("recording_id").agg(
        F.count("f").alias("seen"), F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("times"),
        (F.max(F.when(F.col("f").isNotNull(), F.col("t"))) - F.min(F.when(F.col("f").isNotNull(), F.col("t")))).alias("span"),
        (F.max("f") - F.min("f")).alias("range"),
        F.bool_or((F.col("quantity") == "pri") & (F.col("f") <= 0)).alias("negative"),
        F.bool_or(F.isnan("f") | (F.abs("f") == float("inf")) | F.isnan("t")).alias("odd"),
    )
    rules = {"not_finite": F.col("odd"), "positive": F.col("negative"), "few_samples": F.col("seen") < 8, "repeated_time": F.col("times") < F.col("n"), "no_span": ~(F.col("span") > 0), "infinite_range": F.col("range") == float("inf")}
    return _listed(by, "recording_id", rules)


def corpus_violations(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, key) of a corpus manifest (signal_id, source_id, leakage_group_id, split, sha256) and its test labels."""
    several = [("source in several splits", "source_id"), ("component in several splits", "leakage_group_id")]
    found = [manifest.groupBy(k).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(k).cast("string").alias("key")) for rule, k in several]
    views = manifest.groupBy("source_id").count().where("count <> 6").select(F.lit("source without six views").alias("rule"), F.col("source_id").cast("string").alias("key"))
    test = manifest.where("split = 'test'").select("signal_id")
    odd = [test.join(labels.select("signal_id"), "signal_id", "left_anti"), labels.select("signal_id").join(test, "signal_id", "left_anti")]
    rows = [*found, views, *[o.select(F.lit("labels and test rows differ").alias("rule"), F.col("signal_id").cast("string").alias("key")) for o in odd]]
    twice = manifest.groupBy("signal_id").count().where("count > 1").select(F.lit("repeated signal").alias("rule"), F.col("signal_id").cast("string").alias("key"))
    out = twice
    for r in rows:
        out = out.unionByName(r)
    return out
