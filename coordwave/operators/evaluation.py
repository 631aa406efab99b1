"""Calibration and evaluation: metrics, thresholds, bootstrap. Metrics are DataFrame aggregations."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid
from ..sources.shared import materialise

BINS = 5
#: Ranges of scores that are ordered apart from each other, at most.
RANGES = 2000
#: Width of a cell of standardised scores, and the powers of the distance to its middle that are added up in it: with slopes
#: up to 30 the series of the curve inside a cell is exact to rounding.
CELL, POWERS = 1 / 64, 14


def metrics(outcomes: DataFrame) -> DataFrame:
    """Counts of right and wrong decisions. outcomes: (expected, predicted) regions, null for unfamiliar."""
    known, taken = F.col("expected").isNotNull(), F.col("predicted").isNotNull()
    same = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False))
    counts = outcomes.agg(
        F.count_if(known).alias("n_known"), F.count_if(~known).alias("n_unfamiliar"),
        F.count_if(same).alias("known_correct"), F.count_if(~known & ~taken).alias("unfamiliar_correct"),
        F.count_if(~known & taken).alias("false_merges"), F.count_if(known & ~taken).alias("false_splits"), F.count_if(known & taken & ~same).alias("wrong_groups"),
    )
    half = [F.coalesce(F.try_divide(a, b), F.lit(0.0)) for a, b in (("known_correct", "n_known"), ("unfamiliar_correct", "n_unfamiliar"))]
    return counts.withColumn("balanced_accuracy", F.round((half[0] + half[1]) / 2, 9))


def calibration_error(pairs: DataFrame) -> DataFrame:
    """Brier score and expected calibration error over BINS bins; both classes weigh the same. pairs: (score, y)."""
    n = pairs.agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros"))
    weight = F.when(F.col("y") == 1, 0.5 / F.col("ones")).otherwise(0.5 / F.col("zeros"))
    rows = pairs.crossJoin(F.broadcast(n)).select("score", "y", weight.alias("w"), F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin"))  # one row of counts
    by = rows.groupBy("bin").agg(F.sum(F.col("w") * F.col("score")).alias("s"), F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (F.col("score") - F.col("y")) ** 2).alias("b"))
    return by.agg(F.round(F.sum("b"), 6).alias("brier"), F.round(F.sum(F.abs(F.col("s") - F.col("p"))), 6).alias("ece"))


def _ranges(rows: DataFrame, column: str) -> DataFrame:
    """rows (without null or NaN in column) with `part`: the number of the range of values, up to RANGES of them."""
    n = min(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(rows.approxQuantile(column, [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    splits = [-float("inf"), *(c for c in cuts if abs(c) < float("inf")), float("inf")]
    if len(splits) == 2:
        return rows.withColumn("part", F.lit(0))
    placed = Bucketizer(splits=splits, inputCol=column, outputCol="part").transform(rows)
    return placed.withColumn("part", F.col("part").cast("int"))


def _with_carried(placed: DataFrame, carried: list[tuple]) -> DataFrame:
    """placed with what each range gets from its neighbours: (part, values...) of RANGES rows at most, sent to each task."""
    names = [f"carried{k}" for k in range(len(carried[0]) - 1)] if carried else ["carried0"]
    kind = ", ".join(["part int", *(f"{n} double" for n in names)])
    return placed.join(F.broadcast(placed.sparkSession.createDataFrame(carried, kind)), "part", "left")


def threshold_grid(scores: DataFrame) -> DataFrame:
    """The midpoints between neighbouring different scores, by ranges; each begins at the last score before it. Null
    and NaN scores don't count."""
    kept = scores.select(F.col("score").cast("double").alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    placed = _ranges(kept.distinct(), "score")
    last = sorted(tuple(r) for r in placed.groupBy("part").agg(F.max("score").alias("last")).collect())  # a row a range
    carried = [(high, low_last) for (_, low_last), (high, _) in zip(last[:-1], last[1:], strict=True)]
    before = F.coalesce(F.lag("score").over(Window.partitionBy("part").orderBy("score")), F.col("carried0"))
    return _with_carried(placed, carried).select(((F.col("score") + before) / 2).alias("threshold")).where("threshold IS NOT NULL")


class MissingClass(ValueError):
    """Pairs to calibrate by that all match, or of which none does."""


def fit_logistic(score: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 0.2, penalty: float = 0.01):
    """(mean, scale, slope, intercept) of a logistic curve over standardised scores, by gradient steps from 0 with
    both classes weighing the same; slope 0 to 30, intercept -30 to 30, scale 0.01 at least. A missing class or a
    score that isn't finite is an error."""
    if not ((y == 1).any() and (y == 0).any()) or not np.isfinite(score).all():
        raise ValueError("calibration needs finite scores of both classes")
    mean, scale = score.mean(), max(score.std(), 0.01)
    x, slope, intercept = (score - mean) / scale, 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(slope * x + intercept, -700, 700))) - y)
        slope = float(np.clip(slope - rate * ((error * x).sum() + penalty * slope), 0, 30))
        intercept = float(np.clip(intercept - rate * error.sum(), -30, 30))
    return float(mean), float(scale), slope, intercept


def _series() -> np.ndarray:
    """Row k: the coefficients, by powers of the curve's value s, of its k-th derivative over k!."""
    row, rows = np.zeros(POWERS + 2), []
    row[1] = 1.0
    for k in range(POWERS):
        rows.append(row)
        slope = np.arange(1, len(row)) * row[1:]  # by s; the curve's own slope is s - s^2
        row = (np.concatenate(([0.0], slope)) - np.concatenate(([0.0, 0.0], slope[:-1]))) / (k + 1)
    return np.array(rows)


def _fit_by_cells(rows: DataFrame) -> tuple[float, float, float, float]:
    """fit_logistic of a table (score, y) of any size, with its defaults: the driver holds POWERS sums a cell of scores, not
    the scores. A step's sums over the rows of a cell follow from the curve's series around the cell's middle."""
    score = F.col("score")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    n = rows.agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros"), F.avg(number(score)).alias("mean"), F.stddev_pop(number(score)).alias("scale")).first()
    if not n["ones"] or not n["zeros"]:
        raise MissingClass("calibration needs scores of both classes")
    if not np.isfinite(n["mean"]) or not np.isfinite(n["scale"]):
        raise ValueError("calibration needs finite scores")
    mean, scale = n["mean"], max(n["scale"], 0.01)
    x = (score - mean) / scale
    placed = rows.select(x.alias("x"), "y", F.floor(x / CELL).alias("cell")).withColumn("d", F.col("x") - (F.col("cell") + 0.5) * CELL)
    powers = [F.count(F.lit(1)).cast("double"), *[F.sum(F.pow("d", F.lit(float(k)))) for k in range(1, POWERS + 1)]]
    sums = placed.groupBy("cell", "y").agg(F.sum("x").alias("x"), F.array(*powers).alias("powers")).toPandas().sort_values(["cell", "y"])  # cells, not rows
    y, moments = sums["y"].to_numpy(), np.stack(sums["powers"].to_list())
    weight = np.where(y == 1, 0.5 / n["ones"], 0.5 / n["zeros"])
    middle, moments = (sums["cell"].to_numpy(float) + 0.5) * CELL, moments * weight[:, None]
    first = float((weight * y * sums["x"].to_numpy()).sum())
    # Sums of x times a power of d: x is the middle and d.
    by_x = middle[:, None] * moments[:, :POWERS] + moments[:, 1:]
    series, slope, intercept = _series(), 0.0, 0.0
    for _ in range(1500):
        s = 1 / (1 + np.exp(-np.clip(slope * middle + intercept, -700, 700)))
        terms = np.vander(s, series.shape[1], increasing=True) @ series.T * slope ** np.arange(POWERS)
        by_slope, by_one = float((terms * by_x).sum()) - first, float((terms * moments[:, :POWERS]).sum()) - 0.5
        slope = float(np.clip(slope - 0.2 * (by_slope + 0.01 * slope), 0, 30))
        intercept = float(np.clip(intercept - 0.2 * by_one, -30, 30))
    return float(mean), float(scale), slope, intercept


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `number`, 0, 1, ... in order of a key that no two share: places in ranges of the key, each behind all of
    the ranges before it (a row a range comes to the driver)."""
    n = min(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(rows.repartitionByRange(n, key).withColumn("part", F.spark_partition_id()), "ranges")
    counted, before = [], 0
    for r in placed.groupBy("part").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect():
        counted.append((r["part"], before))
        before += r["n"]
    offset = rows.sparkSession.createDataFrame(counted, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return placed.withColumn("place", place).join(F.broadcast(offset), "part").withColumn("number", F.col("place") + F.col("before")).drop("part", "place", "before")


def _states(seed: int, steps: np.ndarray) -> np.ndarray:
    """The congruential stream's states after so many steps: powers of the step, by the bits of each number."""
    factor, add, mask = 1664525, 1013904223, (1 << 32) - 1
    state, left = np.full(len(steps), seed, np.uint64), steps.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        state[odd] = (state[odd] * np.uint64(factor) + np.uint64(add)) & np.uint64(mask)
        factor, add = factor * factor & mask, (factor + 1) * add & mask
        left >>= np.uint64(1)
    return state


def source_interval(outcomes: DataFrame, reps: int = 500, seed: int = 20261007, low: int = 12, high: int = 487) -> DataFrame:
    """(low, high, n_known, n_unfamiliar): order statistics of the balanced accuracy over resamples of whole sources.
    Each repetition draws as many sources with a known region as there are, then as many unfamiliar ones, by the next numbers
    of one congruential stream; sources are numbered by their first outcome. outcomes: (source_id, place, expected, correct),
    places unique; with `other`, whether a second method is correct, the interval is of the difference. No rows: nulls.

    Draw m of the stream is reached by itself, so draws are rows of any task: they meet the sources' sums by number, and
    are added by repetition."""
    spark, paired = outcomes.sparkSession, "other" in outcomes.columns
    known = F.col("expected").isNotNull()
    rows = outcomes if paired else outcomes.withColumn("other", F.lit(False))
    sums = rows.groupBy("source_id").agg(
        F.min("place").alias("first"), F.min_by(known, "place").alias("known"), F.count_if(known).alias("kn"), F.count_if(~known).alias("un"),
        *[F.count_if(k & F.col(c)).alias(f"{name}{c[0]}") for c in ("correct", "other") for name, k in (("k", known), ("u", ~known))],
    )
    sums = materialise(sums, "sums")
    pools = [sums.where("known"), sums.where("NOT known")]
    n = [p.count() for p in pools]
    sources = materialise(numbered(pools[0], "first").unionByName(numbered(pools[1], "first").withColumn("number", F.col("number") + n[0])), "sources")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0).to_numpy()
            strange = m % sum(n) >= n[0]
            drawn = np.floor(_states(seed, m + 1) / float(1 << 32) * np.where(strange, n[1], n[0])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m // sum(n)), pa.array(drawn + np.where(strange, n[0], 0))], ["rep", "number"])

    drawn = spark.range(reps * sum(n)).mapInArrow(run, "rep long, number long").groupBy("rep", "number").agg(F.count(F.lit(1)).alias("times"))
    total = lambda c: F.sum(F.col("times") * F.col(c))
    accuracy = lambda c: 0.5 * (total(f"k{c}") / F.greatest(total("kn"), F.lit(1)) + total(f"u{c}") / F.greatest(total("un"), F.lit(1)))
    value = accuracy("c") - accuracy("o") if paired else accuracy("c")
    each = drawn.join(sources, "number").groupBy("rep").agg(value.alias("value"))
    placed = each.withColumn("place", F.row_number().over(Window.orderBy("value")) - 1)  # a row a repetition
    at = lambda k, name: F.max(F.when(F.col("place") == k, F.col("value"))).alias(name)
    return placed.agg(at(low, "low"), at(high, "high")).select("low", "high", F.lit(n[0]).cast("long").alias("n_known"), F.lit(n[1]).cast("long").alias("n_unfamiliar"))


def tune(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The threshold of greatest balanced accuracy on scored examples (expected, region, score); then fewer false
    merges, then nearest to 0.5. All thresholds are tried: counts of the examples at or over each are sums over the
    ordered scores, by ranges; each begins with the sums of the ranges over it."""
    known, taken = F.col("expected").isNotNull(), F.col("region").isNotNull()
    right = (known & taken & (F.col("expected") == F.col("region"))).cast("long")
    examples = scored.where("score IS NOT NULL AND NOT isnan(score)").select(F.col("score").cast("double").alias("at"), F.coalesce(right, F.lit(0)).alias("right"), (~known & taken).cast("long").alias("merged"), F.lit(False).alias("tried"))
    grid = thresholds.where("threshold IS NOT NULL").select(F.col("threshold").cast("double").alias("at"), F.lit(0).cast("long").alias("right"), F.lit(0).cast("long").alias("merged"), F.lit(True).alias("tried"))
    sums = [F.sum(c).alias(c) for c in ("right", "merged")]
    placed = _ranges(examples.unionByName(grid).groupBy("at").agg(*sums, F.max("tried").alias("tried")), "at")
    n = scored.agg(F.count_if(known).alias("known"), F.count_if(~known).alias("strange")).first()
    carried, over = [], (0, 0)
    for r in sorted(placed.groupBy("part").agg(*sums).collect(), key=lambda r: -r["part"]):  # a row a range
        carried.append((r["part"], float(over[0]), float(over[1])))
        over = (over[0] + r["right"], over[1] + r["merged"])
    down = Window.partitionBy("part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    all_over = lambda c, k: (F.sum(c).over(down) + F.col(f"carried{k}")).cast("long")
    counted = _with_carried(placed, carried).select(F.col("at").alias("threshold"), "tried", all_over("right", 0).alias("hits"), all_over("merged", 1).alias("false_merges"))
    refused = (n["strange"] - F.col("false_merges")) / n["strange"] if n["strange"] else F.lit(0.0)
    found = F.col("hits") / n["known"] if n["known"] else F.lit(0.0)
    by = counted.where("tried").select("threshold", F.round((found + refused) / 2, 12).alias("accuracy"), "false_merges")
    return by.orderBy(F.desc("accuracy"), "false_merges", F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def recall_at_1(nearest: DataFrame) -> DataFrame:
    """The share of queries whose best match has their label, overall and by quantity. nearest: (query_id,
    quantity, label, match_label, score, match_id)."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    top = nearest.withColumn("n", F.row_number().over(best)).where("n = 1")
    return top.rollup("quantity").agg(F.round(F.avg((F.col("label") == F.col("match_label")).cast("double")), 9).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def split_summary(examples: DataFrame) -> DataFrame:
    """Examples, different sources, known and unfamiliar ones of each split. examples: (split, source_id, expected)."""
    known = F.col("expected").isNotNull()
    return examples.groupBy("split").agg(F.count(F.lit(1)).alias("examples"), F.count_distinct("source_id").alias("sources"), F.count_if(known).alias("known"), F.count_if(~known).alias("unfamiliar"))


def split_violations(examples: DataFrame, reference: DataFrame) -> DataFrame:
    """V7: (rule, subject) for each broken rule of an evaluation dataset: a source or a shape in several splits, a source
    with several labels, a shape that the reference has, a split without known or without unfamiliar examples.
    examples: (source_id, split, expected, shape); reference: (shape)."""
    several = lambda key, what, rule: examples.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(what).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("subject"))
    label = F.coalesce(F.col("expected").cast("string"), F.lit("none"))
    counted = split_summary(examples)
    bare = counted.select(F.explode(F.array_compact(F.array(F.when(F.col("known") == 0, "no known example"), F.when(F.col("unfamiliar") == 0, "no unfamiliar example")))).alias("rule"), F.col("split").cast("string").alias("subject"))
    known = examples.select("shape").distinct().join(reference.select("shape").distinct(), "shape", "left_semi").select(F.lit("shape is in the reference").alias("rule"), F.col("shape").cast("string").alias("subject"))
    found = several("source_id", F.col("split"), "source in several splits").unionByName(several("source_id", label, "source with several labels"))
    return found.unionByName(several("shape", F.col("split"), "shape in several splits")).unionByName(known).unionByName(bare)


def calibrated(score: Column, model: dict[str, float]) -> Column:
    """A score's calibrated value. model: mean, scale, slope, intercept."""
    return sigmoid(model["intercept"] + model["slope"] * (score - model["mean"]) / model["scale"])


def prepare_pairs(examples: DataFrame, representatives: DataFrame, scores: DataFrame) -> DataFrame:
    """E5: (example_id, split, expected, region_id, representative_id, formula, overlap): each example with each
    representative that has a score with it. examples: (example_id, split, expected); representatives: (region_id,
    representative_id); scores: (example_id, representative_id, formula, overlap)."""
    return examples.join(scores, "example_id").join(representatives, "representative_id").select("example_id", "split", "expected", "region_id", "representative_id", "formula", "overlap")


def predict(pairs: DataFrame, share: float, threshold: float, calibration: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(example_id, expected, predicted, score, correct): the region of the best pair, ties by region and
    representative, if its combined score reaches the threshold; null otherwise. The overlap has what the share, a decimal
    setting, leaves of 1: 0.3 beside 0.7, not 0.30000000000000004."""
    value = lambda c: calibrated(F.col(c), calibration[c]) if calibration else F.col(c)
    combined = share * value("formula") + float(1 - Decimal(str(share))) * value("overlap")
    best = pairs.withColumn("combined", combined).groupBy("example_id").agg(F.first("expected").alias("expected"), F.min(F.struct((-F.col("combined")).alias("low"), "region_id", "representative_id")).alias("best"))
    score = -F.col("best.low")
    region = F.when(score >= threshold, F.col("best.region_id"))
    return best.select("example_id", "expected", region.alias("predicted"), score.alias("score"), region.eqNullSafe(F.col("expected")).alias("correct"))


def tune_shares(pairs: DataFrame, shares: list[float], calibration: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(share, threshold, accuracy, false_merges) of the best setting on the tune split: for each share the thresholds are
    1 and all midpoints over 0 between neighbours among 0, 1 and the scores; then greatest accuracy, fewer false merges, the higher share, the threshold
    nearest to 0.5. Another split than `tune` is an error."""
    if pairs.where("split <> 'tune' OR split IS NULL").take(1) or pairs.isEmpty():
        raise ValueError("parameters are chosen on the tune split only")
    found = None
    for share in shares:  # a few settings
        scored = predict(pairs, share, 0.0, calibration).select("expected", F.col("predicted").alias("region"), "score")
        ends = scored.sparkSession.createDataFrame([(0.0,), (1.0,)], "score double")
        grid = threshold_grid(scored.select("score").unionByName(ends)).unionByName(ends.select(F.col("score").alias("threshold")))
        best = tune(scored, grid.where("threshold > 0 AND threshold <= 1").distinct()).select(F.lit(share).alias("share"), "threshold", "accuracy", "false_merges")
        found = best if found is None else found.unionByName(best)
    return found.orderBy(F.desc("accuracy"), "false_merges", F.desc("share"), F.abs(F.col("threshold") - 0.5)).limit(1)


def fitted(pairs: DataFrame) -> dict[str, dict[str, float]]:
    """Calibrations of formula and overlap, fitted to the fit split's pairs, all of them: the driver gets sums by cells
    of the scores (_fit_by_cells)."""
    fit = pairs.where("split = 'fit'").select("formula", "overlap", F.coalesce(F.col("expected") == F.col("region_id"), F.lit(False)).cast("int").alias("y"))
    fit = materialise(fit, "fit")
    return {c: dict(zip(("mean", "scale", "slope", "intercept"), _fit_by_cells(fit.select(F.col(c).alias("score"), "y")), strict=True)) for c in ("formula", "overlap")}


def _calibrations(pairs: DataFrame) -> dict[str, dict[str, float]] | None:
    """fitted, or None (and a warning) where the fit split lacks a class, so that no calibration exists."""
    try:
        return fitted(pairs)
    except MissingClass as missing:
        warnings.warn(f"{missing}: calibrated methods have no setting", stacklevel=2)
        return None


def _unmeasured(row: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """A method's row with nulls but for the columns kept."""
    return row.select(*[c if c in kept else F.lit(None).cast(row.schema[c].dataType).alias(c) for c in row.columns])


def evaluate(pairs: DataFrame, shares: list[float]) -> DataFrame:
    """One row for each of the methods formula, overlap, tuned and calibrated: fitted on the fit split, tuned on the
    tune split, then frozen and measured on the test split. Where the fit split lacks a class, nothing can be calibrated:
    that method's row has nulls. pairs: as prepare_pairs gives them."""
    pairs = materialise(pairs, "pairs")
    on = {s: pairs.where(F.col("split") == s) for s in ("tune", "test")}
    model, made = _calibrations(pairs), None
    for method, tried, calibration in (("formula", [1.0], None), ("overlap", [0.0], None), ("tuned", shares, None), ("calibrated", shares, model)):
        exists = method != "calibrated" or model is not None
        best = tune_shares(on["tune"], tried, calibration).first() if exists else {"share": 1.0, "threshold": 1.0}
        row = metrics(predict(on["test"], best["share"], best["threshold"], calibration)).select(F.lit(method).alias("method"), F.lit(best["share"]).alias("share"), F.round(F.lit(best["threshold"]), 9).alias("threshold"), "n_known", "n_unfamiliar", "known_correct", "unfamiliar_correct", "balanced_accuracy")
        row = row if exists else _unmeasured(row, ("method", "n_known", "n_unfamiliar"))
        made = row if made is None else made.unionByName(row)
    return made


#: The settings that aren't tuned, and the shares that the blend tries (fixed values).
RAW_DEFAULT, HYBRID_DEFAULT, BLENDS = (1.0, 0.82), (0.7, 0.65), [0.25, 0.5, 0.75]


def run_evaluation(pairs: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """E9 whole: `methods`, `paired` and `diagnostics`.

    Calibrations are fitted on the fit split and settings chosen on the tune split before a test label is looked at. methods:
    a row for each of raw-default, raw-tuned, calibrated-formula, calibrated-blend and raw-hybrid-default with its setting,
    its counts on the test split, the interval of its balanced accuracy over sources, and whether it is recommended: the
    calibrated blend, if on the tune split it is more accurate than the calibrated formula or as accurate with fewer false
    merges, else that formula. paired: the blend's accuracy less the formula's and its interval. diagnostics: Brier score and
    calibration error of four series of test pairs (nulls where a class is missing). Where the fit split lacks a class, nothing
    can be calibrated: rows, interval and series of calibrated scores have nulls, and no method is recommended. pairs: as
    prepare_pairs gives them; sources: (example_id, source_id); outcomes count in order of example ids."""
    pairs = materialise(pairs, "pairs")
    tune_, test = pairs.where("split = 'tune'"), pairs.where("split = 'test'")
    model, none = _calibrations(pairs), {"share": 1.0, "threshold": 1.0, "accuracy": 0.0, "false_merges": 0}
    raw, formula, blend = (none if c == {} else tune_shares(tune_, shares, c).first() for shares, c in (([1.0], None), ([1.0], model or {}), (BLENDS, model or {})))
    better = blend["accuracy"] > formula["accuracy"] + 1e-12 or (abs(blend["accuracy"] - formula["accuracy"]) < 1e-12 and blend["false_merges"] < formula["false_merges"])
    chosen = (
        ("raw-default", RAW_DEFAULT, None), ("raw-tuned", (raw["share"], raw["threshold"]), None), ("calibrated-formula", (formula["share"], formula["threshold"]), model),
        ("calibrated-blend", (blend["share"], blend["threshold"]), model), ("raw-hybrid-default", HYBRID_DEFAULT, None),
    )
    made, seen = None, {}
    for method, (share, threshold), calibration in chosen:
        exists = model is not None or not method.startswith("calibrated")
        outcomes = materialise(predict(test, share, threshold, calibration).join(sources, "example_id").withColumnRenamed("example_id", "place"), "outcomes")
        seen[method] = outcomes
        row = metrics(outcomes).crossJoin(F.broadcast(source_interval(outcomes).select("low", "high")))  # one row each
        recommended = exists and method == ("calibrated-blend" if better else "calibrated-formula")
        row = row.select(F.lit(method).alias("method"), F.lit(share).alias("share"), F.lit(threshold).alias("threshold"), F.lit(recommended).alias("recommended"), *[c for c in row.columns])
        row = row if exists else _unmeasured(row, ("method", "recommended", "n_known", "n_unfamiliar"))
        made = row if made is None else made.unionByName(row)
    both = seen["calibrated-blend"].join(seen["calibrated-formula"].select("place", F.col("correct").alias("other")), "place")
    paired = source_interval(both).select("low", "high")
    paired = paired if model else _unmeasured(paired, ())
    rows = test.select("formula", "overlap", F.coalesce(F.col("expected") == F.col("region_id"), F.lit(False)).cast("int").alias("y"))
    series = [(f"{kind} {c}", F.col(c) if kind == "raw" else calibrated(F.col(c), model[c]) if model else F.lit(None).cast("double")) for c in ("formula", "overlap") for kind in ("raw", "calibrated")]
    found = None
    for name, score in series:
        one = calibration_error(rows.select(score.alias("score"), "y")).select(F.lit(name).alias("series"), "brier", "ece")
        found = one if found is None else found.unionByName(one)
    return {"methods": made, "paired": paired, "diagnostics": found}


def component_bootstrap(groups: list[int], correct: np.ndarray, reps: int = 1000, seed: int = 20261007) -> tuple[float, float]:
    """The middle 95 % of the mean over resamples of whole groups; one sum a group is all that it needs."""
    names, at = np.unique(groups, return_inverse=True)
    total, n = np.bincount(at, correct), np.bincount(at)
    drawn = np.random.default_rng(seed).integers(0, len(names), (reps, len(names)))
    means = np.sort(total[drawn].sum(axis=1) / n[drawn].sum(axis=1))
    return float(means[int(0.025 * reps)]), float(means[int(0.975 * reps) - 1])


#: Bounds of calibrations and grouping settings (fixed values).
_CALIBRATION = {"mean": (0, 1), "scale": (0.01, 1), "slope": (0, 30), "intercept": (-30, 30)}


def calibration_violations(profiles: DataFrame) -> DataFrame:
    """V6: (profile_id, rule) for each value of a calibration out of its bounds or not finite. profiles: (profile_id, mean,
    scale, slope, intercept)."""
    broken = [F.when(F.coalesce(F.isnan(c) | ~F.col(c).between(low, high), F.lit(True)), c) for c, (low, high) in _CALIBRATION.items()]
    return profiles.select("profile_id", F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def grouping_violations(settings: DataFrame) -> DataFrame:
    """V5: (settings_id, rule): threshold over 0 up to 1, formula share 0 to 1, no negative weight, some weight over 0, and a
    calibration of the settings' own quantity. settings: (settings_id, threshold, share, w_shape, w_period, w_excursion,
    w_centre, quantity, calibration_quantity)."""
    weights = [F.coalesce(f"w_{w}", F.lit(-1.0)) for w in ("shape", "period", "excursion", "centre")]
    broken = [
        F.when(~F.coalesce((F.col("threshold") > 0) & (F.col("threshold") <= 1), F.lit(False)), "threshold"),
        F.when(~F.coalesce(F.col("share").between(0, 1), F.lit(False)), "share"),
        F.when(F.least(*weights) < 0, "negative weight"),
        F.when(F.greatest(*weights) <= 0, "no weight"),
        F.when(F.col("calibration_quantity").isNotNull() & ~F.col("calibration_quantity").eqNullSafe(F.col("quantity")), "calibration"),
    ]
    return settings.select("settings_id", F.explode(F.array_compact(F.array(*broken))).alias("rule"))
