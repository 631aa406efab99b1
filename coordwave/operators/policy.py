"""Group policy: merge proposals, admission of incoming cycles, near-duplicate components, novelty, placement."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .components import labels

#: Margins of the group policy (fixed values).
CORE, COMPETITION, LEAST_SHAPES, NEAR = 0.08, 0.05, 3, 0.005
#: Members of a group that are compared with another group's at once, and tasks at most.
BLOCK, MOST_TASKS = 5000, 20_000


def merge_proposals(members: DataFrame, representatives: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """(group_a, group_b, weakest) of groups whose members all score at least threshold across, and whose
    representatives all score at least the core threshold. members, representatives: (id, group_id); scores: (a, b,
    score) of pairs, a < b; a missing pair never qualifies."""
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))

    def across(side: DataFrame, least: float) -> DataFrame:
        one, two = side.select(F.col("id").alias("a"), F.col("group_id").alias("ga")), side.select(F.col("id").alias("b"), F.col("group_id").alias("gb"))
        pairs = scores.join(one, "a").join(two, "b").where("ga <> gb").select(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b"), "score")
        found = pairs.groupBy("group_a", "group_b").agg(F.min("score").alias("weakest"), F.count(F.lit(1)).alias("pairs"))
        n = side.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
        counted = found.join(n.select(F.col("group_id").alias("group_a"), F.col("n").alias("na")), "group_a").join(n.select(F.col("group_id").alias("group_b"), F.col("n").alias("nb")), "group_b")
        return counted.where((F.col("pairs") == F.col("na") * F.col("nb")) & (F.col("weakest") + 1e-12 >= least)).select("group_a", "group_b", "weakest")

    core = across(representatives, min(1.0, threshold + CORE)).select("group_a", "group_b")
    return across(members, threshold).join(core, ["group_a", "group_b"]).join(sizes.select(F.col("group_id").alias("group_a")), "group_a", "left_semi")


def scored_proposals(members: DataFrame, representatives: DataFrame, beside: DataFrame, score: Callable[[Column, Column], Column], threshold: float) -> DataFrame:
    """merge_proposals of neighbouring groups, for scores that follow from two ids, the smaller first: no pair of members is
    written or shuffled. beside: (group_a, group_b), a < b, once each. Representatives are asked first; the members of what is
    left meet in blocks that are dealt over tasks, each of which keeps a minimum and a count for two groups."""

    def across(side: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
        n = side.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
        sized = pairs.join(n.select(F.col("group_id").alias("group_a"), F.col("n").alias("na")), "group_a").join(n.select(F.col("group_id").alias("group_b"), F.col("n").alias("nb")), "group_b")
        sized = materialise(sized.withColumn("blocks", F.ceil(F.col("na") / BLOCK)), "sized")
        work = sized.agg(F.sum(F.col("na") / BLOCK * F.col("nb") / BLOCK)).first()[0] or 0
        tasks = max(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(work), MOST_TASKS))
        block = {"a": F.pmod(F.xxhash64("id"), F.col("blocks")), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))}

        def dealt(s: str) -> DataFrame:
            rows = sized.join(side.select("id", F.col("group_id").alias(f"group_{s}")), f"group_{s}")
            return rows.select("group_a", "group_b", F.col("id").alias(s), block[s].alias("block")).repartition(tasks, "group_a", "group_b", "block")

        met = dealt("a").hint("shuffle_hash").join(dealt("b"), ["group_a", "group_b", "block"]).where("a <> b")
        found = met.groupBy("group_a", "group_b").agg(F.min(score(F.least("a", "b"), F.greatest("a", "b"))).alias("weakest"), F.count(F.lit(1)).alias("pairs"))
        enough = (F.col("pairs") == F.col("na") * F.col("nb")) & (F.col("weakest") + 1e-12 >= least)
        return found.join(sized, ["group_a", "group_b"]).where(enough).select("group_a", "group_b", "weakest")

    core = materialise(across(representatives, beside, min(1.0, threshold + CORE)).select("group_a", "group_b"), "core")
    return across(members, core, threshold)


def near_duplicate_components(nodes: DataFrame, distances: DataFrame, limit: float = NEAR) -> DataFrame:
    """(id, component): cycles linked by distances up to limit, so that a component stays in one split."""
    return labels(nodes, distances.where(F.col("distance") <= limit).select("a", "b"))


def novelty_threshold(nearest: DataFrame) -> DataFrame:
    """One and a half times the value at place floor(.95 n) of the sorted nearest distances, 0.15 at least; null
    without distances."""
    kept = nearest.where("distance IS NOT NULL").select("distance")
    n = kept.count()
    value = nth_smallest(kept, "distance", int(0.95 * n)) if n else None
    return nearest.sparkSession.createDataFrame([(None if value is None else max(0.15, 1.5 * value),)], "threshold double")


def nth_smallest(rows: DataFrame, column: str, n: int) -> float:
    """The value at place n (from 0) of a sorted column, by counting ranges: approximate quantiles narrow the interval
    that holds it, and only what lies in it is sorted."""
    size = rows.count()
    low, high = (rows.approxQuantile(column, [min(1.0, max(0.0, n / size + d))], 0.001)[0] for d in (-0.002, 0.002))
    below = rows.where(F.col(column) < low).count()
    inside = rows.where(F.col(column).between(low, high))
    if not below <= n < below + inside.count():
        inside, below = rows, 0
    return inside.orderBy(column).offset(n - below).limit(1).first()[0]


def region_ranges(members: DataFrame, value: str) -> DataFrame:
    """A10: the least and greatest value of each region's members. members: (region_id, value)."""
    return members.groupBy("region_id").agg(F.min(value).alias(f"least_{value}"), F.max(value).alias(f"most_{value}"), F.count(F.lit(1)).alias("n_members"))


def distinct_captures(members: DataFrame) -> DataFrame:
    """Different captures and shapes of each region; nulls don't count. members: (region_id, capture_id, shape)."""
    return members.groupBy("region_id").agg(F.count_distinct("capture_id").alias("captures"), F.count_distinct("shape").alias("shapes"))


def cohesion(members: DataFrame, scores: DataFrame) -> DataFrame:
    """(group_id, cohesion): the least score of two members of a group; 1 for a group of one. members: (id, group_id);
    scores: (a, b, score), a < b; a pair without a score counts as 0."""
    one, two = (members.select(F.col("id").alias(x), F.col("group_id").alias(f"group_{x}")) for x in "ab")
    inside = scores.join(one, "a").join(two, "b").where("group_a = group_b").groupBy(F.col("group_a").alias("group_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("pairs"))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    whole = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(inside, "group_id", "left").select("group_id", F.when(F.col("n") == 1, 1.0).when(F.coalesce("pairs", F.lit(0)) < whole, 0.0).otherwise(F.col("least")).alias("cohesion"))


def group_representatives(members: DataFrame, scores: DataFrame, tie: float = 1e-12) -> DataFrame:
    """(group_id, representative_id, total): the member of greatest total score inside its group, each counting 1 with
    itself; of those equal within tie the least id. members: (id, group_id); scores: (a, b, score), a < b."""
    both = scores.select("a", "b", "score").unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    one, two = (members.select(F.col("id").alias(x), F.col("group_id").alias(f"group_{x}")) for x in "ab")
    sums = both.join(one, "a").join(two, "b").where("group_a = group_b").groupBy(F.col("a").alias("id")).agg(F.sum("score").alias("s"))
    totals = members.join(sums, "id", "left").select("group_id", "id", (1 + F.coalesce("s", F.lit(0.0))).alias("total"))
    most = totals.groupBy("group_id").agg(F.max("total").alias("most"))
    return totals.join(most, "group_id").where(F.col("total") >= F.col("most") - tie).groupBy("group_id").agg(F.min("id").alias("representative_id"), F.min_by("total", "id").alias("total"))


def reconstruction_flags(cycles: DataFrame, most_gap: float = 0.05) -> DataFrame:
    """C20: (cycle_id, flagged): sparse cycles are flagged unless an approved extraction with small gaps. cycles: (cycle_id,
    sampling, approved, generator, gap_fraction)."""
    fine = F.coalesce(F.col("approved") & (F.col("generator") == "recording-extraction") & (F.col("gap_fraction") <= most_gap + 1e-12), F.lit(False))
    return cycles.select("cycle_id", (~fine & (F.col("sampling") == "sparse-periodic")).alias("flagged"))


def equivalence_classes(cycles: DataFrame, active: list[str]) -> DataFrame:
    """(cycle_id, class_id): the least cycle of the same shape key and the same values of the active scales. Shape keys
    are exact to their rounding, so equal keys are equivalent to it. cycles: (cycle_id, shape_key, ...)."""
    least = cycles.groupBy("shape_key", *active).agg(F.min("cycle_id").alias("class_id"))
    match = cycles["shape_key"].eqNullSafe(least["shape_key"])
    for c in active:
        match &= cycles[c].eqNullSafe(least[c])
    return cycles.join(least, match).select("cycle_id", "class_id")


def region_scores(scores: DataFrame, anchors: DataFrame, threshold: float) -> DataFrame:
    """(cycle_id, region_id, anchor_similarity, eligible, place): each region's greatest score over its anchors;
    eligible ones first, then by score and id. scores: (cycle_id, anchor_id, score); anchors: (region_id, anchor_id)."""
    by = scores.join(anchors, "anchor_id").groupBy("cycle_id", "region_id").agg(F.max("score").alias("anchor_similarity"))
    judged = by.withColumn("eligible", F.col("anchor_similarity") >= threshold)
    place = F.row_number().over(Window.partitionBy("cycle_id").orderBy(F.desc("eligible"), F.desc("anchor_similarity"), "region_id"))
    return judged.withColumn("place", place)


def embedding_stress(distances: DataFrame, points: DataFrame) -> DataFrame:
    """What an embedding's distances miss, relative to the distances. distances: (a, b, distance); points: (id, x, y)."""
    one, two = (points.select(F.col("id").alias(s), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}")) for s in "ab")
    got = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))
    rows = distances.join(one, "a").join(two, "b").select("distance", got.alias("got"))
    return rows.agg(F.sqrt(F.sum((F.col("distance") - F.col("got")) ** 2) / F.sum(F.col("distance") ** 2)).alias("stress"))


def medoid_objective(distances: DataFrame, medoids: DataFrame) -> DataFrame:
    """(medoid_id, n_members, objective): members go to their nearest medoid, ties to the lesser; medoids to
    themselves. distances: (a, b, distance), a < b; medoids: (medoid_id)."""
    both = distances.select("a", "b", "distance").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    near = both.join(medoids, F.col("b") == F.col("medoid_id")).select("a", "medoid_id", "distance").unionByName(medoids.select(F.col("medoid_id").alias("a"), "medoid_id", F.lit(0.0).alias("distance")))
    best = near.groupBy("a").agg(F.min(F.struct("distance", "medoid_id")).alias("m"))
    return best.groupBy(F.col("m.medoid_id").alias("medoid_id")).agg(F.count(F.lit(1)).alias("n_members"), F.sum("m.distance").alias("objective"))


def place(distances: np.ndarray, xy: np.ndarray, k: int = 5) -> np.ndarray:
    """The mean of the k nearest positions, by the inverse square of distance; an exact match has its place."""
    near = np.argsort(distances, kind="stable")[:k]
    if distances[near[0]] <= 1e-12:
        return xy[near[0]]
    w = 1 / distances[near] ** 2
    return (xy[near] * w[:, None]).sum(axis=0) / w.sum()
