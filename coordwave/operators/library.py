"""A library's groups: reviewed decisions as constraints, complete linkage, representatives, and what needs review.

Scores are a table of pairs; a pair that it lacks scores 0, two entries of one class score 1 (add such pairs). Decisions
are rows: reviewed groups with an anchor each, placements of entries, acknowledged entries. Nothing depends on the order
in which rows come.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .components import labels
from .linkage import TIE, linked
from .policy import COMPETITION, CORE

#: Classes of clear members that a region needs for representatives besides its anchors, and how many it gets (fixed values).
SHAPES, ADDED = 3, 2


def _both(pairs: DataFrame) -> DataFrame:
    """(x, y, score) of pairs in both directions."""
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "score").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "score"))


def placed(entries: DataFrame, links: DataFrame, groups: DataFrame, placements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pins (id, group_id) that reviewed decisions make, and the decisions that are paused (kind, subject, group_id).

    Anchors are pinned first. Then, in order of ids, a placement holds if its entry reaches the threshold with its group's
    anchor and with all entries placed there before it. In each round the placements are decided that no undecided lesser
    one could still keep out: those that reach the threshold with all lesser undecided ones. entries: (id); links: (a, b)
    that reach the threshold; groups: (group_id, anchor_id); placements: (id, group_id), an id once.
    """
    anchors = groups.join(entries.select(F.col("id").alias("anchor_id")), "anchor_id", "left_semi").select(F.col("anchor_id").alias("id"), "group_id")
    absent = groups.join(entries.select(F.col("id").alias("anchor_id")), "anchor_id", "left_anti").select(F.lit("anchor is absent").alias("kind"), F.col("anchor_id").alias("subject"), "group_id")
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    asked = placements.join(entries, "id", "left_semi").join(anchors.select("id"), "id", "left_anti")
    fits = asked.join(anchors.select(F.col("id").alias("y"), "group_id"), "group_id").join(both.withColumnRenamed("x", "id"), ["id", "y"], "left_semi")
    state = materialise(fits.select("id", "group_id", F.lit(None).cast("boolean").alias("holds")), "placed")
    # Links between two entries asked for the same group.
    one, two = state.select(F.col("id").alias("x"), "group_id"), state.select(F.col("id").alias("y"), "group_id")
    alike = materialise(both.where("y < x").join(one, "x").join(two, ["y", "group_id"]), "alike")
    before = Window.partitionBy("group_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    while state.where("holds IS NULL").take(1):
        seen = alike.join(state.select(F.col("id").alias("y"), "holds"), "y").groupBy(F.col("x").alias("id")).agg(F.count_if("holds").alias("with_held"), F.count_if(F.col("holds").isNull()).alias("with_open"))
        ahead = state.select("*", F.coalesce(F.count_if("holds").over(before), F.lit(0)).alias("held"), F.coalesce(F.count_if(F.col("holds").isNull()).over(before), F.lit(0)).alias("open")).join(seen, "id", "left").na.fill(0, ["with_held", "with_open"])
        now = F.when(F.col("with_held") < F.col("held"), False).when(F.col("with_open") == F.col("open"), True)
        state = materialise(ahead.select("id", "group_id", F.coalesce("holds", now).alias("holds")), "placed")
    pins = anchors.unionByName(state.where("holds").select("id", "group_id"))
    paused = asked.join(pins.select("id"), "id", "left_anti").select(F.lit("placement is paused").alias("kind"), F.col("id").alias("subject"), "group_id")
    return pins, absent.unionByName(paused)


def library_groups(entries: DataFrame, scores: DataFrame, groups: DataFrame, placements: DataFrame, acknowledged: DataFrame, threshold: float) -> DataFrame:
    """One row an entry: (id, group_id, cluster, reviewed, representative_id, group_size, cohesion, pinned, status, reasons).

    Complete linkage in which pinned entries of a reviewed group start together and two reviewed groups never merge. A
    group is called by its reviewed group or region-<least id>, with -1, -2 ... behind it where a reviewed group has that
    name. Its representative is the member of greatest total score with the group's classes (one entry a class counts),
    among the clear unflagged ones - cohesion of the core threshold -, else the unflagged, else all; equal ones by id.
    cohesion is the entry's least score in its group. reasons: reconstruction (flagged), borderline (cohesion under the core
    threshold), competition (an entry that isn't pinned reaches the threshold with all members of another group, whose
    representative is nearly as close as its own). status: core without reasons, fringe if they are acknowledged, else review.

    entries: (id, class_id, flagged); scores: (a, b, score), a < b; groups: (group_id, anchor_id); placements: (id, group_id);
    acknowledged: (id). Ids are longs, group ids texts.
    """
    core = min(1.0, threshold + CORE)
    entries = entries.select("id", "class_id", F.coalesce("flagged", F.lit(False)).alias("flagged"))
    links = materialise(scores.where(F.col("score") + TIE >= threshold).select("a", "b", "score"), "links")
    pins = materialise(placed(entries, links, groups, placements)[0], "pins")
    marked = entries.join(pins.withColumnRenamed("group_id", "mark"), "id", "left")
    found = linked(marked.select("id", "mark"), links, threshold)
    members = materialise(marked.join(found, "id"), "members")

    ends = links
    for end in ("a", "b"):
        ends = ends.join(members.select(F.col("id").alias(end), F.col("cluster").alias(f"cluster_{end}")), end)
    ends = materialise(ends, "ends")
    inside = _both(ends.where("cluster_a = cluster_b"))
    firsts = members.groupBy("cluster", "class_id").agg(F.min("id").alias("y"), F.count(F.lit(1)).alias("n"))
    first = firsts.select("y", F.lit(True).alias("counts"))
    sums = inside.join(first, "y", "left").groupBy(F.col("x").alias("id")).agg(F.min("score").alias("least"), F.sum(F.when(F.col("counts"), F.col("score"))).alias("s"))
    own = members.join(sums, "id", "left").join(first.withColumnRenamed("y", "id"), "id", "left")
    own = own.withColumn("cohesion", F.least(F.lit(1.0), F.coalesce("least", F.lit(1.0)))).withColumn("total", F.coalesce("s", F.lit(0.0)) + F.when(F.col("counts"), 1.0).otherwise(0.0))
    kind = F.when(F.col("flagged"), 2).when(F.col("cohesion") + TIE < core, 1).otherwise(0)
    own = materialise(own.select("id", "cluster", "mark", "flagged", "cohesion", "total", kind.alias("kind")), "own")
    pool = own.groupBy("cluster").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("group_size"), F.max("mark").alias("reviewed"))
    listed = own.join(pool.select("cluster", "kind"), ["cluster", "kind"])
    most = listed.groupBy("cluster").agg(F.max("total").alias("most"))
    medoid = listed.join(most, "cluster").where(F.col("total") >= F.col("most") - TIE).groupBy("cluster").agg(F.min("id").alias("representative_id"))
    group = materialise(_named(pool.join(medoid, "cluster")), "groups")

    # Other groups with all of whose members an entry reaches the threshold, and how near their representatives are.
    across = _both(ends.where("cluster_a <> cluster_b").select("a", "b", "score")).join(members.select(F.col("id").alias("y"), F.col("cluster").alias("other")), "y")
    leads = group.select(F.col("cluster").alias("other"), F.col("representative_id").alias("lead"), F.col("group_size").alias("size"))
    reached = across.join(leads, "other").groupBy(F.col("x").alias("id"), "other", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("y") == F.col("lead"), F.col("score"))).alias("near"))
    rival = reached.where("n = size").groupBy("id").agg(F.max("near").alias("rival"))
    to_own = inside.join(group.select(F.col("representative_id").alias("y")), "y").groupBy(F.col("x").alias("id")).agg(F.max("score").alias("own_near"))

    rows = own.drop("kind").join(group, "cluster").join(rival, "id", "left").join(to_own, "id", "left").join(acknowledged.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    near = F.when(F.col("id") == F.col("representative_id"), 1.0).otherwise(F.coalesce("own_near", F.lit(0.0)))
    reasons = F.array_compact(F.array(
        F.when(F.col("flagged"), "reconstruction"), F.when(F.col("cohesion") + TIE < core, "borderline"),
        F.when(F.col("mark").isNull() & (near - F.col("rival") < COMPETITION), "competition"),
    ))
    status = F.when(F.size("reasons") == 0, "core").when(F.col("known"), "fringe").otherwise("review")
    return rows.withColumn("reasons", reasons).select("id", "group_id", "cluster", "reviewed", "representative_id", "group_size", "cohesion", F.col("mark").isNotNull().alias("pinned"), status.alias("status"), "reasons")


def _named(groups: DataFrame) -> DataFrame:
    """groups with group_id; only those whose name a reviewed group has are looked at twice."""
    taken = groups.where("reviewed IS NOT NULL").select(F.col("reviewed").alias("name")).distinct()
    base = groups.withColumn("base", F.concat(F.lit("region-"), F.col("cluster").cast("string")))
    clash = base.where("reviewed IS NULL").join(taken, F.col("base") == F.col("name"), "left_semi")
    tried = clash.select("cluster", "base", F.posexplode(F.sequence(F.lit(1), F.lit(1 + taken.count()))).alias("at", "k"))
    free = tried.withColumn("name", F.concat("base", F.lit("-"), F.col("k").cast("string"))).join(taken, "name", "left_anti").groupBy("cluster").agg(F.min_by("name", "k").alias("suffixed"))
    return base.join(free, "cluster", "left").withColumn("group_id", F.coalesce("reviewed", "suffixed", "base")).drop("base", "suffixed")


def covering_members(members: DataFrame, scores: DataFrame, most: int = ADDED, shapes: int = SHAPES) -> DataFrame:
    """C17: (group_id, id, place): the representatives that cover a group: its anchors (place 0), then up to `most` core
    members of classes not chosen yet, each time the one whose best score with those chosen is least, ties by id; only for
    groups whose core has `shapes` classes. members: (group_id, id, class_id, anchor, core), scores: (a, b, score), a < b.

    Each place is one join of the chosen with the scores and one aggregation.
    """
    members = materialise(members, "members")
    chosen = members.where("anchor").select("group_id", "id", "class_id", F.lit(0).alias("place"))
    wide = members.where("core").groupBy("group_id").agg(F.count_distinct("class_id").alias("n")).where(F.col("n") >= shapes).select("group_id")
    both = materialise(_both(scores), "both")
    for place in range(1, most + 1):
        open_ = members.where("core").join(wide, "group_id", "left_semi").join(chosen.select("group_id", "class_id").distinct(), ["group_id", "class_id"], "left_anti")
        near = both.join(chosen.select(F.col("id").alias("y"), "group_id"), "y").groupBy("group_id", F.col("x").alias("id")).agg(F.max("score").alias("score"))
        best = open_.join(near, ["group_id", "id"], "left").groupBy("group_id").agg(F.min(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), F.col("id"), F.col("class_id"))).alias("best"))
        chosen = materialise(chosen.unionByName(best.select("group_id", "best.id", "best.class_id", F.lit(place).alias("place"))), "chosen")
    return chosen.select("group_id", "id", "place")


def first_fit(entries: DataFrame, alike: DataFrame) -> DataFrame:
    """(id, home): in order of ids, each entry joins the first cluster all of whose members it is alike to, or founds one; a
    cluster is called by its founder. entries: (id); alike: (a, b), a < b.

    Only founders that an entry is alike to can be its home, and their members are among the founder's neighbours. In each
    round an entry is decided once no lesser entry that it is alike to is open and, for its first founder whose members all
    agree, none of the founder's open lesser neighbours is left; the least open entry always is. So all rounds are joins with
    the links and running counts along each founder's neighbours.
    """
    links = materialise(alike.select("a", "b").distinct(), "alike")
    state = materialise(entries.select("id", F.lit(None).cast("long").alias("home")), "homes")
    along = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    while state.where("home IS NULL").take(1):
        known = links.join(state.select(F.col("id").alias("a"), F.col("home").alias("home_a")), "a").join(state.select(F.col("id").alias("b"), F.col("home").alias("home_b")), "b")
        known = materialise(known, "known")
        waits = known.where("home_b IS NULL").groupBy(F.col("b").alias("id")).agg(F.count_if(F.col("home_a").isNull()).alias("open"))
        own = known.where("home_b IS NULL AND home_a IS NOT NULL").groupBy("b", F.col("home_a").alias("a")).agg(F.count(F.lit(1)).alias("agree"))
        counted = known.where("home_a = a").select("a", "b", "home_b", F.coalesce(F.count_if(F.col("home_b") == F.col("a")).over(along), F.lit(0)).alias("members"), F.coalesce(F.count_if(F.col("home_b").isNull()).over(along), F.lit(0)).alias("coming"))
        asked = counted.where("home_b IS NULL").join(own, ["a", "b"])  # the founder itself is the first member
        judged = asked.where(F.col("agree") == F.col("members") + 1).groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", (F.col("coming") == 0).alias("sure"))).alias("first"))
        rows = state.join(waits, "id", "left").join(judged, "id", "left")
        home = F.when(F.coalesce("open", F.lit(0)) > 0, None).when(F.col("first").isNull(), F.col("id")).when(F.col("first.sure"), F.col("first.a"))
        state = materialise(rows.select("id", F.coalesce("home", home).alias("home")), "homes")
    return state


def split_proposals(fringe: DataFrame, scores: DataFrame, threshold: float, shapes: int = SHAPES) -> DataFrame:
    """(region_id, anchor_id, id, cohesion, n_classes): the members of each proposed split of a region's fringe.

    In order of ids each fringe entry of a region joins the first cluster with all of whose members it reaches the core
    threshold. A cluster of `shapes` classes or more is proposed if its weakest pair exceeds every member's similarity to the
    region's anchors by the competition margin; its anchor is the member of greatest total score, ties by id. fringe: (id,
    region_id, class_id, anchor_similarity), without flagged entries and anchors; a null similarity takes no part; scores:
    (a, b, score), a < b.
    """
    core = min(1.0, threshold + CORE)
    fringe = materialise(fringe.where("anchor_similarity IS NOT NULL").select("id", "region_id", "class_id", "anchor_similarity"), "fringe")
    inside = scores.where(F.col("score") >= core).select("a", "b", "score")
    for end in ("a", "b"):
        inside = inside.join(fringe.select(F.col("id").alias(end), F.col("region_id").alias(f"region_{end}")), end)
    inside = materialise(inside.where("region_a = region_b").select("a", "b", "score"), "inside")
    members = materialise(fringe.join(first_fit(fringe.select("id"), inside), "id"), "members")
    for end in ("a", "b"):
        inside = inside.join(members.select(F.col("id").alias(end), F.col("home").alias(f"home_{end}")), end)
    both = _both(inside.where("home_a = home_b"))
    sums = both.groupBy(F.col("x").alias("id")).agg(F.min("score").alias("least"), F.sum("score").alias("total"))
    rows = members.join(sums, "id")
    best = F.max(F.struct(F.round("total", 9).alias("total"), (-F.col("id")).alias("low")))
    found = rows.groupBy("region_id", "home").agg(F.min("least").alias("cohesion"), F.count_distinct("class_id").alias("n_classes"), F.max("anchor_similarity").alias("nearest"), best.alias("best"))
    found = found.where((F.col("n_classes") >= shapes) & (F.col("cohesion") >= F.col("nearest") + COMPETITION))
    return found.select("home", (-F.col("best.low")).alias("anchor_id"), "cohesion", "n_classes").join(members, "home").select("region_id", "anchor_id", "id", "cohesion", "n_classes")


def _admit(rows: pd.DataFrame, threshold: float, core: float) -> list[tuple]:
    """The admissions of one component, entry by entry. rows: as admissions() sends them."""
    score: dict[tuple[int, int], float] = {}
    for a, b, x in rows.loc[rows["kind"] == "score", ["id", "other", "score"]].itertuples(index=False):
        score[a, int(b)] = score[int(b), a] = x
    shape = dict(rows.loc[rows["kind"].isin(("entry", "anchor")), ["id", "class_id"]].itertuples(index=False))
    anchors: dict[str, list[int]] = {}
    for region, anchor in sorted(rows.loc[rows["kind"] == "anchor", ["region", "id"]].itertuples(index=False)):
        anchors.setdefault(region, []).append(anchor)
    representatives = {r: list(a) for r, a in anchors.items()}
    clear: dict[str, list[int]] = {}
    out = []
    entries = rows[rows["kind"] == "entry"].sort_values(["place", "id"])
    for e, flagged, asked, known in entries[["id", "flagged", "region", "known"]].itertuples(index=False):
        found = []
        for region, own in anchors.items():
            best = min(((-score[e, r] if e != r else -1.0, r) for r in representatives[region] if e == r or (e, r) in score), default=None)
            if best:
                near = max((1.0 if e == a else score.get((e, a), float("-inf")) for a in own), default=float("-inf"))
                found.append((near < threshold, best[0], region, best[1], near))
        found.sort()
        eligible = [f for f in found if not f[0]]
        pinned = next((f for f in eligible if f[2] == asked), None)
        home = pinned or (eligible[0] if eligible else None)
        reasons = ["reconstruction"] if flagged else []
        if home is None:
            region, near, lead = f"region-{e}", 1.0, e
            if found and found[0][4] >= threshold - CORE:
                reasons.append("near an existing group")
            anchors[region], representatives[region] = [e], [e]
        else:
            _, best, region, lead, near = home
            if e not in anchors[region]:
                if near < core:
                    reasons.append("borderline")
                rival = next((f for f in eligible if f[2] != region), None)
                if rival and rival[1] - best < COMPETITION:
                    reasons.append("competition")
        needs = bool(reasons) and not known and not (pinned and not flagged)
        status = "review" if needs else "fringe" if reasons else "core"
        out.append((e, region, lead, home is None, pinned is not None, asked is not None and pinned is None, near, status, reasons))
        if not reasons:
            clear.setdefault(region, []).append(e)
            if len({shape[x] for x in clear[region]}) >= SHAPES:
                chosen = list(anchors[region])
                while len(chosen) < len(anchors[region]) + ADDED:
                    seen = {shape[x] for x in chosen}
                    left = [x for x in clear[region] if shape[x] not in seen]
                    if not left:
                        break
                    chosen.append(min(left, key=lambda x: (max(score.get((x, r), 0.0) for r in chosen), x)))
                representatives[region] = chosen
    return out


def admissions(entries: DataFrame, anchors: DataFrame, scores: DataFrame, reviewed: DataFrame, placements: DataFrame, acknowledged: DataFrame, threshold: float) -> DataFrame:
    """C14: (id, region_id, representative_id, founded, pinned, paused, anchor_similarity, status, reasons): incoming entries,
    in their order, are admitted to the best region whose anchors one reaches, or found a region of their own.

    A region's anchors stay; they say who is eligible. Among eligible regions the one with the closest representative wins,
    ties by name. Entries without reasons for review become representatives once a region has SHAPES classes of them: up to
    ADDED, each the farthest of a new class, so what comes later may go elsewhere than it would in another order. A reviewed
    group is a region anchored at one of the entries, which is asked to go there; so are placements; one that isn't eligible
    is paused. reasons: reconstruction, near an existing group (a founder just below admission), borderline, competition.
    status: core without reasons, review if they need one, else fringe (acknowledged, or placed and not flagged).

    entries: (id, place, class_id, flagged); anchors: (region_id, anchor_id, class_id) of fixed regions; scores: (a, b, score),
    a < b, a missing pair can't be compared; reviewed: (region_id, anchor_id); placements: (id, region_id); acknowledged: (id).
    An entry depends only on what it is linked to by scores of threshold - CORE or more, over any number of steps, so each
    such component is one group, in the order of its entries; a component is held by one task.
    """
    core = min(1.0, threshold + CORE)
    named = reviewed.join(entries.select(F.col("id").alias("anchor_id"), "class_id"), "anchor_id").select("region_id", "anchor_id", "class_id")
    every = materialise(anchors.select("region_id", "anchor_id", "class_id").unionByName(named), "anchors")
    asked = named.select(F.col("anchor_id").alias("id"), "region_id").unionByName(placements.join(named.select(F.col("anchor_id").alias("id")), "id", "left_anti").select("id", "region_id"))
    nodes = entries.select("id").unionByName(every.select(F.col("anchor_id").alias("id"))).distinct()
    together = every.groupBy("region_id").agg(F.min("anchor_id").alias("a")).join(every, "region_id").select("a", F.col("anchor_id").alias("b"))
    where = materialise(labels(nodes, scores.where(F.col("score") >= threshold - CORE).select("a", "b").unionByName(together.where("a <> b"))), "components")
    kind = "id long, kind string, other long, score double, place long, class_id long, flagged boolean, region string, known boolean"
    empty = entries.sparkSession.createDataFrame([], kind)
    rows = entries.join(asked.withColumnRenamed("region_id", "region"), "id", "left").join(acknowledged.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    rows = rows.select("id", F.lit("entry").alias("kind"), "place", "class_id", F.coalesce("flagged", F.lit(False)).alias("flagged"), "region", F.coalesce("known", F.lit(False)).alias("known"))
    inside = scores.join(where.select(F.col("id").alias("b"), F.col("component").alias("there")), "b").join(where.select(F.col("id").alias("a"), "component"), "a").where("there = component")
    sent = empty.unionByName(rows, allowMissingColumns=True).unionByName(every.select(F.col("anchor_id").alias("id"), F.lit("anchor").alias("kind"), "class_id", F.col("region_id").alias("region")), allowMissingColumns=True)
    sent = sent.unionByName(inside.select(F.col("a").alias("id"), F.lit("score").alias("kind"), F.col("b").alias("other"), "score"), allowMissingColumns=True).join(where, "id")
    names = ["id", "region_id", "representative_id", "founded", "pinned", "paused", "anchor_similarity", "status", "reasons"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_admit(rows, threshold, core), columns=names)

    return sent.groupBy("component").applyInPandas(run, "id long, region_id string, representative_id long, founded boolean, pinned boolean, paused boolean, anchor_similarity double, status string, reasons array<string>")


def _changed(placements: DataFrame, changes: DataFrame) -> DataFrame:
    """placements (id, group_id) with those of changes in place of their own."""
    changes = changes.select("id", "group_id")
    return placements.select("id", "group_id").join(changes.select("id"), "id", "left_anti").unionByName(changes)


def _none_of(rows: DataFrame, what: str) -> None:
    """An error that shows one of rows, if there are any."""
    if found := rows.take(1):
        raise ValueError(f"{what}: {found[0].asDict()}")


def retain_anchors(groups: DataFrame, placements: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed groups and placements in which every local region is a group, and its anchor is placed there, so that
    replaying decisions finds it again. groups: (group_id, name, anchor_id); placements: (id, group_id), an id once; regions:
    (region_id, name, anchor_id, local)."""
    own = regions.where("local")
    new = own.join(groups.select(F.col("group_id").alias("region_id")), "region_id", "left_anti")
    listed = groups.select("group_id", "name", "anchor_id").unionByName(new.select(F.col("region_id").alias("group_id"), "name", "anchor_id"))
    return listed, _changed(placements, own.select(F.col("anchor_id").alias("id"), F.col("region_id").alias("group_id")))


def approve_splits(groups: DataFrame, placements: DataFrame, regions: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and placements after splits: split-<anchor> anchored at the proposal's anchor, its members placed there. A
    split that is there already, or of a region that isn't, is an error. proposals: (region_id, anchor_id, id), a row a member;
    an entry is a member of one at most."""
    listed, placed_ = retain_anchors(groups, placements, regions)
    splits = proposals.withColumn("group_id", F.concat(F.lit("split-"), F.col("anchor_id").cast("string")))
    one = splits.select("region_id", "anchor_id", "group_id").distinct()
    _none_of(one.join(listed.select("group_id"), "group_id", "left_semi"), "the split exists")
    _none_of(one.join(regions.select("region_id"), "region_id", "left_anti"), "the region is gone")
    named = one.join(regions.select("region_id", "name"), "region_id").select("group_id", F.substring(F.concat(F.lit("Split from "), "name"), 1, 100).alias("name"), "anchor_id")
    return listed.unionByName(named), _changed(placed_, splits)


def approve_merges(groups: DataFrame, placements: DataFrame, regions: DataFrame, members: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and placements after merges: the source's group goes, its members are placed in the target. Regions must be
    there, differ, and take part in one merge each. members: (id, region_id); merges: (source_id, target_id)."""
    ends = merges.select(F.col("source_id").alias("region_id")).unionByName(merges.select(F.col("target_id").alias("region_id")))
    _none_of(ends.groupBy("region_id").count().where("count > 1"), "a region is in several merges, or merged with itself")
    _none_of(ends.join(regions.select("region_id"), "region_id", "left_anti"), "the region is gone")
    listed, placed_ = retain_anchors(groups, placements, regions)
    moved = members.join(merges, F.col("region_id") == F.col("source_id")).select("id", F.col("target_id").alias("group_id"))
    return listed.join(merges.select(F.col("source_id").alias("group_id")), "group_id", "left_anti"), _changed(placed_, moved)


def move_members(groups: DataFrame, placements: DataFrame, regions: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and placements after moves (id, group_id), an id once. An anchor stays where it is, and the target must be
    there: anything else is an error."""
    _none_of(moves.join(regions.select(F.col("anchor_id").alias("id")), "id", "left_semi"), "anchors stay in their group")
    _none_of(moves.join(regions.select(F.col("region_id").alias("group_id")), "group_id", "left_anti"), "the target is gone")
    listed, placed_ = retain_anchors(groups, placements, regions)
    return listed, _changed(placed_, moves)
