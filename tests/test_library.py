"""Library groups, constrained linkage and covering members against plain versions, by tasks and by rounds."""

import itertools
import random
from collections import defaultdict

import pytest
from coordwave.operators import library, linkage
from coordwave.plans import library_queries

EPS = 1e-12


def plain_linkage(n, sim, threshold, seeds):
    """Join the two clusters whose worst pair is best, first ones first; seeds: lists of members with a mark or None."""
    clusters = sorted(([sorted(m), mark] for m, mark in seeds), key=lambda c: c[0][0])
    while True:
        best = None
        for (i, a), (j, b) in itertools.combinations(enumerate(clusters), 2):
            if a[1] and b[1] and a[1] != b[1]:
                continue
            worst = min(sim[x][y] for x in a[0] for y in b[0])
            if worst + EPS >= threshold and (best is None or (-worst, a[0][0], b[0][0]) < best[0]):
                best = (-worst, a[0][0], b[0][0]), i, j
        if best is None:
            return clusters
        _, i, j = best
        clusters[i] = [sorted(clusters[i][0] + clusters[j][0]), clusters[i][1] or clusters[j][1]]
        clusters.pop(j)


def plain_library(n, sim, classes, flagged, groups, placements, known, threshold):
    core = min(1.0, threshold + 0.08)
    pins, members = {}, {}
    for g, anchor in sorted(groups.items()):
        if anchor < n:
            members[g], pins[anchor] = [anchor], g
    for i, g in sorted(placements.items()):
        if i < n and i not in pins and g in members and all(sim[i][j] + EPS >= threshold for j in members[g]):
            members[g].append(i)
            pins[i] = g
    seeds = [(m, g) for g, m in members.items()] + [([i], None) for i in range(n) if i not in pins]
    clusters, out, taken = plain_linkage(n, sim, threshold, seeds), {}, set()
    taken = {mark for _, mark in clusters if mark}
    leads, names = {}, {}
    for m, mark in clusters:
        unique = [next(i for i in m if classes[i] == c) for c in dict.fromkeys(classes[i] for i in m)]
        seen = [i for i in m if not flagged[i]]
        clear = [i for i in seen if min(sim[i][j] for j in m) + EPS >= core]
        total = {i: sum(sim[i][j] for j in unique) for i in clear or seen or m}
        leads[m[0]] = min(i for i in total if total[i] >= max(total.values()) - EPS)
        name, k = mark or f"region-{m[0]}", 0
        while not mark and name in taken:
            k += 1
            name = f"region-{m[0]}-{k}"
        names[m[0]] = name
    for m, mark in clusters:
        for i in m:
            cohesion = min(sim[i][j] for j in m)
            reasons = ["reconstruction"] * flagged[i] + ["borderline"] * (cohesion + EPS < core)
            rivals = [c for c, _ in clusters if c[0] != m[0] and min(sim[i][j] for j in c) + EPS >= threshold]
            if i not in pins and any(sim[i][leads[m[0]]] - sim[i][leads[c[0]]] < 0.05 for c in rivals):
                reasons.append("competition")
            status = "core" if not reasons else "fringe" if i in known else "review"
            out[i] = (names[m[0]], m[0], mark, leads[m[0]], len(m), round(cohesion, 12), i in pins, status, reasons)
    return out


def random_case(seed, n=26, levels=20):
    rng = random.Random(seed)
    own = [rng.randrange(4) for _ in range(n)]
    sim = [[1.0] * n for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        sim[i][j] = sim[j][i] = rng.randrange(levels // 2 if own[i] == own[j] else 0, levels) / levels
    classes = [i if rng.random() < 0.8 else rng.randrange(n) for i in range(n)]
    flagged = [rng.random() < 0.2 for _ in range(n)]
    groups = {"region-2": 5, "split-b": 11, "region-0": 7, "gone": 99}
    placements = {i: rng.choice([*groups, "none"]) for i in rng.sample(range(n), 12)}
    return n, sim, classes, flagged, groups, placements, set(rng.sample(range(n), 6))


def tables(spark, n, sim, classes, flagged, groups, placements, known):
    entries = spark.createDataFrame(list(zip(range(n), classes, flagged)), "id long, class_id long, flagged boolean").repartition(3)
    scores = spark.createDataFrame([(i, j, sim[i][j]) for i, j in itertools.combinations(range(n), 2) if sim[i][j] > 0], "a long, b long, score double").repartition(3)
    return entries, scores, spark.createDataFrame(list(groups.items()), "group_id string, anchor_id long"), spark.createDataFrame(list(placements.items()), "id long, group_id string"), spark.createDataFrame([(i,) for i in known], "id long")


@pytest.mark.parametrize("seed", range(2))
def test_library_groups(spark, seed):
    case = random_case(seed)
    got = library.library_groups(*tables(spark, *case), 0.4)
    assert {r.id: (*r[1:6], round(r.cohesion, 12), *r[7:]) for r in got.collect()} == plain_library(*case, 0.4)


def test_two_reviewed_groups_in_one_component(spark):
    """All pairs reach the threshold, so only the decisions keep the two apart."""
    n, sim = 6, [[1.0 if i == j else 0.9 - 0.01 * abs(i - j) for j in range(6)] for i in range(6)]
    case = (n, sim, list(range(n)), [False] * n, {"split-x": 1, "split-y": 4}, {3: "split-x", 2: "split-y"}, set())
    got = {r.id: (*r[1:6], round(r.cohesion, 12), *r[7:]) for r in library.library_groups(*tables(spark, *case), 0.5).collect()}
    assert got == plain_library(*case, 0.5) and len({g for g, *_ in got.values()}) == 2 and got[3][0] == "split-x"


def test_paused_decisions(spark):
    n, sim, *_ = random_case(1)
    entries, scores, groups, placements, _ = tables(spark, *random_case(1))
    pins, paused = library.placed(entries, scores.where("score >= 0.4"), groups, placements)
    held = defaultdict(set)
    for r in pins.collect():
        held[r.group_id].add(r.id)
    assert all(sim[a][b] >= 0.4 for m in held.values() for a, b in itertools.combinations(m, 2))
    assert ("anchor is absent", 99, "gone") in {tuple(r) for r in paused.collect()}
    assert {r.subject for r in paused.where("kind LIKE 'placement%'").collect()} == {i for i in random_case(1)[5] if i not in {x for m in held.values() for x in m}}


@pytest.mark.parametrize("held", [linkage.COMPONENT, 0])
def test_linkage_by_tasks_and_by_rounds(spark, held):
    for seed in (11,):
        n, sim, *_ = random_case(seed, 30, 6)
        marks = {3: "p", 9: "p", 20: "q", 27: "r"}
        nodes = spark.createDataFrame([(i, marks.get(i)) for i in range(n)], "id long, mark string").repartition(3)
        scores = spark.createDataFrame([(i, j, sim[i][j]) for i, j in itertools.combinations(range(n), 2)], "a long, b long, score double").repartition(3)
        got = defaultdict(list)
        for r in linkage.linked(nodes, scores, 0.5, held).collect():
            got[r.cluster].append(r.id)
        seeds = [([3, 9], "p"), ([20], "q"), ([27], "r")] + [([i], None) for i in range(n) if i not in marks]
        assert sorted(map(sorted, got.values())) == sorted(m for m, _ in plain_linkage(n, sim, 0.5, seeds))


def test_covering_members(spark):

    n, sim, classes, *_ = random_case(3)
    rows = [(i % 3, i, classes[i], i in (0, 4, 8, 9), i % 4 != 1) for i in range(n)]
    _, scores, *_ = tables(spark, *random_case(3))
    got = defaultdict(list)
    for r in library.covering_members(spark.createDataFrame(rows, "group_id long, id long, class_id long, anchor boolean, core boolean"), scores).orderBy("group_id", "place", "id").collect():
        got[r.group_id].append((r.id, r.place))
    for g in range(3):
        mine = [r for r in rows if r[0] == g]
        chosen = [(i, 0) for _, i, _, anchor, _ in mine if anchor]
        if len({c for *_, c, _, core in [(r[0], r[1], r[2], r[3], r[4]) for r in mine] if core}) >= 3:
            for place in (1, 2):
                left = [i for _, i, c, _, core in mine if core and c not in {classes[x] for x, _ in chosen}]
                if left:
                    chosen.append((min(left, key=lambda i: (max((sim[i][x] for x, _ in chosen), default=0.0), i)), place))
        assert got[g] == chosen



def test_queries_of_the_library(spark, small):
    """c15 and c17 over the whole table; a block at a time, for no score joins two of them."""
    entries, scores, groups, placements, known = (x.collect() for x in library_queries._blocks(spark, small))
    got = {r.id: (*r[1:6], round(r.cohesion, 12), *r[7:]) for r in library_queries.c15_library_groups(spark, small).collect()}
    covered = defaultdict(list)
    for r in library_queries.c17_covering_members(spark, small).orderBy("group_id", "place", "id").collect():
        covered[r.group_id].append((r.id, r.place))
    score = {(r.a, r.b): r.score for r in scores}
    anchors, asked, named = {r.group_id: r.anchor_id for r in groups}, {r.id: r.group_id for r in placements}, {r.id for r in known}
    assert len(got) == len(entries) and any(p for *_, p, _ in got.values())
    for block in {r.id // 8 for r in entries}:
        own = sorted((r for r in entries if r.id // 8 == block), key=lambda r: r.id)
        ids = [r.id for r in own]
        at = {i: k for k, i in enumerate(ids)}
        sim = [[1.0 if i == j else score[min(i, j), max(i, j)] for j in ids] for i in ids]
        mine = {g: at[a] for g, a in anchors.items() if a in at}
        wanted = plain_library(len(ids), sim, [r.class_id for r in own], [r.flagged for r in own], mine, {at[i]: g for i, g in asked.items() if i in at}, {at[i] for i in named if i in at}, 0.45)
        for k, (name, cluster, mark, lead, size, cohesion, pinned, status, _) in wanted.items():
            assert got[ids[k]] == (mark or f"region-{ids[cluster]}", ids[cluster], mark, ids[lead], size, cohesion, pinned, status)
        chosen = [(i, 0) for i in ids if i % 8 == 0]
        core = [r for r in own if not r.flagged]
        if len({r.class_id for r in core}) >= 3:
            classes = {r.id: r.class_id for r in own}
            for place in (1, 2):
                left = [r.id for r in core if r.class_id not in {classes[x] for x, _ in chosen}]
                if left:
                    chosen.append((min(left, key=lambda i: (max((score[min(i, x), max(i, x)] for x, _ in chosen), default=0.0), i)), place))
        assert covered[block] == chosen


def plain_first_fit(ids, alike):
    clusters = []
    for i in sorted(ids):
        home = next((c for c in clusters if all((j, i) in alike for j in c)), None)
        clusters.append([i]) if home is None else home.append(i)
    return {i: c[0] for c in clusters for i in c}


@pytest.mark.parametrize("seed, share", [(5, 0.3), (6, 0.75)])
def test_first_fit(spark, seed, share):
    rng = random.Random(seed)
    alike = {p for p in itertools.combinations(range(24), 2) if rng.random() < share}
    got = library.first_fit(spark.range(24), spark.createDataFrame(list(alike), "a long, b long").repartition(3))
    assert {r.id: r.home for r in got.collect()} == plain_first_fit(range(24), alike)


def test_split_proposals(spark):
    rng, n = random.Random(9), 30
    kind = [i % 5 for i in range(n)]
    score = {(i, j): round(rng.uniform(0.78, 0.95) if kind[i] == kind[j] else rng.uniform(0, 0.7), 3) for i, j in itertools.combinations(range(n), 2)}
    rows = [(i, i % 2, i if i % 7 else 0, None if i == 12 else 0.1 if kind[i] < 4 else 0.85) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, region_id long, class_id long, anchor_similarity double")
    got = {tuple(r) for r in library.split_proposals(frame, spark.createDataFrame([(*p, s) for p, s in score.items()], "a long, b long, score double"), 0.65).collect()}
    wanted = set()
    for region in (0, 1):
        own = [r for r in rows if r[1] == region and r[3] is not None]
        home = plain_first_fit([r[0] for r in own], {p for p, s in score.items() if s >= 0.73})
        for founder in set(home.values()):
            c = [r for r in own if home[r[0]] == founder]
            if len({r[2] for r in c}) < 3:
                continue
            of = lambda a, b: score[min(a, b), max(a, b)]
            least = min(of(a[0], b[0]) for a, b in itertools.combinations(c, 2))
            if all(least >= r[3] + 0.05 for r in c):
                lead = min((r[0] for r in c), key=lambda i: (-round(sum(of(i, r[0]) for r in c if r[0] != i), 9), i))
                wanted |= {(region, lead, r[0], least, len({x[2] for x in c})) for r in c}
    assert got == wanted and wanted


def test_query_of_splits(spark, small):
    entries, scores, *_ = (x.collect() for x in library_queries._blocks(spark, small))
    score, wanted = {(r.a, r.b): r.score for r in scores}, set()
    for region in {r.id // 8 for r in entries}:
        own = {r.id: r for r in entries if r.id // 8 == region and not r.flagged and r.id % 8}
        home = plain_first_fit(own, {p for p, s in score.items() if s >= 0.38})
        for founder in set(home.values()):
            c = [i for i in own if home[i] == founder]
            least = min((score[p] for p in itertools.combinations(sorted(c), 2)), default=0)
            classes = {own[i].class_id for i in c}
            if len(classes) >= 3 and all(least >= i % 4 * 0.15 + 0.05 for i in c):
                lead = min(c, key=lambda i: (-round(sum(score[min(i, j), max(i, j)] for j in c if j != i), 9), i))
                wanted |= {(region, lead, i, least, len(classes)) for i in c}
    assert {tuple(r) for r in library_queries.c18_split_proposals(spark, small).collect()} == wanted and wanted


def plain_admissions(entries, fixed, score, reviewed, placements, known, threshold):
    """One after the other, all regions looked at. entries: (id, class, flagged) in order; fixed: region: {anchor: class}."""
    core, shape = min(1.0, threshold + 0.08), {i: c for i, c, _ in entries} | {a: c for m in fixed.values() for a, c in m.items()}
    of = lambda a, b: 1.0 if a == b else score.get((min(a, b), max(a, b)))
    anchors = {r: list(m) for r, m in fixed.items()} | {r: [a] for r, a in reviewed.items() if a in shape}
    reps, clear, out = {r: list(a) for r, a in anchors.items()}, defaultdict(list), {}
    for e, _, flagged in entries:
        candidates = []
        for r in anchors:
            seen = [(of(e, x), x) for x in reps[r] if of(e, x) is not None]
            if seen:
                top = max(s for s, _ in seen)
                near = max((of(e, a) if of(e, a) is not None else -9 for a in anchors[r]))
                candidates.append((near >= threshold, top, r, min(x for s, x in seen if s == top), near))
        candidates.sort(key=lambda c: (not c[0], -c[1], c[2]))
        asked = next((r for r, a in reviewed.items() if a == e), placements.get(e))
        pinned = next((c for c in candidates if c[2] == asked and c[0]), None)
        home = pinned or next((c for c in candidates if c[0]), None)
        reasons = ["reconstruction"] * flagged
        if home is None:
            region, lead, near = f"region-{e}", e, 1.0
            if candidates and candidates[0][4] >= threshold - 0.08:
                reasons.append("near an existing group")
            anchors[region], reps[region] = [e], [e]
        else:
            _, top, region, lead, near = home
            if e not in anchors[region]:
                if near < core:
                    reasons.append("borderline")
                rival = next((c for c in candidates if c[0] and c[2] != region), None)
                if rival and top - rival[1] < 0.05:
                    reasons.append("competition")
        needs = reasons and e not in known and not (pinned and not flagged)
        out[e] = (region, lead, home is None, pinned is not None, asked is not None and pinned is None, near, "review" if needs else "fringe" if reasons else "core", reasons)
        if not reasons:
            clear[region].append(e)
            if len({shape[x] for x in clear[region]}) >= 3:
                chosen = list(anchors[region])
                for _ in range(2):
                    left = [x for x in clear[region] if shape[x] not in {shape[y] for y in chosen}]
                    if left:
                        chosen.append(min(left, key=lambda x: (max(of(x, y) or 0.0 for y in chosen), x)))
                reps[region] = chosen
    return out


def admitted(spark, entries, fixed, score, reviewed, placements, known, threshold):
    frames = (
        spark.createDataFrame([(i, k, c, f) for k, (i, c, f) in enumerate(entries)], "id long, place long, class_id long, flagged boolean").repartition(3),
        spark.createDataFrame([(r, a, c) for r, m in fixed.items() for a, c in m.items()], "region_id string, anchor_id long, class_id long"),
        spark.createDataFrame([(*p, s) for p, s in score.items()], "a long, b long, score double"),
        spark.createDataFrame(list(reviewed.items()), "region_id string, anchor_id long"), spark.createDataFrame(list(placements.items()), "id long, region_id string"), spark.createDataFrame([(i,) for i in known], "id long"),
    )
    return {r.id: tuple(r)[1:] for r in library.admissions(*frames, threshold).collect()}


def test_admissions_in_two_orders(spark):
    rng = random.Random(21)
    n, own = 44, [rng.randrange(5) for _ in range(44)]
    score = {(i, j): rng.randrange(9, 20) / 20 if own[i] == own[j] else rng.randrange(0, 14) / 20 for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.9}
    fixed = {"ref-a": {0: 0, 1: 1}, "ref-b": {2: 2}}
    entries = [(i, i if i % 5 else i + 1, i % 9 == 4) for i in range(3, n)]
    case = (fixed, score, {"split-x": 10, "gone": 99}, {12: "split-x", 13: "ref-b", 20: "gone"}, set(range(3, n, 2)), 0.65)
    one, two = plain_admissions(entries, *case), plain_admissions(entries[::-1], *case)
    assert admitted(spark, entries, *case) == one and admitted(spark, entries[::-1], *case) == two
    assert {i: x[0] for i, x in one.items()} != {i: x[0] for i, x in two.items()} and {x[6] for x in one.values()} == {"core", "fringe", "review"}


def test_query_of_admissions(spark, small):
    entries, anchors, scores, reviewed, placements, known = (x.collect() for x in library_queries._incoming(spark, small))
    ordered = [(r.id, r.class_id, r.flagged) for r in sorted(entries, key=lambda r: (r.place, r.id))]
    fixed = {r.region_id: {r.anchor_id: r.class_id} for r in anchors}
    present = {r.id for r in entries}
    wanted = plain_admissions(ordered, fixed, {(r.a, r.b): r.score for r in scores}, {r.region_id: r.anchor_id for r in reviewed if r.anchor_id in present}, {r.id: r.region_id for r in placements}, {r.id for r in known}, 0.6)
    assert {r.id: tuple(r)[1:] for r in library_queries.c14_admissions(spark, small).collect()} == {i: x[:-1] for i, x in wanted.items()}


def test_approvals_refuse(spark):
    groups = spark.createDataFrame([("region-1", "One", 1)], "group_id string, name string, anchor_id long")
    placements = spark.createDataFrame([(2, "region-1")], "id long, group_id string")
    regions = spark.createDataFrame([("region-1", "One", 1, True), ("region-5", "Five", 5, True), ("ref", "Ref", 9, False)], "region_id string, name string, anchor_id long, local boolean")
    state = groups, placements, regions
    moves = lambda *rows: spark.createDataFrame(list(rows), "id long, group_id string")
    listed, now = library.move_members(*state, moves((2, "ref")))
    assert {tuple(r) for r in listed.collect()} == {("region-1", "One", 1), ("region-5", "Five", 5)}
    assert {tuple(r) for r in now.collect()} == {(1, "region-1"), (2, "ref"), (5, "region-5")}
    merges = lambda *rows: spark.createDataFrame(list(rows), "source_id string, target_id string")
    members = spark.createDataFrame([(2, "region-1")], "id long, region_id string")
    split = spark.createDataFrame([("region-1", 3, 3), ("gone", 4, 4)], "region_id string, anchor_id long, id long")
    taken = groups.unionByName(spark.createDataFrame([("split-3", "x", 3)], groups.schema))
    for call in (
        lambda: library.move_members(*state, moves((9, "region-1"))), lambda: library.move_members(*state, moves((2, "none"))),
        lambda: library.approve_merges(*state, members, merges(("region-1", "region-1"))), lambda: library.approve_merges(*state, members, merges(("region-1", "ref"), ("ref", "region-5"))),
        lambda: library.approve_merges(*state, members, merges(("region-1", "none"))), lambda: library.approve_splits(*state, split), lambda: library.approve_splits(taken, placements, regions, split.limit(1)),
    ):
        with pytest.raises(ValueError):
            call()
