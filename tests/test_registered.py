"""Registered queries that SQL can't express, against plain versions of their rules."""

import itertools
import math

import numpy as np
import pytest
from coordwave.operators import evaluation, matching
from coordwave.plans import library_queries, queries
from coordwave.sources.tables import table


def linked(n, score, threshold):
    """Complete linkage by its definition: join the two groups whose worst pair is best, first ones first."""
    own = [[i] for i in range(n)]
    while True:
        best = None
        for i, j in itertools.combinations(range(len(own)), 2):
            worst = min(score.get((min(a, b), max(a, b)), -math.inf) for a in own[i] for b in own[j])
            if worst + 1e-12 >= threshold and (best is None or (-worst, own[i][0], own[j][0]) < best[0]):
                best = ((-worst, own[i][0], own[j][0]), i, j)
        if best is None:
            return own
        own[best[1]] = sorted(own[best[1]] + own.pop(best[2]))


def test_similarity_groups(spark, small):
    packed = queries._packed(spark, small)
    ids = sorted(r.recording_id for r in packed.select("recording_id").collect())
    at = {x: k for k, x in enumerate(ids)}
    score = {(at[r.a], at[r.b]): r.score for r in matching.symmetric_scores(packed).collect()}
    wanted = {}
    for members in linked(len(ids), score, 0.2):
        total = {i: 1 + sum(score.get((min(i, k), max(i, k)), 0) for k in members if k != i) for i in members}
        lead = next(i for i in members if total[i] >= max(total.values()) - 1e-12)
        wanted |= {ids[i]: (ids[members[0]], ids[lead], len(members)) for i in members}
    got = {r.id: (r.group_id, r.representative_id, r.group_size) for r in queries.c13_similarity_groups(spark, small).collect()}
    assert got == wanted and len({g for g, _, _ in got.values()}) > 1


def rows_of(packed):
    """Views as lists of points: index, time, three values (None: missing), three breaks."""
    return {r.recording_id: [(int(p[0]), p[1], [None if math.isnan(x) else x for x in p[2:5]], [x > 0 for x in p[5:8]]) for p in np.array(r.data).reshape(-1, 8).tolist()] for r in packed.collect()}


def scored(query, target):
    """The score of all points of a query against all of a target, and whether the evidence is complete; None without."""
    if query[-1][1] <= query[0][1] or target[-1][1] <= target[0][1]:
        return None
    span = max(1, query[-1][0] - query[0][0])
    place = [math.floor((p[0] - query[0][0]) / span * (len(target) - 1) + 0.5) for p in query]
    shape, enough, joint, late = [], [], [], []
    used = [[] for _ in query]
    for k in range(3):
        q, t = ([p[2][k] for p in side if p[2][k] is not None] for side in (query, target))
        pairs = [(i, j) for i, j in enumerate(place) if None not in (query[i][2][k], target[j][2][k]) and not query[i][3][k] and not target[j][3][k]]
        for i, _ in pairs:
            used[i].append(k)
        enough.append(min(len({i for i, _ in pairs}), len({j for _, j in pairs})))
        if pairs:
            flat = (max(q) == min(q), max(t) == min(t))
            gap = lambda i, j: 0 if all(flat) else 1 if any(flat) else (query[i][2][k] - min(q)) / (max(q) - min(q)) - (target[j][2][k] - min(t)) / (max(t) - min(t))  # noqa: E731, B023
            shape.append(sum(gap(i, j) ** 2 for i, j in pairs) / len(pairs))
    for i, j in enumerate(place):
        if used[i]:
            late.append(((query[i][1] - query[0][1]) / (query[-1][1] - query[0][1]) - (target[j][1] - target[0][1]) / (target[-1][1] - target[0][1])) ** 2)
        if len(used[i]) == 3:
            joint.append((i, j))
    if not shape:
        return None
    whole = min(enough) >= 16 and min(len({i for i, _ in joint}), len({j for _, j in joint})) >= 16
    return math.exp(-4 * math.sqrt(sum(shape) / len(shape)) - 2 * math.sqrt(sum(late) / len(late))), whole


def best_part(query, target):
    n, best = len(target), None
    for length in dict.fromkeys([n, min(n, len(query)), *[max(16, math.floor(n * f + 0.5)) for f in (0.25, 0.5, 0.75)]]):
        if 16 <= length < n:
            stride = max(1, (n - length) // 24)
            for start in dict.fromkeys([*range(0, n - length + 1, stride), n - length]):
                got = scored(query, target[start : start + length])
                if got and (best is None or got[1] > best[1] or (got[1] == best[1] and got[0] > best[0] + 1e-9)):
                    best = (*got, target[start][0], target[start + length - 1][0] + 1)
    return best


def test_ranked_matches(spark, small):
    views = rows_of(queries._packed(spark, small))
    wanted = []
    for other in views:
        if other == 0:
            continue
        full, part, back = scored(views[0], views[other]), best_part(views[0], views[other]), None
        if full is None or not full[1] or full[0] < 0.85:
            found = best_part(views[other], views[0])
            if found and found[1]:
                own = [p for p in views[0] if found[2] <= p[0] < found[3]]
                back = scored(own, views[other]) if len(own) >= 16 else None
        options = [(x[0], x[1], kind if x[1] else "partial-channel", x[1] and x[0] >= 0.85) for x, kind in ((full, "whole"), (part, "partial"), (back, "query-partial")) if x]
        chosen = next((x for test in (lambda x: x[3], lambda x: x[1], lambda x: True) for x in options if test(x)), None)
        if chosen:
            tier = 4 if chosen[2] == "partial-channel" else (0 if chosen[3] else 2) + (chosen[2] != "whole")
            wanted.append((tier, -chosen[0], other, chosen[2], chosen[3]))
    got = queries.m5_ranked_matches(spark, small).where("query_id = 0").orderBy("rank").collect()
    assert [(r.tier, r.target_id, r.kind, r.qualifying) for r in got] == [(t, o, k, q) for t, _, o, k, q in sorted(wanted)]
    assert np.allclose([r.score for r in got], [-s for _, s, *_ in sorted(wanted)])


def plain_periods(f):
    """E1 for samples at 0, 1, 2 ...: one lag at a time."""
    n, span, size = len(f), len(f) - 1, max(f) - min(f)
    if n < 24 or size <= 1e-12:
        return []
    low, high, every = max(8, span / 200), span / 2.8, -(-n // 384)

    def like(lag):
        total = pairs = possible = 0
        for i in range(0, n, every):
            at = i + lag
            if at > span:
                break
            possible += 1
            k = math.floor(at)
            if k + 1 < n:
                total += ((f[i] - (f[k] + (f[k + 1] - f[k]) * (at - k))) / size) ** 2
                pairs += 1
        return (math.exp(-3 * math.sqrt(total / pairs)) if pairs else 0, pairs, pairs / possible if possible else 0)

    step = (high - low) / 600
    coarse = [like(low + i * step)[0] for i in range(601)]
    peaks = sorted((i for i in range(1, 600) if coarse[i] >= coarse[i - 1] and coarse[i] >= coarse[i + 1]), key=lambda i: -coarse[i])[:16]
    found = []
    for i in peaks:
        centre, best, width = low + i * step, coarse[i], step
        for _ in range(3):
            base = centre
            for k in range(-10, 11):
                lag = base + k * width / 10
                if low <= lag <= high and like(lag)[0] > best:
                    centre, best = lag, like(lag)[0]
            width /= 10
        similarity, pairs, coverage = like(centre)
        whole = sum(8 <= sum(k * centre <= t < (k + 1) * centre for t in range(n)) for k in range(math.floor(span / centre + 1e-10)))
        if similarity >= 0.85 and pairs >= 12 and coverage >= 0.5 and whole >= 2:
            found.append((centre, similarity, pairs))
    found.sort()
    return [x for k, x in enumerate(found) if not any(abs(x[0] - y[0]) < 1 for y in found[:k])][:5]


def test_periods(spark, small):
    got = {}
    for r in queries.e1_periods(spark, small).where("recording_id < 6").orderBy("recording_id", "place").collect():
        got.setdefault(r.recording_id, []).append((r.period, r.similarity, r.pairs))
    for r in table(spark, small, "embeddings").where("vec_id < 6").collect():
        wanted = plain_periods([float(x) for x in r.embedding] * 5)
        assert len(wanted) == len(got.get(r.vec_id, []))
        assert np.allclose([x[:2] for x in wanted], [x[:2] for x in got.get(r.vec_id, [])], atol=1e-6) if wanted else True


def test_evaluation_of_all_methods(spark, small):
    rows = [r.asDict() for r in library_queries._pairs(spark, small).collect()]
    fitted = {}
    for c in ("formula", "overlap"):
        fit = [r for r in rows if r["split"] == "fit"]
        fitted[c] = evaluation.fit_logistic(np.array([r[c] for r in fit]), np.array([int(r["expected"] is not None and r["expected"] == r["region_id"]) for r in fit]))

    def outcomes(split, share, calibrated):
        def value(r, c):
            mean, scale, slope, intercept = fitted[c]
            return 1 / (1 + math.exp(-(intercept + slope * (r[c] - mean) / scale))) if calibrated else r[c]

        best = {}
        for r in rows:
            if r["split"] == split:
                key = (-(share * value(r, "formula") + (1 - share) * value(r, "overlap")), r["region_id"], r["representative_id"])
                best[r["example_id"]] = min(best.get(r["example_id"], (key, None)), (key, None), key=lambda x: x[0])
        expected = {r["example_id"]: r["expected"] for r in rows}
        return [(expected[i], k[1], -k[0]) for i, (k, _) in best.items()]

    def accuracy(found, t):
        known, strange = [x for x in found if x[0] is not None], [x for x in found if x[0] is None]
        hits, refused = sum(s >= t and e == g for e, g, s in known), sum(s < t for _, _, s in strange)
        return (hits / len(known) + refused / len(strange)) / 2, hits, refused

    for r in library_queries.e9_evaluation(spark, small).collect():
        calibrated, shares = r.method == "calibrated", {"formula": [1.0], "overlap": [0.0]}.get(r.method, [0.3, 0.7])
        best = 0
        for share in shares:
            found = outcomes("tune", share, calibrated)
            s = sorted({x[2] for x in found})
            best = max([best, *[round(accuracy(found, t)[0], 9) for t in [0, 1, *[(a + b) / 2 for a, b in itertools.pairwise(s)]]]])
        assert r.share in shares and abs(accuracy(outcomes("tune", r.share, calibrated), r.threshold)[0] - best) < 1e-6
        whole, hits, refused = accuracy(outcomes("test", r.share, calibrated), r.threshold)
        assert (r.known_correct, r.unfamiliar_correct) == (hits, refused) and abs(r.balanced_accuracy - whole) < 1e-6


def test_calibration_guards():
    with pytest.raises(ValueError):
        evaluation.fit_logistic(np.array([0.1, 0.2]), np.array([1, 1]))
    with pytest.raises(ValueError):
        evaluation.fit_logistic(np.array([0.1, np.nan]), np.array([0, 1]))
    low, high = evaluation.component_bootstrap([1, 1, 2, 3], np.array([1, 0, 1, 1]))
    assert 0 <= low <= high <= 1


def test_leaders(spark, small):
    ids = sorted(r.o_orderkey for r in table(spark, small, "orders").select("o_orderkey").collect())
    heads, wanted = [], {}
    for i in ids:
        wanted[i] = next((h for h in heads[-8:] if 0 < i - h <= 3 and i // 8 == h // 8 and (h * 31 + i * 17) % 5 < 2), i)
        if wanted[i] == i:
            heads.append(i)
    assert {r.id: r.leader for r in library_queries.m9_leaders(spark, small).collect()} == wanted
