"""Review state: merges, conflicts, decisions and a versioned store of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import by_locale



def keyed_union(present: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Present rows, and incoming ones whose key isn't present."""
    return present.unionByName(incoming.join(present.select(key), key, "left_anti").select(present.columns))


def conflicts(present: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Keys that both have with different content."""
    rest = [c for c in present.columns if c != key]
    content = F.to_json(F.struct(*rest))
    return present.select(key, content.alias("one")).join(incoming.select(key, content.alias("two")), key).where("one <> two").select(key)


def first_wins(rows: DataFrame, key, order: list) -> DataFrame:
    """Of rows with one key the first in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place__", place).where("place__ = 1").drop("place__")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """U4: whether two tables have the same rows as often."""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: the rows that one table has and the other hasn't (as often), with `side` a or b; none if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def with_missing(samples: DataFrame, missing: DataFrame) -> DataFrame:
    """Observed samples (cycle_id, t, f) and missing times (cycle_id, t), with their place in order of time."""
    both = samples.select("cycle_id", "t", "f").unionByName(missing.select("cycle_id", "t", F.lit(None).cast("double").alias("f")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("cycle_id").orderBy("t", F.col("f").isNull())) - 1)


def latest(decisions: DataFrame, key: str, order: str, keep: int = 20) -> DataFrame:
    """The last `keep` decisions of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return decisions.withColumn("place__", place).where(F.col("place__") <= keep).drop("place__")


def maximal(evidence: DataFrame) -> DataFrame:
    """Evidence (window_id, pattern_id, channels, start_event, end_event) without what another row of the same window,
    pattern and channels takes in: in order of start, only rows that end beyond all before them stay."""
    key = ["window_id", "pattern_id", "channels"]
    once = evidence.select(*key, "start_event", "end_event").withColumn("channels", F.array_sort(F.array_distinct("channels"))).groupBy(*key, "start_event").agg(F.max("end_event").alias("end_event"))
    before = F.max("end_event").over(Window.partitionBy(*key).orderBy("start_event").rowsBetween(Window.unboundedPreceding, -1))
    return once.withColumn("before", before).where("before IS NULL OR end_event > before").drop("before")


def covering(scopes: DataFrame, evidence: DataFrame, patterns: DataFrame) -> DataFrame:
    """(scope_id, pattern_id): the patterns that a scope of a window belongs to. Evidence of the scope's window, other
    than a challenge, takes in its interval and all its channels. A scope without an interval stands for its whole window: any
    such evidence of the window does, and so do patterns that the window represents, if they have such evidence anywhere.
    Only maximal evidence meets scopes, and scopes that ask for the same meet it once. evidence: (window_id, pattern_id, role,
    start_event, end_event, channels); patterns: (pattern_id, window_id), the representative one; scopes: (scope_id,
    window_id, start_event, end_event, channels), nulls without an interval."""
    counts = evidence.where("role IS NULL OR role <> 'challenge'")
    e = maximal(counts).select("window_id", "pattern_id", F.col("start_event").alias("e0"), F.col("end_event").alias("e1"), F.col("channels").alias("ec"))
    asked = ["window_id", "start_event", "end_event", "channels"]
    inside = (F.col("e0") <= F.col("start_event")) & (F.col("end_event") <= F.col("e1")) & (F.size(F.array_except("channels", "ec")) == 0)
    within = scopes.where("start_event IS NOT NULL")
    found = within.select(*asked).distinct().join(e, "window_id").where(inside).select(*asked, "pattern_id").distinct()
    represented = patterns.join(counts.select("pattern_id").distinct(), "pattern_id", "left_semi").select("window_id", "pattern_id")
    whole = counts.select("window_id", "pattern_id").unionByName(represented).distinct()
    alone = scopes.where("start_event IS NULL").select("scope_id", "window_id").join(whole, "window_id")
    return within.join(found, asked).select("scope_id", "pattern_id").unionByName(alone.select("scope_id", "pattern_id")).distinct()


def text_filter(rows: DataFrame, columns: list[str], text: str, *conditions: Column) -> DataFrame:
    """Rows whose columns, joined by blanks, contain the text in any case, and that meet the conditions."""
    kept = rows.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower().strip()))
    for c in conditions:
        kept = kept.where(c)
    return kept


def window_status(state: Column) -> Column:
    """What a window's review state is shown as."""
    return F.when(state == "associated", "reviewed").when(state == "unresolved", "unresolved").otherwise("unreviewed")


def named_windows(windows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Windows with display_name: the first pattern (by id) that the window represents, else the view's name, else
    the id. windows: (window_id, name, ...); patterns: (pattern_id, representative_id, name)."""
    first = patterns.groupBy(F.col("representative_id").alias("window_id")).agg(F.min_by("name", "pattern_id").alias("pattern_name"))
    return windows.join(first, "window_id", "left").withColumn("display_name", F.coalesce("pattern_name", "name", F.col("window_id").cast("string"))).drop("pattern_name")


def placed_by_locale(rows: DataFrame, group: str, name: str, *ties: str) -> DataFrame:
    """Rows with their place in their group by the root collation's order of names: marks, digits, letters, small ones
    before capitals that differ in nothing else; then by `ties`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(by_locale(F.col(name)), *ties)).cast("long"))


def fresh(results: DataFrame, current: DataFrame, identity: list[str]) -> DataFrame:
    """Results whose identity (workspace, revision, hashes ...) is a current one; nulls agree with nulls."""
    match = F.lit(True)
    for c in identity:
        match &= results[c].eqNullSafe(current[c])
    return results.join(current, match, "left_semi")


def same_windows(cycles: DataFrame) -> DataFrame:
    """(a, b), a < b: cycles (cycle_id, recording_id, window_start, window_end) of the same source window, each
    linked to the least one of it. Null-aware: cycles without a source share its absence."""
    least = F.min("cycle_id").over(Window.partitionBy("recording_id", "window_start", "window_end"))
    return cycles.select(least.alias("a"), F.col("cycle_id").alias("b")).where("a < b")


def presentation_edges(matches: DataFrame, limit: int = 4) -> DataFrame:
    """The first matches of each query, whole ones first, then by score and id, with the uncapped total. matches:
    (query_id, target_id, kind, score)."""
    order = Window.partitionBy("query_id").orderBy(F.col("kind") != "whole", F.desc("score"), "target_id")
    total = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    placed = matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return placed.join(total, "query_id")


def missing_references(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't among the known keys; a null reference is missing."""
    return rows.join(known.select(F.col(key).alias("known__")), F.col(column) == F.col("known__"), "left_anti")


def looked_up(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is among the keys of known ones; a null key is among none."""
    return rows.join(known.select(F.col(known_key).alias(key)), key, "left_semi").select(rows.columns)


def capacity(events: DataFrame, recording: str, most_events: int = 1_000_000) -> DataFrame:
    """(events, recordings, most, within): the events of all recordings, of the largest, and whether a library may hold
    them; one row, also of no events."""
    n = events.groupBy(recording).agg(F.count(F.lit(1)).alias("n"))
    found = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("recordings"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return found.withColumn("within", F.col("events") <= most_events)


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The different rows of both."""
    return a.unionByName(b).distinct()


def common_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that both have; none if the tables are disjoint."""
    return a.select(keys).join(b.select(keys), keys, "left_semi").distinct()


def collection(**sources: DataFrame) -> DataFrame:
    """All sources one after the other, with the source's name."""
    made = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    rows = made[0]
    for m in made[1:]:
        rows = rows.unionByName(m)
    return rows


def fingerprints(recordings: DataFrame, original: str, content: list[str]) -> DataFrame:
    """R2: each row's SHA-256 of its original text, and of its content as JSON with the columns in order of name."""
    canonical = F.to_json(F.struct(*[F.col(c) for c in sorted(content)]))
    return recordings.withColumn("original_sha256", F.sha2(F.col(original).cast("string"), 256)).withColumn("fingerprint", F.sha2(canonical, 256))


def add_windows(present: DataFrame, incoming: DataFrame, most: int | None = None) -> DataFrame:
    """Incoming windows (window_id, recording_id, start_event, end_event) that aren't present with these bounds yet;
    of several with the same bounds that of the least id. With `most`, an error where the table would grow beyond."""
    bounds = ["recording_id", "start_event", "end_event"]
    new = first_wins(incoming.join(present.select(bounds), bounds, "left_anti"), F.struct(*bounds), ["window_id"]).select(incoming.columns)
    if most is not None and present.count() + new.count() > most:
        raise ValueError(f"more than {most} windows")
    return new


def add_recordings(sources: DataFrame, streams: DataFrame, incoming: DataFrame) -> dict[str, DataFrame]:
    """The rows that a batch of recordings (recording_id, stream_id, profile_id, name, n_events) adds: sources, missing
    stream profiles and full windows; `refused` has what can't be added, with the first reason."""
    known = sources.select(F.col("recording_id").alias("known"))
    once = F.row_number().over(Window.partitionBy("recording_id").orderBy("stream_id", "name"))
    checked = incoming.withColumn("nth", once).join(known, F.col("recording_id") == F.col("known"), "left")
    reason = F.when(F.col("known").isNotNull() | (F.col("nth") > 1), "id exists").when(~F.col("profile_id").eqNullSafe(F.col("stream_id")), "profile disagrees")
    judged = checked.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(incoming.columns)
    windows = good.select(F.concat(F.lit("window-"), F.substring(F.sha2(F.concat_ws("/", F.col("recording_id").cast("string"), F.lit("0"), F.col("n_events").cast("string")), 256), 1, 12)).alias("window_id"), "recording_id", F.lit(0).cast("long").alias("start_event"), F.col("n_events").alias("end_event"), F.lit("unreviewed").alias("review_state"))
    new_streams = good.select("stream_id").distinct().join(streams.select("stream_id"), "stream_id", "left_anti")
    return {"sources": good, "streams": new_streams, "windows": windows, "refused": judged.where("reason IS NOT NULL").select(*incoming.columns, "reason")}


def effective(decisions: DataFrame, library: str = "library_id", seq: str = "seq") -> DataFrame:
    """The decisions that stand. An `undo` takes back the latest decision that stands; nothing is deleted. With each
    decision one up and each undo one down, a decision is taken back where the height later falls below its own."""
    order = Window.partitionBy(library).orderBy(seq)
    height = F.sum(F.when(F.col("action") == "undo", -1).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.min("height__").over(order.rowsBetween(1, Window.unboundedFollowing))
    stands = (F.col("action") != "undo") & F.coalesce(F.col("later__") >= F.col("height__"), F.lit(True))
    return decisions.withColumn("height__", height).withColumn("later__", later).where(stands).drop("height__", "later__")


def moved(members: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, group_id) after moves (seq, id, group_id), of which the last of each member counts. Approving a split moves
    its members into the new group; members without a move, anchors among them, stay."""
    last = moves.groupBy("id").agg(F.max_by("group_id", "seq").alias("to"))
    return members.join(last, "id", "left").select("id", F.coalesce("to", "group_id").alias("group_id"))


#: Entries of a review store that may be placed or acknowledged, and names that can't be ids (fixed values).
MOST_PLACEMENTS, MOST_ACKNOWLEDGED, RESERVED = 10_000, 10_000, ("__proto__", "constructor", "prototype")


def store_violations(groups: DataFrame, placements: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """V8: (rule, subject) for each broken rule of a review store. Group, anchor, name, placed entry, its group and
    acknowledged tokens have 1 to 200 UTF-16 units and aren't reserved words; group ids begin with region- or split-; no
    group or anchor is named twice; at most 10,000 entries are placed and as many acknowledged. groups: (group_id, anchor_id,
    name); placements: (entry_id, group_id); acknowledged: (token); all texts."""
    size = lambda c: F.octet_length(F.encode(c, "UTF-16BE")) / 2
    bad = lambda c: ~F.coalesce(size(c).between(1, 200) & ~F.col(c).isin(*RESERVED), F.lit(False))
    broken = lambda rows, when, rule, c: rows.where(when).select(F.lit(rule).alias("rule"), F.col(c).alias("subject"))
    found = broken(groups, ~F.coalesce(F.col("group_id").startswith("region-") | F.col("group_id").startswith("split-"), F.lit(False)), "group_id without region- or split-", "group_id")
    for rows, c, what in ((groups, "group_id", "group_id"), (groups, "anchor_id", "anchor_id"), (groups, "name", "name"), (placements, "entry_id", "placed entry"), (placements, "group_id", "placed group"), (acknowledged, "token", "acknowledged")):
        found = found.unionByName(broken(rows, bad(c), f"{what} is no id", c))
    for c in ("group_id", "anchor_id"):
        found = found.unionByName(broken(groups.groupBy(c).count(), F.col("count") > 1, f"{c} named twice", c))
    for what, n, most in (("placements", placements.agg(F.count_distinct("entry_id").alias("n")), MOST_PLACEMENTS), ("acknowledged", acknowledged.agg(F.count(F.lit(1)).alias("n")), MOST_ACKNOWLEDGED)):
        found = found.unionByName(n.where(F.col("n") > most).select(F.lit(f"too many {what}").alias("rule"), F.col("n").cast("string").alias("subject")))
    return found


#: The actions of a review that associate a window with a pattern.
ASSOCIATING = ("new-pattern", "support", "variant", "challenge")


def review_state(decisions: DataFrame) -> DataFrame:
    """(library_id, window_id, review_state, pattern_id, n_evidence): the state that standing decisions leave, as a
    fold over the appended log. decisions: (library_id, seq, action, window_id, pattern_id)."""
    standing = effective(decisions).where(F.col("action") != "reject-suggestion")
    associated = F.col("action").isin(*ASSOCIATING)
    last = standing.groupBy("library_id", "window_id").agg(
        F.max_by(F.when(associated, "associated").otherwise("unresolved"), "seq").alias("review_state"),
        F.max_by(F.when(associated, F.col("pattern_id")), F.when(associated, F.col("seq"))).alias("pattern_id"),
        F.count_if(associated).alias("n_evidence"),
    )
    return last


def review_errors(decisions: DataFrame, windows: DataFrame, patterns: DataFrame) -> DataFrame:
    """R3's guards: (decision_id, rule): the first rule that a decision breaks. decisions: (decision_id, action, window_id,
    explanation, target_id, target_revision, score, match_scope); windows: (window_id, n_events, most_measured);
    patterns: (pattern_id, representative_id, revision)."""
    by_window = patterns.groupBy(F.col("representative_id").alias("window_id")).agg(F.count(F.lit(1)).alias("represents"))
    target = patterns.select(F.col("pattern_id").alias("target_id"), F.col("revision").alias("now"))
    rows = decisions.join(windows, "window_id", "left").join(by_window, "window_id", "left").join(target, "target_id", "left")
    passive, against = F.col("action").isin("leave-unresolved", "reject-suggestion"), F.col("action").isin("support", "variant", "challenge")
    rule = (
        F.when(F.col("n_events").isNull(), "window is gone")
        .when(~passive & ((F.col("n_events") < 16) | (F.col("most_measured") < 16)), "too little evidence")
        .when(F.trim(F.coalesce("explanation", F.lit(""))) == "", "no explanation")
        .when((F.col("action") == "new-pattern") & F.col("represents").isNotNull(), "window represents a pattern")
        .when(against & F.col("now").isNull(), "no target")
        .when(F.col("target_revision") != F.col("now"), "target changed")
        .when(F.col("score").isNotNull() & ~F.col("score").between(0, 1), "invalid score")
        .when(against & (F.col("match_scope") == "insufficient-evidence"), "insufficient evidence")
    )
    return rows.select("decision_id", rule.alias("rule")).where("rule IS NOT NULL")


def relation_kind(scope: Column, partial: Column, missing: Column, action: Column) -> Column:
    """The kind of a reviewed relationship between streams."""
    return (
        F.when(scope == "single-parameter", "single-parameter-similarity").when(partial, "partial-match").when(missing, "partial-channel-similarity")
        .when(action == "variant", "scale-variant").otherwise("coordinated-similarity")
    )


def merge_tables(present: dict[str, DataFrame], incoming: dict[str, DataFrame], key: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of two backups joined by kind, and (kind, id) of the rows that both have with different content; the
    merge is only valid without any."""
    found = None
    for kind in present:
        here = conflicts(present[kind], incoming[kind], key).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
        found = here if found is None else found.unionByName(here)
    return {kind: keyed_union(present[kind], incoming[kind], key) for kind in present}, found


def migrate(legacy: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Legacy JSON texts by a schema: rows with `value`, and rows that aren't valid JSON, with their text kept."""
    whole = F.try_parse_json(text).isNotNull()
    return legacy.where(whole).withColumn("value", F.from_json(text, schema)), legacy.where(F.coalesce(~whole, F.lit(True)))
