"""The registered queries over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import cycles, evaluation, linkage, matching, periods, policy, review, windows
from ..sources.shared import materialise
from ..sources.tables import QUANTITIES, recordings, table

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}

#: Recordings of the event table, as in sources.tables.recordings.
REC = """
WITH rec AS (
  SELECT user_id AS recording_id, row_number() OVER w - 1 AS event_idx,
         CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) AS t, value AS frequency,
         CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w AS DOUBLE) AS pri,
         nullif(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE), 0) AS pw
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rec(spark, sf_dir):
    return recordings(table(spark, sf_dir, "events"))


_SUMMARY = """SELECT recording_id, count(*) AS n_events, count(frequency) AS n_frequency, count(pri) AS n_pri, count(pw) AS n_pw,
  count(*) FILTER (frequency IS NOT NULL AND pri IS NOT NULL) AS n_frequency_pri,
  count(*) FILTER (frequency IS NOT NULL AND pw IS NOT NULL) AS n_frequency_pw,
  count(*) FILTER (pri IS NOT NULL AND pw IS NOT NULL) AS n_pri_pw,
  count(*) FILTER ((frequency IS NOT NULL)::INT + (pri IS NOT NULL)::INT + (pw IS NOT NULL)::INT >= 2) AS n_joint,
  count(*) FILTER (frequency IS NOT NULL AND pri IS NOT NULL AND pw IS NOT NULL) AS n_complete,
  min(frequency) AS min_frequency, max(frequency) AS max_frequency, min(pri) AS min_pri, max(pri) AS max_pri,
  min(pw) AS min_pw, max(pw) AS max_pw, max(t) - min(t) AS duration FROM rec GROUP BY recording_id"""


@query(f"{REC} {_SUMMARY}")
def a_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.summary(_rec(spark, sf_dir))


@query(f"""{REC}, rests AS (SELECT recording_id * 2 + (event_idx >= 60)::INT AS recording_id, event_idx, t, frequency, pri, pw FROM rec),
  x AS (SELECT *, t - lag(t) OVER (PARTITION BY recording_id ORDER BY event_idx) AS step FROM rests), g AS (
  SELECT recording_id, count(*) < 16 AS r1, coalesce(bool_or(step <= 0), false) AS r2,
    coalesce(bool_or(NOT isfinite(coalesce(frequency, 0)) OR NOT isfinite(coalesce(pri, 0)) OR NOT isfinite(coalesce(pw, 0))), false) AS r3,
    coalesce(bool_or(coalesce(pri, 1) <= 0 OR coalesce(pw, 1) <= 0), false) AS r4, max(t) - min(t) <= 0 AS r5,
    greatest(count(frequency), count(pri), count(pw)) < 16 AS r6 FROM x GROUP BY recording_id),
  l AS (SELECT recording_id, list_filter([CASE WHEN r1 THEN 'few_events' END, CASE WHEN r2 THEN 'unordered_time' END,
    CASE WHEN r3 THEN 'not_finite' END, CASE WHEN r4 THEN 'not_positive' END, CASE WHEN r5 THEN 'no_span' END,
    CASE WHEN r6 THEN 'few_measurements' END], lambda r: r IS NOT NULL) AS rules FROM g)
  SELECT recording_id, CAST(i - 1 AS INTEGER) AS rule_order, rules[i] AS rule
  FROM (SELECT recording_id, rules, unnest(generate_series(1, len(rules))) AS i FROM l)""")
def v1_gate(spark, sf_dir):
    # Recordings are cut at 60 events; some rests are too short, so that rules are broken.
    cut = F.col("recording_id") * 2 + (F.col("event_idx") >= 60).cast("int")
    return windows.violations(_rec(spark, sf_dir).withColumn("recording_id", cut))


@query(f"""{REC}, w AS (SELECT DISTINCT recording_id, CAST(16 AS BIGINT) AS start_event, CAST(48 AS BIGINT) AS end_event FROM rec)
  SELECT recording_id, event_idx, t, frequency, pri, pw FROM rec JOIN w USING (recording_id)
  WHERE event_idx >= start_event AND event_idx < end_event""")
def p1_window_slice(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    cut = rec.select("recording_id").distinct().select("recording_id", F.lit(16).alias("start_event"), F.lit(48).alias("end_event"))
    return windows.slice_window(rec, cut).select(*rec.columns)


_DECIMATE = REC + """, d AS (
  SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM rec
), b AS (SELECT *, event_idx // greatest(1, CAST(ceil(n / 64.0) AS BIGINT)) AS bucket FROM d
), k AS (
  SELECT recording_id, min(event_idx) AS i FROM b GROUP BY recording_id, bucket
  UNION SELECT recording_id, max(event_idx) FROM b GROUP BY recording_id
  %s
), c AS (
  SELECT *, %s FROM rec
), p AS (SELECT c.* FROM c JOIN k ON c.recording_id = k.recording_id AND c.event_idx = k.i)
""" % (
    " ".join(
        f"UNION SELECT recording_id, (min(struct_pack(v := {q}, i := event_idx)) FILTER ({q} IS NOT NULL)).i FROM b GROUP BY recording_id, bucket"
        f" UNION SELECT recording_id, (min(struct_pack(v := -{q}, i := event_idx)) FILTER ({q} IS NOT NULL)).i FROM b GROUP BY recording_id, bucket"
        f" UNION SELECT recording_id, min(event_idx) FILTER ({q} IS NULL) FROM b GROUP BY recording_id, bucket"
        for q in QUANTITIES
    ),
    ", ".join(f"sum(({q} IS NULL)::INT) OVER (PARTITION BY recording_id ORDER BY event_idx) AS m_{q}" for q in QUANTITIES),
)
_POINTS = ", points AS (SELECT recording_id, event_idx, t, frequency, pri, pw, %s FROM p WINDOW o AS (PARTITION BY recording_id ORDER BY event_idx))" % ", ".join(
    f"coalesce(m_{q} - ({q} IS NULL)::INT > lag(m_{q}) OVER o, false) AS break_{q}" for q in QUANTITIES
)


@query(f"{_DECIMATE}{_POINTS} SELECT * FROM points")
def m1_decimate(spark, sf_dir):
    return windows.decimate(_rec(spark, sf_dir))


@query(f"""{_DECIMATE}{_POINTS}, s AS ({_SUMMARY}), j AS (SELECT recording_id, count(*) FILTER (frequency IS NOT NULL AND pri IS NOT NULL
  AND pw IS NOT NULL AND NOT break_frequency AND NOT break_pri AND NOT break_pw) AS joint_measured FROM points GROUP BY recording_id)
  SELECT recording_id, joint_measured, n_frequency >= 16 AND n_pri >= 16 AND n_pw >= 16 AND n_events >= 16 AND duration > 0 AND joint_measured >= 16 AS eligible,
  concat_ws('; ', CASE WHEN n_frequency < 16 THEN 'frequency: too few measured events' END, CASE WHEN n_pri < 16 THEN 'pri: too few measured events' END,
   CASE WHEN n_pw < 16 THEN 'pw: too few measured events' END, CASE WHEN n_events < 16 OR duration <= 0 THEN 'too few events or no time span' END,
   CASE WHEN joint_measured < 16 THEN 'too few positions with all quantities' END) AS reasons FROM s JOIN j USING (recording_id)""")
def p5_eligibility(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return windows.eligibility(windows.resample(windows.decimate(rec)), windows.summary(rec))


def _packed(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    counts = windows.summary(rec)
    points = windows.resample(windows.decimate(rec))
    fit = windows.eligibility(points, counts).where("eligible").select("recording_id")
    return matching.pack(points, counts.join(fit, "recording_id", "left_semi"))


#: Whole-window scores in SQL: positions by rounding, ranges by pair, mean squares, and distinct aligned support.
_WHOLE = f"""{_DECIMATE}{_POINTS}, v AS (
  SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY event_idx) - 1 AS pos, event_idx, t,
    [frequency, pri, pw] AS x, [break_frequency, break_pri, break_pw] AS br FROM points
), g AS (
  SELECT recording_id, count(*) AS n, min(event_idx) AS i0, max(event_idx) AS i1, min(t) AS t0, max(t) AS t1,
    [min(x[1]), min(x[2]), min(x[3])] AS lo, [max(x[1]), max(x[2]), max(x[3])] AS hi FROM v GROUP BY recording_id
  HAVING count(*) >= 16
), ev AS (
  SELECT recording_id AS er FROM rec GROUP BY recording_id HAVING greatest(count(frequency), count(pri), count(pw)) >= 16
), al AS (
  SELECT ga.recording_id AS q, gb.recording_id AS u, k, a.pos AS ap, b.pos AS bp, (a.t - ga.t0) / (ga.t1 - ga.t0) - (b.t - gb.t0) / (gb.t1 - gb.t0) AS dt,
    a.x[k] IS NOT NULL AND b.x[k] IS NOT NULL AND NOT a.br[k] AND NOT b.br[k] AS ok,
    CASE WHEN ga.hi[k] = ga.lo[k] AND gb.hi[k] = gb.lo[k] THEN 0 WHEN ga.hi[k] = ga.lo[k] OR gb.hi[k] = gb.lo[k] THEN 1
      ELSE (a.x[k] - ga.lo[k]) / (ga.hi[k] - ga.lo[k]) - (b.x[k] - gb.lo[k]) / (gb.hi[k] - gb.lo[k]) END AS d
  FROM g ga JOIN ev ON er = ga.recording_id JOIN g gb ON ga.recording_id <> gb.recording_id JOIN v a ON a.recording_id = ga.recording_id
  JOIN v b ON b.recording_id = gb.recording_id AND b.pos = CAST(floor((a.event_idx - ga.i0) / greatest(1, ga.i1 - ga.i0)::DOUBLE * (gb.n - 1) + 0.5) AS BIGINT)
  CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)
), ch AS (
  SELECT q, u, k, sum(d * d) FILTER (ok) / count(*) FILTER (ok) AS ms,
    least(count(DISTINCT ap) FILTER (ok), count(DISTINCT bp) FILTER (ok)) AS support FROM al GROUP BY q, u, k
), pt AS (SELECT q, u, ap, any_value(bp) AS bp, any_value(dt) AS dt, count(*) FILTER (ok) AS n FROM al GROUP BY q, u, ap
), ti AS (
  SELECT q, u, sqrt(avg(dt * dt) FILTER (n > 0)) AS te, least(count(*) FILTER (n = 3), count(DISTINCT bp) FILTER (n = 3)) AS joint FROM pt GROUP BY q, u
), sc AS (
  SELECT q, u, exp(-4 * sqrt(avg(ms)) - 2 * any_value(te)) AS score, min(support) >= 16 AND any_value(joint) >= 16 AS complete
  FROM ch JOIN ti USING (q, u) GROUP BY q, u
)"""


#: The same with channels: units by recording, some arbitrary, a second channel of a quantity, a channel that isn't there,
#: times in two units; frequency and pri are compared.
_UNITS = """, kd AS (SELECT DISTINCT user_id AS kr, [CASE WHEN user_id % 9 = 4 THEN NULL WHEN user_id % 4 = 3 THEN 'fu' ELSE '' END, CASE WHEN user_id % 6 = 5 THEN 'tu' ELSE '' END] AS cls FROM events)"""
_CHANNELLED = (
    _WHOLE.replace("value AS frequency", "CASE WHEN user_id % 9 <> 4 THEN value END AS frequency").replace("nullif(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS DOUBLE), 0) AS pw", "CAST(NULL AS DOUBLE) AS pw", 1)
    .replace("SELECT recording_id AS er FROM rec GROUP BY recording_id HAVING greatest(count(frequency), count(pri), count(pw)) >= 16", "SELECT user_id AS er FROM events GROUP BY user_id HAVING count(*) >= 16")
    .replace("AND NOT a.br[k] AND NOT b.br[k] AS ok", "AND NOT a.br[k] AND NOT b.br[k] AND coalesce(ka.cls[k] = kb.cls[k], false) AS ok")
    .replace("  CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)", "  JOIN kd ka ON ka.kr = ga.recording_id JOIN kd kb ON kb.kr = gb.recording_id CROSS JOIN (SELECT unnest([1, 2]) AS k)")
    .replace("n = 3", "n = 2").replace("), al AS (", ")" + _UNITS + ", al AS (")
)


def _channelled(spark, sf_dir):
    """Values, channels and windows of recordings that differ in units."""
    rec, r = _rec(spark, sf_dir), F.col("recording_id")
    names = F.array(F.lit("f1"), F.lit("f2"), F.lit("p1"), F.lit("x1"))
    value = [F.col("frequency") / F.when(r % 4 == 1, 1e3).otherwise(1.0), F.when(r % 9 == 4, F.col("frequency")), F.col("pri") / F.when(r % 2 == 0, 1e3).otherwise(1.0), F.lit(1.0)]
    rows = rec.select(r.alias("window_id"), "event_idx", (F.col("t") / F.when(r % 5 == 0, 1e3).otherwise(1.0)).alias("t"), F.explode(F.arrays_zip(names.alias("n"), F.array(*value).alias("v"))).alias("x"))
    values = rows.select("window_id", "event_idx", "t", F.col("x.n").alias("channel_id"), F.col("x.v").alias("value"))
    ids = rec.select(r.alias("window_id")).distinct()
    w = F.col("window_id")
    unit = F.when(F.col("channel_id").isin("f1", "f2"), F.when(w % 4 == 3, "fu").when(w % 4 == 1, "GHz").otherwise("MHz")).when(F.col("channel_id") == "p1", F.when(w % 6 == 5, "tu").when(w % 2 == 0, "ms").otherwise("us")).otherwise("dB")
    kinds = ids.select("window_id", F.explode(names).alias("channel_id")).where((F.col("channel_id") != "f2") | (w % 9 == 4))
    quantity = F.when(F.col("channel_id").isin("f1", "f2"), "frequency").when(F.col("channel_id") == "p1", "pri").otherwise("numeric")
    channels = kinds.select("window_id", "channel_id", quantity.alias("quantity"), unit.alias("unit"), F.lit("supplied").alias("origin"))
    return values, channels, ids.withColumn("time_unit", F.when(w % 5 == 0, "ms").otherwise("us"))


@query(f"{_CHANNELLED} SELECT q AS query_id, u AS target_id, round(score, 6) AS score, complete FROM sc WHERE score IS NOT NULL")
def m3_units(spark, sf_dir):
    """M3 with P3 and P4: windows by their one supplied channel of frequency and of pri, whatever the units."""
    from ..operators import channels

    rec, kinds = channels.compared_recordings(*_channelled(spark, sf_dir), ("frequency", "pri"))
    packed = matching.pack(windows.resample(windows.decimate(rec)), windows.summary(rec), kinds)
    found = matching.directed_scores(packed, matching.Settings(parameters=("frequency", "pri")))
    return found.select("query_id", "target_id", F.round("score", 6).alias("score"), "complete")


@query(f"{_WHOLE} SELECT q AS query_id, u AS target_id, round(score, 6) AS score, complete FROM sc WHERE score IS NOT NULL")
def m3_whole_score(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    packed = matching.pack(windows.resample(windows.decimate(rec)), windows.summary(rec))
    return matching.directed_scores(packed).withColumn("score", F.round("score", 6))


@query(f"{_WHOLE} SELECT x.q AS a, x.u AS b, round(least(x.score, y.score), 6) AS score FROM sc x JOIN sc y ON x.q = y.u AND x.u = y.q WHERE x.q < x.u AND x.complete AND y.complete")
def m6_symmetric(spark, sf_dir):
    return matching.symmetric_scores(_packed(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query()
def c13_similarity_groups(spark, sf_dir):
    packed = _packed(spark, sf_dir)
    return linkage.groups(packed.select(F.col("recording_id").alias("id")), matching.symmetric_scores(packed, least_score=0.2), 0.2)


@query()
def m5_ranked_matches(spark, sf_dir):
    packed = _packed(spark, sf_dir)
    return matching.ranked(matching.match_many(packed, packed.where("recording_id % 100 = 0")))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings), c AS (
  SELECT vec_id, f, (list_max(f) + list_min(f)) / 2 AS centre, (list_max(f) - list_min(f)) / 2 AS excursion FROM v), g AS (
  SELECT vec_id, p, p / 2.0 AS x, f, centre, excursion FROM c, (SELECT unnest(generate_series(0, 127)) AS p))
  SELECT vec_id AS cycle_id, CAST(p AS INTEGER) AS phase, round(((f[1 + p // 2] + (f[1 + (p // 2 + 1) % 64] - f[1 + p // 2]) * (p % 2) / 2.0) - centre) / excursion, 6) AS value FROM g WHERE excursion > 1e-12""")
def c2_phase_grid(spark, sf_dir):
    grid = cycles.phase_grid(cycles.from_embeddings(table(spark, sf_dir, "embeddings")))
    return grid.select("cycle_id", F.posexplode("grid").alias("phase", "value")).select("cycle_id", "phase", F.round("value", 6).alias("value"))


def _gridded(spark, sf_dir):
    return cycles.phase_grid(cycles.from_embeddings(table(spark, sf_dir, "embeddings")))


#: Least root mean squares over all circular shifts, by inner products with every rotation.
_SHIFTED = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings), c AS (
  SELECT vec_id, f, (list_max(f) + list_min(f)) / 2 AS centre, (list_max(f) - list_min(f)) / 2 AS excursion FROM v), g AS (
  SELECT vec_id, excursion, list_transform(range(128), lambda p: ((f[1 + p // 2] + (f[1 + (p // 2 + 1) % 64] - f[1 + p // 2]) * (p % 2) / 2.0) - centre) / excursion) AS a FROM c WHERE excursion > 1e-12),
  n AS (SELECT vec_id, excursion, a::DOUBLE[128] AS a, list_inner_product(a, a) AS s FROM g),
  r AS (SELECT vec_id, excursion, s, list_concat((a::DOUBLE[])[k + 1:], (a::DOUBLE[])[:k])::DOUBLE[128] AS b FROM n, unnest(generate_series(0, 127)) AS t(k)),
  m AS (SELECT x.vec_id AS x, y.vec_id AS y, any_value(x.excursion) AS ex, any_value(y.excursion) AS ey, sqrt(greatest(0, any_value(x.s) + any_value(y.s) - 2 * max(array_inner_product(x.a, y.b))) / 128) AS rms FROM n x JOIN r y ON {ON} GROUP BY ALL)"""


@query(_SHIFTED.replace("{ON}", "y.vec_id > x.vec_id") + " SELECT x AS a, y AS b, round(rms, 6) AS distance FROM m")
def j4_cycle_distances(spark, sf_dir):
    return cycles.distances(_gridded(spark, sf_dir)).select("a", "b", F.round("distance", 6).alias("distance"))


@query(_SHIFTED.replace("{ON}", "y.vec_id <> x.vec_id") + """, d AS (SELECT x, y, sqrt(0.65 * rms ** 2 + 0.15 * log2(ex / ey) ** 2) AS d FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(d, 9), y) AS n FROM d)
  SELECT x AS query_id, y AS cycle_id, round(d, 6) AS distance FROM k WHERE n <= 5""")
def j6_neighbours(spark, sf_dir):
    """Of every cycle, by the default weights of shape, period and excursion."""
    return cycles.neighbours(_gridded(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id AS cycle_id, CAST(64 AS INTEGER) AS n_samples, 0.015625 AS gap_fraction FROM embeddings WHERE list_max(embedding) - list_min(embedding) > 2e-12")
def a12_cyclic_gap(spark, sf_dir):
    return cycles.largest_gap(cycles.from_embeddings(table(spark, sf_dir, "embeddings"))).select("cycle_id", "n_samples", F.round("gap_fraction", 9).alias("gap_fraction"))


@query(f"""{REC}, g AS (SELECT recording_id, t - lag(t) OVER (PARTITION BY recording_id ORDER BY t) AS gap FROM rec)
  SELECT recording_id, list_sort(list(gap))[1 + len(list(gap)) // 2] AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY recording_id""")
def a11_median_gap(spark, sf_dir):
    return periods.median_gap(_rec(spark, sf_dir).select("recording_id", "t", F.col("frequency").alias("f")))


@query()
def e1_periods(spark, sf_dir):
    """Each vector, five times over, is a recording of period 64."""
    e = table(spark, sf_dir, "embeddings")
    five = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 5))
    samples = e.select(F.col("vec_id").alias("recording_id"), F.posexplode(five).alias("t", "f"))
    return periods.suggest_periods(samples.select("recording_id", F.col("t").cast("double").alias("t"), "f"))


@query(f"""{REC}, l AS (SELECT recording_id, max(t) AS m FROM rec GROUP BY recording_id)
  SELECT recording_id, CAST(floor(t / (m / 4)) AS BIGINT) AS "window", t - floor(t / (m / 4)) * (m / 4) AS t, frequency AS f
  FROM rec JOIN l USING (recording_id) WHERE (floor(t / (m / 4)) + 1) * (m / 4) <= m + 1e-12""")
def c24_extract_cycles(spark, sf_dir):
    samples = _rec(spark, sf_dir).select("recording_id", "t", F.col("frequency").alias("f"))
    quarter = samples.groupBy("recording_id").agg(F.lit(0.0).alias("start"), (F.max("t") / 4).alias("period"))
    return periods.extract_cycles(samples, quarter)


_OUTCOMES = """WITH o AS (SELECT CASE WHEN vec_id % 3 = 0 THEN NULL ELSE label END AS expected, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN label + 1 ELSE label END AS predicted FROM embeddings)"""


def _outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    miss = F.when(F.col("vec_id") % 5 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))
    return e.select(F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("expected"), miss.alias("predicted"))


@query(f"""{_OUTCOMES}, c AS (SELECT count(expected) AS n_known, count(*) - count(expected) AS n_unfamiliar, count(*) FILTER (expected = predicted) AS known_correct,
  count(*) FILTER (expected IS NULL AND predicted IS NULL) AS unfamiliar_correct, count(*) FILTER (expected IS NULL AND predicted IS NOT NULL) AS false_merges,
  count(*) FILTER (expected IS NOT NULL AND predicted IS NULL) AS false_splits, count(*) FILTER (expected <> predicted) AS wrong_groups FROM o)
  SELECT *, round((known_correct / n_known + unfamiliar_correct / n_unfamiliar) / 2, 9) AS balanced_accuracy FROM c""")
def a13_metrics(spark, sf_dir):
    return evaluation.metrics(_outcomes(spark, sf_dir))


@query("""WITH p AS (SELECT (vec_id * 37 % 1000) / 1000.0::DOUBLE AS score, CASE WHEN label > 4 THEN 1 ELSE 0 END AS y FROM embeddings),
  n AS (SELECT count(*) FILTER (y = 1) AS o, count(*) FILTER (y = 0) AS z FROM p),
  r AS (SELECT score, y, CASE WHEN y = 1 THEN 0.5 / o ELSE 0.5 / z END AS w, least(floor(score * 5), 4) AS bin FROM p, n),
  b AS (SELECT sum(w * score) AS s, sum(w * y) AS p, sum(w * (score - y) * (score - y)) AS b FROM r GROUP BY bin)
  SELECT round(sum(b), 6) AS brier, round(sum(abs(s - p)), 6) AS ece FROM b""")
def a14_calibration_error(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return evaluation.calibration_error(e.select((F.col("vec_id") * 37 % 1000 / 1000.0).alias("score"), (F.col("label") > 4).cast("int").alias("y")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def u3_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.struct("user_id", "event_type"))
    return review.first_wins(e, "k", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def o6_latest_decisions(spark, sf_dir):
    return review.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def j14_keyed_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return review.keyed_union(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")
def j15_conflicts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    changed = c.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    return review.conflicts(c, changed, "c_custkey")


@query("""WITH e AS (SELECT o_orderkey % 50 AS window_id, o_orderkey % 7 + 7 * (o_orderkey % 2) AS pattern_id, o_orderkey % 20 AS a, o_orderkey % 20 + 20 + o_orderkey % 11 AS b, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS both_channels FROM orders WHERE o_orderkey % 13 > 3),
  s AS (SELECT c_custkey AS scope_id, c_custkey % 53 AS window_id, c_custkey % 17 = 0 AS whole, 10 + c_custkey % 25 AS z, c_custkey % 3 = 0 AS needs FROM customer), r AS (SELECT p_partkey AS pattern_id, p_partkey % 60 AS window_id FROM part WHERE p_partkey IN (SELECT pattern_id FROM e))
  SELECT DISTINCT scope_id, pattern_id FROM s JOIN e USING (window_id) WHERE whole OR (a <= 10 AND z <= b AND (both_channels = 1 OR NOT needs))
  UNION SELECT scope_id, pattern_id FROM s JOIN r USING (window_id) WHERE whole""")
def p12_covering_evidence(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    both = F.array(F.lit("f"), F.lit("p"))
    evidence = o.select(
        (k % 50).alias("window_id"), (k % 7 + 7 * (k % 2)).alias("pattern_id"), F.when(k % 13 <= 3, "challenge").when(k % 13 < 8, "variant").otherwise("support").alias("role"),
        (k % 20).alias("start_event"), (k % 20 + 20 + k % 11).alias("end_event"), F.when(k % 2 == 0, both).otherwise(F.array(F.lit("f"))).alias("channels"),
    )
    c, p = F.col("c_custkey"), F.col("p_partkey")
    part = lambda x: F.when(c % 17 > 0, x)
    scopes = table(spark, sf_dir, "customer").select(c.alias("scope_id"), (c % 53).alias("window_id"), part(F.lit(10).cast("long")).alias("start_event"), part(10 + c % 25).alias("end_event"), part(F.when(c % 3 == 0, both).otherwise(F.array(F.lit("f")))).alias("channels"))
    return review.covering(scopes, evidence, table(spark, sf_dir, "part").select(p.alias("pattern_id"), (p % 60).alias("window_id")))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'reviewed' WHEN c_custkey % 3 = 1 THEN 'unresolved' ELSE 'unreviewed' END AS status
  FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build') AND c_nationkey >= 5""")
def p6_text_filter(spark, sf_dir):
    k = F.col("c_custkey") % 3
    status = review.window_status(F.when(k == 0, "associated").when(k == 1, "unresolved"))
    kept = review.text_filter(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "Build", F.col("c_nationkey") >= 5)
    return kept.select("c_custkey", "c_name", status.alias("status"))


@query("""SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda x: unicode(x)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))), 8, '0') AS signature FROM part""")
def hash_fnv(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.fnv1a(F.col("p_name")).alias("signature"))


@query("""WITH RECURSIVE s AS (SELECT c_custkey, CAST(c_custkey AS BIGINT) AS x, 0 AS i FROM customer
  UNION ALL SELECT c_custkey, (x * 1664525 + 1013904223) % 4294967296, i + 1 FROM s WHERE i < 10) SELECT c_custkey, x AS state FROM s WHERE i = 10""")
def prng_lcg(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.lcg(F.col("c_custkey"), F.lit(10)).alias("state"))


@query("""WITH d AS (SELECT DISTINCT o_totalprice AS score FROM orders), p AS (SELECT (score + lag(score) OVER (ORDER BY score)) / 2 AS threshold FROM d) SELECT threshold FROM p WHERE threshold IS NOT NULL""")
def w8_threshold_grid(spark, sf_dir):
    return evaluation.threshold_grid(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score")))


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
  SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank, t.total FROM e JOIN (SELECT user_id, count(*) AS total FROM events GROUP BY user_id) t USING (user_id) WHERE rank <= 4""")
def o5_presentation_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    edges = review.presentation_edges(e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("target_id"), F.lit("whole").alias("kind"), F.col("value").alias("score")))
    return edges.select(F.col("query_id").alias("user_id"), F.col("target_id").alias("event_id"), F.col("score").alias("value"), "rank", "total")


@query("""WITH v AS (SELECT vec_id, label, list_max(embedding)::DOUBLE AS hi, list_min(embedding)::DOUBLE AS lo FROM embeddings)
  SELECT label, min(hi - lo) AS least_range, max(hi - lo) AS most_range, count(*) AS n_members FROM v GROUP BY label""")
def a10_region_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    span = F.array_max("embedding").cast("double") - F.array_min("embedding").cast("double")
    return policy.region_ranges(e.select(F.col("label").alias("region_id"), span.alias("range")), "range").withColumnRenamed("region_id", "label")


@query("""SELECT label, count(DISTINCT vec_id % 7) AS captures, count(DISTINCT CASE WHEN vec_id % 3 = 0 THEN vec_id % 11 END) AS shapes FROM embeddings GROUP BY label""")
def a9_distinct_captures(spark, sf_dir):
    v = F.col("vec_id")
    members = table(spark, sf_dir, "embeddings").select(F.col("label").alias("region_id"), (v % 7).alias("capture_id"), F.when(v % 3 == 0, v % 11).alias("shape"))
    return policy.distinct_captures(members).withColumnRenamed("region_id", "label")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 12)""")
def v10_missing_references(spark, sf_dir):
    """Rows of a backup whose reference isn't in it."""
    known = table(spark, sf_dir, "customer").where("c_nationkey < 12")
    return review.missing_references(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", known, "c_custkey")


@query("""SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS bucket, count(*) AS n_events, min(value) AS least, max(value) AS most FROM events GROUP BY ALL""")
def w10_tumbling_buckets(spark, sf_dir):
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return windows.tumbling(table(spark, sf_dir, "events"), ["user_id"], at, 3600000000, F.count(F.lit(1)).alias("n_events"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"""{REC}, n AS (SELECT *, lag(frequency) OVER o AS b, lead(frequency) OVER o AS a FROM rec WINDOW o AS (PARTITION BY recording_id ORDER BY event_idx))
  SELECT recording_id, event_idx, frequency FROM n WHERE b IS NOT NULL AND a IS NOT NULL AND frequency >= a AND frequency >= b""")
def w5_local_maxima(spark, sf_dir):
    return windows.local_maxima(_rec(spark, sf_dir), "recording_id", "event_idx", "frequency").select("recording_id", "event_idx", "frequency")


from . import library_queries  # noqa: E402, F401  (registers its queries)
