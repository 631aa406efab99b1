"""Period search in raw recordings, and cycles cut out at a period."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .review import row_differences

SUGGESTED = "recording_id long, place int, period double, similarity double, pairs int, coverage double, repeats double"


#: Values that are read at once when lags are scored: temporary arrays then stay in the processor's cache.
AT_ONCE = 1 << 14


class _Likeness:
    """How much a recording resembles itself at lags: values are read on the line between the samples around a time, or with
    hold from the one before, and don't count where these are more than widest apart or a time between them is missing."""

    def __init__(self, t: np.ndarray, f: np.ndarray, widest: float, missing: np.ndarray, hold: bool):
        every = -(-len(t) // 384)
        self.t, self.f, self.base_t, self.base_f = t, f, t[::every], f[::every]
        self.gap, self.rise, self.scale = np.diff(t), None if hold else np.diff(f), -3 / np.ptp(f)
        at = np.searchsorted(missing, t)
        self.apart = (self.gap > widest) | (at[:-1] < at[1:])
        self.some_apart = bool(self.apart.any())

    def __call__(self, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Similarity, number of pairs and share of the possible pairs at each lag."""
        step = max(1, AT_ONCE // len(self.base_t))
        parts = [self._score(lags[k : k + step]) for k in range(0, len(lags), step)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0), np.empty(0, int), np.empty(0))

    def _score(self, lags: np.ndarray):
        t, f = self.t, self.f
        at = self.base_t + lags[:, None]
        k = np.searchsorted(t, at.ravel(), side="right").reshape(at.shape) - 1
        seen = (k >= 0) & (k < len(t) - 1)  # there is no sample behind the last one
        possible = (at <= t[-1]).sum(axis=1)
        np.clip(k, 0, len(t) - 2, out=k)
        if self.some_apart:
            seen &= ~self.apart[k]
        value = f[k] if self.rise is None else f[k] + self.rise[k] * (at - t[k]) / self.gap[k]
        seen &= ~np.isnan(value)
        value -= self.base_f
        value[~seen] = 0
        n = seen.sum(axis=1)
        rms = np.sqrt(np.einsum("ij,ij->i", value, value) / np.maximum(n, 1))
        return np.where(n > 0, np.exp(rms * self.scale), 0.0), n, n / np.maximum(possible, 1)


def suggest(t: np.ndarray, f: np.ndarray, missing: np.ndarray, hold: bool = False) -> list[tuple[float, float, int, float, float]]:
    """Up to five periods at which a recording resembles itself: (period, similarity, pairs, coverage, repeats)."""
    if len(t) < 24 or np.ptp(f) <= 1e-12:
        return []
    gaps = np.sort(np.diff(t))
    spacing, span = gaps[len(gaps) // 2], t[-1] - t[0]
    low, high = max(8 * spacing, span / 200), span / 2.8
    if low >= high:
        return []
    like = _Likeness(t, f, 3.01 * spacing, missing, hold)
    lags = np.linspace(low, high, 601)
    score = like(lags)[0]
    peak = 1 + np.flatnonzero((score[1:-1] >= score[:-2]) & (score[1:-1] >= score[2:]))  # the ends are no peaks
    peak = np.array(sorted(peak, key=lambda k: (-score[k], k))[:16], int)
    centre, best, reach = lags[peak], score[peak], lags[1] - lags[0]
    for _ in range(3):
        tries = centre[:, None] + np.arange(-10, 11) * reach / 10
        inside = (tries >= low) & (tries <= high)
        near = np.full(tries.shape, -1.0)
        near[inside] = like(tries[inside])[0]
        first = np.argmax(near, axis=1)
        top = near[np.arange(len(peak)), first]
        better = top > best  # only a better one moves the centre; of several, the first
        centre, best = np.where(better, tries[np.arange(len(peak)), first], centre), np.where(better, top, best)
        reach /= 10
    found = []
    for at, similarity, n, coverage in zip(centre.tolist(), *(x.tolist() for x in like(centre)), strict=True):
        if similarity >= 0.85 and n >= 12 and coverage >= 0.5 and supported(t, missing, t[0], at) >= 2:
            found.append((at, similarity, n, coverage, float(span / at)))
    found.sort()
    kept = [x for k, x in enumerate(found) if k == 0 or x[0] - found[k - 1][0] >= spacing]
    return kept[:5]


def supported(t: np.ndarray, missing: np.ndarray, start: float, period: float) -> int:
    """Whole windows of a period, two at most, with eight samples or more and no cyclic gap over a fifth."""
    n = 0
    for k in range(min(200, int(np.floor((t[-1] - start) / period + 1e-10)))):
        a = start + k * period
        own = t[(t >= a) & (t < a + period)] - a
        if len(own) >= 8 and max(np.diff(own).max(), own[0] + period - own[-1]) <= 0.2 * period + 1e-12:
            n += 1
        if n == 2:
            break
    return n


def suggest_periods(samples: DataFrame, hold: bool = False) -> DataFrame:
    """Suggestions for each recording. samples: (recording_id, t, f), f null where a value is missing. hold: values
    stay until the next sample instead of following the line to it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        seen = rows["f"].notna()
        got = suggest(rows.loc[seen, "t"].to_numpy(float), rows.loc[seen, "f"].to_numpy(float), rows.loc[~seen, "t"].to_numpy(float), hold)
        return pd.DataFrame([(rows["recording_id"].iloc[0], k, *x) for k, x in enumerate(got)], columns=["recording_id", "place", "period", "similarity", "pairs", "coverage", "repeats"])

    return samples.groupBy("recording_id").applyInPandas(run, SUGGESTED)


def extract_cycles(samples: DataFrame, periods: DataFrame) -> DataFrame:
    """Each recording's consecutive whole windows of its period: (recording_id, window, t, f), t from
    the window's start. periods: (recording_id, start, period)."""
    rows = samples.join(periods, "recording_id").where("period > 0 AND t >= start")
    last = samples.groupBy("recording_id").agg(F.max("t").alias("last_t"))
    placed = rows.join(last, "recording_id").withColumn("window", F.floor((F.col("t") - F.col("start")) / F.col("period")))
    whole = placed.where(F.col("start") + (F.col("window") + 1) * F.col("period") <= F.col("last_t") + 1e-12)
    return whole.select("recording_id", "window", (F.col("t") - F.col("start") - F.col("window") * F.col("period")).alias("t"), "f")


def median_gap(samples: DataFrame) -> DataFrame:
    """The upper median of the gaps between neighbouring samples."""
    from pyspark.sql import Window

    gap = F.col("t") - F.lag("t").over(Window.partitionBy("recording_id").orderBy("t"))
    gaps = samples.withColumn("gap", gap).where("gap IS NOT NULL")
    listed = gaps.groupBy("recording_id").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    return listed.select("recording_id", F.element_at("g", (F.floor(F.size("g") / 2) + 1).cast("int")).alias("median_gap"))


def changed_cycles(recorded: DataFrame, saved: DataFrame, cycles: DataFrame) -> DataFrame:
    """V9: the samples, by side, in which saved cycles differ from those cut anew out of their recordings. recorded, saved:
    samples as extract_cycles takes them; cycles: (recording_id, start, period)."""
    return row_differences(extract_cycles(recorded, cycles), extract_cycles(saved, cycles))
