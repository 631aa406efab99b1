"""Lags of the period search are scored in arrays, as if one by one."""

import numpy as np
import pytest

from coordwave.operators import periods


def plain_likeness(t, f, widest, missing, hold, lag):
    """One lag, sample by sample."""
    every = -(-len(t) // 384)
    squares, possible = [], 0
    for base_t, base_f in zip(t[::every].tolist(), f[::every].tolist(), strict=True):
        at = base_t + lag
        possible += at <= t[-1]
        if not t[0] <= at < t[-1]:
            continue
        k = max(i for i in range(len(t)) if t[i] <= at)
        if t[k + 1] - t[k] > widest or any(t[k] <= m < t[k + 1] for m in missing.tolist()):
            continue
        value = f[k] if hold else f[k] + (f[k + 1] - f[k]) * (at - t[k]) / (t[k + 1] - t[k])
        squares.append((value - base_f) ** 2)
    return (np.exp(-3 * np.sqrt(np.mean(squares)) / np.ptp(f)) if squares else 0.0), len(squares), len(squares) / max(1, possible)


@pytest.mark.parametrize("hold", [False, True])
@pytest.mark.parametrize("n", [30, 400])
def test_lags_at_once(n, hold, monkeypatch):
    rng = np.random.default_rng(n)
    t = np.sort(rng.integers(0, 3 * n, n)).astype(float)  # times repeat, gaps differ
    f, missing = np.sin(t / 5) + rng.normal(0, 0.1, n), np.sort(rng.uniform(0, 3 * n, 4))
    monkeypatch.setattr(periods, "AT_ONCE", 1000)
    lags = np.append(rng.uniform(0, 3.2 * n, 25), [0, 10 * n])
    got = periods._Likeness(t, f, 5.0, missing, hold)(lags)
    assert np.allclose(np.transpose(got), [plain_likeness(t, f, 5.0, missing, hold, x) for x in lags.tolist()], rtol=0, atol=1e-12)


def test_a_recording_takes_few_passes(monkeypatch):
    passes, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *x, **k: passes.append(1) or search(*x, **k))
    t = np.arange(320.0)
    assert periods.suggest(t, np.sin(t * 2 * np.pi / 64) + np.sin(t * 2 * np.pi / 16), np.empty(0))
    assert len(passes) < 100  # some 1,600 lags
