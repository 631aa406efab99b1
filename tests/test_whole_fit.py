"""Calibrations of whole tables, and evaluations whose fit split lacks a class."""

import numpy as np
import pytest
from coordwave.operators import evaluation

PAIRS = "example_id long, split string, expected long, region_id long, representative_id long, formula double, overlap double"


@pytest.mark.parametrize("kind", ["even", "narrow", "outlier", "noise"])
def test_cells_equal_rows(spark, kind):
    rng = np.random.default_rng(5)
    score = {"even": rng.random(900), "narrow": 0.5 + 0.001 * rng.normal(size=900), "outlier": np.append(rng.random(899), 60.0), "noise": rng.random(900)}[kind]
    y = rng.integers(0, 2, 900) if kind == "noise" else (score + 0.1 * score.std() * rng.normal(size=900) > np.median(score)).astype(int)
    rows = spark.createDataFrame(list(zip(score.tolist(), y.tolist(), strict=True)), "score double, y int")
    assert np.allclose(evaluation._fit_by_cells(rows), evaluation.fit_logistic(score, y), rtol=0, atol=1e-12)


def test_more_than_a_million_pairs(spark):
    """Both classes twice over a range: the figures are those of one range."""
    rows = spark.range(1_000_002).selectExpr("id AS example_id", "'fit' AS split", "id % 2 AS expected", "1L AS region_id", "1L AS representative_id", "(id % 2 * 300 + id % 601) / 1000.0D AS formula", "(id % 701) / 1000.0D AS overlap")
    some = np.arange(1_000_002)
    want = evaluation.fit_logistic((some % 2 * 300 + some % 601) / 1000, some % 2, steps=1500)
    got = evaluation.fitted(rows)["formula"]
    assert np.allclose([got[k] for k in ("mean", "scale", "slope", "intercept")], want, rtol=0, atol=1e-9)


def test_no_match_in_the_fit_split(spark):
    rows = [(k, s, (k % 3 if k % 4 else None) if s != "fit" else None, k % 2, 1, k % 10 / 10, k % 7 / 7) for k, s in ((3 * i + j, s) for i in range(12) for j, s in enumerate(("fit", "tune", "test")))]
    pairs = spark.createDataFrame(rows, PAIRS)
    with pytest.warns(UserWarning, match="both classes"):
        found = {r.method: r for r in evaluation.evaluate(pairs, [0.5]).collect()}
    assert found["calibrated"].share is None and found["calibrated"].balanced_accuracy is None
    assert all(found[m].balanced_accuracy is not None for m in ("formula", "overlap", "tuned"))
    with pytest.warns(UserWarning, match="both classes"):
        whole = evaluation.run_evaluation(pairs, spark.createDataFrame([(r[0], r[0] % 5) for r in rows], "example_id long, source_id long"))
    methods = {r.method: r for r in whole["methods"].collect()}
    assert not any(r.recommended for r in methods.values()) and methods["calibrated-blend"].low is None and methods["raw-tuned"].low is not None
    assert whole["paired"].first().low is None and len(whole["diagnostics"].collect()) == 4
