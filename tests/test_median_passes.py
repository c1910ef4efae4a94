"""The median distance: equal rows, hot values, spans that miss, and the number of passes over all pairs."""

import numpy as np
import pytest

from gradeline.operators import shift


def rows_of(spark, x):
    half = len(x) // 2
    rows = [(i, "source" if i < half else "target", [float(v) for v in f]) for i, f in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, domain string, f array<double>")


def brute(x):
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2))[np.triu_indices(len(x), 1)]
    return float(np.median(d[d > 0]))


def median(df):
    return shift.median_distance(df, "id", "domain", "f", block_rows=32)


def test_equal_rows_have_no_distance(spark):
    """Copies of a row differ by rounding in a matrix product; such pairs are not positive distances."""
    x = np.repeat(np.random.default_rng(3).normal(size=(12, 64)).astype(np.float32).astype(float) + 5.0, 8, axis=0)
    assert median(rows_of(spark, x)) == pytest.approx(brute(x), rel=1e-12)


def test_two_hot_values_and_spans_that_miss(spark, monkeypatch):
    x = np.array([[0.0], [0.0], [1.0], [3.0], [3.0], [3.0], [7.0]])
    x = np.concatenate([x] * 6)
    df = rows_of(spark, x)
    monkeypatch.setattr(shift, "PICKED", 4)
    assert median(df) == brute(x)
    for span in ((1, 2), (shift._INFINITE, shift._INFINITE + 1)):
        monkeypatch.setattr(shift, "_pilot_span", lambda *a, span=span: span)
        assert median(df) == brute(x)


def test_two_passes_find_the_median(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(90, 16))
    passes = []
    for name in ("_span_counts", "_span_values"):
        monkeypatch.setattr(shift, name, lambda *a, made=getattr(shift, name): passes.append(a) or made(*a))
    assert median(rows_of(spark, x)) == pytest.approx(brute(x), rel=1e-12)
    assert len(passes) == 2
