"""The box optimum of scale-and-clip against a dense grid around every point."""

import numpy as np
import pytest

from tessera.operators import scaleclip
from tessera.operators.scaleclip import scale_clip_box


def loss(p, y, c, m):
    return np.sqrt(np.mean((np.clip(c * p, -m, m) - y) ** 2)) + ((c - 1) ** 2 + (m - 1) ** 2) / 10


@pytest.mark.parametrize("n,scale", [(40, 1.0), (600, 0.8), (600, 1.4), (300, 0.2)])
def test_box_beats_a_dense_grid(spark, n, scale):
    rng = np.random.default_rng(n)
    y = np.clip(rng.normal(0, 0.8, n), -1, 1)
    p = np.round(y * scale + rng.normal(0, 0.3, n), 2)
    f = rng.integers(0, 3, n)
    rows = [*zip(f.tolist(), p.tolist(), y.tolist()), (0, None, 0.1), (1, float("nan"), 0.2), (2, 0.3, None)]
    got = {r.fold: r for r in scale_clip_box(spark.createDataFrame(rows, "fold int, p double, y double"), "p", "y", "fold", 3).collect()}
    assert got.keys() == {0, 1, 2}
    for t, r in got.items():
        a, b = p[f != t], y[f != t]
        assert 0.9 <= r.coef <= 1.2 and 0.5 - 1e-9 <= r.mag <= 1 + 1e-9
        assert abs(loss(a, b, r.coef, r.mag) - r.train_loss) < 1e-9
        grid = min((loss(a, b, c, m), c, m) for c in np.linspace(0.9, 1.2, 31) for m in np.linspace(0.5, 1, 51))
        near = min(loss(a, b, c, m) for c in np.linspace(max(0.9, grid[1] - 0.01), min(1.2, grid[1] + 0.01), 41)
                   for m in np.linspace(max(0.5, grid[2] - 0.01), min(1, grid[2] + 0.01), 41))
        assert r.train_loss <= near + 1e-9


def test_bins_narrow_before_rows_are_ordered(spark, monkeypatch):
    """Passes add up bins and keep few of them; what is left is the whole search, also with one bin to a pass, equal |p| or no row in the box."""
    rng = np.random.default_rng(9)
    y = np.clip(rng.normal(0, 0.8, 3000), -1, 1)
    p, f = y * 0.9 + rng.normal(0, 0.2, 3000), rng.integers(0, 3, 3000)
    rows = [*zip(f.tolist(), p.tolist(), y.tolist()), (None, 0.5, 9.0), (0, 0.6, None)]
    d = spark.createDataFrame(rows, "fold int, p double, y double")
    passes, binned = [], scaleclip.binned
    monkeypatch.setattr(scaleclip, "binned", lambda rows, place, left, more: passes.append(left) or binned(rows, place, left, more))
    monkeypatch.setattr(scaleclip, "FEW", 1)
    want = {r.fold: r for r in scale_clip_box(d, "p", "y", "fold", 3).collect()}
    assert passes[0] is None and all(len(x) < scaleclip.BINS / 2 for x in passes[1:]) and want.keys() == {0, 1, 2}
    monkeypatch.setattr(scaleclip, "BINS", 2)
    monkeypatch.setattr(scaleclip, "FEW", 1000)
    for r in scale_clip_box(d, "p", "y", "fold", 3).collect():
        assert abs(r.train_loss - want[r.fold].train_loss) < 1e-9 and abs(r.train_loss - loss(p[f != r.fold], y[f != r.fold], r.coef, r.mag)) < 1e-9
    for value in (0.1, 0.7, 3.0):
        one = scale_clip_box(d.selectExpr("fold", f"{value}D as p", "y").where("fold is not null and y is not null"), "p", "y", "fold", 3).collect()
        for r in one:
            a, b = np.full((f != r.fold).sum(), value), y[f != r.fold]
            assert r.train_loss <= min(loss(a, b, c, m) for c in np.linspace(0.9, 1.2, 31) for m in np.linspace(0.5, 1, 51)) + 1e-9
