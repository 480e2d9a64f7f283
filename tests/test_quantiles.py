"""M2 fitted per fold against numpy: percentiles of the other folds' rows, both directions averaged at ties."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.udfs import _norm_ppf
from tessera.operators.quantiles import apply_quantiles, quantile_knots


def want(x, fold, normal=False):
    out = np.full(len(x), np.nan)
    for f in range(3):
        train, test = x[(fold != f) & ~np.isnan(x)], fold == f
        k = min(len(train), max(min(len(train) // 30, 1000), 10))
        ref = np.linspace(0, 1, k)
        at = [Fraction(j * (len(train) - 1), k - 1) for j in range(k)]  # exact places: numpy's own are a hair off at ties
        train = np.sort(train)
        q = np.array([train[int(p)] + (train[min(int(p) + 1, len(train) - 1)] - train[int(p)]) * float(p % 1) for p in at])
        assert np.allclose(q, np.percentile(train, ref * 100))
        t = x[test]
        u = 0.5 * (np.interp(t, q, ref) - np.interp(-t, -q[::-1], -ref[::-1]))
        edge = 1e-7 if normal else 0.0
        u[t >= q[-1] - edge], u[t <= q[0] + edge] = 1.0, 0.0
        u[t <= q[0] + edge] = 0.0
        out[test] = u
    if normal:
        some = ~np.isnan(out)
        out[some] = _norm_ppf(np.clip(out[some], 1e-7, 1 - 1e-7))
    return out


@pytest.mark.parametrize("n,levels", [(4000, 0), (4000, 7), (900, 0), (12, 3)])
def test_fold_quantiles_equal_numpy(spark, n, levels):
    rng = np.random.default_rng(n + levels)
    x = rng.integers(0, levels, n).astype(float) if levels else rng.normal(size=n)
    x[::11] = np.nan
    fold = np.arange(n) % 3
    rows = [(int(i), None if np.isnan(v) else float(v), int(f)) for i, (v, f) in enumerate(zip(x, fold))]
    d = spark.createDataFrame(rows, "id long, x double, fold int").repartition(5)
    knots = quantile_knots(d, "x", "fold", 3, ["id"])
    for normal in (False, True):
        got = apply_quantiles(d, "x", "fold", knots, "q", normal).orderBy("id").select("q").collect()
        got = np.array([np.nan if r.q is None else r.q for r in got])
        assert np.allclose(got, want(x, fold, normal), atol=1e-9, equal_nan=True)


def test_fold_quantiles_of_little_data(spark):
    one = spark.createDataFrame([(1, 2.0, 0), (2, 3.0, 1), (3, None, 1)], "id long, x double, fold int")
    got = {r.id: r.q for r in apply_quantiles(one, "x", "fold", quantile_knots(one, "x", "fold", 2, ["id"]), "q").collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None}
    none = one.where("false")
    assert apply_quantiles(none, "x", "fold", quantile_knots(none, "x", "fold", 2, ["id"]), "q").isEmpty()
    assert apply_quantiles(one, "x", "fold", quantile_knots(one.where(F.col("fold") == 0), "x", "fold", 2, ["id"]), "q").where("q is not null").count() == 1
