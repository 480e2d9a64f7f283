"""Isotonic fits against a plain pool-adjacent-violators loop, with cuts in the middle of pooled stretches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tessera.operators import isotonic as I


def pava(x, y, w=None):
    """Blocks (lo, hi, value, centroid) of the fit; equal x are one."""
    w = np.ones(len(x)) if w is None else np.asarray(w, float)
    out = []
    for v in np.unique(x):
        m = x == v
        out.append([v, v, w[m].sum(), (w * y)[m].sum(), v * w[m].sum()])
        while len(out) > 1 and out[-2][3] / out[-2][2] >= out[-1][3] / out[-1][2] - 1e-11:
            b, a = out.pop(), out.pop()
            out.append([a[0], b[1], a[2] + b[2], a[3] + b[3], a[4] + b[4]])
    return [(a, b, s / n, c / n) for a, b, n, s, c in out]


def line(blocks, q, centred):
    if centred:
        kx, ky = [c for *_, c in blocks], [v for _, _, v, _ in blocks]
        z = np.interp(q, kx, ky)
        return np.where((q < kx[0]) | (q > kx[-1]), q, z)
    kx = [z for a, b, _, _ in blocks for z in ((a, b) if a < b else (a,))]
    return np.interp(q, kx, [v for a, b, v, _ in blocks for _ in range(2 if a < b else 1)])


def series(kind, n, rng):
    x = np.round(rng.uniform(-1, 1, n), 3)
    if kind == "noise":
        return x, np.clip(x + rng.normal(0, 0.8, n), -1, 1)
    if kind == "falling":
        return x, -x
    if kind == "rising":
        return np.arange(n) / n, np.arange(n) / n
    y = np.sort(rng.uniform(-1, 1, n))  # a last low value pulls half of it down
    y[-n // 8:] = -3.0
    return np.arange(n) / n, y


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "pulled"])
def test_blocks_equal_plain_pooling(spark, kind):
    rng = np.random.default_rng(5)
    x, y = series(kind, 3000, rng)
    w = rng.integers(1, 4, len(x)).astype(float)
    d = spark.createDataFrame([*zip(x.tolist(), y.tolist(), w.tolist())], "x double, y double, w double")
    for least, most in ((7, 64) if kind != "pulled" else (50, 800), (100, 1 << 20)):
        got = I.pooled_blocks(I.training_cells(d, "x", "y", weight="w"), least, most).orderBy("lo").collect()
        want = pava(x, y, w)
        assert np.allclose([(r.lo, r.hi, r.wy / r.w, r.wx / r.w) for r in got], want, atol=1e-9)


@pytest.mark.parametrize("centred", [False, True])
def test_cv_equals_plain_folds(spark, centred):
    rng = np.random.default_rng(6)
    x, y = series("noise", 2000, rng)
    x = x * 1.2
    f = rng.integers(0, 4, len(x))
    rows = [*zip(range(len(x)), f.tolist(), x.tolist(), y.tolist())] + [(9001, 1, None, 0.5), (9002, 2, float("nan"), 0.5), (9003, 0, 0.1, None)]
    d = spark.createDataFrame(rows, "id long, fold int, p double, y double")
    got = {r.id: r for r in I.isotonic_cv(d, "p", "y", "fold", 4, "id", centred=centred).collect()}
    assert len(got) == len(rows) and got[9001].iso is None and got[9002].iso is None and got[9003].iso is not None
    c = np.clip(x, -1, 1)
    for t in range(4):
        want = line(pava(c[f != t], y[f != t]), c[f == t], centred)
        assert np.allclose([got[i].iso for i in np.flatnonzero(f == t)], want, atol=1e-9)


def test_centred_follows_the_training_targets(spark):
    rows = [(i, i % 3, i / 300 - 0.5, (1.0 if i == 3 else -1.0 if i == 4 else 0.1)) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, fold int, p double, y double")
    got = I.isotonic_cv(d, "p", "y", "fold", 3, "id")
    assert {(r.fold, r.centred) for r in got.select("fold", "centred").distinct().collect()} == {(0, False), (1, False), (2, True)}


def test_hot_value_and_empty(spark):
    d = spark.range(5000).select("id", (F.col("id") % 2).alias("fold"), F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / 5000).alias("p"),
                                 (F.col("id") % 7 / 7.0).alias("y"))
    got = I.isotonic_cv(d, "p", "y", "fold", 2, "id")
    assert got.count() == 5000 and got.where("iso is null").count() == 0
    assert I.isotonic_cv(d.where("false"), "p", "y", "fold", 2, "id").isEmpty()
    one = I.isotonic_cv(d.where("fold = 0"), "p", "y", "fold", 2, "id")  # no training rows: raw
    assert one.where("iso <> raw_clipped").count() == 0


def test_monotone_rows_keep_their_knots_off_the_driver(spark):
    """A block for each of 300,000 rows, over many stretches; the greatest result the driver gets stays small."""
    d = spark.range(300_000).select((F.col("id") / 300_000).alias("x"), (F.col("id") / 300_000).alias("y"))
    k = I.isotonic_fit(d, "x", "y")
    assert k.count() == 300_000 and k.where("abs(kx - ky) > 1e-12").isEmpty()


def test_queries_agree_with_plain_fits(spark):
    import __spark_entry__ as e
    from tessera.operators.folds import group_kfold
    from tessera.plans.fixtures import predictions
    p = group_kfold(predictions(spark, SMALL), "game", 5, 42).select("row_id", "fold", "p1", "y").toPandas()
    c, f, y = np.clip(p.p1.to_numpy(), -1, 1), p.fold.to_numpy(), p.y.to_numpy(float)
    want = {}
    for t in range(5):
        z = line(pava(c[f != t], y[f != t]), c[f == t], True)
        want |= zip(p.row_id[f == t], z)
    got = {r.row_id: r.cir for r in e.queries()["m13_centered_isotonic"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
    m12 = e.queries()["m12_isotonic_cv"](spark, SMALL).toPandas()
    assert len(m12) == len(p)
    both = np.sqrt(np.mean((m12.set_index("row_id").iso.loc[p.row_id].to_numpy() - y) ** 2)), np.sqrt(np.mean((c - y) ** 2))
    assert both[0] < both[1]


@pytest.mark.parametrize("weight", [None, "w"])
def test_ranges_pool_every_training_set_in_one_pass(spark, weight):
    rng = np.random.default_rng(8)
    x, y = series("noise", 4000, rng)
    f, w = rng.integers(0, 3, len(x)), rng.integers(1, 4, len(x)).astype(float)
    rows = [*zip(f.tolist(), x.tolist(), y.tolist(), w.tolist())] + [(None, 0.1, 0.2, 1.0), (1, None, 0.2, 1.0)]
    d = spark.createDataFrame(rows, "fold int, x double, y double, w double")
    blocks = I.training_blocks(d, "x", "y", "fold", 3, weight)
    assert blocks.count() < 0.2 * I.training_cells(d, "x", "y", "fold", 3, weight).count()
    got = I.pooled_blocks(blocks).orderBy("t", "lo").collect()
    for t in range(3):
        want = pava(x[f != t], y[f != t], w[f != t] if weight else None)
        assert np.allclose([(r.lo, r.hi, r.wy / r.w, r.wx / r.w) for r in got if r.t == t], want, atol=1e-9)


@pytest.mark.parametrize("centred", [False, True])
def test_cv_is_the_same_with_few_and_many_knots(spark, centred):
    rng = np.random.default_rng(9)
    x, y = series("noise", 1500, rng)
    rows = [*zip(range(len(x)), rng.integers(0, 3, len(x)).tolist(), (1.2 * x).tolist(), y.tolist())] + [(9001, None, 0.1, 0.5), (9002, 1, None, 0.5)]
    d = spark.createDataFrame(rows, "id long, fold int, p double, y double")
    few, many = ({r.id: (r.iso, r.centred) for r in I.isotonic_cv(d, "p", "y", "fold", 3, "id", centred=centred, few_knots=n).collect()}
                 for n in (I.FEW_KNOTS, 0))
    assert few.keys() == many.keys() and len(few) == len(rows)
    assert all(few[i][1] == many[i][1] and (few[i][0] == many[i][0] or abs(few[i][0] - many[i][0]) < 1e-9) for i in few)
