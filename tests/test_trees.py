"""Histogram trees of all folds against MLlib's, fold by fold, on rows few enough for MLlib to read all of them for its thresholds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tessera.functions.hashing import KeyDraws, hash_int
from tessera.operators import learn as L
from tessera.operators import trees as TR
from tessera.plans import training as T

NAMES = list("abcd")
MAKE = {"tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=7), "linear": LinearRegression,
        "boosted": lambda: GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.2, seed=7, validationTol=0.001)}


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(3)
    n = 1500
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 72, n), rng.integers(1, 8, n), rng.normal(size=n) * rng.integers(0, 2, n)])
    y = np.sin(x[:, 0]) + 0.02 * x[:, 1] + 0.3 * (x[:, 2] > 3) + rng.normal(size=n) * 0.3
    rows = [(f"r{i}", i % 97 % 3, i % 97, *map(float, x[i]), float(y[i]), float(x[i, 0] * y[i]), 1.0 if i % 3 else 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "id string, fold int, g int, a double, b double, c double, d double, y double, z double, w double").cache()


def both(monkeypatch, run):
    """(result of the small way, result of the large way)"""
    out = []
    for most in (1_000_000, 0):
        monkeypatch.setattr(L, "FEW_ROWS", most)
        out.append(run())
    return out


def column(frame, name, key="id"):
    return frame.toPandas().sort_values(key)[name].to_numpy()


@pytest.mark.parametrize("name, more", [("tree", {"weight": "w"}), ("boosted", {}), ("linear", {}),
                                        ("boosted", {"weight": "w", "group": "g", "validation_frac": 0.2})])
def test_all_folds_in_the_same_passes_are_mllibs_models(df, monkeypatch, name, more):
    fitted = []
    monkeypatch.setattr(L, "fit_folds", lambda *a, real=L.fit_folds: fitted.append(1) or real(*a))
    (want, models), (got, mine) = both(monkeypatch, lambda: L.grouped_cv(df, MAKE[name], NAMES, "y", "fold", 3, "id", keep_models=True, **more))
    assert fitted == [1]  # only the small way fits fold after fold
    assert got.columns == want.columns and np.array_equal(column(got, "fold"), column(want, "fold"))
    far = np.abs(column(got, "prediction") - column(want, "prediction")) > 1e-9
    assert far.mean() < 0.01  # splits that part the same rows are equally good
    if name != "linear":
        assert all(np.allclose(m.featureImportances.toArray(), w.featureImportances.toArray(), atol=1e-3) for m, w in zip(mine, models))
        assert [len(m.trees) for m in mine] == [getattr(w, "getNumTrees", 1) for w in models]


def test_a_level_of_all_folds_is_one_pass(df, monkeypatch):
    passes = []
    monkeypatch.setattr(TR, "_one_pass", lambda *a, real=TR._one_pass: passes.append(1) or real(*a))
    monkeypatch.setattr(L, "FEW_ROWS", 0)
    L.grouped_cv(df, MAKE["boosted"], NAMES, "y", "fold", 3, "id")
    assert len(passes) <= 5 * 3


@pytest.mark.parametrize("residual", [False, True])
def test_stacking_of_many_rows_needs_no_join(df, monkeypatch, residual):
    want, got = both(monkeypatch, lambda: L.stacked_cv(df, LinearRegression, ["a", "b"], MAKE["tree"], NAMES, "y", "fold", 3, "id", residual))
    assert np.allclose(column(got, "stage1"), column(want, "stage1"), atol=1e-9) and got.columns == want.columns
    assert (np.abs(column(got, "prediction") - column(want, "prediction")) > 1e-9).mean() < 0.01
    twice = df.unionByName(df.where("id = 'r5'"))  # ids that repeat are joined as before
    want, got = both(monkeypatch, lambda: L.stacked_cv(twice, LinearRegression, ["a", "b"], MAKE["tree"], NAMES, "y", "fold", 3, "id", residual).count())
    assert got == want > 1501


def test_bases_become_features_without_a_join(df, monkeypatch):
    bases = {n: MAKE[n] for n in ("linear", "tree")}
    want, got = both(monkeypatch, lambda: L.oof_features(df, bases, NAMES, "y", "fold", 3, "id"))
    assert np.allclose(column(got, "oof_linear"), column(want, "oof_linear"), atol=1e-9)
    assert (np.abs(column(got, "oof_tree") - column(want, "oof_tree")) > 1e-9).mean() < 0.01
    few, many = both(monkeypatch, lambda: L.cv_rmse(df, LinearRegression, NAMES, "y", "fold", 3, "id"))
    assert abs(few - many) < 1e-9


def test_a_forest_draws_by_the_same_law(df, monkeypatch):
    rmse = lambda seed: L.grouped_cv(df, lambda: RandomForestRegressor(numTrees=10, maxDepth=4, seed=seed), NAMES, "y", "fold", 3, "id").join(
        df.select("id", "y"), "id").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]
    want, got = both(monkeypatch, lambda: np.mean([rmse(s) for s in (1, 2, 3)]))
    assert abs(want - got) < 0.03


def test_refit_on_top_of_many_rows(df, monkeypatch):
    tree = lambda: DecisionTreeRegressor(maxDepth=4, seed=1)
    (want, kept), (got, mine) = both(monkeypatch, lambda: L.refit_on_top(df, tree, NAMES, ["y", "z"], "fold", 3, "id", top=2))
    assert kept == mine and {"y", "z"} <= set(got.columns)
    assert all((np.abs(column(got, c) - column(want, c)) > 1e-9).mean() < 0.01 for c in ("y_all", "y_top", "z_all", "z_top"))


def test_bad_values_are_errors(df, monkeypatch):
    monkeypatch.setattr(L, "FEW_ROWS", 0)
    for name in ("tree", "linear"):
        with pytest.raises(Exception, match="must not be NULL"):
            L.grouped_cv(df.selectExpr("id", "fold", "if(id = 'r5', null, a) a", "y"), MAKE[name], ["a"], "y", "fold", 3, "id")


def test_draws_of_many_keys_are_hash_int(spark):
    keys = [f"{i * 37}|{i % 7}|{i}" for i in range(300)] + [None, "", "x" * 80, "é|1", "y" * 40, "y" * 41, "y" * 42, "y" * 43]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    want = [r.h for r in rows.select("i", hash_int("9r1", "k", F.lit("ev")).alias("h")).orderBy("i").collect()]
    assert KeyDraws(pa.array(["skipped", *keys])[1:]).draw("9r1", "ev").tolist() == want


@pytest.mark.parametrize("dropped", [None, [["a"], [], ["ev"]]])
def test_flow_of_many_rows(spark, monkeypatch, dropped):
    rng = np.random.default_rng(1)
    runs = [(g, r, float(rng.normal())) for g in range(30) for r in range(2) if (g, r) not in {(3, 0), (7, 1)}]
    rows = [(f"r{i}", int(rng.integers(30)), float(rng.normal()), float(rng.normal())) for i in range(900)]
    rows = [(*r, float(np.clip(0.5 * r[2] - 0.3 * r[3] + rng.normal() * 0.2, -1, 1))) for r in rows]
    cols = "row_id string, game long, a double, m double, y double"
    frame = T.base_frame(spark.createDataFrame([r for r in rows if r[1] < 24], cols), spark.createDataFrame([r for r in rows if r[1] >= 24], cols),
                         "game", 3, 9, T.run_arrays(spark.createDataFrame(runs, "game long, run int, ev double"), "game", "run", range(2), ["ev"]),
                         spark.createDataFrame([(g, float(rng.normal())) for g in range(30) if g % 4], "game long, m_est double")).cache()
    packs: dict = {}
    run = lambda: T.train(frame, MAKE["boosted"], 3, 2, ["a", "m"], ["ev"], ["m"], "game", "row_id", "y", 9, dropped, packs=packs)
    (want, models, names), (got, mine, own) = both(monkeypatch, run)
    assert names == own and len(packs) == 1
    assert (np.abs(column(got, "prediction", "row_id") - column(want, "prediction", "row_id")) > 1e-9).mean() < 0.01
    assert [len(m.trees) for m in mine] == [m.getNumTrees for m in models]
