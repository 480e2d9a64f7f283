"""The training flow, stacking and refits against plain numpy and MLlib-free loops."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tessera.operators import learn as L
from tessera.plans import training as T

N_FOLDS, N_RUNS, SEED = 3, 2, 9


def draw(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    games = 24
    runs = [(g, r, float(rng.normal())) for g in range(games) for r in range(N_RUNS) if (g, r) not in {(3, 0), (7, 1)}]
    est = [(g, float(rng.normal())) for g in range(games) if g % 4]
    rows = [(f"r{i}", int(rng.integers(games)), float(rng.normal()), float(rng.normal())) for i in range(400)]
    rows = [(*r, float(np.clip(0.5 * r[2] - 0.3 * r[3] + rng.normal() * 0.2, -1, 1))) for r in rows]
    cols = "row_id string, game long, a double, m double, y double"
    base, extra = [r for r in rows if r[1] < 18], [r for r in rows if r[1] >= 18]
    frame = T.base_frame(spark.createDataFrame(base, cols), spark.createDataFrame(extra, cols), "game", N_FOLDS, SEED,
                         T.run_arrays(spark.createDataFrame(runs, "game long, run int, ev double"), "game", "run", range(N_RUNS), ["ev"]),
                         spark.createDataFrame(est, "game long, m_est double"))
    return rows, {(g, r): v for g, r, v in runs}, dict(est), frame


def features(row, fold, test, runs, est, dropped=()):
    """One row's features as the flow defines them."""
    rid, game, a, m, _ = row
    held = fold % N_RUNS
    have = [runs[game, r] for r in range(N_RUNS) if (game, r) in runs]
    others = [runs.get((game, r)) for r in range(N_RUNS) if r != held]
    known = [v for v in others if v is not None]
    usual = np.mean(known) if known else np.mean(have)
    if test:
        ev = runs.get((game, held), usual)
    else:
        got = others[draw(f"{SEED}r{fold}", f"{rid}|ev") % len(others)]
        ev = (usual if got is None else got) * 0.67 + usual * 0.33
        e = est.get(game, m)
        m = min(m, e) + (max(m, e) - min(m, e)) * draw(f"{SEED}a{fold}", f"{rid}|m") / 2 ** 32
    return [v for n, v in (("a", a), ("m", m), ("ev", ev)) if n not in dropped]


@pytest.mark.parametrize("dropped", [None, [["a"], [], ["ev"]]])
def test_flow_equals_weighted_least_squares(spark, made, dropped):
    rows, runs, est, frame = made
    folds = {r.row_id: r.fold for r in frame.select("row_id", "fold").collect()}
    assert {folds[r[0]] for r in rows if r[1] >= 18} == {None} and {folds[r[0]] for r in rows if r[1] < 18} == set(range(N_FOLDS))
    assert frame.groupBy("game").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    oof, models, names = T.train(frame, lambda: LinearRegression(solver="normal"), N_FOLDS, N_RUNS, ["a", "m"], ["ev"], ["m"],
                                 "game", "row_id", "y", SEED, dropped)
    got = {r.row_id: r for r in oof.collect()}
    assert set(got) == {r[0] for r in rows if r[1] < 18}
    for f in range(N_FOLDS):
        gone = dropped[f] if dropped else ()
        tr, te = [r for r in rows if folds[r[0]] != f], [r for r in rows if folds[r[0]] == f]
        x = np.array([[1.0, *features(r, f, False, runs, est, gone)] for r in tr])
        w = np.sqrt([0.75 if r[1] >= 18 else 1.0 for r in tr])
        beta = np.linalg.lstsq(x * w[:, None], w * np.array([r[4] for r in tr]), rcond=None)[0]
        want = np.array([[1.0, *features(r, f, True, runs, est, gone)] for r in te]) @ beta
        assert np.allclose([got[r[0]].prediction for r in te], want, atol=1e-8)
        assert names[f] == [n for n in ("a", "m", "ev") if n not in gone]
    order = sorted(got.values(), key=lambda r: (r.fold, r.prediction))
    assert all(p.iso <= q.iso + 1e-12 for p, q in zip(order, order[1:]) if p.fold == q.fold and p.centred is False)


def test_the_flow_adds_no_shuffle_by_fold(made):
    x, _ = T.fold_view(made[3], 1, N_RUNS, ["a", "m"], ["ev"], ["m"], "row_id", SEED)
    count = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert count(x) == count(made[3])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -0.5, 0.0, 0.0] + 0.3 * (x[:, 2] > 0) + rng.normal(size=300) * 0.1
    rows = [(i, i % 3, *map(float, x[i]), float(y[i]), float(x[i, 1])) for i in range(300)]
    return x, y, spark.createDataFrame(rows, "id long, fold int, a double, b double, c double, d double, y double, z double").cache()


def _oof(x, y, extra=None):
    """Out-of-fold least squares on folds i % 3."""
    one = np.column_stack([np.ones(len(y)), x, *([extra] if extra is not None else [])])
    out, f = np.empty(len(y)), np.arange(len(y)) % 3
    for t in range(3):
        out[f == t] = one[f == t] @ np.linalg.lstsq(one[f != t], y[f != t], rcond=None)[0]
    return out


@pytest.mark.parametrize("residual", [False, True])
def test_stacking(table, residual):
    x, y, df = table
    linear = lambda: LinearRegression(solver="normal")
    got = {r.id: r for r in L.stacked_cv(df, linear, ["a"], linear, ["b", "c"], "y", "fold", 3, "id", residual).collect()}
    s1 = _oof(x[:, :1], y)
    want = s1 + _oof(x[:, 1:3], y - s1) if residual else _oof(x[:, 1:3], y, s1)
    assert np.allclose([got[i].stage1 for i in range(300)], s1, atol=1e-8)
    assert np.allclose([got[i].prediction for i in range(300)], want, atol=1e-8)


def test_several_bases_become_features(table):
    x, y, df = table
    linear = lambda: LinearRegression(solver="normal")
    z = L.oof_features(df, {"one": linear, "tree": lambda: DecisionTreeRegressor(seed=1)}, ["a", "b"], "y", "fold", 3, "id")
    assert [c for c in z.columns if c.startswith("oof_")] == ["oof_one", "oof_tree"] and z.count() == 300
    p = {r.id: r.oof_one for r in z.collect()}
    assert np.allclose([p[i] for i in range(300)], _oof(x[:, :2], y), atol=1e-8)
    assert abs(L.cv_rmse(df, linear, ["a"], "y", "fold", 3, "id") - np.sqrt(np.mean((y - _oof(x[:, :1], y)) ** 2))) < 1e-9


def test_refit_on_the_features_of_all_targets(table):
    x, y, df = table
    tree = lambda: DecisionTreeRegressor(maxDepth=4, seed=1)
    oof, kept = L.refit_on_top(df, tree, ["a", "b", "c", "d"], ["y", "z"], "fold", 3, "id", top=2)
    assert kept == [["a", "b"]] * 3 and oof.count() == 300
    alone = {r.id: r.prediction for r in L.grouped_cv(df, tree, ["a", "b"], "z", "fold", 3, "id").collect()}
    every = {r.id: r.prediction for r in L.grouped_cv(df, tree, ["a", "b", "c", "d"], "y", "fold", 3, "id").collect()}
    got = {r.id: r for r in oof.collect()}
    assert all(abs(got[i].z_top - alone[i]) < 1e-12 and abs(got[i].y_all - every[i]) < 1e-12 for i in range(300))


def test_large_frames_are_fitted_one_fold_after_the_other(table, monkeypatch):
    import threading
    _, _, df = table
    for most, side_by_side in ((L.FEW_ROWS, True), (299, False)):
        monkeypatch.setattr(L, "FEW_ROWS", most)
        seen = L.fit_folds(range(3), lambda f: (f, threading.get_ident()), df)
        assert [f for f, _ in seen] == [0, 1, 2] and (side_by_side or len({t for _, t in seen}) == 1)
    running, most_running, lock = [0], [0], threading.Lock()

    def one(f):
        with lock:
            running[0] += 1
            most_running[0] = max(most_running[0], running[0])
        df.count()
        with lock:
            running[0] -= 1

    L.fit_folds(range(3), one, df)
    assert most_running[0] == 1


def test_linear_search_reads_rows_once_and_equals_cross_validation(table):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    _, _, df = table
    names, lr = ["a", "b", "c", "d"], LinearRegression(labelCol="y", elasticNetParam=0.5)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.3]).build()
    want = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), foldCol="fold",
                          numFolds=3).fit(L.assemble(df, names))
    got, best = L.linear_search(df, lr, grid, names, "y", "fold", 3)
    assert np.allclose(got, want.avgMetrics, rtol=1e-7)
    assert np.allclose([best.intercept, *best.coefficients], [want.bestModel.intercept, *want.bestModel.coefficients], atol=1e-7)
    with pytest.raises(ValueError):
        L.linear_search(df.selectExpr("id", "fold", "if(id = 5, null, a) a", "b", "y"), lr, grid, ["a", "b"], "y", "fold", 3)


@pytest.mark.parametrize("name", ["m29", "m30", "m9_picked"])
def test_only_columns_in_use_are_moved_and_kept(spark, monkeypatch, name):
    from conftest import SMALL
    from tessera.registry import learn as R

    class Seen(Exception):
        pass

    def stop(df, *_):
        raise Seen(df.columns)

    monkeypatch.setattr(*((R, "group_kfold", stop) if name == "m9_picked" else (L, "fit_frame", stop)))
    with pytest.raises(Seen) as seen:
        getattr(R, name)(spark, SMALL)
    assert not {"agent1", "agent2", "l_discount", "l_quantity*l_quantity"} & set(seen.value.args[0])
