"""The training flow as one plan.

Group folds → each fold tests on one held-out measurement run and trains on
draws from the others → extra rows join every training set with a weight of
their own → the fold's least important features go → re-measured features
are interpolated towards their estimates (training rows only) → fit →
out-of-fold table → isotonic recalibration over the same folds.

Everything that does not depend on a fold is joined once: a key's runs become
one row with an array a run, its estimates one row with a column a feature.
What depends on a fold is a projection of that frame, so the folds add no
shuffle; the fits are independent jobs over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import TWO_32, KeyDraws, hash_int, uniform
from tessera.operators.augment import interpolate
from tessera.operators.folds import group_kfold
from tessera.operators.isotonic import isotonic_cv
from tessera.operators import learn
from tessera.operators import trees as TR
from tessera.operators.learn import assemble, fit_folds, fit_frame
from tessera.operators.reshape import bag_union
from tessera.sources.sinks import stored, stored_once

# What an extra row weighs, and what the mean of the runs weighs beside the drawn one.
EXTRA_WEIGHT, MEAN_SHARE = 0.75, 0.33


def run_arrays(runs: DataFrame, key: str, run: str, run_ids: Sequence, values: Sequence[str]) -> DataFrame:
    """One row a key: ``<value>_runs``, the mean of each value in each run, in the order of ``run_ids``; null where a run
    lacks the key.  One aggregate; its width is runs times values."""
    cells = [F.avg(F.when(F.col(run) == r, F.col(v))).alias(f"_{v}_{i}") for v in values for i, r in enumerate(run_ids)]
    wide = runs.where(F.col(run).isin(list(run_ids))).groupBy(key).agg(*cells)
    return wide.select(key, *[F.array(*[F.col(f"_{v}_{i}") for i in range(len(run_ids))]).alias(f"{v}_runs") for v in values])


def _mean(values: Column) -> Column:
    known = F.filter(values, lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))


def run_feature(values: Column, n_runs: int, held: int, test: Column, seed, row: str, name: str, mean_share: float) -> Column:
    """M23 with W3: a test row has the held-out run's value; a training row one of another run, drawn for the row and the
    feature, blended with the mean of those runs.  A run without a value counts as the mean of the runs the row may use,
    or of all where those have none."""
    others = F.array(*[F.get(values, F.lit(r)) for r in range(n_runs) if r != held]) if n_runs > 1 else values
    usual = F.coalesce(_mean(others), _mean(values))
    drawn = F.get(others, F.pmod(hash_int(seed, row, F.lit(name)), F.lit(max(n_runs - 1, 1))).cast("int"))
    train = F.coalesce(drawn, usual) * F.lit(1.0 - mean_share) + usual * F.lit(mean_share)
    return F.when(test, F.coalesce(F.get(values, F.lit(held)), usual)).otherwise(train)


def base_frame(rows: DataFrame, extra: DataFrame | None, key: str, n_folds: int, seed: int, runs: DataFrame,
               estimates: DataFrame | None, extra_weight: float = EXTRA_WEIGHT) -> DataFrame:
    """Rows with their group's fold and extra rows without one, with their key's runs and estimates.

    ``runs`` (from ``run_arrays``) and ``estimates`` (key, feature columns named ``<feature>_est``) have a row a key.
    """
    folded = group_kfold(rows, key, n_folds, seed)
    parts = {"base": (folded, 1.0)}
    if extra is not None:
        parts["extra"] = (extra.withColumn("fold", F.lit(None).cast("int")), extra_weight)
    x = bag_union(parts).join(runs, key, "left")
    return x if estimates is None else x.join(estimates, key, "left")


def fold_view(frame: DataFrame, fold: int, n_runs: int, features: Sequence[str], run_values: Sequence[str],
              measured: Sequence[str], row: str, seed: int, dropped: Sequence[str] = (),
              mean_share: float = MEAN_SHARE) -> tuple[DataFrame, list[str]]:
    """The fold's rows (with ``is_test``) and the features it fits on: a projection of ``frame``."""
    made, test = view_columns(fold, n_runs, run_values, measured, row, seed, mean_share)
    names = [c for c in (*features, *run_values) if c not in set(dropped)]
    kept = [c for c in frame.columns if c not in {*run_values, *measured}]
    return frame.select(*kept, *[c.alias(n) for n, c in made.items()], test.alias("is_test")), names


def view_columns(fold: int, n_runs: int, run_values: Sequence[str], measured: Sequence[str], row: str, seed: int,
                 mean_share: float = MEAN_SHARE) -> tuple[dict[str, Column], Column]:
    """The features that depend on the fold, and whether a row is tested in it."""
    test = F.coalesce(F.col("fold") == fold, F.lit(False))
    held = fold % n_runs
    made = {v: run_feature(F.col(f"{v}_runs"), n_runs, held, test, f"{seed}r{fold}", row, v, mean_share) for v in run_values}
    near = {m: F.when(test, F.col(m)).otherwise(interpolate(F.col(m), F.col(f"{m}_est"), f"{seed}a{fold}", row, F.lit(m)))
            for m in measured}
    return made | near, test


def drawn_views(n_folds: int, n_runs: int, features: Sequence[str], run_values: Sequence[str], measured: Sequence[str], seed,
                mean_share: float = MEAN_SHARE):
    """``view_columns`` of training rows for ``trees.pack``: Arrow batch -> fold by fold an array a feature, from ``_row``, by
    which rows draw, and the columns the draws choose from."""
    features, run_values, measured = list(features), list(run_values), set(measured)

    def runs_of(batch, v):
        c = batch.column(f"{v}_runs")
        values, known = np.zeros((len(c), n_runs)), np.zeros((len(c), n_runs), bool)
        here, flat = c.is_valid().to_numpy(zero_copy_only=False), c.flatten()
        values[here] = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, n_runs)
        known[here] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n_runs)
        return values, known

    def mean(values, known, runs):
        total, n = np.zeros(len(values)), np.zeros(len(values))
        for r in runs:
            total, n = total + np.where(known[:, r], values[:, r], 0.0), n + known[:, r]
        return np.where(n > 0, total / np.maximum(n, 1), np.nan), n > 0

    def view(fold, batch, draws, runs):
        out, others = [], [r for r in range(n_runs) if r != fold % n_runs] if n_runs > 1 else [0]
        for n in features:
            x = TR.numbers(batch, n)
            if n in measured:
                near = np.where(batch.column(f"{n}_est").is_valid().to_numpy(zero_copy_only=False), TR.numbers(batch, f"{n}_est"), x)
                x = np.where(batch.column(n).is_valid().to_numpy(zero_copy_only=False), x, near)
                low, high = np.minimum(x, near), np.maximum(x, near)
                x = low + (high - low) * (draws.draw(f"{seed}a{fold}", n) / TWO_32)
            out.append(x)
        for v in run_values:
            values, known = runs[v]
            few, some = mean(values, known, others)
            usual = np.where(some, few, mean(values, known, range(n_runs))[0])
            at = np.arange(len(values)), np.array(others)[draws.draw(f"{seed}r{fold}", v) % max(n_runs - 1, 1)]
            out.append(np.where(known[at], values[at], usual) * (1.0 - mean_share) + usual * mean_share)
        return out

    def views(batch):
        draws, runs = KeyDraws(batch.column("_row")), {v: runs_of(batch, v) for v in run_values}
        return [view(f, batch, draws, runs) for f in range(n_folds)]

    return views


def _train_at_once(frame: DataFrame, est, n_folds: int, n_runs: int, features: Sequence[str], run_values: Sequence[str],
                   measured: Sequence[str], key: str, row: str, label: str, seed: int, dropped, validation_share: float,
                   n_rows: int, packs: dict):
    """(out-of-fold table, models, features by fold) of many rows: every fold's view of a row is packed once, and one pass a
    level serves the trees of all folds."""
    kind, names = TR.kind_of(est), [*features, *run_values]
    stop = uniform(f"{seed}v", key) < validation_share if est.hasParam("validationIndicatorCol") else None
    what = (tuple(names), tuple(run_values), tuple(measured), n_folds, n_runs, key, row, label, seed, kind.bins, validation_share)
    if what not in packs:
        inputs = [*[F.col(n).cast("double") for n in features], *[F.col(f"{m}_est").cast("double") for m in measured],
                  *[F.col(f"{v}_runs").cast("array<double>") for v in run_values]]
        packs[what] = TR.pack(frame, [*inputs, F.col(row).cast("string").alias("_row")], names, [F.col(label)], F.col("fold"), n_folds, kind.bins, n_rows,
                              F.col("sample_weight"), stop, drawn_views(n_folds, n_runs, features, run_values, measured, seed), [row, "fold", label])
    use = [[i for i, n in enumerate(names) if not dropped or n not in set(dropped[f])] for f in range(n_folds)]
    found = TR.grow(packs[what], kind, features=use)
    models = [found[0, f] for f in range(n_folds)]
    views = [view_columns(f, n_runs, run_values, measured, row, seed)[0] for f in range(n_folds)]
    tested = [F.coalesce(*[F.when(F.col("fold") == f, views[f].get(n, F.col(n)).cast("double")) for f in range(n_folds)]) for n in names]
    p = TR.predictions([models], tested, F.col("fold"), ["p"])["p"]
    oof = stored(frame.where(F.col("fold").between(0, n_folds - 1)).select(row, "fold", label, p.alias("prediction")), "oof")
    return oof, models, [[names[i] for i in u] for u in use]


def train(frame: DataFrame, make_estimator: Callable, n_folds: int, n_runs: int, features: Sequence[str],
          run_values: Sequence[str], measured: Sequence[str], key: str, row: str, label: str, seed: int,
          dropped: Sequence[Sequence[str]] | None = None, validation_share: float = 0.1, packs: dict | None = None):
    """(out-of-fold table, models, features by fold): row, fold, label, prediction, iso and centred.

    An estimator with a validation column gets a share of the training groups to stop on, never the test fold.  ``packs``,
    given to several calls on one frame, keeps the rows that the first of them packed.
    """
    est = make_estimator()
    kind = TR.kind_of(est)
    if kind and not kind.bootstrap and kind.min_rows == 1 and (n_rows := frame.count()) > learn.FEW_ROWS:
        oof, models, names = _train_at_once(stored_once(frame, "flow"), est, n_folds, n_runs, features, run_values, measured, key, row, label,
                                            seed, dropped, validation_share, n_rows, {} if packs is None else packs)
        iso = isotonic_cv(oof, "prediction", label, "fold", n_folds, row).select(row, "iso", "centred")
        return oof.join(iso, row), models, names
    frame = fit_frame(frame)

    def one(f):
        x, names = fold_view(frame, f, n_runs, features, run_values, measured, row, seed, dropped[f] if dropped else ())
        fit = make_estimator().setFeaturesCol("features").setLabelCol(label).setWeightCol("sample_weight")
        rows = assemble(x, names).select(row, key, "fold", label, "sample_weight", "is_test", "features")
        training = rows.where(~F.col("is_test"))
        if fit.hasParam("validationIndicatorCol"):
            training = training.withColumn("_stop", uniform(f"{seed}v", key) < validation_share)
            fit = fit.setValidationIndicatorCol("_stop")
        model = fit.fit(training)
        return model, names, model.transform(rows.where("is_test")).select(row, "fold", label, "prediction")

    found = fit_folds(range(n_folds), one, frame)
    oof = found[0][2]
    for _, _, p in found[1:]:
        oof = oof.unionByName(p)
    oof = stored(oof, "oof")
    frame.unpersist()
    iso = isotonic_cv(oof, "prediction", label, "fold", n_folds, row).select(row, "iso", "centred")
    return oof.join(iso, row), [m for m, _, _ in found], [n for _, n, _ in found]


def least_important(models, names: Sequence[Sequence[str]], k: int) -> list[list[str]]:
    """W11 — the k least important features of each fold's model (ties by name)."""
    out = []
    for model, cols in zip(models, names):
        weight = model.featureImportances.toArray()
        out.append([c for _, c in sorted(zip(weight, cols))[:k]])
    return out
