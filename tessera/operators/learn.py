"""Statistical learning on Spark (M1-M8, M10, M24-M34; M12 and M13 are in ``isotonic``).

Models are MLlib estimators; folds are data (a ``fold`` column), so every
cross-validated fit is "train where fold != f, predict where fold == f",
and the OOF table is the union of per-fold transforms keyed by row id.
Per-fold fits are independent Spark jobs submitted from a small driver
thread pool over one cached feature frame.  Anything pulled to the driver
is model-sized (coefficients, Gram matrices, importances).
"""


from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.operators import trees as TR
from tessera.operators.gram import block_gram
from tessera.operators.ordered import average_rank, global_prefix_sum
from tessera.sources.sinks import stored, stored_once

#: Fits side by side, and the rows of a frame up to which they are.
FIT_THREADS, FEW_ROWS = 4, 1_000_000


def ordinal_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M1 — alphabetical ordinal codes 0..k-1 (``OrdinalEncoder``); the
    distinct-value table is ranked by range partitions, not one window."""
    out = out or f"{col}_code"
    vals = df.select(col).where(F.col(col).isNotNull()).distinct()
    codes = global_prefix_sum(vals, [col], out="_c").select(col, (F.col("_c") - 1).alias(out))
    return df.join(codes, col, "left")


def quantile_uniform(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M2 (exact form) — empirical CDF via average ranks: (rank−1)/(n−1)."""
    out = out or f"{col}_q"
    n = df.where(F.col(col).isNotNull()).count()  # one scalar
    r = average_rank(df, col, "_r")
    return r.withColumn(out, (F.col("_r") - 1) / F.lit(max(n - 1, 1))).drop("_r")


def quantile_normal(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M2 (normal output) — inverse normal CDF of the uniform form."""
    from tessera.functions.udfs import norm_ppf
    out = out or f"{col}_qn"
    u = quantile_uniform(df, col, "_u")
    return u.withColumn(out, norm_ppf(F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col("_u"))))).drop("_u")


def standardize(df: DataFrame, col: str, out: str | None = None):
    """M3 — (x − mean)/std_pop; returns (frame, (mean, std)) so predictions
    can be de-standardised with the same two numbers."""
    out = out or f"{col}_z"
    mean, std = df.agg(F.avg(col), F.stddev_pop(col)).first()
    return df.withColumn(out, (F.col(col) - F.lit(mean)) / F.lit(std)), (mean, std)


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def fit_frame(df: DataFrame) -> DataFrame:
    """The frame an iterative fit scans many times: persisted memory-and-disk
    (lost blocks are recomputed from lineage) in partitions that AQE sizes by
    bytes, so their number follows the data, not the cores that happen to be up."""
    from pyspark import StorageLevel
    return df.hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK)


def pca(df: DataFrame, vec_col: str, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """M5 — principal components (mean-centred) as columns pc_0..pc_{k-1}."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    centred = StandardScaler(withMean=True, withStd=False, inputCol=vec_col, outputCol="_c").fit(df).transform(df)
    model = PCA(k=k, inputCol="_c", outputCol="_pc").fit(centred)
    z = model.transform(centred).select(*keep, vector_to_array("_pc").alias("_a"))
    return z.select(*keep, *[F.col("_a")[i].alias(f"pc_{i}") for i in range(k)])


def kmeans(df: DataFrame, vec_col: str, k: int, seed: int = 7, bisecting: bool = False,
           keep: Sequence[str] = ()) -> DataFrame:
    """M6 — k-means (or bisecting) cluster labels."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    est = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, featuresCol=vec_col, predictionCol="cluster")
    return est.fit(df).transform(df).select(*keep, "cluster")


def cluster_diagnostics(df: DataFrame, cluster: str, arr: str) -> DataFrame:
    """M7 — per cluster and for the rows outside it (``out_``): mean of each
    row's (population) std over its non-null values and mean number of NULL
    values per row; rows without any value have no std and count in ``n``
    and ``mean_nulls``.  The outside is the total less the cluster, summed
    over the aggregate of clusters."""
    known = F.filter(arr, lambda v: v.isNotNull())  # as numpy's nanstd: over the values there are
    x = df.withColumn("_k", known).withColumn("_m", F.aggregate("_k", F.lit(0.0), lambda a, x: a + x) / F.size("_k"))
    var = F.aggregate("_k", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / F.size("_k")
    nulls = F.size(F.filter(arr, lambda v: v.isNull()))
    sums = x.groupBy(cluster).agg(F.sum(F.sqrt(var)).alias("_s"), F.count(F.sqrt(var)).alias("_c"),
                                  F.sum(nulls).alias("_z"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # a row a cluster
    rest = {c: F.sum(c).over(every) - F.coalesce(c, F.lit(0)) for c in ("_s", "_c", "_z", "n")}
    share = lambda a, b: F.when(b > 0, a / b)
    return sums.select(cluster, share(F.col("_s"), F.col("_c")).alias("mean_row_std"), (F.col("_z") / F.col("n")).alias("mean_nulls"), "n",
                       share(rest["_s"], rest["_c"]).alias("out_mean_row_std"), share(rest["_z"], rest["n"]).alias("out_mean_nulls"))


def fit_folds(folds: Sequence[int], fit_one, frame: DataFrame):
    """``fit_one`` of each fold: side by side on a small frame, whose stages leave cores idle; one after the other on a larger
    one, where each fit fills the cores and its binned rows are to stay in memory beside the frame."""
    threads = FIT_THREADS if frame.count() <= FEW_ROWS else 1
    with ThreadPoolExecutor(max_workers=min(threads, len(folds))) as ex:
        return list(ex.map(fit_one, folds))


def _is_linear(est) -> bool:
    """A linear regression that reads nothing but sums and products of the rows."""
    from pyspark.ml.regression import LinearRegression
    return type(est) is LinearRegression and est.getLoss() == "squaredError" and est.getSolver() in ("auto", "normal")


def at_once(est, weight: str | None = None, n_features: int = 0) -> bool:
    """Whether the estimator is fitted for all folds in the same passes where rows are many."""
    kind = TR.kind_of(est)
    if kind is None:
        return _is_linear(est) and weight is None and n_features < 4096
    return not (weight and (kind.bootstrap or kind.min_rows > 1))


def ids_are_keys(df: DataFrame, row_id: str) -> bool:
    """Whether no row lacks its id and no two share one (told by a hash), so that a join on it only finds a row's own values."""
    ids = df.select(F.when(F.col(row_id).isNotNull(), F.xxhash64(row_id)).alias("_h"))
    return ids.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_h").isNull() | (F.col("_n") > 1)).isEmpty()


def cv_models(x: DataFrame, est, features: Sequence[str], label: str, fold: str, n_folds: int, n_rows: int,
              weight: str | None = None, stop=None, packs: dict | None = None) -> list:
    """The estimator's model of each fold, trained on the rows of all others in passes that serve every fold; ``x`` is a table."""
    kind = TR.kind_of(est)
    if kind is None:
        grams = clean_grams(x, features, label, fold)
        total = sum(grams.values())
        fit = est.copy({est.labelCol: label, est.weightCol: "weight"}).setFeaturesCol("features")
        return [fit.fit(moment_rows(x.sparkSession, total - grams.get(f, 0.0), features, label)) for f in range(n_folds)]
    packs = {} if packs is None else packs
    key = (tuple(features), label, weight, kind.bins, stop is None)
    if key not in packs:
        packs[key] = TR.pack(x, [F.col(c).cast("double") for c in features], features, [F.col(label)], F.col(fold), n_folds,
                             kind.bins, n_rows, F.col(weight) if weight else None, stop)
    models = TR.grow(packs[key], kind)
    return [models[0, f] for f in range(n_folds)]


def fold_prediction(models: Sequence, features: Sequence[str], fold: str):
    """A column: what the model of the row's fold predicts."""
    if isinstance(models[0], TR.Trees):
        return TR.predictions([models], [F.col(c) for c in features], F.col(fold), ["p"])["p"]
    out = F.lit(None).cast("double")
    for f, m in enumerate(models):
        y = sum((F.lit(float(b)) * F.col(c) for b, c in zip(m.coefficients.toArray(), features)), F.lit(float(m.intercept)))
        out = F.when(F.col(fold) == f, y).otherwise(out)
    return out


def _oof_at_once(df: DataFrame, est, features: Sequence[str], label: str, fold: str, n_folds: int, row_id: str, n_rows: int,
                 carry: Sequence[str] = (), weight: str | None = None, group: str | None = None, validation_frac: float = 0.0, seed: int = 7,
                 at_rest: bool = False):
    """(out-of-fold table with ``carry``, models): rows are written once, packed once and read in one pass a level."""
    tested = F.col(fold).between(0, n_folds - 1)
    stops = bool(validation_frac > 0 and group and est.hasParam("validationIndicatorCol"))
    cols = dict.fromkeys([row_id, fold, label, *features, *carry, *([weight] if weight else []), *([group] if stops else [])])
    x = df if at_rest else stored(df.select(*cols), "cv_frame")
    stop = uniform(seed, group) < validation_frac if stops else None
    models = cv_models(x.where(F.col(fold).isNotNull()), est, features, label, fold, n_folds, n_rows, weight, stop)
    oof = x.where(tested).select(row_id, fold, *carry, fold_prediction(models, features, fold).alias("prediction"))
    return stored(oof, "oof"), models


def grouped_cv(df: DataFrame, make_estimator, features: Sequence[str], label: str, fold: str,
               n_folds: int, row_id: str, group: str | None = None, weight: str | None = None,
               validation_frac: float = 0.0, seed: int = 7, keep_models: bool = False):
    """M8 — grouped-CV fit with an OOF table (row_id, fold, prediction).

    ``validation_frac`` carves an early-stopping validation slice out of
    the *training* groups (hashed per group), never the test fold.
    Many rows are fitted for all folds in the same passes (linear models
    and trees) or one fold after the other (all else).
    """
    if at_once(make_estimator(), weight, len(features)) and (n_rows := df.count()) > FEW_ROWS:
        oof, models = _oof_at_once(df, make_estimator(), features, label, fold, n_folds, row_id, n_rows, (), weight, group, validation_frac, seed)
        return (oof, models) if keep_models else oof
    x = assemble(df, features).select(row_id, fold, label, "features",
                                      *([group] if group else []), *([weight] if weight else []))
    if validation_frac > 0 and group:
        x = x.withColumn("_is_val", uniform(seed, group) < validation_frac)
    x = fit_frame(x)

    def fit_one(f):
        train = x.where(F.col(fold) != f)
        est = make_estimator()
        if weight and est.hasParam("weightCol"):
            est = est.setWeightCol(weight)
        if validation_frac > 0 and group and est.hasParam("validationIndicatorCol"):
            est = est.setValidationIndicatorCol("_is_val")
        model = est.setFeaturesCol("features").setLabelCol(label).fit(train)
        pred = model.transform(x.where(F.col(fold) == f)).select(row_id, fold, F.col("prediction"))
        return model, pred

    results = fit_folds(list(range(n_folds)), fit_one, x)
    oof = results[0][1]
    for _, p in results[1:]:
        oof = oof.unionByName(p)
    models = [m for m, _ in results]
    oof = stored(oof, "oof")
    x.unpersist()
    return (oof, models) if keep_models else oof


def stacked_cv(df: DataFrame, first, first_features: Sequence[str], second, features: Sequence[str], label: str,
               fold: str, n_folds: int, row_id: str, residual: bool = False) -> DataFrame:
    """M25 — (row_id, fold, stage1, prediction): the first model's out-of-fold prediction is a feature of the second, or,
    with ``residual``, the second is fitted to what the first leaves and added to it.  Many rows carry what the second needs
    through the first instead of being joined to its predictions."""
    if (at_once(first(), n_features=len(first_features)) and at_once(second(), n_features=len(features) + 1)
            and (n_rows := df.count()) > FEW_ROWS and ids_are_keys(df, row_id)):
        carry = [c for c in dict.fromkeys([label, *features]) if c not in (row_id, fold)]
        one, _ = _oof_at_once(df, first(), first_features, label, fold, n_folds, row_id, n_rows, carry)
        one = one.withColumnRenamed("prediction", "stage1")
        if not residual:
            two, _ = _oof_at_once(one, second(), [*features, "stage1"], label, fold, n_folds, row_id, n_rows, ["stage1"], at_rest=True)
            return two.select(row_id, fold, "stage1", "prediction")
        one = one.withColumn("_left", F.col(label) - F.col("stage1"))
        two, _ = _oof_at_once(one, second(), features, "_left", fold, n_folds, row_id, n_rows, ["stage1"], at_rest=True)
        return two.select(row_id, fold, "stage1", (F.col("stage1") + F.col("prediction")).alias("prediction"))
    s1 = grouped_cv(df, first, first_features, label, fold, n_folds, row_id).select(row_id, F.col("prediction").alias("stage1"))
    x = df.join(s1, row_id)
    if not residual:
        two = grouped_cv(x, second, [*features, "stage1"], label, fold, n_folds, row_id)
        return two.join(s1, row_id).select(row_id, fold, "stage1", "prediction")
    two = grouped_cv(x.withColumn("_left", F.col(label) - F.col("stage1")), second, features, "_left", fold, n_folds, row_id)
    return two.join(s1, row_id).select(row_id, fold, "stage1", (F.col("stage1") + F.col("prediction")).alias("prediction"))


def oof_features(df: DataFrame, bases: dict, features: Sequence[str], label: str, fold: str, n_folds: int, row_id: str) -> DataFrame:
    """M26 — df with a column ``oof_<name>`` for the out-of-fold prediction of each base model."""
    if (all(at_once(make(), n_features=len(features)) for make in bases.values()) and (n_rows := df.count()) > FEW_ROWS
            and ids_are_keys(df, row_id)):
        x, packs = stored_once(df, "cv_frame"), {}
        known = x.where(F.col(fold).isNotNull())
        found = {n: cv_models(known, make(), features, label, fold, n_folds, n_rows, packs=packs) for n, make in bases.items()}
        return x.where(F.col(fold).between(0, n_folds - 1)).select("*", *[fold_prediction(m, features, fold).alias(f"oof_{n}")
                                                                          for n, m in found.items()])
    for name, make in bases.items():
        p = grouped_cv(df, make, features, label, fold, n_folds, row_id)
        df = df.join(p.select(row_id, F.col("prediction").alias(f"oof_{name}")), row_id)
    return df


def cv_rmse(df: DataFrame, make_estimator, features: Sequence[str], label: str, fold: str, n_folds: int, row_id: str) -> float:
    """RMSE of the out-of-fold predictions, one number; of many rows and a linear model, from one Gram matrix a fold."""
    est = make_estimator()
    if _is_linear(est) and len(features) < 4096 and df.count() > FEW_ROWS and ids_are_keys(df, row_id):
        grams = clean_grams(df.where(F.col(fold).isNotNull()), features, label, fold)
        total, wrong, n = sum(grams.values()), 0.0, 0.0
        fit = est.copy({est.labelCol: label, est.weightCol: "weight"}).setFeaturesCol("features")
        for g in (grams[f] for f in range(n_folds) if f in grams):
            m = fit.fit(moment_rows(df.sparkSession, total - g, features, label))
            b = np.r_[m.intercept, m.coefficients.toArray(), -1.0]
            wrong, n = wrong + max(b @ g @ b, 0.0), n + g[0, 0]
        return float(np.sqrt(wrong / n))
    p = grouped_cv(df, make_estimator, features, label, fold, n_folds, row_id)
    return p.join(df.select(row_id, label), row_id).agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("prediction"), 2)))).first()[0]


def refit_on_top(df: DataFrame, make_estimator, features: Sequence[str], targets: Sequence[str], fold: str, n_folds: int,
                 row_id: str, top: int = 400):
    """M27 — (out-of-fold table of every target, kept features by fold).

    In each fold a model a target is fitted on all features; the ``top`` of them by importance summed over the targets
    stay for all targets (ties: the earlier feature), and the models are fitted again on these.  The table has
    row_id, fold and ``<target>_all`` and ``<target>_top``; of many rows, which are fitted for all folds and targets in the
    same passes, it also has the targets, so that it need not be joined to them.
    """
    from pyspark.ml.feature import VectorSlicer
    kind = TR.kind_of(make_estimator())
    if kind and not kind.bootstrap and (n_rows := df.count()) > FEW_ROWS and ids_are_keys(df, row_id):
        x = stored(df.select(row_id, fold, *targets, *features), "cv_frame")
        cols, number = [F.col(c).cast("double") for c in features], range(len(targets))
        packed = TR.pack(x.where(F.col(fold).isNotNull()), cols, features, [F.col(t) for t in targets], F.col(fold), n_folds, kind.bins, n_rows)
        wide = TR.grow(packed, kind, number)
        matter = [sum(wide[t, f].featureImportances.toArray() for t in number) for f in range(n_folds)]
        kept = [sorted(np.argsort(-w, kind="stable")[:top].tolist()) for w in matter]
        again = TR.grow(packed, kind, number, kept)
        of = lambda found, t: [found[t, f] for f in range(n_folds)]
        p = TR.predictions([of(m, t) for t in number for m in (wide, again)], cols, F.col(fold), [f"{t}_{w}" for t in targets for w in ("all", "top")])
        oof = x.where(F.col(fold).between(0, n_folds - 1)).select(row_id, fold, *targets, p.alias("_p")).select(row_id, fold, *targets, "_p.*")
        return stored(oof, "oof"), [[features[i] for i in k] for k in kept]
    x = fit_frame(assemble(df, features).select(row_id, fold, *targets, "features"))

    def one(f):
        tr, te = x.where(F.col(fold) != f), x.where(F.col(fold) == f)
        wide = {t: make_estimator().setFeaturesCol("features").setLabelCol(t).fit(tr) for t in targets}
        weight = sum(m.featureImportances.toArray() for m in wide.values())
        kept = sorted(np.argsort(-weight, kind="stable")[:top].tolist())
        cut = VectorSlicer(inputCol="features", outputCol="kept", indices=kept)
        tr, te = cut.transform(tr), cut.transform(te)
        for t, m in wide.items():
            again = make_estimator().setFeaturesCol("kept").setLabelCol(t).fit(tr)
            te = m.setPredictionCol(f"{t}_all").transform(te)
            te = again.setPredictionCol(f"{t}_top").transform(te)
        return kept, te.select(row_id, fold, *[f"{t}_{w}" for t in targets for w in ("all", "top")])

    found = fit_folds(range(n_folds), one, x)
    oof = found[0][1]
    for _, p in found[1:]:
        oof = oof.unionByName(p)
    oof = stored(oof, "oof")
    x.unpersist()
    return oof, [[features[i] for i in kept] for kept, _ in found]


def fold_gram(df: DataFrame, fold: str, features: Sequence[str], label: str) -> dict[int, np.ndarray]:
    """Per-fold augmented Gram matrices [1, X, y]ᵀ[1, X, y] in one pass of block products
    (model-sized: (k+2)² numbers per fold)."""
    return block_gram(df.withColumn("_one", F.lit(1.0)), ["_one", *features, label], fold)


def cv_rmse_from_gram(grams: dict[int, np.ndarray], subset: Sequence[int], ridge: float = 1e-9) -> float:
    """CV RMSE of OLS on a feature subset, exactly, from per-fold Grams:
    fit on Σ_{other folds} G, score the fold with its own G
    (SSE = yᵀy − 2βᵀXᵀy + βᵀXᵀXβ)."""
    total = sum(grams.values())
    k = next(iter(grams.values())).shape[0]
    idx = [0, *[i + 1 for i in subset]]
    yi = k - 1
    sse, n = 0.0, 0.0
    for g in grams.values():
        tr = total - g
        a = tr[np.ix_(idx, idx)] + ridge * np.eye(len(idx))
        beta = np.linalg.solve(a, tr[idx, yi])
        sse += g[yi, yi] - 2 * beta @ g[idx, yi] + beta @ g[np.ix_(idx, idx)] @ beta
        n += g[0, 0]
    return float(np.sqrt(max(sse, 0.0) / n))


def moment_rows(spark, gram: np.ndarray, features: Sequence[str], label: str) -> DataFrame:
    """Two rows a column (``features`` vector, label, ``weight``) with the sums, products and row count of a Gram matrix [1, X, y]:
    linear estimators that read nothing else get the same model from them as from the rows."""
    from pyspark.ml.linalg import Vectors
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    size, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    steps = (axes * np.sqrt(np.maximum(size, 0.0) * len(mean))).T * scale
    points = np.vstack([mean + steps, mean - steps])
    rows = [(Vectors.dense(p[:-1].tolist()), float(p[-1]), float(n / len(points))) for p in points]
    return spark.createDataFrame(rows, schema=["features", label, "weight"]).coalesce(1)


def clean_grams(df: DataFrame, features: Sequence[str], label: str, fold: str) -> dict[int, np.ndarray]:
    """``fold_gram``, and an error where a value is NULL, NaN or infinite."""
    known = F.lit(True)
    for c in (*features, label):
        known = known & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    whole = df.select(fold, *[F.when(known, F.col(c)).alias(c) for c in (*features, label)], F.when(known, 0).otherwise(1).alias("_gone"))
    grams = fold_gram(whole, fold, ["_gone", *features], label)
    if any(g[1, 1] for g in grams.values()):
        raise ValueError("features and label must not be NULL, NaN or infinite")
    return {f: np.delete(np.delete(g, 1, 0), 1, 1) for f, g in grams.items()}


def linear_search(df: DataFrame, estimator, trials: Sequence[dict], features: Sequence[str], label: str, fold: str, n_folds: int):
    """(mean RMSE over the folds of each trial, model of the best trial on all rows): linear regressions with the trials'
    parameters, cross-validated from one Gram matrix a fold, so rows are read once for all trials and folds."""
    spark, grams = df.sparkSession, clean_grams(df, features, label, fold)
    if set(grams) != set(range(n_folds)):
        raise ValueError(f"every fold from 0 to {n_folds - 1} must have rows, and no other")
    total, scores = sum(grams.values()), np.zeros(len(trials))
    fit = estimator.copy({estimator.labelCol: label, estimator.weightCol: "weight"})
    for g in grams.values():
        train = moment_rows(spark, total - g, features, label).cache()
        for i, trial in enumerate(trials):
            m = fit.fit(train, trial)
            b = np.r_[m.intercept, m.coefficients.toArray(), -1.0]
            scores[i] += np.sqrt(max(b @ g @ b, 0.0) / g[0, 0]) / n_folds
        train.unpersist()
    return scores.tolist(), fit.fit(moment_rows(spark, total, features, label), trials[int(np.argmin(scores))])


def nested_cv_linear(df: DataFrame, x: str, y: str, outer: str, inner: str, row_id: str) -> DataFrame:
    """M24 — nested CV with 1-feature OLS, exact and shuffle-light:
    per (outer, inner) cell sufficient statistics; the inner model for
    (o, i) trains on cells with outer ≠ o and inner ≠ i; outer-train rows
    get their inner OOF prediction, outer-test rows the mean of the inner
    models' predictions.  Output (outer_fold, row_id, prediction)."""
    s = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                                     F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"))
    cells = s.collect()  # outer × inner rows: parameter-sized
    outs = sorted({r[outer] for r in cells})
    ins = sorted({r[inner] for r in cells})
    coefs = []
    for o in outs:
        for i in ins:
            tr = [r for r in cells if r[outer] != o and r[inner] != i]
            n = sum(r["n"] for r in tr)
            sx, sy = sum(r["sx"] for r in tr), sum(r["sy"] for r in tr)
            sxy, sxx = sum(r["sxy"] for r in tr), sum(r["sxx"] for r in tr)
            b = (sxy - sx * sy / n) / (sxx - sx * sx / n)
            # rounded like every closed-form fit: engine-independent predictions
            coefs.append((o, i, round(float(b), 9), round(float(sy / n - b * sx / n), 9)))
    spark = df.sparkSession
    cdf = spark.createDataFrame(coefs, "o long, i long, slope double, intercept double")
    # outer-train rows: inner model of their own inner fold (o ≠ row's outer)
    rep = df.select(row_id, outer, inner, x, F.explode(F.array(*[F.lit(o) for o in outs])).alias("o")) \
            .where(F.col("o") != F.col(outer)).withColumnRenamed(inner, "i")
    tr = rep.join(F.broadcast(cdf), ["o", "i"]).select(
        F.col("o").alias("outer_fold"), row_id, (F.col("intercept") + F.col("slope") * F.col(x)).alias("prediction"))
    # outer-test rows: mean over the inner models of their outer fold
    mean_c = cdf.groupBy("o").agg(F.avg("slope").alias("ms"), F.avg("intercept").alias("mi"))
    te = df.join(F.broadcast(mean_c), F.col("o") == F.col(outer)).select(
        F.col("o").alias("outer_fold"), row_id, (F.col("mi") + F.col("ms") * F.col(x)).alias("prediction"))
    return tr.unionByName(te)
