"""M1-M8, M10, M12, M13, M24-M27, M29-M34 learning queries and K7."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_int
from tessera.operators import gram as G
from tessera.operators import learn as L
from tessera.operators.folds import group_kfold
from tessera.operators.isotonic import isotonic_cv
from tessera.functions.hashing import sql_hash_int, sql_uniform
from tessera.operators.quantiles import apply_quantiles, gauss, quantile_knots
from tessera.plans import reconcile as rc
from tessera.plans import training as T
from tessera.plans.fixtures import PREDICTIONS_SQL, matches, measurements, predictions, row_key, ROW_KEY_SQL
from tessera.registry import register
from tessera.sources.sinks import stored
from tessera.session import fresh_path
from tessera.sources.tables import table

FEATURES = ["l_quantity", "l_extendedprice", "l_tax", "run", "agent1_idx", "agent2_idx"]


@register("m1_ordinal_encoding", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS p_name_code FROM part""")
def m1(spark, d):
    return L.ordinal_encode(table(spark, d, "part").select("p_partkey", "p_name"), "p_name").select(
        "p_partkey", "p_name_code")


@register("m2_quantile_uniform", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((rank() OVER (ORDER BY l_extendedprice)
  + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 - 1) / (count(*) OVER () - 1), 6) AS l_extendedprice_q
FROM lineitem""")
def m2(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    q = L.quantile_uniform(li, "l_extendedprice")
    return q.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round("l_extendedprice_q", 6).alias("l_extendedprice_q"))


@register("m2_quantile_normal")
def m2n(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return L.quantile_normal(li, "l_extendedprice").drop("l_extendedprice")


@register("m2_quantile_folds", f"""WITH d AS (SELECT {ROW_KEY_SQL} AS row_id, l_extendedprice AS x, {sql_hash_int(29, ROW_KEY_SQL)} % 5 AS fold,
    l_extendedprice + 1e-5::DOUBLE * (sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_uniform("31a", ROW_KEY_SQL)}))
      * cos(2.0::DOUBLE * pi() * {sql_uniform("31b", ROW_KEY_SQL)})) AS v FROM lineitem),
t AS (SELECT f.f, v, row_number() OVER (PARTITION BY f.f ORDER BY v, row_id) - 1 AS p FROM d JOIN range(5) f(f) ON d.fold <> f.f),
n AS (SELECT f, count(*) AS n, least(count(*), greatest(least(count(*) // 30, 1000), 10)) AS k FROM t GROUP BY f),
w AS (SELECT f, j, k, (j * (n - 1)) // (k - 1) AS lo, ((j * (n - 1)) % (k - 1))::DOUBLE / (k - 1) AS share FROM n, unnest(range(k)) u(j)),
q AS (SELECT w.f, j, k, a.v + coalesce((b.v - a.v) * share, 0) AS q FROM w JOIN t a ON a.f = w.f AND a.p = w.lo
      LEFT JOIN t b ON b.f = w.f AND b.p = w.lo + 1),
g AS (SELECT f, q, k, min(j) AS j0, max(j) AS j1, lead(q) OVER (PARTITION BY f ORDER BY q) AS up FROM q GROUP BY f, q, k)
SELECT row_id, d.fold::INT AS fold, round(CASE WHEN g.q IS NULL OR j0 = 0 AND x = g.q THEN 0.0 WHEN up IS NULL THEN 1.0
    WHEN x = g.q THEN (j0 + j1) / 2.0::DOUBLE / (k - 1) ELSE (j1 + (x - g.q) / (up - g.q)) / (k - 1) END, 6) AS price_q
FROM d ASOF LEFT JOIN g ON d.fold = g.f AND d.x >= g.q""")
def m2_folds(spark, d):
    """Quantile transform fitted with jitter on the other folds' rows and applied to each fold's own."""
    li = table(spark, d, "lineitem").select(row_key().alias("row_id"), F.col("l_extendedprice").alias("x"))
    li = li.withColumn("fold", (hash_int(29, F.col("row_id")) % 5).cast("int"))
    knots = quantile_knots(li, "x", "fold", 5, ["row_id"], 1e-5 * gauss(31, F.col("row_id")))
    q = apply_quantiles(li, "x", "fold", knots, "price_q")
    return q.select("row_id", "fold", F.round("price_q", 6).alias("price_q"))


@register("m3_standardize", """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6)
  AS c_acctbal_z FROM customer""")
def m3(spark, d):
    z, _ = L.standardize(table(spark, d, "customer"), "c_acctbal")
    return z.select("c_custkey", F.round("c_acctbal_z", 6).alias("c_acctbal_z"))


def _emb_vectors(spark, d):
    from pyspark.ml.functions import array_to_vector
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", "embedding", array_to_vector("embedding").alias("v"))


@register("m5_pca")
def m5(spark, d):
    return L.pca(_emb_vectors(spark, d), "v", 8, keep=["vec_id"])


@register("m6_kmeans")
def m6(spark, d):
    return L.kmeans(_emb_vectors(spark, d), "v", 10, keep=["vec_id"])


@register("m7_cluster_diagnostics", """
WITH r AS (SELECT label, list_stddev_pop(embedding) AS s, len(list_filter(embedding, lambda v: v IS NULL)) AS z FROM embeddings)
SELECT c.label, round(avg(r.s) FILTER (r.label = c.label), 6) AS mean_row_std, round(avg(r.z) FILTER (r.label = c.label), 6) AS mean_nulls,
       count(*) FILTER (r.label = c.label) AS n, round(avg(r.s) FILTER (r.label <> c.label), 6) AS out_mean_row_std,
       round(avg(r.z) FILTER (r.label <> c.label), 6) AS out_mean_nulls
FROM (SELECT DISTINCT label FROM r) c, r GROUP BY c.label""")
def m7(spark, d):
    r = L.cluster_diagnostics(table(spark, d, "embeddings"), "label", "embedding")
    return r.select("label", F.round("mean_row_std", 6).alias("mean_row_std"),
                    F.round("mean_nulls", 6).alias("mean_nulls"), "n", F.round("out_mean_row_std", 6).alias("out_mean_row_std"),
                    F.round("out_mean_nulls", 6).alias("out_mean_nulls"))


def _cv_frame(spark, d):
    m = matches(spark, d).withColumn("sample_weight", F.when(F.col("run") <= 3, 1.0).otherwise(0.5))
    return group_kfold(m, "game", 5, 42)


def _gbt():
    from pyspark.ml.regression import GBTRegressor
    return GBTRegressor(maxIter=10, maxDepth=4, stepSize=0.2, seed=7, validationTol=0.001)


@register("m8_grouped_cv_gbt")
def m8(spark, d):
    """Grouped 5-fold GBT with sample weights and a validation slice carved
    from the training groups; OOF (row_id, fold, prediction)."""
    return L.grouped_cv(_cv_frame(spark, d), _gbt, FEATURES, "utility", "fold", 5, "row_id",
                        group="game", weight="sample_weight", validation_frac=0.1)


@register("m31_feature_importance")
def m31(spark, d):
    """Per-fold GBT feature importances, sorted (fold, feature, importance)."""
    _, models = L.grouped_cv(_cv_frame(spark, d), _gbt, FEATURES, "utility", "fold", 5, "row_id",
                             group="game", keep_models=True)
    rows = [(f, FEATURES[i], float(v)) for f, m in enumerate(models)
            for i, v in enumerate(m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "fold int, feature string, importance double").orderBy(
        "fold", F.col("importance").desc(), "feature")


@register("m10_lasso_interactions")
def m10(spark, d):
    """L1 linear fit of price on quantity with interaction terms (x·n, n²),
    regularisation chosen by 5-fold CV on the fold column."""
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import ParamGridBuilder
    li = table(spark, d, "lineitem")
    x = li.select((F.col("l_extendedprice") / 1000.0).alias("y"), "l_quantity",
                  F.col("l_linenumber").cast("double").alias("n"),
                  (F.col("l_quantity") * F.col("l_linenumber")).alias("x_n"),
                  (F.col("l_linenumber") * F.col("l_linenumber")).cast("double").alias("n2"),
                  F.pmod(hash_int(5, "l_orderkey", "l_linenumber"), F.lit(5)).cast("int").alias("fold"))
    feats = ["l_quantity", "n", "x_n", "n2"]
    lr = LinearRegression(labelCol="y", elasticNetParam=1.0)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    _, best = L.linear_search(x, lr, grid, feats, "y", "fold", 5)
    rows = [("intercept", float(best.intercept))] + [(f, float(c)) for f, c in zip(feats, best.coefficients)]
    return spark.createDataFrame(rows, "feature string, coef double")


@register("m12_isotonic_cv")
def m12(spark, d):
    """Grouped-CV isotonic recalibration of p1, centred in folds whose training targets span [-1, 1]
    (row_id, fold, raw_clipped, iso, centred)."""
    p = group_kfold(predictions(spark, d), "game", 5, 42)
    return isotonic_cv(p, "p1", "y", "fold", 5, "row_id")


@register("m13_centered_isotonic")
def m13(spark, d):
    """Centred isotonic by grouped CV: pooled blocks become their weighted centroids, linear between them;
    raw beyond the first and last."""
    p = group_kfold(predictions(spark, d), "game", 5, 42)
    return isotonic_cv(p, "p1", "y", "fold", 5, "row_id", out="cir", centred=True).drop("centred")


_NCV_SUMS = "count(*) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxy) AS sxy, sum(sxx) AS sxx"


@register("m24_nested_cv", f"""WITH p AS ({PREDICTIONS_SQL}),
pf AS (SELECT *, {sql_hash_int(51, 'CAST(game AS VARCHAR)')} % 4 AS o_f, {sql_hash_int(52, 'CAST(game AS VARCHAR)')} % 3 AS i_f FROM p),
c AS (SELECT o_f, i_f, count(*) AS n, sum(p1) AS sx, sum(y) AS sy, sum(p1 * y) AS sxy, sum(p1 * p1) AS sxx FROM pf GROUP BY ALL),
oi AS (SELECT DISTINCT a.o_f AS o, b.i_f AS i FROM c a, c b),
t AS (SELECT oi.o, oi.i, sum(c.n) AS n, sum(c.sx) AS sx, sum(c.sy) AS sy, sum(c.sxy) AS sxy, sum(c.sxx) AS sxx
      FROM oi JOIN c ON c.o_f <> oi.o AND c.i_f <> oi.i GROUP BY ALL),
b AS (SELECT o, i, n, sx, sy, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b FROM t),
coef AS (SELECT o, i, round(b, 9) AS slope, round(sy / n - b * sx / n, 9) AS intercept FROM b),
mc AS (SELECT o, avg(slope) AS ms, avg(intercept) AS mi FROM coef GROUP BY o)
SELECT coef.o AS outer_fold, pf.row_id, round(coef.intercept + coef.slope * pf.p1, 6) AS prediction
FROM pf JOIN coef ON coef.o <> pf.o_f AND coef.i = pf.i_f
UNION ALL SELECT mc.o, pf.row_id, round(mc.mi + mc.ms * pf.p1, 6) FROM pf JOIN mc ON mc.o = pf.o_f""")
def m24(spark, d):
    """Nested 4×3 CV of y ~ p1: (outer_fold, row_id, prediction)."""
    p = predictions(spark, d).withColumn("outer", F.pmod(hash_int(51, "game"), F.lit(4))) \
                             .withColumn("inner", F.pmod(hash_int(52, "game"), F.lit(3)))
    r = L.nested_cv_linear(p, "p1", "y", "outer", "inner", "row_id")
    return r.select("outer_fold", "row_id", F.round("prediction", 6).alias("prediction"))


#: The base features, their squares and their products.
WIDE = FEATURES + [f"{a}*{b}" for i, a in enumerate(FEATURES) for b in FEATURES[i:]]


def _wide(m):
    pairs = [c.split("*") for c in WIDE[len(FEATURES):]]
    return m.select("*", *[(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}*{b}") for a, b in pairs])


def _stacked(spark, d, residual):
    from pyspark.ml.regression import LinearRegression
    return L.stacked_cv(_cv_frame(spark, d), LinearRegression, ["l_quantity", "l_tax", "agent1_idx"], _gbt, FEATURES, "utility",
                        "fold", 5, "row_id", residual)


@register("m25_stacking")
def m25(spark, d):
    """The out-of-fold prediction of a linear model becomes a feature of the boosted trees."""
    return _stacked(spark, d, False)


@register("m25_residual_stacking")
def m25_residual(spark, d):
    """Boosted trees fitted to what the linear model's out-of-fold prediction leaves, and added to it."""
    return _stacked(spark, d, True)


@register("m26_oof_as_features")
def m26(spark, d):
    """CV RMSE of a linear model without and with the out-of-fold predictions of a linear model, a tree and a forest as
    features, each by itself and all together."""
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
    bases = {"linear": LinearRegression, "tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=7),
             "forest": lambda: RandomForestRegressor(numTrees=10, maxDepth=5, seed=7)}
    cv = _cv_frame(spark, d).select("row_id", "fold", "utility", *FEATURES)
    x = stored(L.oof_features(cv, bases, ["agent1_idx", "agent2_idx", "run"], "utility", "fold", 5, "row_id"), "with_oof")
    variants = {"without": []} | {n: [f"oof_{n}"] for n in bases} | {"all": [f"oof_{n}" for n in bases]}
    rows = [(v, L.cv_rmse(x, LinearRegression, FEATURES + more, "utility", "fold", 5, "row_id")) for v, more in variants.items()]
    return spark.createDataFrame(rows, "variant string, rmse double")


@register("m27_multi_target")
def m27(spark, d):
    """Trees for three targets on features, squares and products, fitted again on the 10 that matter most to all targets:
    RMSE by target and fold with all features and with those."""
    from pyspark.ml.regression import DecisionTreeRegressor
    base = _wide(_cv_frame(spark, d)).withColumn("t_outcome", F.col("outcome").cast("double")).withColumn("t_discount", F.col("l_discount"))
    targets = ["utility", "t_outcome", "t_discount"]
    oof, _ = L.refit_on_top(base, lambda: DecisionTreeRegressor(maxDepth=5, seed=7), WIDE, targets, "fold", 5, "row_id", top=10)
    j = oof if set(targets) <= set(oof.columns) else oof.join(base.select("row_id", *targets), "row_id")
    err = lambda t, w: F.sqrt(F.avg(F.pow(F.col(t) - F.col(f"{t}_{w}"), 2)))
    by_fold = j.groupBy("fold").agg(*[err(t, w).alias(f"{t}_{w}") for t in targets for w in ("all", "top")])
    each = [F.struct(F.lit(t).alias("target"), F.col(f"{t}_all").alias("rmse_all"), F.col(f"{t}_top").alias("rmse_top")) for t in targets]
    return by_fold.select("fold", F.explode(F.array(*each)).alias("r")).select("r.target", "fold", "r.rmse_all", "r.rmse_top")


_RUNS, _MEASURED = list(range(1, 8)), ["l_quantity", "l_extendedprice"]


def flow_frame(spark, d, n_folds=5, seed=42):
    """Games whose number divides by 5 stand for the extra data; the runs of a game are its line numbers, measured by tax and
    supplier, and its estimates those of the reconciliation."""
    m = matches(spark, d).select("row_id", "game", "utility", "agent1_idx", "agent2_idx", *_MEASURED)
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("game"), "l_linenumber", F.col("l_tax").alias("run_tax"),
                                            F.col("l_suppkey").cast("double").alias("run_supp"))
    est = rc.estimates(rc.baseline_pairs(measurements(spark, d), "key", "run", ["ord_a", "ord_b"], _MEASURED, 1), "key", "run")
    wide = est.groupBy(F.col("key").alias("game")).agg(*[F.max(F.when(F.col("feature") == f, F.col("estimate"))).alias(f"{f}_est")
                                                         for f in _MEASURED])
    extra = F.pmod(F.col("game"), F.lit(5)) == 0
    return T.base_frame(m.where(~extra), m.where(extra), "game", n_folds, seed,
                        T.run_arrays(li, "game", "l_linenumber", _RUNS, ["run_tax", "run_supp"]), wide)


def flow(frame, make_estimator, dropped=None, n_folds=5, seed=42, packs=None):
    return T.train(frame, make_estimator, n_folds, len(_RUNS), ["agent1_idx", "agent2_idx", *_MEASURED], ["run_tax", "run_supp"],
                   _MEASURED, "game", "row_id", "utility", seed, dropped, packs=packs)


@register("m8_training_flow")
def training_flow(spark, d):
    """The whole flow twice: once with all features, whose importances name the least important one of each fold, then
    without it: row, fold, target, out-of-fold prediction and its recalibration."""
    frame, packs = stored(flow_frame(spark, d), "flow"), {}
    _, models, names = flow(frame, _gbt, packs=packs)
    return flow(frame, _gbt, T.least_important(models, names, 1), packs=packs)[0]


@register("m29_multiclass_outcome")
def m29(spark, d):
    """Multinomial outcome classifier, grouped CV; per-row class
    probabilities and their log loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    base = _cv_frame(spark, d).withColumn("cls", (F.col("outcome") + 1).cast("double"))
    x = L.fit_frame(L.assemble(base, FEATURES).select("row_id", "fold", "cls", "features"))
    parts = []
    for f in range(5):
        m = LogisticRegression(family="multinomial", labelCol="cls", maxIter=30).fit(x.where(F.col("fold") != f))
        parts.append(m.transform(x.where(F.col("fold") == f)).select(
            "row_id", "cls", vector_to_array("probability").alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stored(out, "classes")
    x.unpersist()
    return out.select("row_id", "cls", F.col("p")[0].alias("p_loss"), F.col("p")[1].alias("p_draw"),
                      F.col("p")[2].alias("p_win"),
                      (-F.log(F.element_at("p", (F.col("cls") + 1).cast("int")))).alias("log_loss"))


@register("m30_hybrid")
def m30(spark, d):
    """Saturated outcomes classified (−1 / interior / +1), interior
    regressed; expected value −p₋ + p₀·ŷ + p₊."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression
    base = _cv_frame(spark, d)
    cls = (F.when(F.col("utility") > 0.999, 2.0).when(F.col("utility") < -0.999, 0.0).otherwise(1.0))
    x = L.fit_frame(L.assemble(base.withColumn("sat", cls), FEATURES).select("row_id", "fold", "utility", "sat", "features"))
    parts = []
    for f in range(5):
        tr, te = x.where(F.col("fold") != f), x.where(F.col("fold") == f)
        c = LogisticRegression(family="multinomial", labelCol="sat", maxIter=30).fit(tr)
        r = LinearRegression(labelCol="utility").fit(tr.where(F.col("sat") == 1.0))
        t = r.transform(c.transform(te).withColumnRenamed("prediction", "cls_pred")
                        .drop("rawPrediction"))
        p = vector_to_array("probability")
        parts.append(t.select("row_id", (-p[0] + p[1] * F.col("prediction") + p[2]).alias("expected")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stored(out, "hybrid")
    x.unpersist()
    return out


def _selection_grams(spark, d):
    m = _wide(matches(spark, d)).withColumn("fold", F.pmod(hash_int(61, "game"), F.lit(5)))
    return L.fold_gram(m, "fold", WIDE, "utility")


@register("m32_backward_elimination")
def m32(spark, d):
    """Backward elimination over features, squares and products by exact linear CV RMSE (one Gram matrix a fold, swept)."""
    path = G.backward_elimination(_selection_grams(spark, d), len(WIDE))
    rows = [(s, WIDE[f] if f is not None else None, float(r)) for s, f, r in path]
    return spark.createDataFrame(rows, "step int, dropped string, cv_rmse double")


@register("m33_forward_selection")
def m33(spark, d):
    """Forward selection over features, squares and products by exact linear CV RMSE (one Gram matrix a fold, swept)."""
    path = G.forward_selection(_selection_grams(spark, d), len(WIDE))
    rows = [(s, WIDE[f] if f is not None else None, float(r)) for s, f, r in path]
    return spark.createDataFrame(rows, "step int, added string, cv_rmse double")


@register("m9_correlation_picked")
def m9_picked(spark, d):
    """Grouped-CV linear regression on the features, squares and products whose |r| exceeds 0.01 in the fold's training rows."""
    m = _wide(group_kfold(matches(spark, d).select("row_id", "game", "utility", *FEATURES), "game", 5, 42))
    return G.picked_linear_cv(m, "fold", WIDE, "utility", "row_id", 0.01)[0]


@register("m34_random_search")
def m34(spark, d):
    """Seeded random search (log-uniform regParam, uniform elasticNet),
    cross-validated on the grouped fold column."""
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(34)
    lr = LinearRegression(labelCol="utility")
    trials = [{lr.regParam: float(10 ** rng.uniform(-4, 0)), lr.elasticNetParam: float(rng.uniform(0, 1))}
              for _ in range(6)]
    scores, _ = L.linear_search(_cv_frame(spark, d), lr, trials, FEATURES, "utility", "fold", 5)
    rows = [(i, t[lr.regParam], t[lr.elasticNetParam], float(s)) for i, (t, s) in enumerate(zip(trials, scores))]
    return spark.createDataFrame(rows, "trial int, reg_param double, elastic_net double, cv_rmse double")


@register("k7_model_bundle")
def k7(spark, d):
    """Fit a pipeline, save it to shared storage, reload, predict."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from tessera.sources.sinks import save_model
    m = matches(spark, d)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"),
                            LinearRegression(labelCol="utility")])
    path = save_model(pipe.fit(m), fresh_path(spark, "model"))
    return PipelineModel.load(path).transform(m).select("row_id", "prediction")
