"""M9, M14-M23 calibration/blending/augmentation and M28, M36-M38 rating
queries (all closed form → DuckDB oracles)."""

from pyspark.sql import functions as F

from tessera.functions.hashing import hash_int, sql_hash_int, sql_uniform
from tessera.operators import augment as G
from tessera.operators import calib as K
from tessera.operators.scaleclip import scale_clip_box
from tessera.operators.aggs import two_sided
from tessera.operators.folds import group_fold_table, group_kfold
from tessera.operators.ordered import average_rank, dedup_first
from tessera.operators.ratings import component_rows, component_sides, packed_field_lookup
from tessera.plans.fixtures import MATCHES_SQL, PREDICTIONS_SQL, matches, predictions
from tessera.registry import register
from tessera.sources.sinks import stored
from tessera.registry.aggs import FOLD_SQL
from tessera.registry.reshape import COMP_SQL
from tessera.sources.tables import table

M = f"m AS ({MATCHES_SQL})"
P = f"p AS ({PREDICTIONS_SQL})"
PF = f"pf AS (SELECT p.*, f.fold FROM p JOIN ({FOLD_SQL(5, 4, 'game', 'p')}) f USING (game))"


def _pf(spark, d):
    """Predictions with group folds: a game's rows are all on one side of a split."""
    return group_kfold(predictions(spark, d), "game", 5, 4)


@register("m9_fold_linear_fit", f"""WITH {P}, {PF},
s AS (SELECT fold, count(*) AS n, sum(p1) AS sx, sum(y) AS sy, sum(p1 * y) AS sxy, sum(p1 * p1) AS sxx FROM pf GROUP BY fold),
t AS (SELECT fold, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy,
             sum(sxy) OVER () - sxy AS sxy, sum(sxx) OVER () - sxx AS sxx FROM s)
SELECT fold, round((sxy - sx * sy / n) / (sxx - sx * sx / n), 6) AS slope,
       round(sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n, 6) AS intercept,
       round(sxy / sxx, 6) AS slope0 FROM t""")
def m9(spark, d):
    r = K.fold_linear_fits(_pf(spark, d), "fold", "p1", "y")
    return r.select("fold", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "slope0")])


@register("m14_residual_blend", f"WITH {P} SELECT row_id, p1 * 0.157 + p2 * 0.843 AS blend FROM p")
def m14(spark, d):
    return predictions(spark, d).select("row_id", K.residual_blend(F.col("p1"), F.col("p2"), 0.157).alias("blend"))


def _g(a, b):
    a, b = sorted((a, b))
    return f"g_{a}_{b}"


_PS = ["p1", "p2", "p3"]
_GRAM_SQL = ", ".join([f"sum({a} * {b}) AS {_g(a, b)}" for i, a in enumerate(_PS) for b in _PS[i:]]
                      + [f"sum({a} * y) AS r_{a}" for a in _PS])


def _det3(m):
    return (f"(({m[0][0]}) * (({m[1][1]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][1]})) - "
            f"({m[0][1]}) * (({m[1][0]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][0]})) + "
            f"({m[0][2]}) * (({m[1][0]}) * ({m[2][1]}) - ({m[1][1]}) * ({m[2][0]})))")


_A = [[_g(_PS[i], _PS[j]) for j in range(3)] for i in range(3)]
_W_SQL = ", ".join(
    f"round({_det3([[f'r_{_PS[i]}' if j == c else _A[i][j] for j in range(3)] for i in range(3)])} / {_det3(_A)}, 6) AS w_{_PS[c]}"
    for c in range(3))


@register("m15_optimal_blend_weights", f"WITH {P}, g AS (SELECT {_GRAM_SQL} FROM p) SELECT {_W_SQL} FROM g")
def m15(spark, d):
    w = K.optimal_blend_weights(predictions(spark, d), _PS, "y")
    return w.select(*[F.round(c, 6).alias(c) for c in w.columns])


@register("m16_weight_sweep", f"""WITH {P}
SELECT w, round(sqrt(avg(power(y - (w * p1 + (1.0 - w) * p2), 2))), 6) AS rmse
FROM p, (SELECT unnest(range(11)) / 10 AS w) GROUP BY w""")
def m16(spark, d):
    r = K.weight_sweep(predictions(spark, d), "p1", "p2", "y", 11)
    return r.select("w", F.round("rmse", 6).alias("rmse"))


_COEFS, _MAGS = [0.9, 1.0, 1.1, 1.2], [0.5, 0.75, 1.0]


@register("m17_scale_clip_grid", f"""WITH {P}, {PF},
g AS (SELECT * FROM (VALUES {', '.join(f'({c}::DOUBLE)' for c in _COEFS)}) a(coef),
                    (VALUES {', '.join(f'({m}::DOUBLE)' for m in _MAGS)}) b(mag)),
e AS (SELECT fold, coef, mag, sum(power(y - greatest(-mag, least(mag, coef * p1)), 2)) AS sse, count(*) AS n
      FROM pf, g GROUP BY fold, coef, mag),
t AS (SELECT *, sum(sse) OVER (PARTITION BY coef, mag) - sse AS tsse, sum(n) OVER (PARTITION BY coef, mag) - n AS tn FROM e),
l AS (SELECT *, round(sqrt(tsse / tn) + (power(coef - 1, 2) + power(mag - 1, 2)) / 10.0, 12) AS loss FROM t)
SELECT fold, coef, mag, round(sqrt(sse / n), 6) AS test_rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY loss, coef, mag) AS rn FROM l) WHERE rn = 1""")
def m17(spark, d):
    r = K.scale_clip_grid(_pf(spark, d), "p1", "y", "fold", _COEFS, _MAGS)
    return r.select("fold", "coef", "mag", F.round("test_rmse", 6).alias("test_rmse"))


@register("m17_scale_clip_box")
def m17_box(spark, d):
    """Scale-and-clip with the optimum over all of coef in [0.9, 1.2] and mag in [0.5, 1] for each fold's training rows."""
    r = scale_clip_box(_pf(spark, d), "p1", "y", "fold", 5)
    return r.select("fold", *[F.round(c, 6).alias(c) for c in ("coef", "mag", "train_loss", "test_rmse")])


def _wdl(spark, d):
    m = matches(spark, d)
    return m.groupBy("game").agg(F.count_if(F.col("outcome") == 1).alias("wins"),
                                 F.count_if(F.col("outcome") == 0).alias("draws"),
                                 F.count_if(F.col("outcome") == -1).alias("losses"),
                                 F.avg("outcome").alias("actual_mean"))


@register("m18_monte_carlo_resim", f"""WITH {M},
w AS (SELECT game, count(*) FILTER (WHERE outcome = 1) AS wins, count(*) FILTER (WHERE outcome = 0) AS draws,
             count(*) FILTER (WHERE outcome = -1) AS losses, avg(outcome) AS actual_mean FROM m GROUP BY game),
t AS (SELECT game, wins, draws, losses, {sql_uniform(19, "row_id")} AS u FROM m JOIN w USING (game)),
s AS (SELECT game, avg(CASE WHEN u < losses / (wins + draws + losses) THEN -1
                          WHEN u < (losses + draws) / (wins + draws + losses) THEN 0 ELSE 1 END) AS sim_mean FROM t GROUP BY game)
SELECT game, round(actual_mean, 6) AS actual_mean, round(sim_mean, 6) AS sim_mean FROM w JOIN s USING (game)""")
def m18(spark, d):
    """Each game is played again as often as it was played, from its own shares of outcomes."""
    w = _wdl(spark, d)
    s = K.resimulate(matches(spark, d), w, "game", "row_id", "wins", "draws", "losses", 19)
    return w.join(s, "game").select("game", F.round("actual_mean", 6).alias("actual_mean"),
                                    F.round("sim_mean", 6).alias("sim_mean"))


@register("m18_resim_report", f"""WITH {M},
w AS (SELECT game, count(*) FILTER (WHERE outcome = 1) AS wins, count(*) FILTER (WHERE outcome = 0) AS draws,
             count(*) FILTER (WHERE outcome = -1) AS losses, avg(outcome) AS actual_mean FROM m GROUP BY game),
t AS (SELECT game, wins, draws, losses, {sql_uniform(19, "row_id")} AS u FROM m JOIN w USING (game)),
s AS (SELECT game, avg(CASE WHEN u < losses / (wins + draws + losses) THEN -1
                          WHEN u < (losses + draws) / (wins + draws + losses) THEN 0 ELSE 1 END) AS sim_mean FROM t GROUP BY game)
SELECT count(*) AS n, round(corr(actual_mean, sim_mean), 6) AS correlation,
       round(sqrt(avg(power(actual_mean - sim_mean, 2))), 6) AS rmse FROM w JOIN s USING (game)""")
def m18_report(spark, d):
    """How far replayed means stay from the measured ones: the noise floor of a mean outcome."""
    w = _wdl(spark, d)
    s = K.resimulate(matches(spark, d), w, "game", "row_id", "wins", "draws", "losses", 19)
    diff = F.col("actual_mean") - F.col("sim_mean")
    return w.join(s, "game").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("actual_mean", "sim_mean"), 6).alias("correlation"),
                                 F.round(F.sqrt(F.avg(diff * diff)), 6).alias("rmse"))


@register("m19_pseudo_label", f"""WITH {P}
SELECT row_id, round(y * (1.0 - w) + ((p1 + p2 + p3) / 3.0) * w, 6) AS y_new FROM
  (SELECT *, CASE WHEN run <= 3 THEN 0.3 ELSE 0.6 END AS w FROM p)""")
def m19(spark, d):
    p = predictions(spark, d)
    w = F.when(F.col("run") <= 3, F.lit(0.3)).otherwise(F.lit(0.6))
    yhat = (F.col("p1") + F.col("p2") + F.col("p3")) / 3.0
    return p.select("row_id", F.round(G.pseudo_label(F.col("y"), yhat, w), 6).alias("y_new"))


@register("m20_error_reweight", f"""WITH {P}
SELECT row_id, round(exp(-2.0 * (y - p1) * (y - p1)) * CASE WHEN run % 2 = 0 THEN 0.5 ELSE 1.0 END, 6) AS weight FROM p""")
def m20(spark, d):
    p = predictions(spark, d)
    sw = F.when(F.pmod(F.col("run"), F.lit(2)) == 0, F.lit(0.5)).otherwise(F.lit(1.0))
    return p.select("row_id", F.round(G.error_weight(F.col("y"), F.col("p1"), 2.0, sw), 6).alias("weight"))


@register("m21_fitness_weight", f"WITH {P} SELECT row_id, CASE WHEN p2 > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM p")
def m21(spark, d):
    return predictions(spark, d).select("row_id", G.fitness_weight(F.col("p2")).alias("weight"))


_RUN_IDS = list(range(1, 8))


@register("m23_run_sampled_noise", f"""
WITH first AS (SELECT l_partkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (
       PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1),
mean AS (SELECT l_partkey, avg(l_quantity) AS mu FROM first GROUP BY l_partkey),
r AS (SELECT p_partkey AS l_partkey, {_RUN_IDS}[1 + {sql_hash_int(31, 'CAST(p_partkey AS VARCHAR)')} % 7] AS run FROM part)
SELECT r.l_partkey AS p_partkey, round(coalesce(f.l_quantity, mean.mu) * 0.67 + mean.mu * 0.33, 6) AS eval
FROM r LEFT JOIN first f ON f.l_partkey = r.l_partkey AND f.l_linenumber = r.run
LEFT JOIN mean ON mean.l_partkey = r.l_partkey""")
def m23(spark, d):
    li = table(spark, d, "lineitem")
    runs = dedup_first(li.select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", "l_quantity"),
                       ["l_partkey", "l_linenumber"], ["l_orderkey", "l_suppkey"])
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"))
    r = G.run_sampled_noise(rows.withColumn("p_partkey", F.col("l_partkey")), "l_partkey", runs, "l_linenumber",
                            "l_quantity", _RUN_IDS, 31, "p_partkey", 0.33)
    return r.select("p_partkey", F.round("eval", 6).alias("eval"))


# ---- M28: out-of-fold rating prediction -----------------------------------

@register("m28_oof_rating_prediction", f"""WITH {M}, {COMP_SQL},
f AS ({FOLD_SQL(4, 23, 'game', 'm')}),
cs AS (SELECT f.fold, component, option, sum(v) AS sv, count(*) AS n FROM x JOIN f USING (game) GROUP BY ALL),
tr AS (SELECT fold, component, option, (sum(sv) OVER (PARTITION BY component, option) - sv)
         / (sum(n) OVER (PARTITION BY component, option) - n) AS score FROM cs)
SELECT x.row_id, round(avg(CASE WHEN side = 1 THEN score END) - avg(CASE WHEN side = -1 THEN score END) + 1e-10, 6) AS delta
FROM x JOIN f USING (game) LEFT JOIN tr ON tr.fold = f.fold AND tr.component = x.component AND tr.option = x.option
GROUP BY x.row_id""")
def m28(spark, d):
    """Each game's matches are scored by the rating model of the fold that
    held the game out: per (fold, component, option) mean two-sided score
    over the other folds' games (total − own sums)."""
    from pyspark.sql import Window
    m = matches(spark, d)
    folds = group_fold_table(m, "game", 4, 23)
    t = two_sided(m, "game", "agent1", "agent2", "utility")
    rows = component_rows(t, "game", "agent", extra=["v"]).join(folds, "game")
    cs = rows.groupBy("fold", "component", "option").agg(F.sum("v").alias("sv"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("component", "option")
    tr = cs.select("fold", "component", "option",
                   ((F.sum("sv").over(w) - F.col("sv")) / (F.sum("n").over(w) - F.col("n"))).alias("score"))
    r = packed_field_lookup(m, "row_id", "game", "agent1", "agent2", folds.join(tr, "fold"), "score")
    return r.select("row_id", F.round(F.col("delta") + 1e-10, 6).alias("delta"))


# ---- M36-M38 ---------------------------------------------------------------

def _half_scores(spark, d):
    rows = component_sides(matches(spark, d), "game", "agent1", "agent2", "utility", extra=["run"])
    odd, even = F.pmod("run", F.lit(2)) == 1, F.pmod("run", F.lit(2)) == 0
    # scores rounded to 1e-9 + shift so equal means tie in any engine
    score = lambda half: F.round(F.avg(F.when(half, F.col("v"))) + 1e-12, 9)
    s = rows.groupBy("game", "component", "option").agg(score(odd).alias("sa"), score(even).alias("sb"),
                                                        F.count_if(odd).alias("_a"), F.count_if(even).alias("_b"))
    return s.where("_a > 0 and _b > 0 and game is not null and option is not null").select("game", "component", "option", "sa", "sb")


_HALF_SQL = f"""{M},
x2 AS (SELECT game, run % 2 AS half, c.component, string_split(agent, '-')[c.idx + 1] AS option, v FROM
  (SELECT game, run, agent1 AS agent, utility AS v FROM m UNION ALL SELECT game, run, agent2, -utility FROM m) s,
  (VALUES ('selection', 1), ('exploration_const', 2), ('playout', 3), ('score_bounds', 4)) c(component, idx)),
h AS (SELECT game, component, option, half, round(avg(v) + 1e-12, 9) AS score FROM x2 GROUP BY ALL),
j AS (SELECT a.game, a.component, a.option, a.score AS sa, b.score AS sb FROM h a JOIN h b
      ON a.game = b.game AND a.component = b.component AND a.option = b.option AND a.half = 1 AND b.half = 0)"""


@register("m36_rating_stability", f"""WITH {_HALF_SQL},
rk AS (SELECT *, rank() OVER (ORDER BY sa) + (count(*) OVER (PARTITION BY sa) - 1) / 2.0 AS ra,
              rank() OVER (ORDER BY sb) + (count(*) OVER (PARTITION BY sb) - 1) / 2.0 AS rb FROM j)
SELECT round(corr(sa, sb), 6) AS pearson, round(corr(ra, rb), 6) AS spearman,
       round(sqrt(avg(power(sa - sb, 2))), 6) AS rmse, round(sqrt(avg(power(sa, 2))), 6) AS rmse_vs_zero,
       round(stddev_pop(sa - sb), 6) AS std_diff FROM rk""")
def m36(spark, d):
    """Run-to-run stability of component ratings: odd vs even runs."""
    j = stored(_half_scores(spark, d).select("sa", "sb"), "half_scores")
    r = average_rank(average_rank(j, "sa", "ra"), "sb", "rb")
    e = F.col("sa") - F.col("sb")
    return r.agg(F.round(F.corr("sa", "sb"), 6).alias("pearson"), F.round(F.corr("ra", "rb"), 6).alias("spearman"),
                 F.round(F.sqrt(F.avg(F.pow(e, 2))), 6).alias("rmse"),
                 F.round(F.sqrt(F.avg(F.pow(F.col("sa"), 2))), 6).alias("rmse_vs_zero"),
                 F.round(F.stddev_pop(e), 6).alias("std_diff"))


@register("m37_quality_vs_budget", f"""WITH {P}
SELECT string_split(agent1, '-')[2] AS config, run AS budget, round(corr(p1, y), 6) AS r FROM p GROUP BY 1, 2
UNION ALL SELECT 'ensemble', run, round(corr((p1 + p2 + p3) / 3.0, y), 6) FROM p GROUP BY 2""")
def m37(spark, d):
    p = predictions(spark, d)
    per = p.groupBy(F.split("agent1", "-")[1].alias("config"), F.col("run").alias("budget")).agg(
        F.round(F.corr("p1", "y"), 6).alias("r"))
    ens = p.groupBy(F.lit("ensemble").alias("config"), F.col("run").alias("budget")).agg(
        F.round(F.corr((F.col("p1") + F.col("p2") + F.col("p3")) / 3.0, "y"), 6).alias("r"))
    return per.unionByName(ens)


@register("m38_outcome_vs_utility", f"""WITH {M}
SELECT round(corr(mo, mu), 6) AS r FROM (SELECT game, avg(outcome) AS mo, avg(utility) AS mu FROM m GROUP BY game)""")
def m38(spark, d):
    g = matches(spark, d).groupBy("game").agg(F.avg("outcome").alias("mo"), F.avg("utility").alias("mu"))
    return g.agg(F.round(F.corr("mo", "mu"), 6).alias("r"))
