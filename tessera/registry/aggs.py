"""A1-A26 aggregation queries."""

from pyspark.sql import functions as F

from tessera.functions.hashing import hash_int, sql_hash_int
from tessera.operators import aggs as A
from tessera.operators.folds import group_kfold
from tessera.operators.ordered import dedup_first
from tessera.operators.ratings import component_counts
from tessera.plans.fixtures import MATCHES_SQL, N_AGENTS, PREDICTIONS_SQL, matches, predictions
from tessera.registry import register
from tessera.registry.flagship import _PAIRS_SQL, _pairs
from tessera.sources.tables import table

M = f"m AS ({MATCHES_SQL})"
P = f"p AS ({PREDICTIONS_SQL})"


@register("a1_mean_target", f"""WITH {M}
SELECT game, round(avg(utility), 6) AS mean_y, round(avg(abs(utility)), 6) AS mean_abs_y FROM m GROUP BY game""")
def a1(spark, d):
    r = A.mean_target(matches(spark, d), "game", "utility")
    return r.select("game", F.round("mean_y", 6).alias("mean_y"), F.round("mean_abs_y", 6).alias("mean_abs_y"))


@register("a2_two_sided_mean", f"""WITH {M},
t AS (SELECT game, agent1 AS agent, utility AS v FROM m UNION ALL SELECT game, agent2, -utility FROM m)
SELECT game, agent, round(avg(v), 6) AS mean_score, count(*) AS n FROM t GROUP BY game, agent""")
def a2(spark, d):
    r = A.two_sided_mean(matches(spark, d), "game", "agent1", "agent2", "utility")
    return r.select("game", "agent", F.round("mean_score", 6).alias("mean_score"), "n")


_AGENTS = list(range(N_AGENTS))


@register("a3_profile_pivot", f"WITH {M} SELECT game, " + ", ".join(
    [f"round(avg(CASE WHEN agent1_idx = {a} THEN utility END), 6) AS a1_{a}" for a in _AGENTS]
    + [f"round(avg(CASE WHEN agent2_idx = {a} THEN -utility END), 6) AS a2_{a}" for a in _AGENTS]
    + [f"round((coalesce(sum(CASE WHEN agent1_idx = {a} THEN utility END), 0) + "
       f"coalesce(sum(CASE WHEN agent2_idx = {a} THEN -utility END), 0)) / nullif(count(CASE WHEN agent1_idx = {a} "
       f"THEN 1 END) + count(CASE WHEN agent2_idx = {a} THEN 1 END), 0), 6) AS all_{a}" for a in _AGENTS])
    + " FROM m GROUP BY game")
def a3(spark, d):
    p = A.profile_pivot(matches(spark, d), "game", "agent1_idx", "agent2_idx", "utility", _AGENTS)
    return p.select("game", *[F.round(F.col(c), 6).alias(c) for c in p.columns if c != "game"])


@register("a4_mean_over_runs_null_zero", """
SELECT l_partkey, l_linenumber, round(avg(coalesce(l_quantity, 0.0)), 6) AS mean_value, count(*) AS n_runs
FROM lineitem GROUP BY l_partkey, l_linenumber""")
def a4(spark, d):
    r = A.mean_over_runs(table(spark, d, "lineitem"), ["l_partkey", "l_linenumber"], "l_quantity", True)
    return r.select("l_partkey", "l_linenumber", F.round("mean_value", 6).alias("mean_value"), "n_runs")


@register("a5_pair_outcome_contract", f"""WITH {M}
SELECT game, agent1, agent2, round(avg(outcome), 6) AS mean_outcome, count(*) AS n, count(*) NOT IN (4, 8) AS violation
FROM m GROUP BY game, agent1, agent2""")
def a5(spark, d):
    r = A.pair_outcomes(matches(spark, d), "game", "agent1", "agent2", "outcome")
    return r.select("game", "agent1", "agent2", F.round("mean_outcome", 6).alias("mean_outcome"), "n", "violation")


@register("a6_result_pivot", f"WITH {M} SELECT l_orderkey, " + ", ".join(
    f"max(CASE WHEN run = {i} THEN outcome END) AS match_{i}_outcome" for i in range(1, 8))
    + " FROM m GROUP BY l_orderkey")
def a6(spark, d):
    return A.result_pivot(matches(spark, d), "l_orderkey", "run", "outcome", list(range(1, 8)))


def quality(spark, d):
    """A7 per game, from match statistics."""
    m = matches(spark, d)
    n = F.count(F.lit(1))
    g = m.groupBy("game").agg(
        F.round(F.avg(F.when(F.col("run") == 1, F.col("utility"))), 9).alias("ev"),
        (F.lit(1.0) - F.abs(F.avg("outcome"))).alias("balance"),
        (F.count_if(F.col("outcome") != 0) / n).alias("agency"),
        (F.count_distinct("agent1") / n).alias("coverage"),
        (F.lit(1.0) - F.count_if(F.col("outcome") == 0) / n).alias("decisiveness"),
        F.avg(F.lit(1.0) - F.col("l_tax") * 10).alias("completion"),
        F.avg(F.col("l_discount") * 10).alias("depth"))
    q = A.harmonic_quality(F.col("ev"), [F.col(c) for c in ("balance", "agency", "coverage", "decisiveness",
                                                             "completion", "depth")], F.col("agency"))
    return g.select("game", F.round(q, 6).alias("quality"))


_CL = lambda c: f"(1.0 / least(1.0, greatest(0.01, {c})))"
QUALITY_SQL = f"""q0 AS (SELECT game, round(avg(CASE WHEN run = 1 THEN utility END), 9) AS ev,
  1.0 - abs(avg(outcome)) AS balance, count(*) FILTER (WHERE outcome <> 0) / count(*) AS agency,
  count(DISTINCT agent1) / count(*) AS coverage, 1.0 - count(*) FILTER (WHERE outcome = 0) / count(*) AS decisiveness,
  avg(1.0 - l_tax * 10) AS completion, avg(l_discount * 10) AS depth FROM m GROUP BY game),
quality AS (SELECT game, round(CASE WHEN ev IS NULL THEN -3.0 WHEN abs(ev) >= 0.5 THEN -2.0 WHEN agency < 0.5 THEN -1.0
  ELSE 6.0 / ({' + '.join(_CL(c) for c in ('balance', 'agency', 'coverage', 'decisiveness', 'completion', 'depth'))})
  END, 6) AS quality FROM q0)"""

register("a7_harmonic_quality", f"WITH {M}, {QUALITY_SQL} SELECT game, quality FROM quality")(quality)


@register("a8_conditional_win_rate", f"""WITH {M},
t AS (SELECT agent1 AS agent, outcome AS v FROM m UNION ALL SELECT agent2, -outcome FROM m)
SELECT string_split(agent, '-')[2] AS selection, round(count(*) FILTER (WHERE v = 1) / count(*), 6) AS win_rate
FROM t GROUP BY 1""")
def a8(spark, d):
    t = A.two_sided(matches(spark, d), "game", "agent1", "agent2", "outcome")
    return t.groupBy(F.split("agent", "-")[1].alias("selection")).agg(
        F.round(F.count_if(F.col("v") == 1) / F.count(F.lit(1)), 6).alias("win_rate"))


@register("a9_component_counts", f"""WITH {M},
s AS (SELECT game, agent1 AS agent FROM m UNION ALL SELECT game, agent2 FROM m),
x AS (SELECT game, agent, c.component, string_split(agent, '-')[c.idx + 1] AS option FROM s,
      (VALUES ('selection', 1), ('exploration_const', 2), ('playout', 3), ('score_bounds', 4)) c(component, idx))
SELECT game, component, option, count(*) AS match_count, count(DISTINCT agent) AS agent_count,
       min(count(*)) OVER (PARTITION BY game, component) AS min_count FROM x GROUP BY game, component, option""")
def a9(spark, d):
    return component_counts(matches(spark, d), "game", "agent1", "agent2")


@register("a10_histogram", f"""WITH {M}
SELECT CAST(least(9, floor((utility + 1.0) / 2.0 * 10)) AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY 1""")
def a10(spark, d):
    b = F.least(F.lit(9), F.floor((F.col("utility") + 1.0) / 2.0 * 10)).cast("bigint")
    return matches(spark, d).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("a10_share_above", f"""WITH {M}
SELECT round(avg(CAST(utility > 0.5 AS INTEGER)), 6) AS share FROM m""")
def a10b(spark, d):
    return matches(spark, d).agg(F.round(F.avg((F.col("utility") > 0.5).cast("int")), 6).alias("share"))


@register("a11_pearson", """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag""")
def a11(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


_RUNS = list(range(1, 8))
_FIRST_LI = """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber
  ORDER BY l_orderkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1)"""


@register("a12_run_correlation_matrix", f"WITH {_FIRST_LI}, w AS (SELECT l_partkey, " + ", ".join(
    f"max(CASE WHEN l_linenumber = {r} THEN l_quantity END) AS r{r}" for r in _RUNS)
    + " FROM first GROUP BY l_partkey) " + " UNION ALL ".join(
    f"SELECT {a} AS run_a, {b} AS run_b, round(corr(r{a}, r{b}), 6) AS r, round(corr(ln(r{a}), ln(r{b})), 6) AS r_log FROM w"
    for a in _RUNS for b in _RUNS if a < b))
def a12(spark, d):
    li = table(spark, d, "lineitem")
    first = dedup_first(li.select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", "l_quantity"),
                        ["l_partkey", "l_linenumber"], ["l_orderkey", "l_suppkey"])
    w = first.groupBy("l_partkey").pivot("l_linenumber", _RUNS).agg(F.max("l_quantity"))
    pairs = [(a, b) for a in _RUNS for b in _RUNS if a < b]
    row = w.agg(*[F.corr(str(a), str(b)).alias(f"c_{a}_{b}") for a, b in pairs],
                *[F.corr(F.ln(str(a)), F.ln(str(b))).alias(f"l_{a}_{b}") for a, b in pairs])
    st = F.explode(F.array(*[F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"),
                                      F.round(f"c_{a}_{b}", 6).alias("r"), F.round(f"l_{a}_{b}", 6).alias("r_log"))
                             for a, b in pairs]))
    return row.select(st.alias("s")).select("s.*")


@register("a13_spearman", """
SELECT round(corr(rx, ry), 6) AS spearman FROM (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry
  FROM lineitem)""")
def a13(spark, d):
    r = A.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return r.select(F.round("spearman", 6).alias("spearman"))


_A14_COLS = ["l_quantity", "l_extendedprice", "l_tax", "run", "agent1_idx", "agent2_idx", "outcome"]


@register("a14_target_correlation_filter", f"WITH {M}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", corr({c}, utility) AS r, var_pop({c}) AS v FROM m" for c in _A14_COLS)
    + ") SELECT \"column\", round(r, 6) AS r FROM c WHERE v > 0 AND abs(r) > 0.005")
def a14(spark, d):
    m = matches(spark, d)
    row = m.agg(*[F.corr(c, "utility").alias(f"r_{c}") for c in _A14_COLS],
                *[F.var_pop(c).alias(f"v_{c}") for c in _A14_COLS])
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r_{c}").alias("r"),
                                      F.col(f"v_{c}").alias("v")) for c in _A14_COLS]))
    x = row.select(st.alias("s")).select("s.*")
    return x.where((F.col("v") > 0) & (F.abs("r") > 0.005)).select("column", F.round("r", 6).alias("r"))


@register("a15_rmse", f"""WITH {P},
f AS (SELECT {sql_hash_int(11, 'row_id')} % 5 AS fold, sum((y - p1) * (y - p1)) AS sse,
      sum((y - greatest(-1.0, least(1.0, p1))) * (y - greatest(-1.0, least(1.0, p1)))) AS sse_c, count(*) AS n
      FROM p GROUP BY 1)
SELECT round(sqrt(sum(sse) / sum(n)), 6) AS rmse, round(avg(sqrt(sse / n)), 6) AS rmse_fold_mean,
       round(sqrt(sum(sse_c) / sum(n)), 6) AS rmse_clipped FROM f""")
def a15(spark, d):
    p = predictions(spark, d).withColumn("fold", F.pmod(hash_int(11, "row_id"), F.lit(5)))
    e = F.col("y") - F.col("p1")
    ec = F.col("y") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("p1")))
    f = p.groupBy("fold").agg(F.sum(e * e).alias("sse"), F.sum(ec * ec).alias("sse_c"), F.count(F.lit(1)).alias("n"))
    return f.agg(F.round(F.sqrt(F.sum("sse") / F.sum("n")), 6).alias("rmse"),
                 F.round(F.avg(F.sqrt(F.col("sse") / F.col("n"))), 6).alias("rmse_fold_mean"),
                 F.round(F.sqrt(F.sum("sse_c") / F.sum("n")), 6).alias("rmse_clipped"))


@register("a16_log_loss", f"""WITH {M},
s AS (SELECT agent1, (count(*) FILTER (WHERE outcome = -1) + 1.0) / (count(*) + 3.0) AS p0,
             (count(*) FILTER (WHERE outcome = 0) + 1.0) / (count(*) + 3.0) AS p1,
             (count(*) FILTER (WHERE outcome = 1) + 1.0) / (count(*) + 3.0) AS p2 FROM m GROUP BY agent1),
g AS (SELECT count(*) FILTER (WHERE outcome = -1) / count(*) AS q0, count(*) FILTER (WHERE outcome = 0) / count(*) AS q1,
             count(*) FILTER (WHERE outcome = 1) / count(*) AS q2 FROM m)
SELECT round(avg(-ln(CASE m.outcome WHEN -1 THEN s.p0 WHEN 0 THEN s.p1 ELSE s.p2 END)), 6) AS log_loss,
       round(avg(-ln(CASE m.outcome WHEN -1 THEN g.q0 WHEN 0 THEN g.q1 ELSE g.q2 END)), 6) AS baseline_log_loss
FROM m JOIN s USING (agent1), g""")
def a16(spark, d):
    m = matches(spark, d)
    s = A.class_shares(m, "agent1", "outcome", [-1, 0, 1])
    n = F.count(F.lit(1))
    prior = m.agg(*[(F.count_if(F.col("outcome") == c) / n).alias(f"q_{i}") for i, c in enumerate((-1, 0, 1))])
    q = prior.first()  # three numbers: the constant-distribution baseline
    j = m.join(s, "agent1")
    pick = lambda pre: F.when(F.col("outcome") == -1, pre[0]).when(F.col("outcome") == 0, pre[1]).otherwise(pre[2])
    pp = pick([F.col("p_0"), F.col("p_1"), F.col("p_2")])
    pq = pick([F.lit(q[0]), F.lit(q[1]), F.lit(q[2])])
    return j.agg(F.round(F.avg(-F.ln(pp)), 6).alias("log_loss"), F.round(F.avg(-F.ln(pq)), 6).alias("baseline_log_loss"))


@register("a17_mape", f"""WITH {_PAIRS_SQL}
SELECT feature, run, round(avg(abs(b - a) / greatest(abs(b), 1e-12)), 6) AS mape FROM pairs GROUP BY feature, run""")
def a17(spark, d):
    p = _pairs(spark, d)
    return p.groupBy("feature", "run").agg(
        F.round(F.avg(F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("b"), F.lit(1e-12))), 6).alias("mape"))


_SEEDS = [1, 2, 3, 4, 5]
_SEED_U = "(('0x' || substr(md5(CAST(seed AS VARCHAR) || '|' || row_id), 1, 8))::BIGINT / 4294967296.0)"


@register("a18_constant_baseline_z", f"""WITH {M},
s AS (SELECT seed, sqrt(avg(power(utility - (utility * 0.6 + ({_SEED_U} - 0.5) * 0.8), 2))) AS rmse
      FROM m, (VALUES {', '.join(f'({s})' for s in _SEEDS)}) v(seed) GROUP BY seed),
c AS (SELECT stddev_pop(utility) AS rmse_const FROM m)
SELECT round(rmse_const, 6) AS rmse_const, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std,
       round((rmse_const - avg(rmse)) / stddev_pop(rmse), 3) AS z FROM s, c GROUP BY rmse_const""")
def a18(spark, d):
    m = matches(spark, d)
    const = m.agg(F.stddev_pop("utility")).first()[0]  # one scalar
    x = m.select("row_id", "utility", F.explode(F.array(*[F.lit(s) for s in _SEEDS])).alias("seed"))
    u = F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit("|"), F.col("row_id"))), 1, 8),
               16, 10).cast("bigint") / 4294967296.0
    pred = F.col("utility") * 0.6 + (u - 0.5) * 0.8
    e = F.col("utility") - pred
    s = x.groupBy("seed").agg(F.sqrt(F.avg(F.pow(e, 2))).alias("rmse"))
    return s.agg(F.round(F.lit(const), 6).alias("rmse_const"), F.round(F.avg("rmse"), 6).alias("rmse_mean"),
                 F.round(F.stddev_pop("rmse"), 6).alias("rmse_std"),
                 F.round((F.lit(const) - F.avg("rmse")) / F.stddev_pop("rmse"), 3).alias("z"))


_WELCH_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a19_welch_t", "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", l_returnflag AS g, avg({c}) AS m, var_samp({c}) AS v, count({c}) AS n "
    f"FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag" for c in _WELCH_COLS) + """)
SELECT a."column", round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
       round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 6) AS dof
FROM s a JOIN s b ON a."column" = b."column" AND a.g = 'A' AND b.g = 'R'""")
def a19(spark, d):
    r = A.welch(table(spark, d, "lineitem"), "l_returnflag", "A", "R", _WELCH_COLS)
    return r.select("column", F.round("t", 6).alias("t"), F.round("dof", 6).alias("dof"))


_DIFF_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


@register("a20_run_difference_detector", f"WITH {_FIRST_LI}, j AS (SELECT b.l_linenumber AS run, "
          + ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in _DIFF_COLS) + " FROM "
          "(SELECT * FROM first WHERE l_linenumber = 1) a JOIN (SELECT * FROM first WHERE l_linenumber <> 1) b "
          "USING (l_partkey)) " + " UNION ALL ".join(
              f"SELECT run, '{c}' AS \"column\", count(*) FILTER (WHERE a_{c} IS DISTINCT FROM b_{c}) AS n_diff, "
              f"count(*) FILTER (WHERE a_{c} IS DISTINCT FROM b_{c}) > 0 AS differs FROM j GROUP BY run" for c in _DIFF_COLS))
def a20(spark, d):
    """Run 1 against every other run."""
    li = table(spark, d, "lineitem")
    first = dedup_first(li.select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", *_DIFF_COLS),
                        ["l_partkey", "l_linenumber"], ["l_orderkey", "l_suppkey"])
    others = first.where("l_linenumber <> 1").withColumnRenamed("l_linenumber", "run")
    return A.run_differences(first.where("l_linenumber = 1"), others, "l_partkey", "run", _DIFF_COLS)


def _long_preds(spark, d):
    p = predictions(spark, d)
    return p.select("row_id", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred"))
                                                  for m in ("p1", "p2", "p3")])).alias("s")).select("row_id", "s.*")


_LONG = "l AS (SELECT row_id, 'p1' AS model, p1 AS pred FROM p UNION ALL SELECT row_id, 'p2', p2 FROM p UNION ALL SELECT row_id, 'p3', p3 FROM p)"


@register("a21_weighted_mean", f"""WITH {P}, {_LONG}, w AS (SELECT * FROM (VALUES ('p1', 4.0), ('p2', 2.0), ('p3', 1.0)) v(model, weight))
SELECT row_id, round(sum(weight * pred) / sum(weight), 6) AS blend FROM l JOIN w USING (model) GROUP BY row_id""")
def a21(spark, d):
    w = spark.createDataFrame([("p1", 4.0), ("p2", 2.0), ("p3", 1.0)], "model string, weight double")
    r = A.weighted_mean(_long_preds(spark, d), "row_id", "model", "pred", w)
    return r.select("row_id", F.round("blend", 6).alias("blend"))


@register("a22_mean_prediction", f"""WITH {P}, {_LONG}
SELECT row_id, round(avg(pred), 6) AS mean_pred FROM l GROUP BY row_id""")
def a22(spark, d):
    r = _long_preds(spark, d).groupBy("row_id").agg(F.avg("pred").alias("mean_pred"))
    return r.select("row_id", F.round("mean_pred", 6).alias("mean_pred"))


@register("a23_indexed_list", """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, turn, role
FROM conversations""")
def a23(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return A.indexed_list(c, "conv_id", ["turn"]).select("conv_id", "pos", "turn", "role")


@register("a24_ratio_stats", """
SELECT l_returnflag, round(avg(l_extendedprice / l_quantity), 6) AS mean_ratio,
       round(stddev_pop(l_extendedprice / l_quantity), 6) AS std_ratio FROM lineitem GROUP BY l_returnflag""")
def a24(spark, d):
    r = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg(r), 6).alias("mean_ratio"), F.round(F.stddev_pop(r), 6).alias("std_ratio"))


FOLD_SQL = lambda n, seed, grp, src: (
    f"SELECT {grp}, CAST(ntile({n}) OVER (ORDER BY md5('{seed}|' || CAST({grp} AS VARCHAR))) - 1 AS BIGINT) AS fold "
    f"FROM (SELECT DISTINCT {grp} FROM {src})")


@register("a25_fold_quality_report", f"""WITH {M}, {QUALITY_SQL}, f AS ({FOLD_SQL(6, 5, 'game', 'm')})
SELECT fold, count(*) FILTER (WHERE quality > 0.3) AS n_kept, count(*) AS n_total,
       round(avg(quality) FILTER (WHERE quality > 0.3), 6) AS mean_kept
FROM quality JOIN f USING (game) GROUP BY fold""")
def a25(spark, d):
    q = group_kfold(quality(spark, d), "game", 6, 5)
    kept = F.col("quality") > 0.3
    return q.groupBy("fold").agg(F.count_if(kept).alias("n_kept"), F.count(F.lit(1)).alias("n_total"),
                                 F.round(F.avg(F.when(kept, F.col("quality"))), 6).alias("mean_kept"))


_NOISE = [0.4, 0.8, 1.2]


@register("a26_seed_sweep_summary", f"""WITH {M},
r AS (SELECT noise, seed, sqrt(avg(power(utility - (utility * 0.6 + ({_SEED_U} - 0.5) * noise), 2))) AS rmse
      FROM m, (VALUES {', '.join(f'({s})' for s in _SEEDS)}) v(seed), (VALUES {', '.join(f'({x}::DOUBLE)' for x in _NOISE)}) c(noise)
      GROUP BY noise, seed)
SELECT noise, round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS std_rmse, round(min(rmse), 6) AS min_rmse,
       round(max(rmse), 6) AS max_rmse, count(*) AS n,
       {", ".join(f"round(max(rmse) FILTER (WHERE seed = {s}), 6) AS score_{s}" for s in _SEEDS)} FROM r GROUP BY noise""")
def a26(spark, d):
    m = matches(spark, d)
    x = m.select("row_id", "utility", F.explode(F.array(*[F.lit(s) for s in _SEEDS])).alias("seed"),
                 ).select("*", F.explode(F.array(*[F.lit(v) for v in _NOISE])).alias("noise"))
    u = F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit("|"), F.col("row_id"))), 1, 8),
               16, 10).cast("bigint") / 4294967296.0
    e = F.col("utility") - (F.col("utility") * 0.6 + (u - 0.5) * F.col("noise"))
    r = x.groupBy("noise", "seed").agg(F.sqrt(F.avg(F.pow(e, 2))).alias("rmse"))
    return r.groupBy("noise").agg(F.round(F.avg("rmse"), 6).alias("mean_rmse"),
                                  F.round(F.stddev_pop("rmse"), 6).alias("std_rmse"),
                                  F.round(F.min("rmse"), 6).alias("min_rmse"), F.round(F.max("rmse"), 6).alias("max_rmse"),
                                  F.count(F.lit(1)).alias("n"),
                                  *[F.round(F.max(F.when(F.col("seed") == s, F.col("rmse"))), 6).alias(f"score_{s}") for s in _SEEDS])
