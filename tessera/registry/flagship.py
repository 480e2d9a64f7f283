"""Flagship: re-measurement reconciliation on lineitem (runs = line number,
key = part, features = quantity and extended price, baseline = run 1)."""

from pyspark.sql import functions as F

from tessera.plans import reconcile as rc
from tessera.plans.fixtures import MEASURED_FEATURES, MEASUREMENTS_SQL, measurements
from tessera.registry import register

SEED = 7
BASELINE = 1

_PAIRS_SQL = f"""
m AS ({MEASUREMENTS_SQL}),
first AS (SELECT key, run, l_quantity, l_extendedprice FROM
  (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY ord_a, ord_b) AS rn FROM m) WHERE rn = 1),
lng AS (UNPIVOT first ON l_quantity, l_extendedprice INTO NAME feature VALUE value),
base AS (SELECT key, feature, value AS b FROM lng WHERE run = {BASELINE}),
other AS (SELECT key, run, feature, value AS a FROM lng WHERE run <> {BASELINE}),
pairs AS (SELECT o.key, o.run, o.feature, o.a, b.b FROM other o JOIN base b USING (key, feature)),
fit AS (SELECT feature, run, round(regr_slope(ln(b), ln(a)), 9) AS slope,
               round(regr_intercept(ln(b), ln(a)), 9) AS intercept, count(*) AS n
        FROM pairs WHERE a > 0 AND b > 0 GROUP BY feature, run),
pred AS (SELECT p.*, exp(f.intercept + f.slope * ln(p.a)) AS estimate
         FROM pairs p JOIN fit f USING (feature, run))"""


def _pairs(spark, d):
    return rc.baseline_pairs(measurements(spark, d), "key", "run", ["ord_a", "ord_b"],
                             MEASURED_FEATURES, BASELINE)


@register("m11_reconcile_fit", f"""WITH {_PAIRS_SQL}
SELECT f.feature, f.run, f.slope, f.intercept, f.n, round(avg(abs(p.b - p.estimate) / abs(p.b)), 6) AS mape
FROM fit f JOIN pred p USING (feature, run) GROUP BY f.feature, f.run, f.slope, f.intercept, f.n""")
def reconcile_fit(spark, d):
    r = rc.fit_runs(_pairs(spark, d), "run")
    return r.select("feature", "run", "slope", "intercept", "n", F.round("mape", 6).alias("mape"))


@register("a4_reconcile_estimates", f"""WITH {_PAIRS_SQL}
SELECT key, feature, round(avg(estimate), 4) AS estimate, count(estimate) AS n_runs
FROM pred GROUP BY key, feature""")
def reconcile_estimates(spark, d):
    e = rc.estimates(_pairs(spark, d), "key", "run")
    return e.select("key", "feature", F.round("estimate", 4).alias("estimate"), "n_runs")


def augmented(spark, d):
    meas = measurements(spark, d)
    est = rc.estimates(_pairs(spark, d), "key", "run")
    out = rc.augment(meas, est, "key", ["ord_a", "run", "key", "ord_b"], MEASURED_FEATURES, SEED)
    return out.select("row_id", "feature", F.round("original", 4).alias("original"),
                      F.round("estimate", 4).alias("estimate"), F.round("augmented", 4).alias("augmented"))


register("m22_reconcile_augmented", f"""WITH {_PAIRS_SQL},
est AS (SELECT key, feature, avg(estimate) AS estimate FROM pred GROUP BY key, feature),
rows AS (SELECT concat_ws('|', CAST(ord_a AS VARCHAR), CAST(run AS VARCHAR), CAST(key AS VARCHAR), CAST(ord_b AS VARCHAR)) AS row_id,
                key, l_quantity, l_extendedprice FROM m),
rl AS (UNPIVOT rows ON l_quantity, l_extendedprice INTO NAME feature VALUE original),
j AS (SELECT rl.row_id, rl.feature, rl.original, est.estimate, coalesce(est.estimate, rl.original) AS e
      FROM rl LEFT JOIN est USING (key, feature))
SELECT row_id, feature, round(original, 4) AS original, round(estimate, 4) AS estimate,
       round(least(original, e) + (greatest(original, e) - least(original, e)) *
             (('0x' || substr(md5('{SEED}|' || concat_ws('|', row_id, feature)), 1, 8))::BIGINT / 4294967296.0), 4) AS augmented
FROM j""")(augmented)
