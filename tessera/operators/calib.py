"""Closed-form fits, calibration and blends.

Fits are grouped aggregates (one partial-aggregation pass); the fitted
coefficient table is model-sized (groups × 2 numbers) and joins back by
broadcast.  Coefficients are rounded to 1e-9 before use so predictions do
not depend on the summation order of the engine that fitted them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COEF_DIGITS = 9


def linear_fit(df: DataFrame, group: Sequence[str], x: str, y: str, intercept: bool = True) -> DataFrame:
    """M9 — 1-feature least squares per group: slope, intercept, n.
    ``intercept=False`` gives the through-origin slope Σxy/Σxx."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = df.where(ok)
    if intercept:
        aggs = [F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                F.regr_intercept(F.col(y), F.col(x)).alias("intercept")]
    else:
        aggs = [(F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"),
                F.lit(0.0).alias("intercept")]
    fit = d.groupBy(*group).agg(*aggs, F.count(F.lit(1)).alias("n"))
    return fit.select(*group, F.round("slope", COEF_DIGITS).alias("slope"),
                      F.round("intercept", COEF_DIGITS).alias("intercept"), "n")


def loglog_fit(pairs: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """M11 — fit ``ln b = intercept + slope·ln a`` per group (positive
    values only)."""
    d = pairs.where((F.col(a) > 0) & (F.col(b) > 0)) \
             .select(*group, F.ln(a).alias("_la"), F.ln(b).alias("_lb"))
    return linear_fit(d, group, "_la", "_lb")


def loglog_predict(pairs: DataFrame, fit: DataFrame, group: Sequence[str], a: str,
                   out: str = "estimate") -> DataFrame:
    """M11 — ``exp(intercept + slope·ln a)``; the fit table is tiny
    (one row per group) and is broadcast."""
    j = pairs.join(F.broadcast(fit.select(*group, "slope", "intercept")), list(group))
    est = F.when(F.col(a) > 0, F.exp(F.col("intercept") + F.col("slope") * F.ln(F.col(a))))
    return j.withColumn(out, est).drop("slope", "intercept")


def residual_blend(raw: Column, iso: Column, w: float) -> Column:
    """M14 — ``w·raw + (1-w)·iso``."""
    return raw * F.lit(w) + iso * F.lit(1.0 - w)


def gram_aggregates(df: DataFrame, preds: Sequence[str], y: str) -> list[Column]:
    """Σ p_i p_j and Σ p_i y in one pass (the normal equations)."""
    out = []
    for i, a in enumerate(preds):
        for b in preds[i:]:
            out.append(F.sum(F.col(a) * F.col(b)).alias(f"g_{a}_{b}"))
        out.append(F.sum(F.col(a) * F.col(y)).alias(f"r_{a}"))
    return out


def optimal_blend_weights(df: DataFrame, preds: Sequence[str], y: str,
                          group: Sequence[str] = ()) -> DataFrame:
    """M15 — unconstrained RMSE-optimal weights w minimising Σ(y - Σ w_i p_i)².

    One aggregate pass gives the Gram matrix; the k×k system (k = 2 or 3)
    is solved in closed form by Cramer's rule as column expressions.
    """
    k = len(preds)
    if k not in (2, 3):
        raise ValueError("closed form implemented for 2 or 3 prediction columns")
    g = df.groupBy(*group).agg(*gram_aggregates(df, preds, y)) if group else df.agg(*gram_aggregates(df, preds, y))

    def G(i, j):
        a, b = sorted((i, j))
        return F.col(f"g_{preds[a]}_{preds[b]}")

    def R(i):
        return F.col(f"r_{preds[i]}")

    def det(m):
        if len(m) == 2:
            return m[0][0] * m[1][1] - m[0][1] * m[1][0]
        return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
                - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))

    A = [[G(i, j) for j in range(k)] for i in range(k)]
    D = det(A)
    ws = []
    for c in range(k):
        Ac = [[R(i) if j == c else A[i][j] for j in range(k)] for i in range(k)]
        ws.append((det(Ac) / D).alias(f"w_{preds[c]}"))
    return g.select(*group, *ws)


def weight_sweep(df: DataFrame, a: str, b: str, y: str, steps: int = 11) -> DataFrame:
    """M16 — RMSE of ``w·a + (1-w)·b`` for w = 0, 1/(steps-1), …, 1.

    The squared error is a quadratic in w: with r = y - b and s = a - b it is
    (r - w·s)², so three sums over the rows give every weight.
    """
    r, s = F.col(y) - F.col(b), F.col(a) - F.col(b)
    q = df.agg(F.avg(r * r).alias("_rr"), F.avg(r * s).alias("_rs"), F.avg(s * s).alias("_ss"))
    q = q.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("w", F.col("_i") / F.lit(steps - 1))
    w = F.col("w")
    return q.select("w", F.sqrt(F.greatest(F.lit(0.0), F.col("_rr") - 2 * w * F.col("_rs") + w * w * F.col("_ss"))).alias("rmse"))


def scale_clip_grid(df: DataFrame, pred: str, y: str, fold: str, coefs: Sequence[float],
                    mags: Sequence[float]) -> DataFrame:
    """M17 — choose (coef, magnitude) minimising train RMSE + penalty per
    fold, then score the choice on that fold's test rows.

    Prediction = clip(coef·p, -mag, mag); penalty ((c-1)²+(m-1)²)/10.
    For fold f the train rows are all rows with fold ≠ f: per-(fold,param)
    sums are built from per-fold sums (total − own fold), never by
    replicating rows per fold.
    """
    grid = [(c, m) for c in coefs for m in mags]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("coef"), F.lit(m).alias("mag")) for c, m in grid]))
    x = df.select(fold, pred, y, pairs.alias("_g")).select(fold, pred, y, "_g.coef", "_g.mag")
    p = F.greatest(-F.col("mag"), F.least(F.col("mag"), F.col("coef") * F.col(pred)))
    per = x.groupBy(fold, "coef", "mag").agg(F.sum((F.col(y) - p) ** 2).alias("_sse"),
                                             F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    tot = Window.partitionBy("coef", "mag")
    per = per.withColumn("_train_sse", F.sum("_sse").over(tot) - F.col("_sse")) \
             .withColumn("_train_n", F.sum("_n").over(tot) - F.col("_n"))
    loss = F.sqrt(F.col("_train_sse") / F.col("_train_n")) + \
        ((F.col("coef") - 1) ** 2 + (F.col("mag") - 1) ** 2) / 10.0
    per = per.withColumn("_loss", F.round(loss, 12))
    best = per.groupBy(fold).agg(F.min_by(F.struct("coef", "mag", "_sse", "_n"),
                                          F.struct("_loss", "coef", "mag")).alias("b"))
    return best.select(fold, F.col("b.coef").alias("coef"), F.col("b.mag").alias("mag"),
                       F.sqrt(F.col("b._sse") / F.col("b._n")).alias("test_rmse"))


def complement_sums(df: DataFrame, fold: str, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Per-fold sufficient statistics of the *training* rows (all folds but
    this one): per-fold sums, then total − own.  Lets every fold's model be
    fitted from one aggregate pass, without replicating rows per fold."""
    from pyspark.sql import Window
    s = df.groupBy(*group, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                                     F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"))
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    for c in ("n", "sx", "sy", "sxy", "sxx"):
        s = s.withColumn(c, F.sum(c).over(w) - F.col(c))
    return s


def fold_linear_fits(df: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """M9 — per fold, least squares y ~ x on the fold's training rows:
    slope/intercept and the through-origin slope."""
    s = complement_sums(df, fold, x, y)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    slope = (F.col("sxy") - sx * sy / n) / (F.col("sxx") - sx * sx / n)
    return s.select(fold, F.round(slope, COEF_DIGITS).alias("slope"),
                    F.round(sy / n - slope * sx / n, COEF_DIGITS).alias("intercept"),
                    F.round(F.col("sxy") / F.col("sxx"), COEF_DIGITS).alias("slope0"))


def resimulate(rows: DataFrame, shares: DataFrame, key: str, row: str, wins: str, draws: str, losses: str, seed) -> DataFrame:
    """M18 — Monte-Carlo re-simulation: every row of a key is one trial drawn
    from the key's win/draw/loss shares (a uniform hashed from the row's id),
    so a key has as many trials as outcomes; mean simulated outcome per key."""
    from tessera.functions.hashing import uniform
    t = rows.select(key, row).join(shares.select(key, wins, draws, losses), key)
    tot = F.col(wins) + F.col(draws) + F.col(losses)
    u = uniform(seed, row)
    o = (F.when(u < F.col(losses) / tot, F.lit(-1)).when(u < (F.col(losses) + F.col(draws)) / tot, F.lit(0))
         .otherwise(F.lit(1)))
    return t.select(key, o.alias("o")).groupBy(key).agg(F.avg("o").alias("sim_mean"))
