"""Aggregations, statistics and metrics.

All are declarative aggregates: Spark plans them as partial (map-side) +
final hash aggregation, so a hot key is pre-combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import average_rank, global_prefix_sum


def flip(y: Column, how: str = "negate") -> Column:
    """Opponent's score: ``-y`` or ``1 - y`` (both conventions exist)."""
    return -y if how == "negate" else F.lit(1.0) - y


def two_sided(df: DataFrame, key: str, a1: str, a2: str, y: str, how: str = "negate",
              extra: Sequence[str] = ()) -> DataFrame:
    """Each match as two rows: (agent1, y) and (agent2, flipped y).  One
    scan + explode instead of a union of two scans."""
    sides = F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col(a1).alias("agent"), F.col(y).cast("double").alias("v")),
        F.struct(F.lit(2).alias("side"), F.col(a2).alias("agent"), flip(F.col(y).cast("double"), how).alias("v"))))
    return df.select(key, *extra, sides.alias("_s")).select(key, *extra, "_s.side", "_s.agent", "_s.v")


def mean_target(df: DataFrame, key: str, y: str) -> DataFrame:
    """A1 — mean and mean absolute target per key."""
    return df.groupBy(key).agg(F.avg(y).alias("mean_y"), F.avg(F.abs(F.col(y))).alias("mean_abs_y"))


def two_sided_mean(df: DataFrame, key: str, a1: str, a2: str, y: str, how: str = "negate") -> DataFrame:
    """A2 — mean score per (key, agent) over both seatings."""
    return two_sided(df, key, a1, a2, y, how).groupBy(key, "agent").agg(
        F.avg("v").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def profile_pivot(df: DataFrame, key: str, a1: str, a2: str, y: str, agents: Sequence[int],
                  how: str = "negate") -> DataFrame:
    """A3 — key × agent profile, three blocks (as agent1, as agent2, both),
    NULL where unseen.  One shuffle: matches are dealt by key, every match is
    exploded to its four block cells, then a single pivot over the explicit
    value list; a key's wide row is made in its partition and never moves."""
    t = two_sided(df.select(key, a1, a2, y).repartition(key), key, a1, a2, y, how)
    tag = F.explode(F.array(F.when(F.col("side") == 1, F.lit("a1")).otherwise(F.lit("a2")), F.lit("all")))
    cells = t.select(key, "agent", "v", tag.alias("_tag")).select(
        key, F.concat_ws("_", "_tag", F.col("agent").cast("string")).alias("_cell"), "v")
    names = [f"{b}_{a}" for b in ("a1", "a2", "all") for a in agents]
    per_cell = cells.groupBy(key, "_cell").agg(F.avg("v").alias("v"))
    return per_cell.groupBy(key).pivot("_cell", names).agg(F.first("v"))


def mean_over_runs(df: DataFrame, keys: Sequence[str], value: str, null_as_zero: bool = False) -> DataFrame:
    """A4 — mean over runs per key (optionally treating missing as 0)."""
    v = F.coalesce(F.col(value), F.lit(0.0)) if null_as_zero else F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean_value"), F.count(F.lit(1)).alias("n_runs"))


def pair_outcomes(df: DataFrame, key: str, a1: str, a2: str, y: str,
                  expected: Sequence[int] = (4, 8)) -> DataFrame:
    """A5 — mean outcome per (key, agent pair) with a cardinality contract."""
    g = df.groupBy(key, a1, a2).agg(F.avg(y).alias("mean_outcome"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("violation", ~F.col("n").isin(*expected))


def result_pivot(df: DataFrame, key: str, slot: str, value: str, slots: Sequence[int],
                 prefix: str = "match") -> DataFrame:
    """A6 — ``{prefix}_{i}_outcome`` per key, NULL where missing."""
    p = df.groupBy(key).pivot(slot, list(slots)).agg(F.max(value))
    return p.select(key, *[F.col(str(s)).alias(f"{prefix}_{s}_outcome") for s in slots])


def harmonic_quality(eval_: Column, metrics: Sequence[Column], agency: Column) -> Column:
    """A7 — gate ladder (unplayable −3, unbalanced −2, low agency −1), else
    the harmonic mean of the metrics clipped to [0.01, 1]."""
    arr = F.array(*[F.least(F.lit(1.0), F.greatest(F.lit(0.01), m)) for m in metrics])
    hmean = F.lit(float(len(metrics))) / F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.lit(1.0) / x)
    return (F.when(eval_.isNull(), F.lit(-3.0))
            .when(F.abs(eval_) >= 0.5, F.lit(-2.0))
            .when(agency < 0.5, F.lit(-1.0))
            .otherwise(hmean))


def rmse(y: Column, p: Column) -> Column:
    """A15 — RMSE aggregate."""
    return F.sqrt(F.avg((y - p) * (y - p)))


def welch(df: DataFrame, group: str, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """A19 — Welch t and degrees of freedom per column for groups a vs b.
    Long form (one aggregate over column × group), then a tiny pivot."""
    long = df.where(F.col(group).isin(a, b)).unpivot([group], list(columns), "column", "x")
    s = long.groupBy("column", group).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"),
                                          F.count("x").alias("n"))
    ga = s.where(F.col(group) == a).select("column", F.col("m").alias("m1"), F.col("v").alias("v1"),
                                            F.col("n").alias("n1"))
    gb = s.where(F.col(group) == b).select("column", F.col("m").alias("m2"), F.col("v").alias("v2"),
                                            F.col("n").alias("n2"))
    j = ga.join(gb, "column")
    se1, se2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return j.select("column", ((F.col("m1") - F.col("m2")) / F.sqrt(se1 + se2)).alias("t"),
                    ((se1 + se2) * (se1 + se2) / (se1 * se1 / (F.col("n1") - 1) + se2 * se2 / (F.col("n2") - 1)))
                    .alias("dof"))


def run_differences(base: DataFrame, others: DataFrame, key: str, run: str, columns: Sequence[str]) -> DataFrame:
    """A20 — which columns differ between the baseline run and each other
    run on their common keys: one aggregate of ``count_if(a.c IS DISTINCT
    FROM b.c)`` per column and run."""
    j = base.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(
        others.select(key, run, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    rows = j.groupBy(run).agg(*[F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns])
    return rows.unpivot([run], list(columns), "column", "n_diff").withColumn("differs", F.col("n_diff") > 0)


def weighted_mean(long: DataFrame, row: str, model: str, pred: str, weights: DataFrame) -> DataFrame:
    """A21 — Σ w·p / Σ w per row; AQE broadcasts the weight table if its measured size allows."""
    j = long.join(weights, model)
    return j.groupBy(row).agg((F.sum(F.col("weight") * F.col(pred)) / F.sum("weight")).alias("blend"))


def indexed_list(df: DataFrame, key: str, order: Sequence[str], out: str = "pos") -> DataFrame:
    """A23 — group → ordered list, kept in long form ``(key, pos, …)``.

    A global running count over (key, order) minus each key's first
    position: exact list positions without gathering a key's rows into one
    task (a key may hold a third of the data).
    """
    cum = global_prefix_sum(df, [key, *order], out="_cum")
    start = cum.groupBy(key).agg(F.min("_cum").alias("_start"))
    return cum.join(start, key).withColumn(out, (F.col("_cum") - F.col("_start")).cast("bigint")) \
              .drop("_cum", "_start")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """A13 — Pearson correlation of average ranks."""
    rx = average_rank(df.select(x, y), x, "_rx")
    rxy = average_rank(rx, y, "_ry")
    return rxy.agg(F.corr("_rx", "_ry").alias("spearman"))


def class_shares(df: DataFrame, key: str, label: str, classes: Sequence[int], alpha: float = 1.0) -> DataFrame:
    """Smoothed class distribution per key (for A16 log loss)."""
    n = F.count(F.lit(1))
    k = len(classes)
    return df.groupBy(key).agg(*[((F.count_if(F.col(label) == c) + alpha) / (n + alpha * k)).alias(f"p_{i}")
                                 for i, c in enumerate(classes)])
