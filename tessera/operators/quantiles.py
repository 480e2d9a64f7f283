"""M2 fitted on one set of rows and applied to another: a table of quantile knots per fold.

Each fold's transform is fitted on the rows of all other folds.  Values are put
in order once, by range partitions; every row carries its count of rows before
it in each fold, so its place in each fold's training set is a difference, and
no training set is copied or sorted again.  A fold has
``max(min(n / 30, 1000), 10)`` knots at most, so the knots of all folds are a
table of at most 1,000 rows a fold, whatever the data's size.

Nulls have no place in the fit and stay null.  A fold whose training set is
empty, or has one row only, has one knot or none; its rows get 0 at or below
the knot, 1 above it, null without one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.functions.udfs import _norm_ppf

MAX_KNOTS = 1000


def n_knots(n: Column) -> Column:
    """max(min(n / 30, 1000), 10), and no more than there are rows."""
    return F.least(n, F.greatest(F.least(F.floor(n / 30), F.lit(MAX_KNOTS)), F.lit(10)).cast("long"))


def gauss(seed, key: Column | str) -> Column:
    """A standard normal draw by (seed, key): Box-Muller over two hash draws."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(f"{seed}a", key))) * F.cos(F.lit(2.0 * np.pi) * uniform(f"{seed}b", key))


def quantile_knots(df: DataFrame, col: str, fold: str, n_folds: int, order: Sequence[str], jitter: Column | None = None) -> DataFrame:
    """(fold, j, knot, knots): the j-th of the fold's knots, linear between the order statistics of the other folds' rows."""
    value = F.col(col).cast("double") + (jitter if jitter is not None else 0.0)
    v = df.where(F.col(col).isNotNull()).select(F.col(fold).cast("int").alias("_f"), value.alias("_v"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = ["_v", *[f"_o{i}" for i in range(len(order))]]
    parts = v.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    in_fold = [(F.col("_f") == i).cast("long") for i in range(n_folds)]
    names = [f"_n{i}" for i in range(n_folds)]
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_pid").agg(*[F.sum(x).alias(n) for x, n in zip(in_fold, names)])
    offsets = sums.select("_pid", F.array(*[F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names]).alias("_off"))
    totals = sums.agg(F.array(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).alias("_t"))
    inside = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    run = F.array(*[F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in in_fold])
    placed = (parts.withColumn("_run", run).join(F.broadcast(offsets), "_pid")
              .select("_f", "_v", F.zip_with("_run", "_off", lambda a, b: a + b).alias("_c")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    places = (placed.select("_f", "_v", F.posexplode(F.transform("_c", lambda x: total(F.col("_c")) - x)).alias("fold", "_p"))
              .where(F.col("fold") != F.col("_f")))
    wanted = (totals.select(F.posexplode(F.transform("_t", lambda x: total(F.col("_t")) - x)).alias("fold", "_n"))
              .where("_n > 0").withColumn("knots", n_knots(F.col("_n")))
              .select("fold", "_n", "knots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("knots") - 1)).alias("j")))
    steps = F.greatest(F.col("knots") - 1, F.lit(1))
    at = F.expr("(j * (_n - 1)) div greatest(knots - 1, 1)")
    share = (F.col("j") * (F.col("_n") - 1)) % steps / steps
    wanted = wanted.select("fold", "j", "knots", share.alias("_w"), F.posexplode(F.array(at, at + 1)).alias("_side", "_p")).where("_side = 0 or _w > 0")
    # at most 2,000 wanted places a fold
    low, high = F.max(F.when(F.col("_side") == 0, F.col("_v"))), F.max(F.when(F.col("_side") == 1, F.col("_v")))
    return (places.join(F.broadcast(wanted), ["fold", "_p"]).groupBy("fold", "j", "knots", "_w")
            .agg(low.alias("_low"), high.alias("_high"))
            .select("fold", "j", "knots", (F.col("_low") + F.coalesce((F.col("_high") - F.col("_low")) * F.col("_w"), F.lit(0.0))).alias("knot")))


def apply_quantiles(df: DataFrame, col: str, fold: str, knots: DataFrame, out: str | None = None, normal: bool = False) -> DataFrame:
    """The column through its fold's knots, both directions averaged where knots tie; ``normal`` gives the normal form."""
    out = out or f"{col}_q"
    table: dict[int, np.ndarray] = {}
    rows = knots.select("fold", "j", "knot").toPandas()  # at most MAX_KNOTS rows a fold
    for f, part in rows.sort_values(["fold", "j"]).groupby("fold"):
        table[int(f)] = np.maximum.accumulate(part["knot"].to_numpy())

    def through(x: np.ndarray, q: np.ndarray | None) -> np.ndarray:
        if q is None:
            return np.full(len(x), np.nan)
        if len(q) == 1:
            return np.where(np.isnan(x), np.nan, (x > q[0]).astype(float))
        ref = np.linspace(0.0, 1.0, len(q))
        u = 0.5 * (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1]))
        edge = 1e-7 if normal else 0.0
        u[x >= q[-1] - edge] = 1.0
        u[x <= q[0] + edge] = 0.0
        return u

    @F.pandas_udf("double")
    def run(values: pd.Series, folds: pd.Series) -> pd.Series:
        x, res = values.to_numpy(dtype=float, na_value=np.nan), np.full(len(values), np.nan)
        for f in folds.dropna().unique():
            at = (folds == f).to_numpy(dtype=bool)
            res[at] = through(x[at], table.get(int(f)))
        if normal:
            some = ~np.isnan(res)
            res[some] = _norm_ppf(np.clip(res[some], 1e-7, 1 - 1e-7))
        return pd.Series(res)

    return df.withColumn(out, run(F.col(col).cast("double"), F.col(fold).cast("int")))
