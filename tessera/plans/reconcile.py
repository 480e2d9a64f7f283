"""Re-measurement reconciliation (the flagship flow).

Repeated measurements of the same keys in several runs are reconciled to a
baseline run: keep-first dedup per (key, run) → run-vs-baseline join on
common keys → log-log fit per (feature, run) → MAPE report → mean
estimate per (key, feature) over runs → interpolation augmentation of the
full table.

Shuffles: one partial aggregate for the dedup (hot keys are combined
map-side), one join on (key, feature) between already-deduplicated sides,
one tiny aggregate for the fits (features × runs groups) that is broadcast
back, one aggregate for the mean estimates, one join back to the full
table (AQE splits a skewed key's partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hkey
from tessera.operators.augment import interpolate
from tessera.operators.calib import loglog_fit, loglog_predict
from tessera.operators.ordered import dedup_first
from tessera.operators.reshape import unpivot


def baseline_pairs(meas: DataFrame, key: str, run: str, order: Sequence[str],
                   features: Sequence[str], baseline_run: int) -> DataFrame:
    """W1 + N2 + J12: (feature, run, key, a = run value, b = baseline value)."""
    first = dedup_first(meas.select(key, run, *order, *features), [key, run], list(order)).drop(*order)
    # split by run before unpivoting so the run predicates reach the scan
    base = unpivot(first.where(F.col(run) == baseline_run), [key, run], features, "feature", "value") \
        .select(key, "feature", F.col("value").alias("b"))
    other = unpivot(first.where(F.col(run) != baseline_run), [key, run], features, "feature", "value") \
        .select(key, run, "feature", F.col("value").alias("a"))
    return other.join(base, [key, "feature"])


def materialize(df: DataFrame) -> DataFrame:
    """Compute once for several consumers (fit and prediction).  Persisted
    memory-and-disk: a lost block is recomputed from lineage, so executor
    loss stays safe; the pairs table is deduplicated (one row per key, run
    and feature), far smaller than the raw measurements."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fit_runs(pairs: DataFrame, run: str) -> DataFrame:
    """M11 per (feature, run) + A17 MAPE of the back-transformed estimate."""
    pairs = materialize(pairs)
    fit = loglog_fit(pairs, ["feature", run], "a", "b")
    pred = loglog_predict(pairs, fit, ["feature", run], "a")
    mape = pred.groupBy("feature", run).agg(
        F.avg(F.abs(F.col("b") - F.col("estimate")) / F.abs(F.col("b"))).alias("mape"))
    return fit.join(mape, ["feature", run])


def estimates(pairs: DataFrame, key: str, run: str) -> DataFrame:
    """A4 — mean of the per-run estimates per (key, feature)."""
    pairs = materialize(pairs)
    fit = loglog_fit(pairs, ["feature", run], "a", "b")
    pred = loglog_predict(pairs, fit, ["feature", run], "a")
    return pred.groupBy(key, "feature").agg(F.avg("estimate").alias("estimate"),
                                           F.count("estimate").alias("n_runs"))


def augment(meas: DataFrame, est: DataFrame, key: str, row_cols: Sequence[str],
            features: Sequence[str], seed: int) -> DataFrame:
    """M22 over every original row (long form: one row per row × feature).

    ``est`` has one row per (key, feature).  A key's estimates are put side by
    side first, so that a row meets them once, in its own columns, and is
    named and turned long where the join leaves it."""
    wide = est.groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("estimate"))).alias(f"_e{i}") for i, f in enumerate(features)])
    j = meas.select(*row_cols, *features).join(wide, key, "left").withColumn("row_id", hkey(*row_cols))
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("original"), F.col(f"_e{i}").alias("estimate"))
             for i, f in enumerate(features)]
    return j.select("row_id", F.explode(F.array(*parts)).alias("_p")).select("row_id", "_p.*").select(
        "row_id", "feature", "original", "estimate",
        interpolate(F.col("original"), F.col("estimate"), seed, "row_id", "feature").alias("augmented"))
