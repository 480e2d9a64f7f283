"""Label and feature augmentation (M19-M23).  All draws are seeded hashes
of (seed, row key, feature) so a recomputed partition redraws the same
numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_int, uniform


def pseudo_label(y: Column, yhat: Column, w: Column | float) -> Column:
    """M19 — ``y·(1-w) + ŷ·w`` (w may be a per-source column)."""
    w = w if isinstance(w, Column) else F.lit(w)
    return y * (F.lit(1.0) - w) + yhat * w


def error_weight(y: Column, yhat: Column, c: float, source_weight: Column | float = 1.0) -> Column:
    """M20 — ``exp(-c·(y-ŷ)²) × source weight``."""
    sw = source_weight if isinstance(source_weight, Column) else F.lit(source_weight)
    return F.exp(F.lit(-c) * (y - yhat) * (y - yhat)) * sw


def fitness_weight(score: Column, good: float = 1.0, bad: float = 0.5) -> Column:
    """M21 — weight ``good`` when score > 0 else ``bad``."""
    return F.when(score > 0, F.lit(good)).otherwise(F.lit(bad))


def interpolate(orig: Column, est: Column, seed, *key_cols) -> Column:
    """M22 — uniform draw between the original and the re-measured
    estimate; no estimate → the original value."""
    e = F.coalesce(est, orig)
    lo, hi = F.least(orig, e), F.greatest(orig, e)
    return lo + (hi - lo) * uniform(seed, *key_cols)


def run_sampled_noise(rows: DataFrame, key: str, runs: DataFrame, run: str, value: str,
                      run_ids: Sequence[int], seed, row_key: str, g: float,
                      out: str = "eval") -> DataFrame:
    """M23 — per row: the value of one randomly drawn run blended with the
    all-run mean, ``(1-g)·v_run + g·mean``.

    Both lookups are equi-joins on (key[, run]); the mean table is one row
    per key (A4).  A key the drawn run lacks falls back to the mean.
    """
    ids = F.array(*[F.lit(r) for r in run_ids])
    drawn = F.element_at(ids, (F.pmod(hash_int(seed, row_key), F.lit(len(run_ids))) + 1).cast("int"))
    means = runs.groupBy(key).agg(F.avg(value).alias("_mean"))
    rv = runs.select(key, F.col(run).alias("_run"), F.col(value).alias("_v"))
    x = rows.withColumn("_run", drawn).join(rv, [key, "_run"], "left").join(means, key, "left")
    v = F.coalesce(F.col("_v"), F.col("_mean"))
    return x.withColumn(out, v * F.lit(1.0 - g) + F.col("_mean") * F.lit(g)).drop("_v", "_mean")
