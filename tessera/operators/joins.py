"""Lookup joins.

Dictionary sides are broadcast only when their size is bounded by
construction (fixed dimensions, model-sized tables); otherwise the plan is a
shuffle join and AQE may still switch to broadcast from measured runtime
sizes, or split a skewed key's partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import dedup_first

def strict_lookup(df: DataFrame, dim: DataFrame, key: str, values: Sequence[str],
                  on_miss: str = "raise", flag: str = "missing") -> DataFrame:
    """J1 — every left key must find its dictionary row.

    ``on_miss='raise'``: the job fails at the first miss (``assert_true``);
    ``'report'``: a boolean ``missing`` column instead.
    """
    d = dim.select(key, *values).withColumn("_hit", F.lit(True))
    j = df.join(d, key, "left")
    if on_miss == "raise":
        chk = F.assert_true(F.col("_hit").isNotNull(), F.concat(F.lit("strict lookup miss: "),
                                                                F.col(key).cast("string")))
        return j.where(chk.isNull()).drop("_hit")
    return j.withColumn(flag, F.col("_hit").isNull()).drop("_hit")


def defaulted_lookup(df: DataFrame, dim: DataFrame, key: str, value: str,
                     default: str | float = "mean", original: str | None = None) -> DataFrame:
    """J2 — ``.get(k, default)``: default is a constant, the dictionary
    mean (one scalar), or another column of the row (``original``)."""
    j = df.join(dim.select(key, value), key, "left")
    if original is not None:
        fill = F.col(original)
    elif default == "mean":
        fill = F.lit(dim.agg(F.avg(value)).first()[0])
    else:
        fill = F.lit(default)
    return j.withColumn(value, F.coalesce(F.col(value).cast("double"), fill))


def multi_lookup(df: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """J3 — chain of equi-joins (dimension, left column, dimension column)."""
    out = df
    for dim, left, right in dims:
        out = out.join(dim, out[left] == dim[right], "inner")
    return out


def membership_weight(df: DataFrame, key: str, members: DataFrame, member_key: str,
                      w_in: float, w_out: float = 1.0, out: str = "sample_weight") -> DataFrame:
    """J4 — weight by membership in another table (join on distinct keys)."""
    m = members.select(F.col(member_key).alias(key)).distinct().withColumn("_in", F.lit(True))
    return df.join(m, key, "left").withColumn(
        out, F.when(F.col("_in"), F.lit(w_in)).otherwise(F.lit(w_out))).drop("_in")


def exactly_one(df: DataFrame, dim: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """J6 — join only keys with exactly one dictionary row; also return
    counters (matched / missing / multiple) as a one-row frame."""
    cnt = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_cnt"))
    single = dim.join(cnt.where("_cnt = 1").select(key), key, "left_semi")
    joined = df.join(single, key, "inner")
    c = df.select(key).join(cnt, key, "left")
    counters = c.agg(F.count_if(F.col("_cnt") == 1).alias("matched"),
                     F.count_if(F.col("_cnt").isNull()).alias("missing"),
                     F.count_if(F.col("_cnt") > 1).alias("multiple"))
    return joined, counters


def first_match(df: DataFrame, dim: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """J11 — lookup into the keep-first-deduplicated dictionary."""
    return df.join(dedup_first(dim, [key], list(order)), key, "left")


def keys_in_all(df: DataFrame, key: str, run: str) -> DataFrame:
    """J13 — keys observed in every run (count of distinct runs = total)."""
    n_runs = df.select(run).distinct().count()  # one scalar
    per = df.select(key, run).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per.where(F.col("_n") == n_runs).select(key)
