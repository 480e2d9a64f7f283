"""Sinks (K1-K7).  Writers go to shared storage; nothing goes through the
driver.  Paths should come from ``session.fresh_path`` / the cluster's
``spark.checkpoint.dir``, never a machine-local folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import fresh_path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    """K1 — table sink."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, so that what it was made from can be released."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """``stored``, unless the frame is a table already."""
    at_rest = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return df if at_rest else stored(df, name)


def write_keymap_json(df: DataFrame, key: str, value: str, path: str) -> str:
    """K2 — key→value map as JSON lines ``{"key":…, "value":…}``."""
    df.select(F.col(key).alias("key"), F.col(value).alias("value")).write.mode("overwrite").json(path)
    return path


def write_keyed(df: DataFrame, key: str, path: str, buckets: int = 64) -> str:
    """K3 — "one file per key" re-aimed: a keyed table in ``buckets`` hash
    partitions (a key's rows land in one folder; files stay few and large)."""
    (df.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)))
       .hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path))
    return path


def write_per_worker(df: DataFrame, worker: str, path: str) -> str:
    """K4 — per-worker task files (JSON lines), one folder per worker; a
    worker with many tasks is split over several writers."""
    df.hint("rebalance", worker).write.mode("overwrite").partitionBy(worker).json(path)
    return path


def write_oof(df: DataFrame, path: str) -> str:
    """K5 — OOF predictions partitioned by (seed, fold); dynamic overwrite
    replaces only the (seed, fold) folders present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("seed", "fold").parquet(path))
    return path


def snapshot_delta(current: DataFrame, previous_path: str | None, key: str,
                   spark: SparkSession) -> DataFrame:
    """K6 — rows whose key is not in the previous snapshot (anti-join)."""
    if previous_path is None:
        return current
    prev = spark.read.parquet(previous_path).select(key).distinct()
    return current.join(prev, key, "left_anti")


def save_model(model, path: str) -> str:
    """K7 — MLlib model/pipeline bundle per (seed, fold)."""
    model.write().overwrite().save(path)
    return path
