"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a partition is "skewed" once it is 4x the median and above Spark's own size threshold
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Runtime SQL settings every plan of this library assumes (safe to set on a
# live session).  Broadcasts come only from explicit hints on tables whose
# size is bounded by construction, or from AQE's *measured* shuffle sizes —
# never from a static estimate, which can be wrong by orders of magnitude
# after explodes and checkpoints.
RUNTIME_SQL = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE, UTC and Arrow on.

    On a cluster ``master`` stays None so spark-submit decides; locally the
    caller passes ``local[N]`` and a shuffle width of ~2-3x cores.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {**_DEFAULTS, **RUNTIME_SQL}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_SQL to a session created elsewhere (e.g. a driver)."""
    for k, v in RUNTIME_SQL.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can see, under the cluster's ``spark.checkpoint.dir``.

    The cluster setting always wins.  Where it is unset, a local run gets a
    fresh scratch folder, so that ``DataFrame.checkpoint()`` works; on a
    cluster that would be a folder only the driver sees, so it is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises
            root = None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    if not parts:
        return root
    return "/".join([root.rstrip("/"), *parts])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never-reused path under the shared folder (for written tables)."""
    return shared_dir(spark, "tables", f"{name}-{uuid.uuid4().hex[:12]}")
