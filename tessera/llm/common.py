"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import fresh_path

#: Prefix of every working column, so that columns of the input cannot clash.
P = "__tx_"
#: Whitespace-delimited words, as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UP, ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and kept when executors go."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame, spark: SparkSession | None = None) -> None:
    """Deletes tables that ``written`` has made and nothing needs any more, and lets Spark drop the
    shuffle files of finished jobs: it does so when the driver's JVM collects its garbage."""
    spark = spark or tables[0].sparkSession
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()[:1]}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def bind(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def text_of(col) -> Column:
    """The column as a text, null as the empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, ASCII_UP, ASCII_LOW)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod 5 = 0; a null id counts as the empty text (crc32 0, held out)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def drawn(df: DataFrame, key: Column, n: int, rows: int) -> DataFrame:
    """About ``rows`` of the ``n`` rows of df, those whose 63-bit hash is least; all if there are no more.

    If the hashes there are (of a few keys with many rows) all lie above the
    bound, it is rows of the least one: the sample is empty only where df is.
    """
    if n <= rows:
        return df
    h = key.bitwiseAND(F.lit((1 << 63) - 1))
    found = df.filter(h < F.lit(min(-(-(rows << 63) // n), (1 << 63) - 1)))
    if not found.isEmpty():
        return found
    least = df.agg(F.min(h)).first()[0]
    return df.filter(h == F.lit(least)).limit(rows) if least is not None else df


def salt_hot(df: DataFrame, key: str, limit: int, out: str) -> DataFrame:
    """Adds ``out``: 0, but spread over enough values where more than ``limit`` rows share ``key``.

    Such rows have no order of their own; the salt lets them go to as many
    groups as they need.  Counts are pre-aggregated; the table of hot keys
    holds at most rows / limit rows, and the join has no forced broadcast.
    """
    hot = (df.groupBy(F.col(key).alias(P + "k")).agg(F.count(F.lit(1)).alias(P + "c"))
           .filter(F.col(P + "c") > limit)
           .select(P + "k", F.ceil(F.col(P + "c") / F.lit(limit)).cast("long").alias(P + "ways")))
    cols = df.columns
    return (df.withColumn(P + "rid", F.monotonically_increasing_id())
            .join(hot, F.col(key) == F.col(P + "k"), "left")
            .select(*cols, F.coalesce(F.pmod(F.xxhash64(P + "rid"), F.col(P + "ways")), F.lit(0).cast("long")).alias(out)))
