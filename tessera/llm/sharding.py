"""Global shuffle into shards by a two-pass external shuffle.

Pass one scatters rows by seeded hashes: the shard by highest random weight
over (id, shard), so that one more shard takes rows only into itself, and
inside a shard a memory-sized bucket.  Pass two shuffles every bucket with
Fisher-Yates swaps whose draws are seeded by (shard, bucket, step); the slots
of the buckets follow each other without gaps.

Nulls: a null id is an id of its own (all such rows share a shard); a null
text has no bytes.  Repeated rows get slots of their own; where more copies
share id and text than a bucket holds, they are spread over buckets.  Empty
tables give empty results.  Further columns go along; columns of the input
named shard, slot or grown_shard are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import P, salt_hot, text_of

SEED = 9176
BUCKET_ROWS = 256


def rendezvous(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """The shard with the highest weight: depends on the key and the count alone."""
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("w"), F.lit(s).alias("s"))
                        for s in range(n_shards)]) if n_shards > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"]


def _fisher_yates(n: Column, *key: Column) -> Column:
    """A permutation of 0..n-1: from the last place down, swap with a drawn place at or below it."""
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    draws = F.transform(steps, lambda i: F.struct(i.alias("i"), F.pmod(F.xxhash64(*key, i), i + 1).cast("int").alias("j")))
    return F.aggregate(draws, F.sequence(F.lit(0), n - 1),
                       lambda a, d: F.transform(a, lambda x, k: F.when(k == d["i"], F.get(a, d["j"]))
                                                .when(k == d["j"], F.get(a, d["i"])).otherwise(x)))


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24,
               bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """Every row with its shard, grown_shard (with one more shard) and slot."""
    cols = [c for c in df.columns if c not in ("shard", "grown_shard", "slot")]
    buckets = max(1, math.ceil(df.count() / n_shards / bucket_rows))
    ident, salt, bucket, rank, n = (P + x for x in ("ident", "salt", "bucket", "rank", "n"))
    d = df.select(*cols).withColumn(ident, F.xxhash64(F.lit(seed + 1), F.col(id_col).cast("string"), text_of(text_col)))
    d = salt_hot(d, ident, bucket_rows, salt)
    rows = d.select(*cols, ident, rendezvous(F.col(id_col), n_shards, seed).alias("shard"),
                    rendezvous(F.col(id_col), n_shards + 1, seed).alias("grown_shard"),
                    F.pmod(F.xxhash64(ident, salt), F.lit(buckets)).alias(bucket))
    one = Window.partitionBy("shard", bucket)
    ranked = rows.withColumn(rank, F.row_number().over(one.orderBy(ident, F.col(id_col).cast("string"))) - 1)
    # small counts are summed first; the permutations are then drawn over as many tasks as a shuffle has, not as few as
    # the bytes of the counts ask for
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = (rows.groupBy("shard", bucket).agg(F.count(F.lit(1)).cast("int").alias(n))
            .withColumn(P + "first", F.sum(n).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(n))
            .repartition(min(tasks, n_shards * buckets), "shard", bucket)
            .withColumn(P + "perm", _fisher_yates(F.col(n), F.lit(seed + 2), F.col("shard"), F.col(bucket))))
    return (ranked.join(plan.select(F.col("shard").alias(P + "s"), F.col(bucket).alias(P + "b"), P + "perm", P + "first"),
                        (F.col("shard") == F.col(P + "s")) & (F.col(bucket) == F.col(P + "b")))
            .select(*cols, "shard", "grown_shard",
                    (F.col(P + "first") + F.get(P + "perm", F.col(rank))).cast("long").alias("slot")))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """One folder a shard; its files hold consecutive slots in order."""
    part = P + "part"
    (sharded.withColumn(part, F.floor(F.col("slot") / rows_per_file))
     .repartition("shard", part).sortWithinPartitions("shard", "slot")
     .drop(part).write.partitionBy("shard").parquet(path))
