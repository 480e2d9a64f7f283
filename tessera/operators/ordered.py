"""Ordered operators: dedup, global ranks, grid elites, top-k.

No operator here uses a window without ``partitionBy`` over data-sized
input.  Global positions come from one of two set-based schemes:

* ``rank_by_hash`` — the order key is an md5 hex string, uniform by
  construction, so its first hex digits cut it into equal buckets.  A
  per-bucket count table (≤ 16^digits rows, a proven bound) gives offsets;
  rows are numbered inside their bucket.  Fully lazy.
* ``global_prefix_sum`` — any order: range-partition, checkpoint (so the
  partition assignment is fixed even if an executor is lost and the stage
  is recomputed), per-partition sums → offsets (≤ #partitions rows), then a
  running sum inside each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def rank_by_hash(df: DataFrame, h: str, out: str = "rank", total: str | None = "total",
                 tiebreak: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """0-based global position of every row in ``h`` order (h = md5 hex)."""
    d = df.withColumn("_b", F.substring(F.col(h), 1, digits))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.orderBy("_b")  # ≤ 16^digits rows
    offs = counts.select(
        "_b",
        F.coalesce(F.sum("_n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(F.col(h), *_cols(tiebreak))) - 1
    r = d.join(F.broadcast(offs), "_b").withColumn(out, (F.col("_off") + local).cast("bigint"))
    if total:
        r = r.withColumn(total, F.col("_total").cast("bigint"))
    return r.drop("_b", "_off", "_total", "_n")


def global_prefix_sum(df: DataFrame, order: Sequence, weight: str | None = None,
                      out: str = "cum", exclusive: str | None = None,
                      partitions: int | None = None) -> DataFrame:
    """Running sum of ``weight`` (or row count) in a global ``order``.

    ``order`` must be a total order (end it in a unique key).  Exact for
    integer weights.
    """
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    oc = _cols(order)
    r = df.repartitionByRange(p, *oc).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    w_in = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    sums = r.groupBy("_pid").agg(F.sum(w_in).alias("_s"))
    offs = sums.select("_pid", F.coalesce(
        F.sum("_s").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    wp = Window.partitionBy("_pid").orderBy(*oc)
    res = r.join(F.broadcast(offs), "_pid")
    res = res.withColumn(out, F.col("_off") + F.sum(w_in).over(wp.rowsBetween(Window.unboundedPreceding, 0)))
    if exclusive:
        res = res.withColumn(exclusive, F.col("_off") + F.coalesce(
            F.sum(w_in).over(wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return res.drop("_pid", "_off")


def ntile_fold(rank: Column, total: Column, n: int) -> Column:
    """0-based ``ntile(n)`` of a 0-based rank — the ``np.array_split`` sizes:
    the first ``total % n`` folds get one extra member."""
    q = (total / n).cast("bigint")
    rem = total - q * n
    big = rem * (q + 1)
    return F.when(rank < big, (rank / (q + 1)).cast("bigint")) \
            .otherwise(rem + ((rank - big) / F.greatest(q, F.lit(1))).cast("bigint")).cast("bigint")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W1 — keep the first row per key in ``order``.

    ``min_by(struct(row), struct(order))`` is a partial aggregate: each map
    task keeps one row per key before the shuffle, so a key holding a third
    of the data is reduced map-side instead of landing in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def average_rank(df: DataFrame, value: str, out: str = "avg_rank") -> DataFrame:
    """W8 — 1-based average (fractional) rank of ``value``, ties share the
    mean of their positions (``scipy.stats.rankdata`` default).

    Only the distinct-value count table is ordered globally; rows get their
    rank back by an equi-join on the value.  NULLs get NULL.
    """
    vc = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    cum = global_prefix_sum(vc, [value], weight="_cnt", out="_cum")
    ranks = cum.select(value, (F.col("_cum") - F.col("_cnt") + (F.col("_cnt") + 1) / 2.0).alias(out))
    return df.join(ranks, value, "left")


def grid_cell(x: Column, lo: float, hi: float, n: int) -> Column:
    """W9 bin: ``clip(int((x-lo)/(hi-lo)*n), 0, n-1)`` with Python ``int``
    truncation toward zero (clamped before the cast so it cannot overflow)."""
    v = (x - F.lit(lo)) / F.lit(hi - lo) * F.lit(n)
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.least(F.lit(n), F.greatest(F.lit(-1), v)).cast("int")))


def grid_elites(df: DataFrame, cells: Sequence[str], fitness: str, payload: Sequence[str],
                seq: Sequence[str]) -> DataFrame:
    """W9 — best payload per cell; ties keep the earliest ``seq`` (the
    incumbent of a strictly-greater replacement rule)."""
    order = F.struct(F.col(fitness), *[-F.col(s) for s in seq])
    keep = F.struct(F.col(fitness), *[F.col(c) for c in (*payload, *seq)])
    return (df.groupBy(*cells).agg(F.max_by(keep, order).alias("_e"))
              .select(*cells, *[F.col("_e")[c].alias(c) for c in (fitness, *payload, *seq)]))


def elite_merge_report(df: DataFrame, cells: Sequence[str], generation: str, fitness: str) -> DataFrame:
    """W10 — per generation, how many cells it takes over (strictly better
    than the best of all earlier generations, or a first fill).

    The window runs over the per-(cell, generation) best table, whose size
    is cells × generations, never over raw rows.
    """
    best = df.groupBy(*cells, generation).agg(F.max(fitness).alias("_best"))
    w = Window.partitionBy(*cells).orderBy(generation).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.max("_best").over(w)
    flagged = best.withColumn("_new", (prev.isNull() | (F.col("_best") > prev)).cast("int"))
    return flagged.groupBy(generation).agg(F.sum("_new").cast("bigint").alias("cells_taken"),
                                           F.count(F.lit(1)).cast("bigint").alias("cells_tried"))


def merged_elites(df: DataFrame, cells: Sequence[str], generation: str, fitness: str, key: str, only_new: bool = True) -> DataFrame:
    """W10 — the grid after all generations: (cells, fitness, generation, key).  A later candidate takes a cell only if it is
    strictly better, so ties stay with the earliest generation, then the least key.  ``only_new`` leaves out
    elites whose key is among the originals (the first generation)."""
    best = grid_elites(df, cells, fitness, [], [generation, key])
    if not only_new:
        return best
    first = df.agg(F.min(generation).alias("_first"))
    originals = df.join(F.broadcast(first), F.col(generation) == F.col("_first")).select(F.col(key).alias("_original")).distinct()
    return best.join(originals, F.col(key) == F.col("_original"), "left_anti")


def top_k_per_group(df: DataFrame, group: Sequence[str], score: str, tiebreak: str, k: int,
                    keep: bool = True, out: str = "rank") -> DataFrame:
    """W11 — rank by score desc (tiebreak asc) inside each group; keep top-k
    (``keep``) or drop the top-k's complement (``keep=False`` drops the
    bottom ``k``)."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tiebreak))
    r = df.withColumn(out, F.row_number().over(w).cast("bigint"))
    if keep:
        return r.where(F.col(out) <= k)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return r.withColumn("_n", n).where(F.col(out) <= F.col("_n") - k).drop("_n")
