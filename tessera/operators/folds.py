"""Folds, splits and seeded draws.

A fold/split is a small per-group (or per-row) table joined back to the
data.  Group tables are ranked with ``rank_by_hash`` (no global window),
and the join back is left to AQE: broadcast when the measured group table
is small, sort-merge with skew splitting when one group is huge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex, hash_int, uniform
from tessera.operators.ordered import global_prefix_sum, ntile_fold, rank_by_hash


def _group_table(df: DataFrame, group: str, seed) -> DataFrame:
    g = df.select(group).distinct()
    return g.withColumn("_h", hash_hex(seed, F.coalesce(F.col(group).cast("string"), F.lit("\u0000"))))


def _join_back(df: DataFrame, table: DataFrame, group: str) -> DataFrame:
    t = table.withColumnRenamed(group, "_g")
    return df.join(t, df[group].eqNullSafe(t["_g"])).drop("_g")


def group_fold_table(df: DataFrame, group: str, n_folds: int, seed, out: str = "fold") -> DataFrame:
    """W2 — one row per distinct group with its fold: groups in seeded hash
    order split by ``np.array_split`` sizes (first ``G % n`` folds larger)."""
    ranked = rank_by_hash(_group_table(df, group, seed), "_h")
    return ranked.select(group, ntile_fold(F.col("rank"), F.col("total"), n_folds).alias(out))


def group_kfold(df: DataFrame, group: str, n_folds: int, seed, out: str = "fold") -> DataFrame:
    """W2 — shuffled group k-fold: every row gets the fold of its group."""
    return _join_back(df, group_fold_table(df, group, n_folds, seed, out), group)


def heldout_run_rotation(df: DataFrame, run: str, n_folds: int, n_runs: int,
                         fold: str = "fold", role: str = "role") -> DataFrame:
    """W3 — for fold f the test run is ``f mod R``; every other run trains.

    Rows are replicated once per fold (an explode over a parameter-sized
    sequence, not a join).
    """
    f = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias(fold)
    x = df.select("*", f)
    return x.withColumn(role, F.when(F.pmod(F.col(fold), F.lit(n_runs)) == F.col(run) - F.lit(1), "test")
                        .otherwise("train"))


def balanced_group_folds(df: DataFrame, group: str, n_folds: int, out: str = "fold") -> DataFrame:
    """W4 — unshuffled size-balanced group folds.

    Groups ordered by (size desc, group) are dealt in a serpentine
    (0..n-1, n-1..0, …), which keeps fold sizes within two of the largest
    groups of each other and is set-based (the greedy LPT assignment is
    sequential).
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).withColumn("_neg", -F.col("_size"))
    ranked = global_prefix_sum(sizes, ["_neg", group], out="_pos")
    r = F.col("_pos") - 1
    rnd = (r / n_folds).cast("bigint")
    pos = F.pmod(r, F.lit(n_folds))
    fold = F.when(F.pmod(rnd, F.lit(2)) == 0, pos).otherwise(F.lit(n_folds - 1) - pos).cast("bigint")
    table = ranked.select(group, fold.alias(out))
    return _join_back(df, table, group)


def row_folds(df: DataFrame, row_id: str, n_folds: int, seed, exact: bool = False,
              out: str = "fold") -> DataFrame:
    """W5 — shuffled row folds (group leakage on purpose).

    ``exact=False``: ``pmod(hash, n)`` — no shuffle at all, sizes binomial.
    ``exact=True``: exact ``array_split`` sizes via the hash-bucket rank.
    """
    if not exact:
        return df.withColumn(out, F.pmod(hash_int(seed, row_id), F.lit(n_folds)).cast("bigint"))
    d = df.withColumn("_h", hash_hex(seed, row_id))
    r = global_prefix_sum(d, ["_h", row_id], out="rank").withColumn("rank", F.col("rank") - 1).withColumn("total", F.lit(d.count()))
    return r.withColumn(out, ntile_fold(F.col("rank"), F.col("total"), n_folds)).drop("_h", "rank", "total")


def index_mod_folds(df: DataFrame, index: str, n_folds: int, out: str = "fold") -> DataFrame:
    """W6 — ``index % n``."""
    return df.withColumn(out, F.pmod(F.col(index), F.lit(n_folds)).cast("bigint"))


def group_holdout(df: DataFrame, group: str, test_frac: float, seed, out: str = "is_test") -> DataFrame:
    """W7 — hold out ``ceil(test_frac * G)`` groups (first in seeded order)."""
    ranked = rank_by_hash(_group_table(df, group, seed), "_h")
    table = ranked.select(group, (F.col("rank") < F.ceil(F.col("total") * F.lit(test_frac))).alias(out))
    return _join_back(df, table, group)


def sample_k(df: DataFrame, key: str, k: int, seed) -> DataFrame:
    """T2 — k rows without replacement, seeded (top-k by hash: each task
    keeps k candidates, the driver merges ≤ k × tasks)."""
    return df.withColumn("_h", hash_hex(seed, key)).orderBy("_h", key).limit(k).drop("_h")


def categorical_draw(options: Sequence[str] | Column, seed, *key_cols) -> Column:
    """T3 — uniform draw from a list per row."""
    arr = options if isinstance(options, Column) else F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.pmod(hash_int(seed, *key_cols), F.size(arr)) + 1).cast("int"))


def weighted_bucket(tasks: DataFrame, task_key: str, workers: DataFrame, worker: str,
                    weight: str, seed, scale: int = 1_000_000, buckets: int | None = None,
                    out: str = "worker") -> DataFrame:
    """T4 — assign each task to a worker with probability ∝ weight.

    Weights become integer micro-units so the cumulative intervals tile
    [0, total) exactly.  The task's draw ``r = floor(u·total)`` is matched
    to the worker with ``lo ≤ r < hi`` by a range join on a bucket grid:
    each worker interval is exploded over the ≤ few grid cells it touches,
    then an equi-join on the cell plus the range filter.  No broadcast of
    the worker table is needed, whatever its size.
    """
    w = workers.select(F.col(worker).alias("_w"),
                       F.round(F.col(weight) * scale).cast("bigint").alias("_wi")).where("_wi > 0")
    cum = global_prefix_sum(w, ["_w"], weight="_wi", out="_hi", exclusive="_lo")
    total, n = cum.agg(F.max("_hi"), F.count(F.lit(1))).first()  # two scalars
    buckets = buckets or max(1024, n)  # about a worker a cell, so a cell's tasks meet few workers
    cell = lambda v: (v.cast("decimal(38,0)") * buckets / F.lit(total)).cast("bigint")
    grid = cum.select("_w", "_lo", "_hi",
                      F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi") - 1))).alias("_cell"))
    r = (hash_int(seed, task_key).cast("decimal(38,0)") * F.lit(total) / F.lit(4294967296)).cast("bigint")
    t = tasks.withColumn("_r", r).withColumn("_cell", cell(F.col("_r")))
    j = t.join(grid, "_cell").where((F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
    return j.withColumnRenamed("_w", out).drop("_cell", "_r", "_lo", "_hi")


def fewshot_draws(requests: DataFrame, request_key: str, examples: DataFrame, example_key: str,
                  k: int, seed) -> DataFrame:
    """T6 — k distinct examples per request.

    Examples get positions in a seeded permutation; each request draws an
    offset and takes k consecutive positions (distinct, each example
    equally likely).  An equi-join on position — no request×example pairs.
    """
    n = examples.count()  # one scalar
    ex = rank_by_hash(examples.withColumn("_h", hash_hex(seed, example_key)), "_h", out="_pos",
                      total=None, tiebreak=[example_key]).drop("_h")
    if not n:  # nothing to draw from
        return requests.select(request_key, F.lit(0).alias("shot")).where(F.lit(False)).crossJoin(ex.drop("_pos").limit(0))
    shots = requests.select(request_key, F.explode(F.sequence(F.lit(0), F.lit(min(k, n) - 1))).alias("shot"))
    shots = shots.withColumn("_pos", F.pmod(hash_int(seed, request_key) + F.col("shot"), F.lit(n)))
    return shots.join(ex, "_pos").drop("_pos")

