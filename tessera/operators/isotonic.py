"""Isotonic recalibration as jobs of the cluster.

*Fit.*  Rows are added up to one cell per fold and distinct x and cut into ranges of x;
each range's task pools the adjacent violators (weighted means) of every training
set in one pass, so that a row is shuffled once for all sets.  The blocks that are
left are numbered in order of x and cut into stretches of consecutive numbers, pooled
in their own tasks.  Pooling in any order leads to the one solution, so what remains are
violations between the last block of a stretch and the first of the next:
the next round cuts half a stretch further along, and from stretches twice as
long, until no edge violates.  Blocks stay a table from start to end; a round
brings back one number, the count of violating edges.  A few rounds are usual; where a
last low value pulls everything before it down, each round past the longest
stretch (``MOST_STRETCH`` cells) moves half of one further.

*Predict.*  Up to ``FEW_KNOTS`` knots (a block's two ends, or its centroid) are handed to
all tasks, which look their rows up in place.  More knots and the distinct points
asked for are put in one order over range partitions; a running last and
first knot fills each point, and the knots next to a partition's edges are
handed over through a table of one row per partition and series.

``n`` monotone rows make ``n`` blocks and knots, and nothing of that size
passes through the driver, one task or one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import global_prefix_sum

#: Cells that one task pools at a time: the least, and the most (a few hundred MB).
LEAST_STRETCH, MOST_STRETCH = 1 << 18, 1 << 21
#: Knots that are handed to every task (24 bytes each); more stay a table.
FEW_KNOTS = 1 << 18
#: Values this close are one block: sums taken in another order may differ in their last digits.
SAME = 1e-11
_BLOCK = "t long, lo double, hi double, w double, wy double, wx double"


def _fold_cells(df: DataFrame, x: str, y: str, fold: str | None, weight: str | None) -> DataFrame:
    """(f, x, w, wy): a cell for each fold (0 without ``fold``) and distinct x.  Rows with a NULL or NaN x or y are left out."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    d = df.where(~F.isnan(F.coalesce(xs, F.lit(float("nan")))) & ~F.isnan(F.coalesce(ys, F.lit(float("nan")))) & (w > 0))
    f = F.lit(0).cast("long") if fold is None else F.col(fold).cast("long")
    return d.groupBy(f.alias("f"), (xs + F.lit(0.0)).alias("x")).agg(F.sum(w).alias("w"), F.sum(w * ys).alias("wy"))


def training_cells(df: DataFrame, x: str, y: str, fold: str | None = None, n_folds: int = 1,
                   weight: str | None = None) -> DataFrame:
    """(t, lo, hi, w, wy, wx): a cell for each distinct x of training set t, which has the rows of all folds but t.

    Without ``fold`` there is one set, 0, with all rows.  Rows with a NULL or NaN x or y are left out.
    """
    cells = _fold_cells(df, x, y, fold, weight)
    if fold is None:
        cells = cells.withColumnRenamed("f", "t")
    else:
        sets = F.array(*[F.lit(t).cast("long") for t in range(n_folds)])
        cells = (cells.withColumn("t", F.explode(sets)).where("t <> f")
                 .groupBy("t", "x").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")))
    return cells.select("t", F.col("x").alias("lo"), F.col("x").alias("hi"), "w", "wy", (F.col("w") * F.col("x")).alias("wx"))


def training_blocks(df: DataFrame, x: str, y: str, fold: str, n_folds: int, weight: str | None = None) -> DataFrame:
    """``training_cells`` whose adjacent violators are pooled within ranges of x, one pass over a range for all training sets."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stacks, held = [[] for _ in range(n_folds)], None
        for pdf in frames:
            part = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            whole = part["x"].to_numpy() < part["x"].iloc[-1]  # the last x may go on in the next frame
            held = part[~whole]
            _push(stacks, part[whole])
        if held is not None:
            _push(stacks, held)
        for t, stack in enumerate(stacks):
            for at in range(0, len(stack), 1 << 16):
                out = pd.DataFrame(stack[at:at + (1 << 16)], columns=["lo", "hi", "w", "wy", "wx"])
                out.insert(0, "t", t)
                yield out

    ranges = _fold_cells(df, x, y, fold, weight).repartitionByRange(width, "x").sortWithinPartitions("x")
    return ranges.mapInPandas(pooled, _BLOCK)


def _push(stacks: list[list], cells: pd.DataFrame) -> None:
    """Adds cells that come in order of x to the stack of blocks of every training set, pooling violators."""
    f, xs, ws, wys = (cells[c].to_numpy() for c in ("f", "x", "w", "wy"))
    known = ~pd.isna(f)
    for t, stack in enumerate(stacks):
        mine = known & (f != t)
        x = xs[mine]
        if not len(x):
            continue
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        x, w, wy = x[first], np.add.reduceat(ws[mine], first), np.add.reduceat(wys[mine], first)
        for lo, cw, cwy, cwx in zip(x.tolist(), w.tolist(), wy.tolist(), (w * x).tolist()):
            hi, level = lo, cwy / cw - SAME
            while stack and stack[-1][3] / stack[-1][2] >= level:
                lo, _, tw, twy, twx = stack.pop()
                cw, cwy, cwx = cw + tw, cwy + twy, cwx + twx
                level = cwy / cw - SAME
            stack.append((lo, hi, cw, cwy, cwx))


def _pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools adjacent violators within each (part, t) of rows that come in order."""
    names = ["part", "t", "lo", "hi", "w", "wy", "wx"]
    done, stack, key = [], [], None
    for pdf in frames:
        for part, t, lo, hi, w, wy, wx in zip(*(pdf[c].tolist() for c in names)):
            if (part, t) != key:
                done += stack
                stack, key = [], (part, t)
            while stack and stack[-1][5] / stack[-1][4] >= wy / w - SAME:
                top = stack.pop()
                lo, w, wy, wx = top[2], w + top[4], wy + top[5], wx + top[6]
            stack.append((part, t, lo, hi, w, wy, wx))
        if done:
            yield pd.DataFrame(done, columns=names)
            done = []
    if stack:
        yield pd.DataFrame(stack, columns=names)


def pooled_blocks(cells: DataFrame, least: int = LEAST_STRETCH, most: int = MOST_STRETCH) -> DataFrame:
    """The blocks of the isotonic fit of every series t, with strictly increasing values wy / w."""
    width = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, size, turn = cells, 0, 0
    while True:
        placed = global_prefix_sum(blocks, ["t", "lo"], out="at")
        n = placed.count()
        size = min(max(2 * size, least, -(-n // width)), most)
        part = F.floor((F.col("at") - 1 + (size // 2) * (turn % 2)) / F.lit(size))
        pooled = (placed.withColumn("part", part.cast("long")).repartition(max(width, -(-n // most)), "part")
                  .sortWithinPartitions("part", "t", "lo")
                  .select("part", "t", "lo", "hi", "w", "wy", "wx")
                  .mapInPandas(_pool, "part long, " + _BLOCK).checkpoint())
        value = F.col("wy") / F.col("w")
        edge = pooled.groupBy("t", "part").agg(F.min_by(value, "lo").alias("first"), F.max_by(value, "lo").alias("last"))
        before = F.lag("last").over(Window.partitionBy("t").orderBy("part"))  # a row for each stretch
        open_edges = edge.select((before >= F.col("first") - SAME).alias("bad")).where("bad").count()
        blocks, turn = pooled.drop("part"), turn + 1
        if not open_edges:
            return blocks


def knots(blocks: DataFrame, centred: Column) -> DataFrame:
    """(t, kx, ky): where ``centred``, a block's weighted centroid; else its two ends."""
    ends = F.when(centred, F.array(F.col("wx") / F.col("w"))).when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    return blocks.select("t", F.explode(ends).alias("kx"), (F.col("wy") / F.col("w")).alias("ky"))


def interpolate(points: DataFrame, knot_table: DataFrame) -> DataFrame:
    """points (t, x, distinct) with ``value``, linear between the knots around x, and ``inside``; the end knots' value beyond them.

    NULL where the series has no knot.
    """
    p = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("struct<kx:double,ky:double>")
    both = points.select("t", "x", none.alias("k")).unionByName(
        knot_table.select("t", F.col("kx").alias("x"), F.struct("kx", "ky").alias("k")))
    both = both.repartitionByRange(p, "t", "x").withColumn("pid", F.spark_partition_id()).checkpoint()
    local = Window.partitionBy("pid", "t").orderBy("x", F.col("k").isNull())
    filled = (both.withColumn("a", F.last("k", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("b", F.first("k", ignorenulls=True).over(local.rowsBetween(0, Window.unboundedFollowing))))
    across = Window.partitionBy("t").orderBy("pid")  # a row for each partition
    carry = both.groupBy("t", "pid").agg(F.max("k").alias("hi"), F.min("k").alias("lo")).select(
        "t", "pid", F.last("hi", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("from_left"),
        F.first("lo", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("from_right"))
    a, b = F.coalesce("a", "from_left"), F.coalesce("b", "from_right")
    at = filled.where(F.col("k").isNull()).join(F.broadcast(carry), ["t", "pid"]).select("t", "x", a.alias("a"), b.alias("b"))
    x, ax, ay, bx, by = (F.col(c) for c in ("x", "a.kx", "a.ky", "b.kx", "b.ky"))
    line = ay + (by - ay) * ((x - ax) / (bx - ax))
    value = F.when(F.col("a").isNull(), by).when(F.col("b").isNull() | (ax == x), ay).otherwise(line)
    return at.select("t", "x", value.alias("value"), ((ax == x) | (F.col("a").isNotNull() & F.col("b").isNotNull())).alias("inside"))


def interpolated(spark: SparkSession, knot_table: DataFrame) -> Callable[[str, str], Column]:
    """(t, x) -> struct<value, inside> as ``interpolate`` has them, for a knot table small enough for every task."""
    found = knot_table.orderBy("t", "kx").toPandas()
    series = spark.sparkContext.broadcast({int(t): (k["kx"].to_numpy(), k["ky"].to_numpy()) for t, k in found.groupby("t")})

    @F.pandas_udf("value double, inside boolean")
    def look_up(t: pd.Series, x: pd.Series) -> pd.DataFrame:
        value, inside = np.full(len(x), np.nan), np.zeros(len(x), dtype=bool)
        ts, xs = t.to_numpy(dtype=float, na_value=np.nan), x.to_numpy(dtype=float, na_value=np.nan)
        for s, (kx, ky) in series.value.items():
            rows = np.flatnonzero((ts == s) & ~np.isnan(xs))
            p = xs[rows]
            b = np.searchsorted(kx, p, "right")
            left, right = np.maximum(b - 1, 0), np.minimum(b, len(kx) - 1)
            ax, ay, bx, by = kx[left], ky[left], kx[right], ky[right]
            with np.errstate(divide="ignore", invalid="ignore"):
                line = ay + (by - ay) * ((p - ax) / (bx - ax))
            hit = (b > 0) & (ax == p)
            value[rows] = np.where(b == 0, by, np.where((b == len(kx)) | hit, ay, line))
            inside[rows] = hit | ((b > 0) & (b < len(kx)))
        return pd.DataFrame({"value": pd.Series(value).astype(object).where(~np.isnan(value), None), "inside": inside})

    return lambda t, x: look_up(F.col(t), F.col(x))


def isotonic_cv(df: DataFrame, pred: str, label: str, fold: str, n_folds: int, row_id: str, out: str = "iso",
                centred: bool | None = None, weight: str | None = None, few_knots: int = FEW_KNOTS) -> DataFrame:
    """M12 / M13 — isotonic recalibration by grouped CV: (row_id, fold, raw_clipped, out, centred).

    The raw prediction is clipped to [-1, 1]; fold f is predicted by the fit on the other folds.  ``centred`` None
    follows the training targets: centred where their least and greatest are -1 and 1.  A plain fit is constant
    beyond its first and last x; a centred one has no value there, and such rows, like rows without
    a raw prediction, keep the raw one.
    """
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(pred).cast("double"))) + F.lit(0.0)
    d = df.select(row_id, F.col(fold).cast("long").alias("t"), F.col(label).cast("double").alias("y"),
                  F.when(F.col(pred).isNotNull() & ~F.isnan(F.col(pred).cast("double")), clipped).alias("x"),
                  *([F.col(weight)] if weight else [])).checkpoint()
    blocks = pooled_blocks(training_blocks(d, "x", "y", "t", n_folds, weight).checkpoint())
    if centred is None:
        span = d.where(F.col("x").isNotNull() & ~F.isnan("y")).groupBy("t").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
        spans = {r["t"]: (r["lo"], r["hi"]) for r in span.collect()}  # a row for each fold
        others = {t: [s for f, s in spans.items() if f != t] for t in range(n_folds)}
        which = [t for t, s in others.items() if s and min(a for a, _ in s) == -1 and max(b for _, b in s) == 1]
    else:
        which = list(range(n_folds)) if centred else []
    middle = F.col("t").isin(which) if which else F.lit(False)
    lines = knots(blocks, middle)
    if lines.count() <= few_knots:
        made = d.withColumn("_k", interpolated(df.sparkSession, lines)("t", "x"))
        made = made.withColumn("value", F.col("_k.value")).withColumn("inside", F.col("_k.inside"))
    else:
        made = d.join(interpolate(d.select("t", "x").where("x is not null").distinct(), lines), ["t", "x"], "left")
    value = F.when(~middle | F.col("inside"), F.col("value"))
    return made.select(
        row_id, F.col("t").alias(fold), F.col("x").alias("raw_clipped"), F.coalesce(value, F.col("x")).alias(out), middle.alias("centred"))


def isotonic_fit(df: DataFrame, x: str, y: str, centred: bool = False, weight: str | None = None) -> DataFrame:
    """(t = 0, kx, ky): the knots of one fit of all rows."""
    return knots(pooled_blocks(training_cells(df, x, y, weight=weight)), F.lit(centred))
