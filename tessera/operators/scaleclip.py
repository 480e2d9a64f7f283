"""M17 — scale-and-clip calibration over the whole box of (coefficient, magnitude).

Predictions are clip(c p, -m, m); the loss is their RMSE plus ((c-1)² + (m-1)²) / 10.
Rows with |p| <= m / c are scaled and the others are m or -m, so with the
sums of the rows below r = m / c the loss at any (c, m) takes one row: that of the stretch of
r between two neighbouring |p|.  For one r the loss is convex in c, and its
least value is found by halving; within a stretch the loss is convex in (c, m), so
that least value has a single valley in r.

From r to r + d the loss falls by no more than c * d * (1 + penalty's slope).  So r is searched by bins, halved
again and again: a pass adds up the rows of each bin of r that is left, one row for each bin and fold, and
drops the bins in which no training set can fall from their ends below its best end.  The rows of the bins
that stay are then ordered, bin by bin, and every stretch between their |p| is searched inside.  Nothing is
ordered or held for each training set before that: a training set's sums are all folds' without its own.

A pass hands on ``BINS`` rows a fold at most, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENALTY = 10.0
BINS = 1 << 14
FEW = 1 << 16  # rows that one task orders
_SUMS = ("n", "pp", "pz", "z")
_ROWS = (*_SUMS, "yy")


def binned(rows: DataFrame, place, left: np.ndarray | None, more: int):
    """(bin, f, n, pp, pz, z, yy) of the ``rows`` (f, a, z) by ``place``, a row's bin, and fold: of all bins, or of those that bins of ``left`` give when cut into 2**more."""
    x = rows.withColumn("bin", place)
    if left is not None:
        kept = rows.sparkSession.createDataFrame([(int(b),) for b in left], "_b long")
        x = x.join(F.broadcast(kept), F.shiftright("bin", more) == F.col("_b"), "left_semi")
    a, z = F.col("a"), F.col("z")
    sums = x.groupBy("bin", "f").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(a * a).alias("pp"), F.sum(a * z).alias("pz"),
                                     F.sum(z).alias("z"), F.sum(z * z).alias("yy"))
    return sums.orderBy("bin", "f").toPandas()


def _loss(s, r, c):
    up_n, up_z = s["all_n"] - s["n"], s["all_z"] - s["z"]
    a, b = s["pp"] + r * r * up_n, s["pz"] + r * up_z
    mse = np.maximum(a * c * c - 2 * b * c + s["yy"], 0.0) / s["all_n"]
    root = np.sqrt(mse)
    slope = (a * c - b) / (s["all_n"] * np.maximum(root, 1e-300)) + 2 * ((c - 1) + r * (r * c - 1)) / PENALTY
    return root + ((c - 1) ** 2 + (r * c - 1) ** 2) / PENALTY, slope


def _at_ratio(s, r, box):
    """(least loss, its c) for m = r c inside the box."""
    (c_lo, c_hi), (m_lo, m_hi) = box
    lo, hi = np.maximum(c_lo, m_lo / r), np.minimum(c_hi, m_hi / r)
    hi = np.maximum(lo, hi)
    for _ in range(50):
        mid = (lo + hi) / 2
        up = _loss(s, r, mid)[1] < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    c = (lo + hi) / 2
    return _loss(s, r, c)[0], c


def _without(sums, at: np.ndarray, folds: int) -> dict:
    """Each training set's sums of the bins ``at``: name -> [bin, set]."""
    out = {}
    i, f = np.searchsorted(at, sums["bin"].to_numpy()), sums["f"].to_numpy().astype(int)
    for c in _ROWS:
        own = np.zeros((len(at), folds + 1))  # a fold outside the range is in every training set
        np.add.at(own, (i, np.where((f >= 0) & (f < folds), f, folds)), sums[c].to_numpy())
        out[c] = own.sum(1, keepdims=True) - own[:, :folds]
    return out


def _best(t, loss, c, r):
    import pandas as pd
    d = pd.DataFrame({"t": np.asarray(t, np.int64), "loss": loss, "c": c, "m": r * c})
    return d.loc[d.groupby("t")["loss"].idxmin()]


def _inside(s: dict, lo: np.ndarray, hi: np.ndarray, best: np.ndarray, t: np.ndarray, box):
    """The least loss of each set t inside the stretches lo..hi that could hold less than its ``best``."""
    gold = (5 ** 0.5 - 1) / 2
    low = np.minimum(_at_ratio(s, lo, box)[0], _at_ratio(s, hi, box)[0])
    go = (low - _steep(box) * (hi - lo) <= best) & (hi > lo)
    if not go.any():
        return None
    lo, hi, s = lo[go], hi[go], {k: v[go] for k, v in s.items()}
    for _ in range(40):
        x1, x2 = hi - gold * (hi - lo), lo + gold * (hi - lo)
        left = _at_ratio(s, x1, box)[0] <= _at_ratio(s, x2, box)[0]
        lo, hi = np.where(left, lo, x1), np.where(left, x2, hi)
    r = (lo + hi) / 2
    return _best(t[go], *_at_ratio(s, r, box), r)


def _steep(box) -> float:
    return box[0][1] * (1 + 2 * (1 + box[1][1]) / PENALTY)


def scale_clip_box(df: DataFrame, pred: str, y: str, fold: str, n_folds: int, coef=(0.9, 1.2), mag=(0.5, 1.0)) -> DataFrame:
    """(fold, coef, mag, train_loss, test_rmse): the best point of the box on each fold's training rows, scored on its test rows.

    Training set t has the rows of all folds but t.  NULL and NaN rows are left out of training, as are rows without a fold.
    """
    import pandas as pd
    from tessera.sources.sinks import stored
    spark, box = df.sparkSession, (coef, mag)
    least, most = mag[0] / coef[1], mag[1] / coef[0]
    kept = stored(df.select(fold, pred, y), "clip_rows")  # read once for each pass
    p, t = F.col(pred).cast("double"), F.col(y).cast("double")
    rows = kept.where(p.isNotNull() & t.isNotNull() & ~F.isnan(p) & ~F.isnan(t) & F.col(fold).isNotNull()).select(
        F.col(fold).cast("long").alias("f"), F.abs(p).alias("a"), F.when(p < 0, -t).otherwise(t).alias("z"))
    share = (F.col("a") - least) / (most - least)

    def place(bits):
        return F.when(share < 0, -1).when(share >= 1, 1 << bits).otherwise(F.floor(share * float(1 << bits))).cast("long")

    def edge(b, bits):
        return least + (most - least) * b / (1 << bits)

    bits = BINS.bit_length() - 1
    inside = np.arange(1 << bits)
    sums = _without(binned(rows, place(bits), None, 0), np.arange(-1, (1 << bits) + 1), n_folds)
    every = {"all_n": sums["n"].sum(0), "all_z": sums["z"].sum(0), "yy": sums["yy"].sum(0)}
    sets = np.flatnonzero(every["all_n"] > 0)
    base = {c: np.cumsum(sums[c], 0)[:-2] for c in _SUMS}  # before each bin
    own = {c: sums[c][1:-1] for c in _SUMS}
    best = np.full(n_folds, np.inf)
    found = [pd.DataFrame({"t": [0], "loss": [0.0], "c": [0.0], "m": [0.0]})[:0]]
    while len(sets):
        lo, hi = edge(inside, bits), edge(inside + 1, bits)
        stay = np.zeros(len(inside), bool)
        for i in sets:
            ends = []
            for r, more in ((lo, 0.0), (hi, 1.0)):
                s = {c: base[c][:, i] + more * own[c][:, i] for c in _SUMS} | {c: np.full(len(r), v[i]) for c, v in every.items()}
                loss, c = _at_ratio(s, r, box)
                ends.append(loss)
                found.append(_best(np.full(len(r), i), loss, c, r))
            low = np.minimum(*ends)
            best[i] = min(best[i], low.min())
            stay |= low - _steep(box) * (hi - lo) <= best[i]
        count = len(inside)
        inside, base, own = inside[stay], {c: v[stay] for c, v in base.items()}, {c: v[stay] for c, v in own.items()}
        held = own["n"].max(1)
        more = min((BINS // max(len(inside), 1)).bit_length() - 1, 40 - bits)
        if held.sum() <= 16 * FEW or more < 1 or (len(inside) > 0.9 * count and held.max() <= FEW):
            break
        parts = ((inside[:, None] << more) + np.arange(1 << more)).ravel()
        cells = binned(rows, place(bits + more), inside, more)
        sums = _without(cells, parts, n_folds)
        shape = (len(inside), 1 << more, n_folds)
        base = {c: (base[c][:, None] + np.cumsum(sums[c].reshape(shape), 1) - sums[c].reshape(shape)).reshape(-1, n_folds) for c in _SUMS}
        own = {c: sums[c] for c in _SUMS}
        inside, bits = parts, bits + more
    ends = pd.concat(found).sort_values(["loss", "c", "m"]).drop_duplicates("t")  # a row for each set
    schema = "t long, loss double, c double, m double"
    winners = [tuple(r) for r in ends[["t", "loss", "c", "m"]].itertuples(index=False)]
    first = spark.createDataFrame([(int(a), *map(float, b)) for a, *b in winners], schema)
    best_point = first
    if len(sets):
        group = np.cumsum(held) // FEW if len(held) else held
        edges = spark.createDataFrame([(int(b), int(g)) for b, g in zip(inside, group)], "bin long, g long")
        near = rows.withColumn("bin", place(bits)).join(F.broadcast(edges), "bin").groupBy("bin", "g", "f", "a").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("z").alias("z"))
        # a start for each bin, also of those without a row
        near = near.unionByName(edges.select(
            "bin", F.lit(-1).cast("long").alias("f"), F.lit(-1.0).alias("a"), F.lit(0.0).alias("n"), F.lit(0.0).alias("z"), "g"))

        def search(pdf):
            pdf = pdf.sort_values(["bin", "a"], kind="stable")
            b, f, a = pdf["bin"].to_numpy(), pdf["f"].to_numpy(), pdf["a"].to_numpy()
            at = np.searchsorted(inside, b)
            start = a < 0
            n, z = pdf["n"].to_numpy(), pdf["z"].to_numpy()
            a = np.where(start, edge(b, bits), a)
            value = {"n": n, "pp": a * a * n, "pz": a * z, "z": z}
            lo = np.clip(a, edge(b, bits), edge(b + 1, bits))
            hi = np.r_[lo[1:], 0.0]
            hi = np.where(np.r_[b[1:] != b[:-1], True], edge(b + 1, bits), hi)
            which = np.maximum.accumulate(np.where(start, np.arange(len(b)), 0))  # the bin's first row
            out = []
            for i in sets:
                s = {}
                for c in _SUMS:
                    run = np.cumsum(np.where(f == i, 0.0, value[c]))
                    s[c] = base[c][at, i] + run - run[which]
                s |= {c: np.full(len(b), v[i]) for c, v in every.items()}
                t = np.full(len(b), i)
                out += [_best(t, *_at_ratio(s, r, box), r) for r in (lo, hi)]
                out.append(_inside(s, lo, hi, np.full(len(b), best[i]), t, box))
            return pd.concat([x for x in out if x is not None])

        best_point = first.unionByName(near.groupBy("g").applyInPandas(search, schema))
    best_point = best_point.groupBy("t").agg(F.min_by(F.struct("loss", "c", "m"), F.struct("loss", "c", "m")).alias("x")).select("t", "x.*")
    q = F.greatest(-F.col("m"), F.least(F.col("m"), F.col("c") * F.col(pred)))
    test = kept.join(F.broadcast(best_point), F.col(fold) == F.col("t")).groupBy("t", "c", "m", "loss").agg(
        F.sqrt(F.avg((F.col(y) - q) ** 2)).alias("test_rmse"))
    return test.select(F.col("t").alias(fold), F.col("c").alias("coef"), F.col("m").alias("mag"), F.col("loss").alias("train_loss"), "test_rmse")
