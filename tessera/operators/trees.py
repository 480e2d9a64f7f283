"""Regression trees on histograms, grown for all folds in the same passes (M8, M25-M27, M31 and the training flow).

MLlib fits one training set at a time and keeps it as one object a row.  Here a
row is packed once, a byte a feature, and a pass reads the packed rows and
adds up one histogram for each open node of every fold's tree; histograms are
added by (model, feature), and only the best split of each reaches the driver.
Splits, gains, leaves, boosting and early stopping follow MLlib's, so that
trees on the same thresholds are the same trees; bootstrap draws and drawn
features of a forest follow its law, not its random numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.sinks import stored

#: Rows packed together, and sampled rows of which thresholds are found (MLlib: as many for each training set, in expectation).
BLOCK_ROWS, SAMPLED_ROWS = 131_072, 10_000
AT_ONCE = 16_384  # rows counted together, what a core's cache holds
DEEPEST = 8  # nodes are told apart by a byte


@dataclass
class Node:
    """An open node (``slot`` >= 0), a leaf, or a split."""
    slot: int = -1
    value: float = 0.0
    feature: int = -1
    code: int = 0
    gain: float = 0.0
    weight: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Kind:
    """What an MLlib estimator asks for."""
    boosted: bool
    trees: int
    depth: int
    bins: int
    step: float = 1.0
    tolerance: float = 0.0
    min_gain: float = 0.0
    min_rows: int = 1
    seed: int = 0
    bootstrap: bool = False
    picked: float = 1.0  # the share of the features a node may split on


def kind_of(est) -> Kind | None:
    """The estimator as one of the trees below, or None if it asks for anything else."""
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
    if type(est) not in (DecisionTreeRegressor, GBTRegressor, RandomForestRegressor):
        return None
    get = lambda p: est.getOrDefault(p)
    kind = Kind(False, 1, get("maxDepth"), get("maxBins"), min_gain=get("minInfoGain"), min_rows=get("minInstancesPerNode"), seed=get("seed"))
    plain = get("maxDepth") <= DEEPEST and get("minWeightFractionPerNode") == 0.0 and not (est.isDefined("leafCol") and get("leafCol"))
    if isinstance(est, DecisionTreeRegressor):
        return kind if plain and not (est.isDefined("varianceCol") and est.isSet("varianceCol")) else None
    plain = plain and get("subsamplingRate") == 1.0
    share = get("featureSubsetStrategy")
    if isinstance(est, GBTRegressor):
        kind.boosted, kind.trees, kind.step, kind.tolerance = True, get("maxIter"), get("stepSize"), get("validationTol")
        return kind if plain and share in ("all", "auto") and get("lossType") == "squared" else None
    kind.trees, kind.bootstrap = get("numTrees"), True
    kind.picked = 1.0 if share == "all" else 1.0 / 3.0
    return kind if plain and kind.trees > 1 and get("bootstrap") and share in ("all", "auto", "onethird") else None


class Trees:
    """A fitted model: its trees, what they weigh, and the importance of its features as MLlib has it."""

    def __init__(self, trees: Sequence[Node], weights: Sequence[float], features: Sequence[int], each: bool):
        self.trees, self.weights, self.features, self.each = list(trees), list(weights), list(features), each

    @property
    def featureImportances(self):  # noqa: N802 - MLlib's name
        from pyspark.ml.linalg import Vectors
        number = {f: i for i, f in enumerate(self.features)}
        total = np.zeros(len(number))
        for t in self.trees:
            own, nodes = np.zeros(len(number)), [t]
            while nodes:
                n = nodes.pop()
                if n.left is not None:
                    own[number[n.feature]] += n.gain * n.weight
                    nodes += [n.left, n.right]
            total += own / own.sum() if self.each and own.sum() > 0 else own
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's thresholds of one feature: all midpoints, or those nearest to equal weights between them."""
    found, at = np.unique(values, return_inverse=True)
    weight = np.bincount(at, weights)
    mids = (found[:-1] + found[1:]) / 2.0
    if len(mids) <= bins - 1:
        return mids
    stride = weight.sum() / bins
    target, upto, out = stride, np.cumsum(weight), []
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(mids[i - 1])
            target += stride
    return np.array(out)


@dataclass
class Packed:
    """Rows of a cross-validation, packed: ``table`` has a row a block.

    ``cuts[view][feature]`` are the thresholds by which a view's codes were made, ``own[model][feature]`` the places among them
    of those that the model of a fold may split on.  One view serves all folds, or each fold has its own.
    """
    table: DataFrame
    n_folds: int
    n_labels: int
    weighted: bool
    stops: bool
    cuts: list[list[np.ndarray]]
    own: list[list[np.ndarray]]
    size: int  # bytes of a code
    n_features: int = field(init=False)

    def __post_init__(self):
        self.n_features = len(self.cuts[0])


def numbers(batch, name: str) -> np.ndarray:
    """A column of an Arrow batch, NULL as NaN."""
    return batch.column(name).to_numpy(zero_copy_only=False)


def pack(x: DataFrame, inputs: Sequence[Column], names: Sequence[str], labels: Sequence[Column], fold: Column, n_folds: int, bins: int,
         n_rows: int, weight: Column | None = None, stop: Column | None = None, views=None, by: Sequence[str] | None = None) -> Packed:
    """The rows of ``x`` as blocks of codes, labels, weights and folds (-1: trained on in every fold, never tested).

    The features ``names`` are the columns ``inputs``; or, where they depend on the fold, what ``views(batch)`` makes of an
    Arrow batch of ``inputs``: for each fold, an array a feature.  ``by`` are the columns by whose hash a row is sampled for the thresholds.
    """
    names, n_views = list(names), 1 if views is None else n_folds
    views = views or (lambda batch: [[numbers(batch, n) for n in names]])
    y, extra = [f"_y{i}" for i in range(len(labels))], []
    if weight is not None:
        extra.append(weight.cast("double").alias("_w"))
    if stop is not None:
        extra.append(F.coalesce(stop, F.lit(False)).alias("_stop"))
    cols = [F.coalesce(fold.cast("int"), F.lit(-1)).alias("_fold"), *extra, *[c.cast("double").alias(n) for c, n in zip(labels, y)], *inputs]
    has_w, has_s, most = weight is not None, stop is not None, BLOCK_ROWS

    def values(batch):
        """Folds and, view by view, the features; a row's own fold does not train on it, so there they are 0."""
        of, out = batch.column("_fold").to_numpy(), []
        for v, arrays in enumerate(views(batch)):
            x = [np.asarray(a, dtype=float) for a in arrays]
            out.append([np.where(of == v, 0.0, a) for a in x] if n_views > 1 else x)
            if not all(np.isfinite(a).all() for a in out[-1]):
                raise ValueError("features must not be NULL, NaN or infinite")
        return of, out

    # a row is in the sample by its hash, so the thresholds do not depend on how the table is cut
    share = max(bins * bins, SAMPLED_ROWS) / max(n_rows * (n_folds - 1) / n_folds, 1.0)
    some = x if share >= 1.0 else x.where(F.pmod(F.xxhash64(F.lit(17), *(by or x.columns)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    batches = some.select(*cols).toArrow().combine_chunks().to_batches()
    sample = [values(b) for b in batches]
    of = np.concatenate([np.empty(0, int), *[f for f, _ in sample]])
    w = np.concatenate([np.empty(0), *[numbers(b, "_w") if has_w else np.ones(b.num_rows) for b in batches]])
    train = np.concatenate([np.empty(0, bool), *[~numbers(b, "_stop").astype(bool) if has_s else np.ones(b.num_rows, bool) for b in batches]])
    cuts, own = [], [[np.empty(0)] * len(names) for _ in range(n_folds)]
    for v in range(n_views):
        models = range(n_folds) if n_views == 1 else [v]
        each = [np.concatenate([np.empty(0), *[vs[v][i] for _, vs in sample]]) for i in range(len(names))]
        for f in models:
            used = (of != f) & train
            own[f] = [thresholds(a[used], w[used], bins) for a in each]
        cuts.append([np.unique(np.concatenate([own[f][i] for f in models])) for i in range(len(names))])
    for f in range(n_folds):
        own[f] = [np.searchsorted(c, o) for c, o in zip(cuts[f if n_views > 1 else 0], own[f])]
    size = 1 if max(len(c) for cs in cuts for c in cs) < 256 else 2
    code = np.uint8 if size == 1 else np.uint16

    def blocks(batches):
        import pyarrow as pa
        held, rows, made = [], 0, 0

        def out():
            group, codes, ys, ws = (np.concatenate([h[i] for h in held], axis=-1) for i in range(4))
            order = np.argsort(group, kind="stable")  # a fold's rows lie together
            return pa.RecordBatch.from_pydict({
                "id": pa.array([made], pa.int32()), "n": pa.array([len(order)], pa.int32()),
                "grp": pa.array([group[order].tobytes()], pa.binary()), "codes": pa.array([codes[:, order].tobytes()], pa.binary()),
                "y": pa.array([ys[:, order].tobytes()], pa.binary()), "w": pa.array([ws[order].tobytes() if has_w else b""], pa.binary())})

        for b in batches:
            if not b.num_rows:
                continue
            of, vs = values(b)
            group = of.astype(np.int16) * 2 + (numbers(b, "_stop").astype(np.int16) if has_s else 0)
            ys = np.stack([numbers(b, n) for n in y])
            ws = numbers(b, "_w") if has_w else np.zeros(b.num_rows)
            if not (np.isfinite(ys).all() and np.isfinite(ws).all() and (ws >= 0).all()):
                raise ValueError("labels must not be NULL, NaN or infinite, nor weights negative")
            held.append((group, np.stack([np.searchsorted(c, a).astype(code) for v, cs in zip(vs, cuts) for a, c in zip(v, cs)]), ys, ws))
            rows += b.num_rows
            if rows >= most:
                yield out()
                held, rows, made = [], 0, made + 1
        if rows:
            yield out()

    table = stored(x.select(*cols).mapInArrow(blocks, "id int, n int, grp binary, codes binary, y binary, w binary")
                   .withColumn("part", F.spark_partition_id()), "packed")
    return Packed(table, n_folds, len(labels), has_w, has_s, cuts, own, size)


def _place(node: Node, codes: np.ndarray, leaf):
    """The number, a byte, that ``leaf`` gives a row's last node, for all rows (columns of ``codes``)."""
    if node.left is None:
        return np.uint8(leaf(node))
    a, b = _place(node.left, codes, leaf), _place(node.right, codes, leaf)
    right = np.negative((codes[node.feature] > node.code).view(np.uint8))  # all bits of rows that go right
    right &= a ^ b
    right ^= a
    return right


def _add_value(tree: Node, weight: float, codes: np.ndarray, total: np.ndarray, spare: np.ndarray):
    """``total`` plus ``weight`` times what the tree says."""
    values: list[float] = []

    def number(n):
        values.append(weight * n.value)
        return len(values) - 1

    at = _place(tree, codes, number)
    if len(values) == 1:
        total += values[0]
    else:
        np.take(np.array(values), at, out=spare, mode="clip")
        total += spare


class _Growing:
    """One model on its way: the trees it has, the one it grows, and its open nodes."""

    def __init__(self, number: int, fold: int, label: int, kind: Kind, features: Sequence[int], tree: int = 0):
        self.number, self.fold, self.label, self.kind, self.features, self.tree = number, fold, label, kind, list(features), tree
        self.trees: list[Node] = []
        self.weights: list[float] = []
        self.done, self.best, self.kept, self.check = False, None, 1, False
        self.plant()

    def plant(self):
        self.root, self.level = Node(slot=0), 0
        self.open = [self.root]
        self.pick()

    def pick(self):
        """The features that each open node may split on."""
        n = len(self.features)
        k = int(np.ceil(n * self.kind.picked))
        if k == n:
            self.may = None
        else:
            rng = np.random.default_rng([self.kind.seed, self.number, self.level])
            self.may = [set(rng.choice(n, k, replace=False).tolist()) for _ in self.open]

    def grown(self):
        """The tree is whole: the next one, or the end."""
        self.trees.append(_pruned(self.root))
        self.weights.append(self.kind.step if self.kind.boosted and len(self.trees) > 1 else 1.0)
        self.root, self.open = None, []
        if not self.kind.boosted:
            self.done = True
        elif len(self.trees) < self.kind.trees:
            self.plant()

    def take(self, found: dict, totals: np.ndarray):
        """The best split of every open node, from ``found`` (feature -> (gain, place, weight and sum on the left) by node)."""
        weight, total, square = totals
        nodes, self.open = self.open, []
        for s, node in enumerate(nodes):
            n, mean = weight[s], total[s] / weight[s] if weight[s] > 0 else 0.0
            node.slot, node.value, node.weight = -1, mean, n
            impurity = (square[s] - total[s] * mean) / n if n > 0 else 0.0
            best = None
            for j in sorted(found):
                if self.may is None or j in self.may[s]:
                    if best is None or found[j][0][s] > best[0]:
                        best = (found[j][0][s], j, *(a[s] for a in found[j][1:]))
            if best is None or not best[0] > 0 or best[0] < self.kind.min_gain or self.level >= self.kind.depth \
                    or (self.level and abs(impurity) < np.finfo(float).eps):
                continue
            gain, j, code, w, t = best
            node.feature, node.code, node.gain = self.features[j], int(code), gain
            node.left, node.right = Node(value=t / w), Node(value=(total[s] - t) / (n - w))
            if self.level + 1 < self.kind.depth:
                self.open += [node.left, node.right]
        self.level += 1
        for s, n in enumerate(self.open):
            n.slot = s
        if self.open:
            self.pick()
        else:
            self.grown()

    def judge(self, error: float):
        """MLlib's early stop: the error on the rows kept aside, after each tree."""
        m, k = len(self.trees), self.kind
        if m == 1 or self.best is None:
            self.best = error
        elif self.best - error < k.tolerance * max(error, 0.01):
            self.done = True
        elif error < self.best:
            self.best, self.kept = error, m
        if m >= k.trees:
            self.done = True


def _pruned(node: Node) -> Node:
    """Two leaves that predict the same are one."""
    if node.left is not None:
        node.left, node.right = _pruned(node.left), _pruned(node.right)
        if node.left.left is None and node.right.left is None and node.left.value == node.right.value:
            return Node(value=node.left.value, weight=node.weight)
    return node


def _histograms(packed: Packed, jobs: list, kind: Kind):
    """Batches of blocks -> (model, feature, part, histogram) rows; feature -1 has the nodes' totals, -2 the error aside."""
    n_folds, shared = packed.n_folds, len(packed.cuts) == 1
    n_features, n_labels, weighted = packed.n_features, packed.n_labels, packed.weighted
    code_type, wide = (np.uint8, np.uint16)[packed.size - 1], [[len(c) + 1 for c in cs] for cs in packed.cuts]
    starts = [[np.concatenate([[0], o + 1]).astype(int) for o in own] for own in packed.own]
    from math import factorial
    poisson = np.cumsum([np.exp(-1.0) / factorial(i) for i in range(20)])
    trees_drawn = sorted({m.tree for m in jobs}) if kind.bootstrap else []

    def run(batches):
        import pyarrow as pa
        sums: dict = {}
        part = None

        def add(key, a):
            if key in sums:
                sums[key] += a
            else:
                sums[key] = a

        # written over and over: fresh arrays of this size cost more than what is done with them
        space = [np.empty(AT_ONCE) for _ in range(4)] + [np.empty(AT_ONCE, np.intp) for _ in range(2)]

        def one(m, aside, c, y, w):
            left, spare, rw, rr, base, where = (a[:len(y)] for a in space)
            r = y
            if kind.boosted and m.trees:
                left[:] = 0.0
                for t, step in zip(m.trees, m.weights):
                    _add_value(t, step, c, left, spare)
                r = np.subtract(y, left, out=left)
                if aside:
                    r *= r
                    add((m.number, -2), np.array([r.sum() if w is None else (r * w).sum(), float(len(y)) if w is None else w.sum()]))
                    return
                r *= 2.0
            k = len(m.open)
            node = _place(m.root, c, lambda x: x.slot if x.slot >= 0 else k)
            base[:] = node
            r = r if w is None else np.multiply(r, w, out=rw)
            np.multiply(r, r, out=rr)
            if w is not None:
                np.divide(rr, w, out=rr, where=w > 0)
            count = lambda at, size, a=None: np.bincount(at, a, minlength=size)
            add((m.number, -1), np.stack([count(base, k + 1, w).astype(float), count(base, k + 1, r), count(base, k + 1, rr)])[:, :k])
            view, own, last = 0 if shared else m.fold, starts[m.fold], 1
            for j in range(len(m.features)) if m.may is None else sorted(set().union(*m.may)):
                f = m.features[j]
                if len(own[f]) < 2:
                    continue
                width = wide[view][f]
                if width != last:
                    np.multiply(node, width, out=base, dtype=np.intp)
                    last = width
                np.add(base, c[f], out=where)
                size = (k + 1) * width
                add((m.number, j), np.stack([count(where, size, w), count(where, size, r)]).reshape(2, k + 1, width)[:, :k])

        for b in batches:
            for i in range(b.num_rows):
                n, at = b.column("n")[i].as_py(), b.column("part")[i].as_py()
                part = (at, b.column("id")[i].as_py()) if part is None else part
                raw = {c: np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("grp", np.int16), ("codes", code_type), ("y", float))}
                codes, ys = raw["codes"].reshape(-1, n_features, n), raw["y"].reshape(n_labels, n)
                ws = np.frombuffer(b.column("w")[i].as_buffer(), float) if weighted else None
                drawn = {}
                for t in trees_drawn:
                    rng = np.random.default_rng([kind.seed, t, at, b.column("id")[i].as_py()])
                    drawn[t] = np.searchsorted(poisson, rng.random(n), side="right").astype(float)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(raw["grp"])) + 1, [n]])
                for start, end in zip(edges[:-1], edges[1:]):
                    of, aside = int(raw["grp"][start]) >> 1, int(raw["grp"][start]) & 1
                    for lo in range(start, end, AT_ONCE):
                        hi = min(lo + AT_ONCE, end)
                        for m in jobs:
                            if m.fold != of and (m.check if aside else m.open):
                                w = drawn[m.tree] if kind.bootstrap else ws
                                one(m, aside, codes[0 if shared else m.fold][:, lo:hi], ys[m.label, lo:hi], None if w is None else w[lo:hi])
        if sums:
            by_number = {m.number: m for m in jobs}
            rows = []
            for (number, j), a in sums.items():
                if j >= 0:  # only the places where the model may split
                    m = by_number[number]
                    a = np.add.reduceat(a, starts[m.fold][m.features[j]], axis=2)
                rows.append((number, j, part[0], part[1], a.astype(float).tobytes()))
            for lo in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(
                    ("model", "feature", "part", "id", "sums"), zip(*rows[lo:lo + 500]),
                    (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))})
    return run


def _best_splits(kind: Kind, open_nodes: dict, totals_only=(-1, -2)):
    """Rows of one (model, feature), in the order of parts -> the best split of each node, or the totals."""

    def best(a: np.ndarray, k: int) -> np.ndarray:
        w, t = np.cumsum(a.reshape(2, k, -1), axis=2)
        n, s = w[:, -1:], t[:, -1:]
        w, t = w[:, :-1], t[:, :-1]
        ok = (w > 0) & (n - w > 0) & (w >= kind.min_rows) & (n - w >= kind.min_rows) if kind.min_rows > 1 else (w > 0) & (n - w > 0)
        safe_l, safe_r, safe_n = np.where(ok, w, 1.0), np.where(ok, n - w, 1.0), np.where(n > 0, n, 1.0)
        gain = np.where(ok, (t * t / safe_l + (s - t) * (s - t) / safe_r - s * s / safe_n) / safe_n, -np.inf)
        at, row = np.argmax(gain, axis=1), np.arange(k)
        return np.stack([gain[row, at], at.astype(float), w[row, at], t[row, at]])

    def run(batches):
        import pyarrow as pa
        key, held, out = None, None, []

        def done():
            a = held if key[1] in totals_only else best(held, open_nodes[key[0]])
            out.append((*key, a.tobytes()))

        for b in batches:
            for model, feature, sums in zip(b.column("model").to_pylist(), b.column("feature").to_pylist(), b.column("sums")):
                a = np.frombuffer(sums.as_buffer(), float)
                if (model, feature) == key:
                    held = held + a
                else:
                    if key:
                        done()
                    key, held = (model, feature), a
        if key:
            done()
        if out:
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(("model", "feature", "sums"), zip(*out),
                                                                                    (pa.int32(), pa.int32(), pa.binary()))})
    return run


def _one_pass(packed: Packed, jobs: list[_Growing], kind: Kind) -> dict:
    """(model, feature) -> its sums, from one reading of the packed rows."""
    rows = packed.table.mapInArrow(_histograms(packed, jobs, kind), "model int, feature int, part int, id int, sums binary")
    rows = rows.repartition("model", "feature").sortWithinPartitions("model", "feature", "part", "id")
    found = rows.select("model", "feature", "sums").mapInArrow(_best_splits(kind, {m.number: len(m.open) for m in jobs}),
                                                               "model int, feature int, sums binary").collect()
    return {(r.model, r.feature): np.frombuffer(r.sums, float) for r in found}


def grow(packed: Packed, kind: Kind, labels: Sequence[int] = (0,), features: Sequence[Sequence[int]] | None = None) -> dict[tuple[int, int], Trees]:
    """(label, fold) -> the model of each label trained on the other folds; ``features`` are those of each fold, all without it."""
    use = [list(range(packed.n_features))] * packed.n_folds if features is None else features
    many = 1 if kind.boosted else kind.trees
    keys = [(t, f, k) for t in labels for f in range(packed.n_folds) for k in range(many)]
    models = [_Growing(i, f, t, kind, use[f], k) for i, (t, f, k) in enumerate(keys)]
    stops = packed.stops and kind.boosted
    while jobs := [m for m in models if not m.done]:
        for m in jobs:  # the rows aside are asked once after each tree
            m.check = stops and len(m.trees) > 0 and (m.level == 0 or not m.open)
        found = _one_pass(packed, jobs, kind)
        for m in jobs:
            if m.check:
                if (m.number, -2) in found:
                    wrong, weight = found[m.number, -2]
                    m.judge(wrong / weight)
                elif len(m.trees) >= kind.trees:
                    m.kept, m.done = len(m.trees), True
                if m.done:
                    continue
            if m.open:
                if (m.number, -1) not in found:
                    raise ValueError(f"fold {m.fold} has no rows to train on")
                own = packed.own[m.fold]
                splits = {j: a.reshape(4, -1) for (number, j), a in found.items() if number == m.number and j >= 0}
                for j, a in splits.items():  # from places among the model's thresholds to codes
                    splits[j] = [a[0], own[m.features[j]][a[1].astype(int)], a[2], a[3]]
                m.take(splits, found[m.number, -1].reshape(3, -1))
            if not m.open and not stops and len(m.trees) >= (kind.trees if kind.boosted else 1):
                m.done = True
    out = {}
    for t in labels:
        for f in range(packed.n_folds):
            of = [m for m in models if m.label == t and m.fold == f]
            if kind.boosted:
                n = of[0].kept if stops and of[0].best is not None else len(of[0].trees)
                trees, weights = of[0].trees[:n], of[0].weights[:n]
            else:
                trees, weights = [m.trees[0] for m in of], [1.0 / many] * many
            cuts = packed.cuts[0 if len(packed.cuts) == 1 else f]
            out[t, f] = Trees([_uncoded(x, cuts) for x in trees], weights, use[f], not kind.boosted)
    return out


def _uncoded(node: Node, cuts: Sequence[np.ndarray]) -> Node:
    """The tree with the threshold of a split as its ``value``."""
    if node.left is None:
        return Node(value=node.value, weight=node.weight)
    return Node(value=float(cuts[node.feature][node.code]), feature=node.feature, gain=node.gain, weight=node.weight,
                left=_uncoded(node.left, cuts), right=_uncoded(node.right, cuts))


def _predicted(tree: Node, x: Sequence[np.ndarray]):
    if tree.left is None:
        return tree.value
    return np.where(x[tree.feature] <= tree.value, _predicted(tree.left, x), _predicted(tree.right, x))


def predictions(models: Sequence[Sequence[Trees]], features: Sequence[Column], fold: Column, out: Sequence[str]) -> Column:
    """A struct with a field for each of ``out``: what ``models[i][fold]`` predicts for a row of that fold; NULL in no fold."""
    n_folds, names = len(models[0]), list(out)

    def run(f: pd.Series, *values: pd.Series) -> pd.DataFrame:
        f, v = f.to_numpy(), [x.to_numpy() for x in values]
        result = np.full((len(models), len(f)), np.nan)
        for k in range(n_folds):
            rows = np.flatnonzero(f == k)
            if len(rows):
                mine = [x[rows] for x in v]
                for i, m in enumerate(models):
                    result[i, rows] = sum(w * _predicted(t, mine) for t, w in zip(m[k].trees, m[k].weights))
        return pd.DataFrame(dict(zip(names, result)))

    run = F.pandas_udf(run, ", ".join(f"`{n}` double" for n in names))
    return run(F.coalesce(fold.cast("int"), F.lit(-1)), *[c.cast("double") for c in features])
