"""SimHash near-duplicates linked through BK-trees.

A fingerprint has 64 bits; a bit is 1 if more than half of the shingle hashes
(XXH64, seed 42, unsigned) set it.  Distinct fingerprints, not documents, are
linked.  Two fingerprints within ``radius`` bits agree on at least
``blocks - radius`` of ``blocks`` bit blocks, so every choice of that many
blocks is a key, and fingerprints that share a key form a shard with a BK-tree
of its own: children hang on edges labelled with the integer Hamming distance
to their parent, and a search follows only edges within the radius.  Where
more fingerprints share a key than ``tree_nodes``, they are dealt over several
trees, and every fingerprint of the key searches each of them, a bounded block
of queries at a time.

A shard returns a spanning star of what it linked, not the links themselves,
and the stars are joined into components by large-star/small-star rounds on
the cluster.  No pair list, tree or component goes through the driver.

Nulls and empty texts have no words and share fingerprint zero, which is
linked like any other.  Repeated rows and ids share a component.  A component
whose ids are all null has a null component_id.  Empty tables give empty
results.  Columns of the input named like the result's are replaced.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import P, written

SHINGLE = 3
RADIUS = 3
SEED = 42
TREE_NODES = 8192
_STEP = 1 << 20  # shingles hashed, or tree nodes visited, at a time


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    ones, n = np.zeros(64, np.int64), 0
    grams = iter(grams)
    while part := list(itertools.islice(grams, _STEP)):
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, itertools.repeat(SEED)), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def add_fingerprints(df: DataFrame, text_col: str = "text", k: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of every whole text as a signed long."""
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="int64")
    return df.withColumn(out, prints(F.col(text_col)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a signed number it would count those of its absolute value


class BKForest:
    """The BK-trees of several shards side by side, grown and searched level by level."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value
        order = np.argsort(shard, kind="stable")
        s = shard[order]
        first = np.r_[True, s[1:] != s[:-1]] if n else np.zeros(0, bool)
        self.root_shard, self.root = s[first], order[first]
        parent = np.full(n, -1)
        edge = np.zeros(n, np.int64)
        at = np.empty(n, np.int64)  # the node each unplaced value has come down to
        at[order] = self.root[np.cumsum(first) - 1] if n else order
        left = order[~first]
        while len(left):
            d = _distance(value[left], value[at[left]]).astype(np.int64)
            key = at[left] * 65 + d
            o = np.argsort(key, kind="stable")
            left, key, d = left[o], key[o], d[o]
            new = np.r_[True, key[1:] != key[:-1]]
            child = left[new]
            parent[child], edge[child] = at[child], d[new]
            at[left] = child[np.cumsum(new) - 1]
            left = left[~new]
        kids = np.flatnonzero(parent >= 0)
        self.kids = kids[np.lexsort((edge[kids], parent[kids]))]
        self.key = parent[self.kids] * 65 + edge[self.kids]

    def near(self, shard: np.ndarray, value: np.ndarray, radius: int):
        """Yields (query, node) arrays of all nodes of the query's shard within the radius."""
        where = np.searchsorted(self.root_shard, shard)
        q = np.flatnonzero((where < len(self.root_shard)) & (self.root_shard[np.minimum(where, len(self.root_shard) - 1)] == shard))
        node = self.root[where[q]]
        stack = [(q, node)]
        while stack:
            q, node = stack.pop()
            if len(q) > _STEP:
                stack += [(q[i:i + _STEP], node[i:i + _STEP]) for i in range(0, len(q), _STEP)]
                continue
            d = _distance(value[q], self.value[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            many = hi - lo
            total = int(many.sum())
            if total:
                start = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many)
                stack.append((np.repeat(q, many), self.kids[start + np.arange(total)]))


def _stars(shard: np.ndarray, value: np.ndarray, is_node: np.ndarray, is_query: np.ndarray, radius: int):
    """(value, least value linked to it within its shard), without the least ones themselves."""
    nodes, queries = np.flatnonzero(is_node), np.flatnonzero(is_query)
    forest = BKForest(shard[nodes], value[nodes])
    label = np.arange(len(value))

    def root(x):
        while True:
            up = label[x]
            if (up == label[up]).all():
                return up
            label[x] = label[up]
            x = np.asarray(up)

    for lo in range(0, len(queries), 4096):
        part = queries[lo:lo + 4096]
        for q, node in forest.near(shard[part], value[part], radius):
            a, b = part[q], nodes[node]
            while True:
                ra, rb = root(a), root(b)
                apart = ra != rb
                if not apart.any():
                    break
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
    top = root(np.arange(len(value)))
    moved = value[top] != value
    return value[moved], value[top[moved]]


def _shard_links(radius: int):
    def run(batches):
        held: list[pd.DataFrame] = []
        rows = 0

        def flush(frame):
            shard = pd.factorize(pd.MultiIndex.from_frame(frame[["key", "tree"]]))[0]
            a, b = _stars(shard, frame["fp"].to_numpy(), frame["node"].to_numpy(bool), frame["query"].to_numpy(bool), radius)
            return pd.DataFrame({"u": a, "v": b})

        for b in batches:  # sorted by (key, tree): a shard may go on in the next batch
            held.append(b)
            rows += len(b)
            if rows < 40_000:
                continue
            f = pd.concat(held, ignore_index=True)
            last = (f["key"] == f["key"].iloc[-1]) & (f["tree"] == f["tree"].iloc[-1])
            held, rows = [f[last]], int(last.sum())
            if not last.all():
                yield flush(f[~last])
        if rows:
            yield flush(pd.concat(held, ignore_index=True))
    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of blocks - radius of the bit blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(blocks)]
    return [sum(one[i] for i in c) for c in itertools.combinations(range(blocks), blocks - radius)]


def links(prints: DataFrame, n: int, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(u, v): stars that connect all distinct fingerprints (column fp) within the radius.

    With n fingerprints, keys are chosen long enough that random ones seldom share a key.
    """
    blocks = next(b for b in range(radius + 1, 65)
                  if (b - radius) * (64 // b) >= min(32, math.log2(max(n, 2)) - 4))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(blocks, radius)]
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for i, m in enumerate(signed)])).alias("k"))
    keyed = keyed.select("fp", F.xxhash64("k.m", "k.part").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    trees = F.ceil(F.col("c") / F.lit(tree_nodes)).cast("int")
    home = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("trees")).cast("int")
    dealt = (keyed.join(counts.withColumn("trees", trees), "key")
             .withColumn("home", home).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
             .select("key", "tree", "fp", (F.col("tree") == F.col("home")).alias("node"), F.lit(True).alias("query")))
    ready = dealt.repartition("key", "tree").sortWithinPartitions("key", "tree")
    return ready.mapInPandas(_shard_links(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex that has an edge and is not its component's least one.

    Alternates large-star and small-star until nothing moves; each round is a
    pre-aggregated minimum per vertex and a join, checkpointed.
    """
    def star(e, least):  # every neighbour of u points at the least of u and its neighbours
        m = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        j = e.join(m, "u")
        far = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if not least else (
            j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))))
        return far.filter("u <> v").distinct()

    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    was = state(e)
    while was[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = star(both, least=False)
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = star(down, least=True).checkpoint()
        now = state(e)
        if now == was:
            break
        was = now
    return e.select("u", F.col("v").alias("root"))


def _classes(d: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, component) for every fingerprint of d (fingerprint, __tx_id)."""
    prints = d.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(P + "id").alias("least")).checkpoint()
    comp = components(links(prints.select("fp"), prints.count(), radius))
    rooted = prints.join(comp, prints.fp == comp.u, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id", F.col("root").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    radius: int = RADIUS, keep: list[str] | None = None) -> DataFrame:
    """The rows (with the columns of ``keep``, else all) with fingerprint (signed long), component_id and
    component, the least fingerprint of the component."""
    cols = [c for c in (keep or df.columns) if c not in ("fingerprint", "component_id", "component")]
    d = written(add_fingerprints(df.select(*{*cols, id_col, text_col}), text_col, k).select(
        *cols, F.col(id_col).alias(P + "id"), "fingerprint"), "simhash")
    known = _classes(d, radius)
    return d.join(known, d.fingerprint == known.fp).select(*cols, "fingerprint", "component_id", "component")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row of each component: one with the least id; among texts that share it, the least by hash.

    Classes are found on ids, hashes and fingerprints; whole rows move once, to the choice.
    """
    key = {P + "none": F.col(id_col).isNull(), P + "name": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
           P + "a": F.xxhash64(F.col(text_col)), P + "b": F.xxhash64(F.lit(1), F.col(text_col))}
    slim = add_fingerprints(df.select(F.col(id_col).alias(P + "id"), F.col(text_col).alias(P + "text"),
                                      *[c.alias(n) for n, c in key.items()]), P + "text", k)
    d = written(slim.drop(P + "text"), "simhash")
    known = _classes(d, radius)
    mine = d.join(known, d.fingerprint == known.fp).filter(F.col(P + "id").eqNullSafe(F.col("component_id")))
    chosen = mine.groupBy("component").agg(F.min(F.struct(*key)).alias("one")).select("one.*")
    rows = df.select(F.struct(*df.columns).alias(P + "row"), *[c.alias(n) for n, c in key.items()])
    return rows.join(chosen, list(key), "left_semi").dropDuplicates(list(key)).select(P + "row.*")


def hex_fingerprint(col: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
