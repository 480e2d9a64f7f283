"""Exact duplicates, the frequent texts split off before the shuffle.

Rows become (row, id, SHA-256 of the text), written once.  A Misra-Gries
summary of the digests (Spark's frequent-items sketch, which is one: counters
that are decremented together when they run out) is kept for every input
partition and merged in two steps, so that no task takes more than a share of
the summaries.  It names at most ``COUNTERS`` digests, among them every one
with a share of 1 / ``SHARE`` of all rows.  Their exact counts and winners are
then computed in a second pass with partial aggregation (*verified*: what
misses the share goes back to the rest), and the verified winners, at most
``SHARE`` rows, are broadcast: rows of frequent texts get their result
where they are read, and never move.  The remaining digests, none with more
than 1 / ``SHARE`` of the rows, take an ordinary aggregate and join.

The sketch only decides which way a digest takes, so its error cannot change
a result.

Nulls are empty texts, and all empty texts are equal.  Of equal texts the row
with the largest id stays, null being the least of all; where rows share that
id, the one with the largest hash of its kept columns, and of wholly equal rows
just one.  Empty tables give empty results.  Columns of the input named like
the result's (keep_id, group_size, kept, text_sha256) are replaced; further
columns go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import P, text_of, written

#: A digest with this fraction of all rows, or more, is frequent.
SHARE = 512
#: Counters of a summary: one with m of them is wrong by at most 3.5 / m of the rows, and names all above twice that.
COUNTERS = 4096
#: Summaries of input partitions are merged in so many groups, then the groups' into one.
GROUPS = 256
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def frequent(rows: DataFrame, key: str, share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """(key): at most ``counters`` values of the column, all with a share of 1/share of the rows or more among them."""
    first = (rows.select(F.col(key).alias("k"), F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g"))
             .groupBy("g").agg(F.expr(f"approx_top_k_accumulate(k, {counters})").alias("s")))
    top = first.groupBy(F.lit("all").alias("one")).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s"))  # no row where there are none
    return top.select(F.explode(F.expr(f"approx_top_k_estimate(s, {2 * share})")).alias("x")).select(F.col("x.item").alias(key))


def _hashable(df: DataFrame, c: str):
    """The column, or its JSON text where it holds maps or variants, which have no hash."""
    kind = df.schema[c].dataType.simpleString()
    return F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c)


def _winners(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias(P + "n"), F.max(F.struct(P + "id", P + "tie", P + "row")).alias(P + "win"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                 share: int = SHARE) -> DataFrame:
    """Every row (with the columns of ``keep``, else all) with keep_id, group_size, kept and text_sha256."""
    cols = [c for c in (keep or df.columns) if c not in RESULT]
    ties = [_hashable(df, c) for c in cols if c != text_col]
    digest = P + "digest"
    rows = written(df.select(*cols, F.col(id_col).alias(P + "id"), F.xxhash64(*ties, F.lit(0)).alias(P + "tie"),
                             F.monotonically_increasing_id().alias(P + "row"),
                             F.sha2(text_of(text_col), 256).alias(digest)), "exactdedup")
    n = rows.count()
    slim = rows.select(P + "id", P + "tie", P + "row", digest)
    named = F.broadcast(frequent(slim, digest, share))  # at most 2 * share rows
    heavy = _winners(slim.join(named, digest), [digest]).filter(F.col(P + "n") * share >= n).checkpoint()
    marked = rows.join(F.broadcast(heavy), digest, "left")  # at most ``share`` rows
    rest = marked.filter(F.col(P + "win").isNull()).drop(P + "n", P + "win")
    light = rest.join(_winners(rest, [digest]), digest)
    both = marked.filter(F.col(P + "win").isNotNull()).unionByName(light)
    win = P + "win"
    return both.select(*cols, F.col(f"{win}.{P}id").alias("keep_id"), F.col(P + "n").alias("group_size"),
                       (F.col(P + "row") == F.col(f"{win}.{P}row")).alias("kept"), F.col(digest).alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of df."""
    all_cols = P + "all"
    found = exact_groups(df.select(F.struct(*df.columns).alias(all_cols), F.col(id_col).alias(P + "i"), F.col(text_col).alias(P + "t")),
                         P + "i", P + "t", keep=[all_cols, P + "i"])
    return found.filter("kept").select(f"{all_cols}.*")
