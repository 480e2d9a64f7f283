"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u from a seeded hash of its id and gets the exponential
key -ln(u) / weight; documents of a source are taken in key order, so heavier
ones tend to come first.  A source's token budget is its target; as many
complete epochs as fit in it come first, the rest is the prefix of the key
order whose size comes nearest to what is left.

Rows that agree in source, id and text are one group with a count; each of
its occurrences 0, 1, .. draws by (seed, id, text hash, number), so reruns
agree however the input is split.  Sizes and weights are functions of source,
id and text; they are computed in one pass over the texts and written, without
the texts.  Decisions are made on that table; whole rows move once, when they
are joined to them.

Prefix sums are built from key cells: a cell is a narrow range of ln(key), as
narrow as the row count asks for, cell totals are summed before the shuffle,
and only the cells of one source (rows / cell size) are put in order together,
never its documents.  Groups of more than ``cell_rows`` rows are dealt out in
blocks before they are listed, and their rows are numbered by input part.

Nulls: a null source is a source of its own, ordered last; a null or
non-positive size is 0 (never taken); a null or non-positive weight is the
smallest one; a null text is the empty one.  Of rows that agree in source, id
and text, how many are taken is fixed, and which of them is not.
Empty tables give empty results.  Columns of the input named like the result's
(size, source_size, target, taken, times) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import P, WORD, text_of, written

SEED = 4201
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
MIN_WEIGHT = 0.05
CELL_ROWS = 2048


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def symbol_weight(text_col: str = "text") -> Column:
    """A cheap quality weight: 1 for plain prose, down to MIN_WEIGHT where symbols crowd the text."""
    t = text_of(text_col)
    n = F.length(t)
    share = (n - F.length(F.translate(t, "#$%&*|!", ""))) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(MIN_WEIGHT), 1.0 - 4.0 * share)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(source, source_size) with target: weights repeat along the sources in order, targets are
    level * weight, cut at cap * source_size, with the level at which they add up to share of all.

    Rank the sources by the level at which they are cut; the level is the one
    at which those cut so far and the rest's shares meet the total.  One row a
    source goes through this, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn(P + "w", w).withColumn(P + "cap", F.col("source_size") * cap)
    s = s.withColumn(P + "cut", F.col(P + "cap") / F.col(P + "w"))
    by_cut = Window.orderBy(P + "cut", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_cut.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cut.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn(P + "level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum(P + "cap").over(before), F.lit(0.0)))
                     / F.sum(P + "w").over(after))
    s = s.withColumn(P + "level", F.min(F.when(F.col(P + "level") <= F.col(P + "cut"), F.struct(P + "cut", P + "level"))).over(whole)[P + "level"])
    return s.select("source", "source_size",
                    F.coalesce(F.least(F.col(P + "level") * F.col(P + "w"), F.col(P + "cap")), F.col(P + "cap")).alias("target"))


def _occurrences(groups: DataFrame, block: int, out: str) -> DataFrame:
    """A row for each of the ``c`` rows of a group, numbered from 0; large groups are dealt out in blocks first."""
    count, at = F.col(P + "c"), P + "block"
    few = groups.filter(count <= block).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    many = (groups.filter(count > block)
            .withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / block).cast("long"))))
            .repartition(P + "mark", at)
            .withColumn(out, F.explode(F.sequence(F.col(at) * block, F.least(F.col(at) * block + block, count) - 1))).drop(at))
    return few.unionByName(many)


def _numbered_by_part(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Numbers the rows of each key from 0, a part of the table at a time: written first, so that parts hold still."""
    part = P + "part"
    fixed = written(rows.withColumn(part, F.spark_partition_id()), "mix_hot")
    before = (fixed.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(P + "n"))
              .withColumn(P + "before", F.sum(P + "n").over(Window.partitionBy(*keys).orderBy(part)) - F.col(P + "n")).drop(P + "n"))
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(keys[-1]))
    return (fixed.withColumn(out, own - 1).join(before, [*keys, part])
            .withColumn(out, F.col(out) + F.col(P + "before")).drop(P + "before", part))


def mix(df: DataFrame, size: Column, weight: Column, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", weights=WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = SEED,
        cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row with size, source_size, target, times (how often the mix takes it) and taken words."""
    made = ("size", "source_size", "target", "times", "taken")
    cols = [c for c in df.columns if c not in made]
    src, ident, mark, num, key, cell = (P + x for x in ("source", "ident", "mark", "num", "key", "cell"))
    same = [src, ident, mark]
    marks = [F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name")).alias(src),
             F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(ident), F.md5(text_of(text_col).cast("binary")).alias(mark)]
    groups = written(
        df.select(*marks, F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"),
                  F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(MIN_WEIGHT)).alias(P + "weight"))
        .groupBy(*same).agg(F.count(F.lit(1)).alias(P + "c"), F.max("size").alias("size"), F.max(P + "weight").alias(P + "weight")), "mix_groups")
    n, most = groups.agg(F.sum(P + "c"), F.max(P + "c")).first()
    fine = max(1.0, (n or 0) / cell_rows)
    totals = (groups.groupBy(src).agg(F.sum(F.col("size") * F.col(P + "c")).alias("source_size"))
              .select(F.when(~F.col(src)["none"], F.col(src)["name"]).alias("source"), "source_size"))
    targets = source_targets(totals, weights, share, cap).select(
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias(src),
        "source_size", "target")
    d = _occurrences(groups, cell_rows, num)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), ident, mark, num).cast("binary"))
    u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    d = d.withColumn(key, -F.log(u) / F.col(P + "weight"))
    d = d.withColumn(cell, F.floor(F.log(key) * F.lit(fine)))
    cells = (d.groupBy(src, cell).agg(F.sum("size").alias(P + "sum"))
             .withColumn(P + "base", F.sum(P + "sum").over(Window.partitionBy(src).orderBy(cell)) - F.col(P + "sum"))
             .join(targets, src).select(F.col(src).alias(P + "s"), F.col(cell).alias(P + "k"), P + "base", "source_size", "target"))
    run = Window.partitionBy(src, cell).orderBy(key, ident, "size", mark).rowsBetween(Window.unboundedPreceding, -1)
    d = (d.withColumn(P + "in", F.coalesce(F.sum("size").over(run), F.lit(0).cast("long")))
         .join(cells, (F.col(src) == F.col(P + "s")) & (F.col(cell) == F.col(P + "k"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - epochs * F.col("source_size")
    part = ((F.col(P + "base") + F.col(P + "in") + F.col("size") / 2.0) <= left).cast("int")
    d = d.withColumn("times", F.when(F.col("size") > 0, F.least(epochs + part, F.lit(int(cap)))).otherwise(F.lit(0)).cast("int"))
    # a group's occurrences are taken low or low + 1 times; so many of its rows one more
    plan = d.groupBy(*same).agg(F.max(P + "c").alias(P + "c"), F.max("size").alias("size"), F.max("source_size").alias("source_size"),
                                F.max("target").alias("target"), F.min("times").alias(P + "low"), F.sum("times").alias(P + "all"))
    plan = plan.withColumn(P + "more", F.col(P + "all") - F.col(P + "c") * F.col(P + "low"))
    keyed = df.select(*cols, *marks)
    times = F.col(P + "low") + (F.col(num) < F.col(P + "more")).cast("int")
    first = F.row_number().over(Window.partitionBy(*same).orderBy(mark)) - 1
    if (most or 0) <= cell_rows:
        rows = keyed.join(plan, same).withColumn(num, first)
    else:
        hot = groups.filter(F.col(P + "c") > cell_rows).select(*same)
        plan = written(plan, "mix_plan")
        rows = (keyed.join(plan.filter(F.col(P + "c") <= cell_rows), same).withColumn(num, first)
                .unionByName(_numbered_by_part(keyed.join(hot, same, "left_semi"), same, num).join(plan, same)))
    return (rows.withColumn("times", times.cast("int"))
            .select(*cols, "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with its epoch (the fractional one last)."""
    return mixed.filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
