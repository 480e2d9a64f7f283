"""Brackets by nesting depth.

A text becomes one row per bracket, with the characters up to the next one.
Its depth is a running sum of +1 and -1, less the closing brackets that have
nothing to close; a closing bracket's partner is the row before it at its own
level.  Nothing recurses and no stack is kept, so nesting may be of any depth.
All windows are within one text, and all of them use one shuffle by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a nested expression of more characters is broken onto lines of its own.
LINE_LIMIT = 200


def bracket_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, open, rest, at, run, lone, level): a row per bracket of each text.

    ``at`` is its 1-based place, ``rest`` the text up to the next bracket, ``run`` the open brackets after it (closing ones
    without partner left out), ``lone`` marks those, ``level`` is the depth of the bracket itself, 1 for outermost ones.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[()][^()]*"), 0)
    rows = df.select(F.col(key), F.length(F.regexp_extract(text, r"^[^()]*", 0)).alias("_head"),
                     F.posexplode(pieces).alias("i", "_piece"))
    w = Window.partitionBy(key).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(key, "i", F.col("_piece").startswith("(").alias("open"), F.expr("substring(_piece, 2)").alias("rest"),
                       (F.col("_head") + F.sum(F.length("_piece")).over(upto) - F.length("_piece") + 1).alias("at"),
                       F.sum(F.when(F.col("_piece").startswith("("), 1).otherwise(-1)).over(upto).alias("_sum"))
    rows = rows.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(upto)))
    rows = rows.withColumn("lone", F.col("_low") < F.lag("_low", 1, 0).over(w)).withColumn("run", F.col("_sum") - F.col("_low"))
    return rows.select(key, "i", "open", "rest", "at", "run", "lone",
                       F.when(F.col("open"), F.col("run")).otherwise(F.col("run") + 1).alias("level"))


def spans(df: DataFrame, key: str, text: str, expression: str | None = None) -> DataFrame:
    """P21 — (key, start, end) of every balanced parenthetical span, 1-based and inclusive; with ``expression``, its text too.

    ``key`` identifies a row of ``df``.  Brackets without partner belong to no span.
    """
    pair = Window.partitionBy(key, "level").orderBy("i")
    rows = bracket_rows(df, key, text).filter(~F.col("lone")).drop("rest")
    s = rows.withColumn("start", F.lag("at").over(pair)).filter(~F.col("open")).select(
        key, F.col("start").cast("int").alias("start"), F.col("at").cast("int").alias("end"))
    if expression is None:
        return s
    return s.join(df.select(key, text), key).select(
        key, "start", "end", F.expr(f"substring(`{text}`, start, `end` - start + 1)").alias(expression))


def _tabs(n: Column) -> Column:
    return F.repeat(F.lit("\t"), n.cast("int"))


def layout(df: DataFrame, text: str, out: str = "layout", limit: int = LINE_LIMIT) -> DataFrame:
    """P20 — adds ``out``, the text as lines, and ``laid_out``, whether it could be.

    The input is minified (no line breaks or tabs).  The first line goes up to the second opening bracket; then each
    expression within the first one is a line, one tab deeper, with what stands before it; one of more than ``limit``
    characters is itself laid out there, and if something stands before its bracket that is its first line and an empty line
    its last.  An expression without others in it stays as it is.  Only a text that is one balanced expression from its first
    character to its last is laid out; others and nulls stay as they are.  Works on distinct texts.
    """
    keyed = df.withColumn("_h", F.sha2(text, 256))
    rows = bracket_rows(keyed.select("_h", text).dropDuplicates(["_h"]), "_h", text)
    w = Window.partitionBy("_h").orderBy("i")
    pair, inside = Window.partitionBy("_h", "level").orderBy("i"), Window.partitionBy("_h", "run").orderBy("i")
    so_far = (Window.unboundedPreceding, 0)

    before = F.when(~F.lag("open").over(w), F.length(F.ltrim(F.lag("rest").over(w)))).otherwise(0)
    rows = rows.withColumn("_before", before) \
               .withColumn("_long", F.lead("at").over(pair) - F.col("at") + 1) \
               .withColumn("_nests", F.lead("i").over(pair) > F.col("i") + 1)
    # a bracket's expression is broken onto lines; its lead stands on a line of its own
    rows = rows.withColumn("_broken", F.coalesce(F.col("open") & F.col("_nests") & (
        (F.col("level") == 1) | (F.col("_long") > limit)), F.lit(False)))
    rows = rows.withColumn("_led", F.coalesce(F.col("open") & F.col("_nests") & (F.col("_before") > 0)
                                              & (F.col("_before") + F.col("_long") > limit), F.lit(False)))
    rows = rows.withColumn("_led", F.when(F.col("open"), F.col("_led")).otherwise(F.coalesce(F.lag("_led").over(pair), F.lit(False))))
    step = F.when(F.col("_led"), F.when(F.col("open"), 1).otherwise(-1)).otherwise(0)
    rows = rows.withColumn("_in", F.col("run") + F.sum(step).over(w.rowsBetween(*so_far))) \
               .withColumn("_outer", F.last(F.when(F.col("open"), F.col("_broken")), True).over(inside.rowsBetween(*so_far))) \
               .withColumn("_next", F.lead("open").over(w)).withColumn("_next_led", F.lead("_led").over(w))

    rest, deep = F.col("rest"), F.col("_in")
    closed = F.when(~F.col("open") & F.col("_led"), F.concat(F.lit("\n"), _tabs(deep))).otherwise("")
    lead = (F.when(F.col("open"), F.concat(F.rtrim(rest), F.lit("\n"), _tabs(deep)))
            .when(F.col("_next_led"), F.concat(F.lit("\n"), _tabs(deep), F.trim(rest), F.lit("\n"), _tabs(deep + 1)))
            .otherwise(F.concat(F.lit("\n"), _tabs(deep), F.ltrim(rest))))
    tail = F.concat(F.lit("\n"), _tabs(deep - 1), F.ltrim(rest))
    laid = (F.when(~F.coalesce(F.col("_outer"), F.lit(False)) | F.col("_next").isNull(), rest)
            .otherwise(F.concat(closed, F.when(F.col("_next"), lead).otherwise(tail))))
    piece = F.concat(F.when(F.col("open"), "(").otherwise(")"), laid)
    texts = rows.select("_h", "i", "at", "run", "lone", F.length("rest").alias("_rest"), F.col("_next").isNull().alias("_ends"),
                        piece.alias("_piece")).groupBy("_h").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "_piece"))), lambda x: x["_piece"]), "").alias("_lines"),
        (~F.max("lone") & (F.min("at") == 1) & (F.sum(F.when(F.col("run") == 0, 1).otherwise(0)) == 1)
         & (F.max(F.when(F.col("_ends"), F.col("run") + F.col("_rest"))) == 0)).alias("_one"))
    found = keyed.join(texts, "_h", "left")
    one = F.coalesce(F.col("_one"), F.lit(False))
    return found.select(*[c for c in df.columns if c not in (out, "laid_out")],
                        F.when(one, F.col("_lines")).otherwise(F.col(text)).alias(out), one.alias("laid_out"))
