"""Benchmark decontamination by winnowing.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z.
Both sides keep the minimum k-gram hash of every sliding window of
``WINDOW - K + 1`` k-grams, so any ``WINDOW`` consecutive words that a document
shares with an item contain a fingerprint that both have kept.  Kept
fingerprints are semi-joined with the benchmark's distinct ones, each carrying
the hashes of the words that a window around it can reach; hits are extended by
hashing every window that contains them and joining those with the windows of
the items.  An item shorter than a window is one window of its own length,
which winnowing cannot promise to meet: documents offer all their word runs of
just those lengths.

Nothing but short rows is shuffled: texts stay in their scan, and results go
back to the rows by the hash of the whole text, so copies are worked out once.
The distinct benchmark fingerprints are broadcast only up to
``BROADCAST_ROWS`` of them (8 bytes each, counted first); above, the
same join shuffles.

Nulls have no words; empty texts neither: no hits, n_words 0.  Repeated rows
get equal results; an item listed twice counts once; items with a null id count
as one with the empty id; items without words are never met.  Empty tables:
empty results, or documents without hits.  Further columns go along; columns
of the input named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import P, bind, lower_ascii, text_of

WINDOW = 13
K = 5
BROADCAST_ROWS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def word_hashes(text_col: str) -> Column:
    words = F.split(lower_ascii(text_of(text_col)), NOT_WORD, -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _upto(n: Column) -> Column:
    """0 .. n-1, none where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _wider(a: Column, steps: list[int]) -> Column:
    """least(a[i], a[i + step], ...) for all i that have them."""
    return bind(a, lambda x: F.transform(_upto(F.size(x) - steps[-1]), lambda i: F.least(F.get(x, i), *[F.get(x, i + s) for s in steps])))


def _fingerprints(hashes: Column, window: int, k: int) -> Column:
    """Places of the kept k-grams with their hash and the word hashes around them."""
    span = window - k + 1

    def least(grams: Column) -> Column:
        """The least of each ``span`` neighbours, from leasts of ever wider stretches."""
        m, width = grams, 1
        while width < span:
            step = min(width, span - width)
            more = [step, 2 * step] if width * 3 <= span else [step]
            m = _wider(m, more)
            width += more[-1]
        return m

    def keep(grams: Column) -> Column:
        """Places of the leftmost least k-gram of each window, each once: where the least value is new, or its place has left."""
        return bind(least(grams), lambda m: F.transform(
            F.filter(_upto(F.size(m)), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)) | (F.get(grams, i - 1) == F.get(m, i - 1))),
            lambda i: i + F.array_position(F.slice(grams, i + 1, span), F.get(m, i)).cast("int") - 1))

    def rows(h: Column) -> Column:
        grams = F.transform(_upto(F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i + 1, k)))
        near = lambda i: F.greatest(i - (span - 1), F.lit(0))
        return bind(grams, lambda g: F.transform(keep(g), lambda i: F.struct(
            F.get(g, i).alias("fp"), near(i).alias("start"), (i - near(i)).alias("into"),
            F.slice(h, near(i) + 1, i - near(i) + window).alias("around"))))
    return bind(hashes, rows)


def _window_hash(words: Column) -> Column:
    return F.struct(F.xxhash64(words).alias("a"), F.xxhash64(F.lit(7), words).alias("b"))


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(m, w, item): every window of every item by its word count and hash."""
    h = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), word_hashes(text_col).alias("h"))
    m = F.least(F.size("h"), F.lit(window))
    parts = bind(F.col("h"), lambda x: F.transform(_upto(F.size(x) - F.least(F.size(x), F.lit(window)) + 1),
                                                    lambda i: _window_hash(F.slice(x, i + 1, F.least(F.size(x), F.lit(window))))))
    return h.filter(F.size("h") > 0).select("item", m.alias("m"), F.explode(parts).alias("w")).distinct()


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(__tx_key, start, m, item): each benchmark window that occurs, by text key and first word."""
    texts = docs.select(F.md5(text_of(text_col)).alias(P + "key"), word_hashes(text_col).alias("h"))
    marks = benchmark_windows(items, item_col, item_text, window)
    whole = items.select(word_hashes(item_text).alias("h")).filter(F.size("h") >= window)
    prints = whole.select(F.explode(_fingerprints(F.col("h"), window, k)).alias("f")).select(F.col("f.fp").alias("fp")).distinct()
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    kept = texts.select(P + "key", F.explode(_fingerprints(F.col("h"), window, k)).alias("f")).select(P + "key", "f.*")
    hits = kept.join(prints, "fp", "left_semi").select(P + "key", "start", "into", "around").distinct()
    # a window of the text around a hit: it starts at or before the hit and is whole
    around = bind(F.col("around"), lambda a: F.transform(
        F.filter(F.sequence(F.lit(0), F.col("into")), lambda i: i + window <= F.size(a)),
        lambda i: F.struct((F.col("start") + i).alias("start"), _window_hash(F.slice(a, i + 1, window)).alias("w"))))
    found = hits.select(P + "key", F.lit(window).alias("m"), F.explode(around).alias("c")).select(P + "key", "m", "c.start", "c.w")
    for m in sorted(r["m"] for r in marks.filter(F.col("m") < window).select("m").distinct().collect()):
        runs = bind(F.col("h"), lambda x, m=m: F.transform(_upto(F.size(x) - (m - 1)), lambda i: F.struct(
            i.alias("start"), _window_hash(F.slice(x, i + 1, m)).alias("w"))))
        short = marks.filter(F.col("m") == m).select("w").distinct()
        if short.count() <= BROADCAST_ROWS:
            short = F.broadcast(short)
        every = texts.select(P + "key", F.lit(m).alias("m"), F.explode(runs).alias("c")).select(P + "key", "m", "c.start", "c.w")
        found = found.union(every.join(short, "w", "left_semi").select(P + "key", "m", "start", "w"))
    return found.distinct().join(marks, ["m", "w"]).select(P + "key", "start", "m", "item")


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Every row with n_words, n_hit, n_items, items_sha256 and contaminated."""
    cols = [c for c in docs.columns if c not in RESULT]
    met = find(docs, items, text_col, item_col, item_text, window, k)
    # covered words: each span adds what lies past the furthest end before it
    ends = Window.partitionBy(P + "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = (met.groupBy(P + "key", "start").agg(F.max(F.col("start") + F.col("m")).alias("end"))
             .withColumn("past", F.greatest(F.col("start"), F.coalesce(F.max("end").over(ends), F.lit(0)))))
    hit = spans.groupBy(P + "key").agg(F.sum(F.greatest(F.col("end") - F.col("past"), F.lit(0))).alias(P + "hit"))
    ids = (met.select(P + "key", "item").distinct().groupBy(P + "key")
           .agg(F.count(F.lit(1)).alias(P + "items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias(P + "ids")))
    known = hit.join(ids, P + "key").withColumnRenamed(P + "key", P + "k")
    words = F.size(F.filter(F.split(lower_ascii(text_of(text_col)), NOT_WORD, -1), lambda w: w != "")).cast("long")
    rows = docs.select(*cols, F.md5(text_of(text_col)).alias(P + "key"), words.alias("n_words"))
    n = F.coalesce(P + "hit", F.lit(0)).cast("long")
    return (rows.join(known, F.col(P + "key") == F.col(P + "k"), "left")
            .select(*cols, "n_words", n.alias("n_hit"), F.coalesce(P + "items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(P + "ids", F.lit("")), 256).alias("items_sha256"),
                    ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated")))
