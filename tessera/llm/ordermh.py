"""Document fingerprints by order MinHash, sensitive to edit distance.

Tokens are the words of the text (runs without ASCII white space); where
``long_bytes`` is given, a longer word is as many tokens as it has code points,
so that prose without spaces, minified code and the like are told apart by
their edits, too.  A k-mer is
``K`` tokens in a row, and equal k-mers are numbered by occurrence, so that a
text is a set of (k-mer, number) pairs.  A seeded hash deals the pairs to
``SLOTS`` slots and ranks them; each slot takes its ``PICK`` minimal pairs,
puts them back in text order, and hashes the tuple of their k-mers.  Two texts
share a slot's value only if they share its minimal k-mers in the same order,
so moved blocks lower the likeness as edits do.  The likeness is the share of
equal slots among those that either text fills.

All of it is array functions within a row: k-mer hashes with their places are
packed in longs and sorted, runs of equals give the occurrence numbers, a
second sort ranks the pairs by slot.  Costs n log n for n words.

Nulls are empty texts; texts of fewer than ``K`` words are one k-mer, empty
ones none: they fill no slot, and two of them are alike (1.0).  Equal texts
have equal fingerprints.  Places are kept in 26 bits: beyond 67 million words
in one text, order is modulo that.
Empty tables give empty results; further columns go along, columns of the
input named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import P, bind, text_of

K = 3
SLOTS = 32  # a power of two
PICK = 2
BITS = 26  # of a place
LONG_BYTES = 64  # longer words are taken as their code points
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 8192  # larger tables get larger buckets


def _where(n: Column, cond) -> Column:
    """The places 0 .. n-1 where cond holds."""
    return F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), cond)


def tokens(words: Column, long_bytes: int | None) -> Column:
    """The words, with the code points of those that have more than ``long_bytes`` bytes in their place."""
    if long_bytes is None:
        return words
    long = lambda w: F.octet_length(w) > long_bytes
    return bind(words, lambda x: F.when(F.exists(x, long), F.flatten(F.transform(
        x, lambda w: F.when(long(w), F.split(w, "")).otherwise(F.array(w))))).otherwise(x))


def signature(text: Column, k: int = K, slots: int = SLOTS, pick: int = PICK, long_bytes: int | None = None) -> Column:
    """array<long> of ``slots`` values, null where a slot is empty."""
    top = slots.bit_length() - 1
    place = (1 << BITS) - 1
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    hashes = F.transform(tokens(words, long_bytes), lambda w: F.xxhash64(w))

    def packed(h: Column) -> Column:  # k-mer hash above, place below
        n = F.size(h)
        last = F.greatest(n - k, F.lit(0))
        grams = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(grams, lambda i: F.xxhash64(F.slice(h, i + 1, k)).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))))

    def numbered(s: Column) -> Column:  # occurrence number of each packed k-mer, in the sorted order
        n = F.size(s)
        starts = _where(n, lambda i: (i == 0) | (F.shiftright(F.get(s, i), BITS) != F.shiftright(F.get(s, i - 1), BITS)))
        return bind(starts, lambda b: F.flatten(F.transform(b, lambda x, j: F.sequence(
            F.lit(0), F.coalesce(F.get(b, j + 1), n) - x - 1))))

    def ranked(s: Column) -> Column:  # pair hash above, place in s below: slots in order, least pairs first
        return bind(numbered(s), lambda c: F.sort_array(F.transform(s, lambda x, i: F.xxhash64(
            F.shiftright(x, BITS), F.get(c, i)).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long")))))

    def values(s: Column, r: Column) -> Column:
        slot = lambda i: F.shiftrightunsigned(F.get(r, i), 64 - top)
        firsts = _where(F.size(r), lambda i: (i == 0) | (slot(i) != slot(i - 1)))

        def value(i: Column) -> Column:
            taken = F.filter(F.slice(r, i + 1, pick), lambda x: F.shiftrightunsigned(x, 64 - top) == slot(i))
            grams = F.transform(taken, lambda x: F.get(s, x.bitwiseAND(F.lit(place)).cast("int")))
            ordered = F.array_sort(grams, lambda a, b: (a.bitwiseAND(F.lit(place)) - b.bitwiseAND(F.lit(place))).cast("int"))
            return F.struct(slot(i).cast("int").alias("slot"), F.xxhash64(F.transform(ordered, lambda g: F.shiftright(g, BITS))).alias("value"))

        pairs = F.transform(firsts, value)
        return bind(F.map_from_entries(pairs), lambda m: F.array(*[F.element_at(m, F.lit(j)) for j in range(slots)]))

    return bind(hashes, lambda h: bind(packed(h), lambda s: bind(ranked(s), lambda r: values(s, r))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that either fills; 1 if none is filled."""
    filled = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), (x.eqNullSafe(y)).cast("int")))
    return bind(F.filter(filled, lambda x: x.isNotNull()), lambda f: F.when(F.size(f) == 0, F.lit(1.0)).otherwise(
        F.aggregate(f, F.lit(0), lambda t, x: t + x) / F.size(f)))


def as_text(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.when(x.isNull(), F.lit("-" * 8)).otherwise(
        F.lower(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0")))))


def add_signature(df: DataFrame, text_col: str = "text", out: str = "signature", **how) -> DataFrame:
    return df.withColumn(out, signature(text_of(text_col), **how))


def with_next(df: DataFrame, id_col: str, cols: list[str], bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """Each row with ``next``, a struct of the ``cols`` of the row after it by descending id (the first, after the last).

    Rows go once to buckets between exact ids, found as percentiles over all
    rows; the first rows of a bucket are also put behind the bucket before it,
    so each bucket finds its own neighbours.  Rows of one id follow each other
    by text hash; null ids come last.
    """
    total, low = df.agg(F.sum(F.octet_length(text_of(text_col)) + 64), F.max(id_col)).first()
    n = min(MAX_BUCKETS, int((total or 0) // bucket_bytes) + 1)
    cuts = []
    if n > 1:
        found = df.agg(F.percentile_approx(F.col(id_col), [i / n for i in range(1, n)], 100 * n)).first()[0]
        cuts = sorted({c for c in found or () if c != low}, reverse=True)
    marks = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.when(F.col(id_col).isNull(), F.lit(len(cuts))).otherwise(
        F.size(F.filter(marks, lambda c: F.col(id_col) <= c))) if cuts else F.lit(0)
    heads = F.col(id_col).isin([low, *cuts]) if cuts else F.col(id_col).eqNullSafe(F.lit(low))
    names = df.columns
    d = df.withColumn(P + "b", bucket.cast("int"))
    before = F.when(F.col(id_col).eqNullSafe(F.lit(low)), F.lit(len(cuts))).otherwise(F.col(P + "b") - 1)
    copies = F.when(heads, F.array(F.struct(F.col(P + "b").alias("b"), F.lit(0).alias("copy")),
                                   F.struct(before.cast("int").alias("b"), F.lit(1).alias("copy")))).otherwise(
        F.array(F.struct(F.col(P + "b").alias("b"), F.lit(0).alias("copy"))))
    d = d.withColumn(P + "at", F.explode(copies))
    order = Window.partitionBy(P + "at.b").orderBy(P + "at.copy", F.col(id_col).desc_nulls_last(), F.xxhash64(text_col))
    return (d.withColumn("next", F.lead(F.struct(*cols)).over(order)).filter(F.col(P + "at.copy") == 0).select(*names, "next"))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_bytes: int | None = None) -> DataFrame:
    """Every row with n_chars, its edited text (the last third from the next row's text), signatures and likenesses."""
    made = ("n_chars", "edited_text", "signature", "edited_signature", "near_edited", "near_next")
    cols = [c for c in df.columns if c not in made]
    d = add_signature(df.select(*cols).withColumn(P + "t", text_of(text_col)), P + "t", P + "sig", long_bytes=long_bytes)
    d = with_next(d, id_col, [P + "t", P + "sig"], text_col=P + "t")
    n = F.length(P + "t")
    third = F.floor(n / 3).cast("int")
    d = d.select(*cols, n.cast("long").alias("n_chars"), F.col(P + "sig").alias("signature"), F.col("next")[P + "sig"].alias(P + "ns"),
                 F.concat(F.substring(P + "t", F.lit(1), n - third), F.substring(F.col("next")[P + "t"], F.lit(1), third)).alias("edited_text"))
    d = add_signature(d, "edited_text", "edited_signature", long_bytes=long_bytes)
    return d.select(*cols, "n_chars", "edited_text", "signature", "edited_signature",
                    likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
                    likeness(F.col("signature"), F.col(P + "ns")).alias("near_next"))
