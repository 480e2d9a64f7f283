"""Repeated strings found by a depth-limited radix sort of suffixes.

Every place of a text's UTF-8 bytes begins a suffix.  Ordering suffixes only
through ``length`` bytes, equal groups are exactly the strings of that length
that occur more than once; each byte under such a string is removed.  The sort
goes by passes from the most significant digit, and a group is done as soon as
it is settled:

1. The first digit of a suffix is the least (by hash, the last of equals) of
   the strings of ``digit_length`` bytes within its first ``length``, wherever
   it lies: equal suffixes have equal ones at the same distance.  Neighbouring suffixes share it, so a
   run of them is one row (first and last start, digit, hash of all the bytes
   that the run's strings cover).  Digits met once are settled: unique.
2. Within a digit, runs with equal bytes have all their strings in common:
   they are settled as repeated, and one of them stands for all.
3. Where a digit has runs with different bytes, the suffixes of one run of
   each kind are told apart by the rest: (digit, hash of the whole string).
   Groups of more than one are repeated.

Rows are counted with pre-aggregation and joined back, so a string that
occurs everywhere is never gathered in one task.  Texts move twice, keyed by
their hash, to the runs that concern them.  Hashes are 64 bits each and are
compared only together with the digit (128 bits in all).  Passes leave their
result as a table in the shared folder, and what they needed is deleted.  A text is read in
stretches of ``STRETCH`` bytes that overlap by one string, so that memory does
not grow with its length.

Nulls are empty texts; texts shorter than the length keep all their bytes
(n_spans 0).  Copies of a text count as other occurrences, so repeated rows
lose all their strings.  Ids may be null or repeated.  Empty tables give empty
results; further columns go along, and columns of the input named like the
result's are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import P, discard, text_of, written

LENGTH = 400
STRETCH = 1 << 21
_MASK = (1 << 64) - 1
_M = 0x9E3779B97F4A7C15 | 1
_INV = pow(_M, -1, 1 << 64)
_RNG = np.random.default_rng(20240817)
_BYTES = [_RNG.integers(0, _MASK, 256, dtype=np.uint64, endpoint=True) for _ in range(2)]


class _Powers:
    """Powers of the hash base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _M, np.uint64)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _INV, np.uint64)])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any string of the bytes, from running sums."""

    def __init__(self, data: np.ndarray, table: int):
        up, self.down = _powers.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[table][data] * up[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _least_ahead(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every whole window."""
    n = len(x)
    pad = -n % w
    blocks = np.r_[x, np.full(pad, _MASK, np.uint64)].reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return np.minimum(tail[:m], head[w - 1:w - 1 + m])


def digit_length(length: int) -> int:
    """Longer digits settle more runs at once, but make shorter runs."""
    return max(1, length * 13 // 20)


def runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, digit, hash of the bytes covered) of each run of suffixes."""
    k = digit_length(length)
    parts = []
    for lo in range(0, max(1, len(data) - length + 1), STRETCH):
        piece = data[lo:lo + STRETCH + length - 1]
        n = len(piece)
        if n < length:
            break
        roll = Rolling(piece, 0)
        digit = roll.of(slice(0, n - k + 1), slice(k, n + 1))
        place = np.uint64((1 << 22) - 1) - np.arange(len(digit), dtype=np.uint64)
        least = _least_ahead((digit & ~np.uint64((1 << 22) - 1)) | place, length - k + 1)
        at = (1 << 22) - 1 - (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        parts.append((first + lo, last + lo, digit[at[first]], roll.of(first, last + length)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _batches(chunks: Iterator[tuple], names: tuple, kinds: tuple, size: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Chunks hold an array for each name, or a number that holds for the chunk; gathers them into batches."""
    held: list[tuple] = []
    rows = 0

    def batch():
        count = [next(len(x) for x in c if isinstance(x, np.ndarray)) for c in held]
        columns = []
        for i, kind in enumerate(kinds):
            if isinstance(held[0][i], np.ndarray):
                columns.append(np.concatenate([c[i] for c in held]).astype(kind, copy=False))
            else:
                columns.append(np.repeat(np.array([c[i] for c in held], kind), count))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))

    for c in chunks:
        held.append(c)
        rows += next(len(x) for x in c if isinstance(x, np.ndarray))
        if rows >= size:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


def _all_runs(length: int):
    def run(batches):
        def chunks():
            for b in batches:
                for ka, kb, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                    data = _bytes(text)
                    if len(data) >= length:
                        first, last, digit, body = runs_of(data, length)
                        yield ka, kb, first, last, digit.view(np.int64), body.view(np.int64)
        yield from _batches(chunks(), ("ka", "kb", "first", "last", "digit", "body"), ("i8", "i8", "i4", "i4", "i8", "i8"))
    return run


def _told_apart(length: int):
    """For the runs listed with a text: each suffix by run, digit and hash of its string."""
    def run(batches):
        def chunks():
            for b in batches:
                lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in b.columns[1:]]
                for i, text in enumerate(b.column(0)):
                    data = _bytes(text.as_py())
                    rid, first, last, digit, many = (v[o[i]:o[i + 1]] for o, v in lists)
                    for j in range(len(rid)):
                        piece = data[first[j]:last[j] + length]
                        n = len(piece) - length + 1
                        body = Rolling(piece, 1).of(slice(0, n), slice(length, length + n))
                        yield rid[j], np.arange(first[j], first[j] + n), digit[j], body.view(np.int64), many[j]
        yield from _batches(chunks(), ("rid", "start", "digit", "body", "many"), ("i8", "i4", "i8", "i8", "?"))
    return run


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The maximal covered stretches as rows (start, end)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.r_[True, s[1:] > e[:-1]]
    return np.c_[s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]]


def _cut(length: int):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def one(text, runs, singles):
        data = _bytes(text)
        runs, singles = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (runs, singles))
        spans = covered(len(data), np.r_[runs >> 32, singles], np.r_[runs & 0xFFFFFFFF, singles] + length)
        keep = hashlib.sha256()
        at = 0
        for s, e in spans:
            keep.update(data[at:s])
            at = e
        keep.update(data[at:])
        return len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), keep.hexdigest(), [x for p in spans.tolist() for x in p]

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    def cut(texts: pd.Series, runs: pd.Series, singles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(texts, runs, singles)], columns=names)
    return cut


def _keys(text_col: str):
    """128 bits of the text's hash, as two longs."""
    h = F.md5(text_of(text_col))
    half = lambda i: F.conv(F.substring(h, i, 15), 16, 10).cast("long")
    return half(1), half(17)


def repeated(df: DataFrame, text_col: str, length: int) -> DataFrame:
    """(ka, kb) of texts with runs, whose strings all repeat, and singles, the starts of other repeated strings."""
    ka, kb = _keys(text_col)
    texts = df.select(ka.alias("ka"), kb.alias("kb"), text_of(text_col).alias("text"))
    runs = written(texts.filter(F.octet_length("text") >= length).mapInArrow(
        _all_runs(length), "ka long, kb long, first int, last int, digit long, body long"), "runs")
    more = lambda t: t.groupBy("digit").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("digit")
    many = written(more(runs), "many")  # tables of their own, so that a common digit's rows can be split in the joins
    live = written(runs.join(many, "digit", "left_semi"), "live_runs")
    discard(runs, many)
    kinds = written(live.groupBy("digit", "body").agg(F.count(F.lit(1)).alias("n"),
                                                      F.min(F.struct("ka", "kb", "first", "last")).alias("one")), "kinds")
    settled = written(live.join(kinds.filter("n > 1").select("digit", "body"), ["digit", "body"], "left_semi")
                      .groupBy("ka", "kb").agg(F.collect_set(F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")).alias("runs")), "settled")
    discard(live)
    mixed = written(more(kinds), "mixed")
    apart = written(kinds.join(mixed, "digit", "left_semi")
                    .select(F.monotonically_increasing_id().alias("rid"), "one.*", "digit", (F.col("n") > 1).alias("many")), "apart")
    discard(kinds, mixed)
    parts = ("rid", "first", "last", "digit", "many")
    listed = apart.groupBy("ka", "kb").agg(F.collect_list(F.struct(*parts)).alias("l"))
    one = texts.groupBy("ka", "kb").agg(F.first("text").alias("text"))  # of copies one will do
    chosen = one.join(listed, ["ka", "kb"]).select("text", *[F.col("l")[c].alias(c) for c in parts])
    strings = written(chosen.mapInArrow(
        _told_apart(length), "rid long, start int, digit long, body long, many boolean"), "strings")
    discard(spark=df.sparkSession)
    twice = written(strings.groupBy("digit", "body").agg(F.count(F.lit(1)).alias("c"), F.max("many").alias("m"))
                    .filter("c > 1 or m").select("digit", "body"), "twice")
    discard(spark=df.sparkSession)
    singles = written(strings.filter("not many").join(twice, ["digit", "body"], "left_semi").select("rid", "start")
                      .join(apart.select("rid", "ka", "kb"), "rid")
                      .groupBy("ka", "kb").agg(F.collect_list("start").alias("singles")), "singles")
    discard(strings, twice, apart)
    return settled.join(singles, ["ka", "kb"], "full_outer")


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """The rows (with the columns of ``keep``, else all) with n_bytes, n_removed, n_spans, kept_sha256 and the spans removed."""
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    cols = [c for c in (keep or df.columns) if c not in made]
    found = repeated(df, text_col, length).select(F.col("ka").alias(P + "ka"), F.col("kb").alias(P + "kb"), "runs", "singles")
    found = found.select(P + "ka", P + "kb", F.col("runs").alias(P + "runs"), F.col("singles").alias(P + "singles"))
    ka, kb = _keys(text_col)
    rows = df.select(*cols, F.col(text_col).alias(P + "text"), ka.alias(P + "a"), kb.alias(P + "b"))
    joined = rows.join(found, (F.col(P + "a") == F.col(P + "ka")) & (F.col(P + "b") == F.col(P + "kb")), "left")
    out = joined.select(*cols, _cut(length)(P + "text", P + "runs", P + "singles").alias(P + "cut"))
    return out.select(*cols, *[F.col(P + "cut")[c].alias(c) for c in made])
