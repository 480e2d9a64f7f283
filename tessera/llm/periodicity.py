"""Periodic runs of words, found by online dyadic square catching.

Words arrive one after another (or many at a time, with the same result).  For
every power of two B the text is cut into blocks of B words.  A block that is
complete becomes a catcher: it waits for its own words to come again at a
distance p of B to 2B - 1 words, which it sees from the hash of the last B
words, kept for every end (the blocks of 8 also wait for distances 1 to 7).  A
hit starts a suffix comparison with period p: backward over the words before
the block, then forward; each appended word advances those that reach the end
of the text.  A comparison whose stretch has come to 2p words is a square;
squares of one period that follow each other are one stretch, and so merge
into a run, the maximal one.

A run of 24 words or more and of three periods or more has a whole block, of
the greatest B that is at most its period (or 8), with the period between the
block and the run's end, so no run is missed.  A hit inside a known stretch of
a smaller period q, whole with its block, has a multiple of q as its distance
(two periods whose sum is no more than a stretch's length have their greatest
common divisor as a period) and is passed over.  Words are compared by hashes of
windows; what is reported has been compared word by word.

A text of n words takes n hashes for each of the log n block sizes, and that
memory (8 bytes each); texts are worked on one at a time, in their scan,
without a shuffle.

Nulls and empty texts have no words and no run: four nulls, and the digests of
the empty text.  Repeated rows get equal results, empty tables empty ones; every
further column goes along, and columns named like the result's are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import P

LEAST = 24
TIMES = 3
#: Words appended at a time.
STEP = 1 << 16
_FIRST = 3  # the least blocks have 2 ** 3 words
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, n_dropped long")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K[0] + b * _K[1]
    x ^= x >> np.uint64(29)
    x *= _K[2]
    x ^= x >> np.uint64(32)
    return x


class RunCatcher:
    """Takes words (as integers) by ``append`` and has the runs so far in ``runs()``."""

    def __init__(self, least: int = LEAST, times: int = TIMES):
        if times < 3 or least < 24:
            raise ValueError("blocks of 8 words catch runs of three periods and 24 words or more")
        self.least, self.times = least, times
        self.words = np.zeros(0, np.int64)
        self.level = [np.zeros(0, np.uint64)]  # level[k][i]: hash of words i .. i + 2^k - 1
        self.square: dict[tuple[int, int], int] = {}  # (period, start) -> end of the stretch, two periods or more
        self.active: set[tuple[int, int]] = set()  # comparisons that reach the last word

    def append(self, new: np.ndarray) -> None:
        seen = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(new, np.int64)])
        self._advance(seen)
        done = self._hash(new)
        for k in range(_FIRST, len(self.level)):
            if k == _FIRST:
                self._catch(k, done[k], 0)
            self._catch(k, done[k], 1)

    def _advance(self, seen: int) -> None:
        w, n = self.words, len(self.words)
        for key in list(self.active):
            p, s = key
            differ = w[seen:] != w[seen - p:n - p]
            stop = int(np.argmax(differ)) if differ.any() else n - seen
            if seen + stop < n:
                self.active.remove(key)
            if seen + stop - s >= 2 * p:
                self.square[key] = seen + stop

    def _hash(self, new: np.ndarray) -> list[int]:
        """Hashes of the windows that end in the new words; returns the number of windows there were, by level."""
        n, had = len(self.words), [len(x) for x in self.level]
        self.level[0] = np.concatenate([self.level[0], _mix(np.asarray(new).astype(np.uint64) + np.uint64(1), np.uint64(0))])
        k = 1
        while 3 << k <= n or k < _FIRST:
            if k == len(self.level):
                self.level.append(np.zeros(0, np.uint64))
                had.append(0)
            half, at = 1 << (k - 1), len(self.level[k])
            below = self.level[k - 1]
            if len(below) - half > at:
                self.level[k] = np.concatenate([self.level[k], _mix(below[at:-half], below[at + half:])])
            k += 1
        return had

    def _catch(self, k: int, had: int, back: int) -> None:
        """New windows of 2^k words against the block ``back`` blocks before the one they start in."""
        h, size = self.level[k], 1 << k
        i = np.arange(max(had, back * size), len(h))
        if not len(i):
            return
        b = ((i >> k) - back) << k
        hit = (h[i] == h[b]) & (i > b)
        if not hit.any():
            return
        if back:  # the block before has hit at the same distance: one stretch
            far = np.concatenate([np.zeros(size, bool), hit])[:len(hit)]
            hit = hit & ~far
        b, p = b[hit], (i - b)[hit]
        fresh = self._reach(size)[b] < b + p + size if self.square else np.ones(len(b), bool)
        b, p = b[fresh], p[fresh]
        if not len(b):
            return
        s = b - self._backward(b, b + p)
        e = b + p + size + self._forward(b + size, b + p + size)
        n = len(self.words)
        for x in np.flatnonzero((e - s >= 2 * p) | (e == n)).tolist():
            key = (int(p[x]), int(s[x]))
            if e[x] - s[x] >= 2 * p[x]:
                self.square[key] = int(e[x])
            if e[x] == n:
                self.active.add(key)

    def _reach(self, below: int) -> np.ndarray:
        """For every word, the greatest end of a known stretch of a period under ``below`` that starts there or before."""
        out = np.zeros(len(self.words) + 1, np.int64)
        for (p, s), e in self.square.items():
            if p < below and e > out[s]:
                out[s] = e
        return np.maximum.accumulate(out)

    def _forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of words that agree from x and from y > x on."""
        x, y, start = x.copy(), y.copy(), y.copy()
        for k in range(len(self.level) - 1, -1, -1):
            h = self.level[k]
            go = np.ones(len(y), bool)
            while True:
                go &= y < len(h)
                go[go] = h[x[go]] == h[y[go]]
                if not go.any():
                    break
                x[go] += 1 << k
                y[go] += 1 << k
                if k + 1 < len(self.level):
                    break
        return y - start

    def _backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of words that agree before x and before y > x."""
        x, y, start = x.copy(), y.copy(), y.copy()
        for k in range(len(self.level) - 1, -1, -1):
            h = self.level[k]
            go = np.ones(len(y), bool)
            while True:
                go &= x >= 1 << k
                go[go] = h[x[go] - (1 << k)] == h[y[go] - (1 << k)]
                if not go.any():
                    break
                x[go] -= 1 << k
                y[go] -= 1 << k
                if k + 1 < len(self.level):
                    break
        return start - y

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start, then period; all checked word by word."""
        out = []
        for (p, s), e in self.square.items():
            if e - s < max(self.least, self.times * p):
                continue
            w = self.words[s:e]
            if np.array_equal(w[p:], w[:-p]) and not any(np.array_equal(w[p // r:], w[:-(p // r)]) for r in _primes(p)):
                out.append((s, e - s, p))
        return sorted(out, key=lambda r: (r[0], r[2]))


def _primes(n: int) -> list[int]:
    out, r = [], 2
    while r * r <= n:
        if n % r == 0:
            out.append(r)
            while n % r == 0:
                n //= r
        r += 1
    return out + [n] * (n > 1)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES, step: int = STEP) -> list[tuple[int, int, int]]:
    if len(ids) < least:
        return []
    catch = RunCatcher(least, times)
    for at in range(0, len(ids), step):
        catch.append(ids[at:at + step])
    return catch.runs()


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_runs(text: str | None, least: int = LEAST, times: int = TIMES) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: by \x20 and \x09 to \x0D only
    number = {x: i for i, x in enumerate(dict.fromkeys(words))}
    runs = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least, times)
    if not runs:
        return 0, None, None, None, None, _sha(b""), _sha(b" ".join(words)), [], 0
    best = runs[0]
    for r in runs[1:]:  # in order of start and period, so that a tie stays with the first
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = np.zeros(len(words), bool)
    for s, length, p in runs:
        gone[s + p:s + length] = True
    kept = [x for x, g in zip(words, gone.tolist()) if not g]
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (len(runs), *best, 1000 * best[1] // best[2], _sha(listed.encode()), _sha(b" ".join(kept)),
            [dict(zip(("start", "length", "period"), r)) for r in runs], int(gone.sum()))


def find_runs(df: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Every row with its runs, the one of greatest length / period, and the digest of the words outside repeats."""
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "n_dropped"]

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([text_runs(t, least, times) for t in texts], columns=names)
        return found.astype({c: "Int64" for c in names[1:5]})

    cols = [c for c in df.columns if c not in names]
    return df.withColumn(P + "runs", run(F.col(text_col))).select(*cols, *[F.col(P + "runs")[c].alias(c) for c in names])


def loop_text(text: str | None, h: int) -> str:
    """For h divisible by 10 the words up to a, then from a on a loop of p words, one space between words; else the text.

    With n words and g = floor(h / 10): a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)).
    """
    words = (text or "").encode("utf-8", "surrogatepass").split() if h % 10 == 0 else []
    if not words:
        return text or ""
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode("utf-8", "surrogatepass")


def looped(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """``loop_text`` by h = crc32(id as text); a null id counts as the empty text."""
    @F.pandas_udf("string")
    def loop(texts: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(list(map(loop_text, texts, h.tolist())), dtype=object)

    return loop(F.col(text_col), F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
