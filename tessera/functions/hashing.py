"""Seeded hash draws.

Randomness is a pure function of (seed, key): ``md5(seed || '|' || key)``.
The first 8 hex digits read as an unsigned 32-bit integer give the shared
uniform ``u = int / 2^32`` in [0, 1).  The same bits come out of any engine
that has md5, so every "random" operator is reproducible and re-runnable
after an executor loss (no state, no RNG stream).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hkey(*cols) -> Column:
    """Composite string key ``a|b|c`` (integers only; never hash doubles)."""
    return F.concat_ws("|", *[_col(c).cast("string") for c in cols])


def hash_hex(seed, *cols) -> Column:
    """md5 hex of ``seed|key``."""
    key = hkey(*cols) if len(cols) > 1 else _col(cols[0]).cast("string")
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key))


def hash_int(seed, *cols) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of the md5."""
    return F.conv(F.substring(hash_hex(seed, *cols), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *cols) -> Column:
    """Deterministic U[0,1) draw per (seed, key)."""
    return hash_int(seed, *cols) / F.lit(TWO_32)


def pick(options: Column, seed, *cols) -> Column:
    """Uniform categorical draw from an array column (1-based element_at)."""
    return F.element_at(options, (F.pmod(hash_int(seed, *cols), F.size(options)) + 1).cast("int"))


# --- the same draws for Arrow batches: a column of MD5s costs the JVM ten times as much ---------

_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]  # Fixed values: MD5's
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]


def _md5_first_word(m: np.ndarray) -> np.ndarray:
    """The first four digest bytes, as a big-endian number, of one-block messages; ``m`` has a row a word, a column a message."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(m.shape[1], x) for x in start)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif turn == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) % 16
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = (7 * i) % 16
        f += a
        f += _SINES[i]
        f += m[at]
        by = _SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - by), out=g)
        f <<= np.uint32(by)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += start[0]
    return a.byteswap().astype(np.int64)


class KeyDraws:
    """``hash_int(seed, key, F.lit(name))`` of the string keys of an Arrow column, many at a time."""

    def __init__(self, keys):
        import pyarrow as pa
        keys = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).cast(pa.large_binary())
        self.rows, self.known = len(keys), keys.is_valid().to_numpy(zero_copy_only=False)
        ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset:keys.offset + self.rows + 1]
        size = np.where(self.known, np.diff(ends), 0)
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        self.edges = np.concatenate([[0], np.flatnonzero(np.diff(self.size)) + 1, [self.rows]]) if self.rows else np.zeros(1, int)
        text = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
        first = ends[:-1][self.order]
        self.texts = []  # the keys of one length, a row each
        for lo, hi in zip(self.edges[:-1], self.edges[1:]):
            n = int(self.size[lo])
            self.texts.append(text[first[lo:hi, None] + np.arange(n)] if n else np.empty((hi - lo, 0), np.uint8))

    def draw(self, seed, name: str) -> np.ndarray:
        head, tail = f"{seed}|".encode(), f"|{name}".encode()
        out, block = np.empty(self.rows, np.int64), np.zeros((self.rows, 64), np.uint8)
        short = 0  # rows, the first in order, whose message has one block
        for text, lo, hi in zip(self.texts, self.edges[:-1], self.edges[1:]):
            n = len(head) + text.shape[1] + len(tail)
            if n > 55:
                out[self.order[lo:hi]] = [int(hashlib.md5(head + t.tobytes() + tail).hexdigest()[:8], 16) for t in text]
                continue
            short = hi
            block[lo:hi, :len(head)] = np.frombuffer(head, np.uint8)
            block[lo:hi, len(head):n - len(tail)] = text
            block[lo:hi, n - len(tail):n] = np.frombuffer(tail, np.uint8)
            block[lo:hi, n] = 0x80
            block[lo:hi, 56:58] = np.frombuffer((8 * n).to_bytes(2, "little"), np.uint8)
        if short:
            out[self.order[:short]] = _md5_first_word(np.ascontiguousarray(block[:short].view("<u4").T))
        if not self.known.all():  # a NULL leaves no mark in the key
            out[~self.known] = int(hashlib.md5(head + tail[1:]).hexdigest()[:8], 16)
        return out


# --- DuckDB spellings used by the oracle SQL -------------------------------

def sql_hash_hex(seed, key_sql: str) -> str:
    return f"md5('{seed}' || '|' || ({key_sql}))"


def sql_hash_int(seed, key_sql: str) -> str:
    return f"('0x' || substr({sql_hash_hex(seed, key_sql)}, 1, 8))::BIGINT"


def sql_uniform(seed, key_sql: str) -> str:
    return f"({sql_hash_int(seed, key_sql)} / 4294967296.0)"


def sql_key(*cols: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
