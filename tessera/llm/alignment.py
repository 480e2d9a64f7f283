"""Alignment of two tokenizers' ids by the bytes that both end at.

A text is encoded by a byte-level BPE (A, given a space and the text) and by a
piece BPE with byte fallback (B, which adds the space).  The cumulative ends of
the tokens' bytes are put into a dictionary from end to index for each side;
the intersection of the two key sets, sorted, cuts both id lists into groups,
and within each slice the tokens whose bytes end together are linked.  A text
whose tokens do not give back a space and the text, byte for byte, has no
tokens.

Neither tokenizer joins anything across a single space that stands between a
character other than a space and one other than white space: A starts a new
unit at it, and no piece of B has a space after another character (asked of
the vocabulary when it is loaded).  Such a space is therefore an end
for both, and a text's groups are those of its stretches between such spaces,
one after another.  Each distinct stretch is aligned once and kept until
``MEMO`` of them are held.

Links are counted over the corpus: rows of (document, id pair, times), summed
by pair.  Pairs with 1 / ``HOT`` of all links or more, so at most ``HOT``, are
broadcast back to the documents' pairs; the others, none of them frequent, are
joined by a shuffle.  The greatest count of each B id is bounded by the vocabulary.

Nulls, empty texts and texts that do not come back have zeros and an empty
digest.  Repeated rows count each on its own; empty tables give empty results;
further columns go along, and columns named like the result's are replaced.
Vocabulary files are read by the workers from ``folder``, which has to be on
every node.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import P, written

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches kept before they are let go, stretches aligned at a time, and texts at a time.
MEMO, BATCH, TEXTS = 1 << 18, 1 << 12, 128
#: Pairs with this fraction of all links, or more, are broadcast.
HOT = 1 << 17
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
NAMES = (*COUNTS, "n_best", "count_sum", "groups_sha256")
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
_ODD = re.compile(r" \s|^\s| $")
#: Letters that every version of Unicode puts in the same classes; the faster merge loop is used for texts of them only.
_LATIN = re.compile("[\x00-\u017f]*")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how A cuts its units
NONE = (0, 0, "", b"")
_EDGE = re.compile(r"^(?:\s|$)| $")


def ends_of(lengths: np.ndarray, ids: list[int]) -> dict[int, int]:
    """End of a token's bytes -> number of tokens up to it."""
    return dict(zip(lengths[ids].cumsum().tolist(), range(1, len(ids) + 1)))


def slices(a: dict[int, int], b: dict[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """(from, to in A, from, to in B) between the ends that both have."""
    i = j = 0
    for end in sorted(a.keys() & b.keys()):
        yield i, a[end], j, b[end]
        i, j = a[end], b[end]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte, as byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(0x100 + n): x for n, x in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the stretches aligned so far."""

    def __init__(self, folder: str = FOLDER, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, byte_bpe))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, piece_bpe))
        with open(os.path.join(folder, byte_bpe), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        as_byte = byte_alphabet()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(as_byte[c] for c in piece) if all(c in as_byte for c in piece) else piece.encode()
        self.bytes_b = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        self.apart = not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        self.name = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        ranks = {self.bytes_a[i]: i for piece, i in vocabulary.items() if piece not in special}
        self.fast_a = tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, tuple] = {}

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids of both; None for no tokens."""
        if _LATIN.fullmatch(text):
            x = self.fast_a.encode_ordinary(" " + text)
        else:
            x = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        y = self.b.encode(text)
        whole = (" " + text).encode()
        fits = text and b"".join(map(self.bytes_a.__getitem__, x)) == whole == b"".join(map(self.bytes_b.__getitem__, y))
        return (x, y) if fits else None

    def align(self, parts: list[str]) -> list[tuple] | None:
        """(tokens of A, of B, groups as text, id pairs of the links as packed longs) of each stretch of the text that
        single spaces between the parts make; None if the text has no tokens."""
        ids = self.encode(" ".join(parts))
        if ids is None:
            return None
        x, y = ids
        ends_a, ends_b = ends_of(self.len_a, x), ends_of(self.len_b, y)
        name_x, name_y = list(map(self.name.__getitem__, x)), list(map(self.name.__getitem__, y))
        groups, last_x, last_y = [], [], []
        for i, to_i, j, to_j in slices(ends_a, ends_b):
            groups.append((name_x[i] if to_i == i + 1 else ",".join(name_x[i:to_i])) + "|" +
                          (name_y[j] if to_j == j + 1 else ",".join(name_y[j:to_j])))
            last_x.append(to_i)  # of a slice's tokens only the last ones end together
            last_y.append(to_j)
        last_x, last_y = np.array(last_x), np.array(last_y)
        links = np.array(x, np.int64)[last_x - 1] << 32 | np.array(y, np.int64)[last_y - 1]
        ends = np.cumsum([len(p) + 1 if p.isascii() else len(p.encode()) + 1 for p in parts]).tolist()
        to_x, to_y = (np.array(list(map(e.__getitem__, ends))) for e in (ends_a, ends_b))
        to = np.searchsorted(last_x, to_x) + 1
        start = np.append(0, to[:-1])
        if len(parts) == len(groups):
            text = groups
        else:
            text = [groups[i] if k == i + 1 else ";".join(groups[i:k]) for i, k in zip(start.tolist(), to.tolist())]
        packed = links.tobytes()
        pairs = [packed[i:k] for i, k in zip((8 * start).tolist(), (8 * to).tolist())]
        return list(zip(np.diff(to_x, prepend=0).tolist(), np.diff(to_y, prepend=0).tolist(), text, pairs))

    def remember(self, parts: list[str]) -> None:
        """Aligns the stretches and keeps them; together, as one text, or each by itself where that has no tokens."""
        found = self.align(parts)
        if found is None:
            found = [(self.align([s]) or [NONE])[0] for s in parts]
        self.memo.update(zip(parts, found))

    def stretches(self, text: str) -> list[str]:
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def texts(self, texts: list[str | None]) -> list[tuple]:
        """The alignment of each text, as of ``align``, from its stretches' where they can be taken apart."""
        get = self.memo.get
        cut = [self.stretches(t) if t and self.apart else [] for t in texts]
        known = [list(map(get, parts)) for parts in cut]
        todo = {s for parts, found in zip(cut, known) if None in found for s, f in zip(parts, found) if f is None}
        plain, rest = [], []
        for s in todo:  # white space at an edge: only in a text's first stretch and its last one
            (rest if _EDGE.search(s) else plain).append(s)
        for latin in (True, False):
            some = [s for s in plain if (_LATIN.fullmatch(s) is not None) == latin]
            for at in range(0, len(some), BATCH):
                self.remember(some[at:at + BATCH])
        for s in rest:
            self.remember([s])
        out = []
        for t, parts, found in zip(texts, cut, known):
            if None in found:
                found = [get(s) if f is None else f for s, f in zip(parts, found)]
            if not t:
                out.append(NONE)
            elif not found or NONE in found:  # a stretch does not come back: the whole text decides
                out += self.align([t]) or [NONE]
            else:
                a, b, groups, links = zip(*found)
                out.append((sum(a), sum(b), ";".join(groups), b"".join(links)))
        if len(self.memo) > MEMO:
            self.memo.clear()
        return out


_TYPE = ("struct<n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,pair:array<long>,times:array<int>>")


def _arrays(found: list[tuple]) -> pa.StructArray:
    counts, digests, pairs, times, ends = [], [], [], [], [0]
    for x in found:
        a, b, groups, links = x
        pair, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
        counts.append((a, b, len(links) // 8, len(links) // 8))
        digests.append(hashlib.sha256(groups.encode()).hexdigest() if a else "")
        pairs.append(pair)
        times.append(n)
        ends.append(ends[-1] + len(pair))
    whole = lambda parts, t: np.concatenate([np.zeros(0, t), *parts]).astype(t)
    columns = np.array(counts, np.int64).reshape(-1, 4).T
    ends = pa.array(ends, pa.int32())
    arrays = [*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(digests, pa.string()),
              pa.ListArray.from_arrays(ends, pa.array(whole(pairs, np.int64))), pa.ListArray.from_arrays(ends, pa.array(whole(times, np.int32)))]
    return pa.StructArray.from_arrays(arrays, names=[*COUNTS, "groups_sha256", "pair", "times"])


def aligned(df: DataFrame, text_col: str = "text", folder: str = FOLDER, byte_bpe: str = BYTE_BPE,
            piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Every row with n_a, n_b, n_groups, n_links, groups_sha256, and its id pairs (A id * 2^32 + B id) with their times."""
    @F.arrow_udf(_TYPE)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = Aligner(folder, byte_bpe, piece_bpe)
        gc.disable()  # millions of small tuples, none in a cycle
        try:
            for texts in parts:
                for at in range(0, len(texts), TEXTS):
                    yield _arrays(both.texts(texts[at:at + TEXTS].to_pylist()))
        finally:
            gc.enable()

    names = [*COUNTS, "groups_sha256", "pair", "times"]
    cols = [c for c in df.columns if c not in names]
    return df.withColumn(P + "al", run(F.col(text_col))).select(*cols, *[F.col(P + "al")[c].alias(c) for c in names])


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): the links of each id pair in (pair, times), and the greatest count of its B id."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = written(counts, "alignment_pairs")
    best = counts.groupBy("b").agg(F.max("count").alias("best"))  # a row for each id of B's vocabulary
    return counts.join(F.broadcast(best), "b").drop("b")


def align(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, hot: int = HOT, **files) -> DataFrame:
    """Every row (with the columns of ``keep``, else all) with the counts and the digest of its alignment."""
    cols = [c for c in (keep or df.columns) if c not in NAMES]
    row = P + "row"
    inner = [c.replace(c, f"{P}k{i}") for i, c in enumerate(cols)]
    docs = df.select(*[F.col(c).alias(k) for c, k in zip(cols, inner)], F.col(text_col).alias(P + "text"))
    docs = written(aligned(docs, P + "text", **files).drop(P + "text").withColumn(row, F.monotonically_increasing_id()), "alignment")
    links = docs.select(row, F.inline(F.arrays_zip("pair", "times")))
    counts = pair_counts(links)
    total = links.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    often = F.col("count") * hot >= total
    marked = links.join(F.broadcast(counts.filter(often)), "pair", "left")  # at most ``hot`` rows
    rare = marked.filter(F.col("count").isNull()).drop("count", "best").join(counts.filter(~often), "pair")
    both = marked.filter(F.col("count").isNotNull()).unionByName(rare)
    sums = both.groupBy(row).agg(F.sum(F.when(F.col("count") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                 F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return docs.drop("pair", "times").join(sums, row, "left").select(
        *[F.col(k).alias(c) for c, k in zip(cols, inner)], *COUNTS, F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
