"""Exact dedup, periodic runs and tokenizer alignment against plain versions, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from conftest import SMALL
from tessera.llm import alignment, exactdedup, periodicity
from tessera.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, kept string, runs string, pair string, __row map<string,int>"
LOOP = " ".join(f"w{i % 9}" for i in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9001, None), (9002, ""), (None, "no id " * 30), (9004, "a " * 5000), (9004, "a " * 5000), (9005, "x\n y  z \t q "),
           (9006, "  two at the start"), (9007, "▁ under"), (9008, "<|endoftext|> and <s> [INST] <0x41>"), (9009, " "),
           (9010, "é ü 漢字 かな 😀 " + LOOP), (9011, LOOP + " " + LOOP), (9012, "tail  "), (None, None), (9013, "\x00 a b   c"),
           (9014, " ".join(f"v{i % 7000}" for i in range(60_000)))]
    rows = [(i, t, "en", "k", "r", "p", {"a": 1}) for i, t in odd]
    return base.unionByName(spark.createDataFrame(rows, SCHEMA), allowMissingColumns=True).checkpoint()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def bag(x):
    return sorted(map(repr, x))


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = bag((i, largest[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    for share in (2, 20, 512):  # no, some and many frequent texts
        got = exactdedup.exact_groups(docs, share=share)
        assert [c for c in got.columns if c not in exactdedup.RESULT] == [c for c in docs.columns if c != "kept"]
        got = got.collect()
        assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        stays = Counter(r.text_sha256 for r in got if r.kept)
        assert len(stays) == len(groups) and set(stays.values()) == {1}
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exactdedup.deduplicate(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exactdedup.exact_groups(docs.filter("false")).isEmpty()


def test_frequent_digests_are_found_across_partitions(spark):
    d = spark.range(0, 60_000, numPartitions=40).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit("warm")).otherwise(F.concat(F.lit("t"), "id")).alias("k"))
    named = [r.k for r in exactdedup.frequent(d, "k").collect()]
    assert {"hot", "warm"} <= set(named) and len(named) <= 2 * exactdedup.SHARE
    tied = exactdedup.exact_groups(d.select(F.lit(7).alias("doc_id"), F.col("k").alias("text")))
    got = {(r.text, r.group_size): r.n for r in tied.filter("kept and text in ('hot', 'warm')").groupBy("text", "group_size").agg(F.count("*").alias("n")).collect()}
    assert got == {("hot", 20000): 1, ("warm", d.filter("k = 'warm'").count()): 1}


def plain_runs(w, least=24, times=3):
    out, number = [], np.unique(w, return_inverse=True)[1]
    for p in range(1, len(w) // times + 1):
        same = np.r_[False, number[p:] == number[:-p], False].astype(np.int8)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            length = e + p - s
            if length >= max(least, times * p):
                part = w[s:s + length]
                if next(q for q in range(1, p + 1) if part[q:] == part[:-q]) == p:
                    out.append((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


PIECES = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 6)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 40))
def test_runs_equal_brute_force_for_any_cut(pieces, step):
    w = [x for unit, n in pieces for x in unit * n]
    want = plain_runs(w)
    assert periodicity.runs_of(np.array(w, np.int64)) == want
    assert periodicity.runs_of(np.array(w, np.int64), step=step) == want


def test_runs_of_long_and_hard_words():
    fib = [0, 1]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    gaps = sum([[0] * 60 + [i] for i in (1, 1, 1, 1, 2, 1, 1, 1)], [])
    draw = random.Random(4)
    unit = [draw.randrange(50) for _ in range(97)]
    for w in (b, gaps, unit * 5 + unit[:13] + [99] + unit * 3, fib * 150):
        assert periodicity.runs_of(np.array(w, np.int64)) == plain_runs(w)
    n = 300_000
    assert periodicity.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    two = np.arange(n) % 70_001
    assert periodicity.runs_of(two) == [(0, n, 70_001)]


def test_find_runs(docs, rows, spark, tmp_path):
    got = periodicity.find_runs(docs)
    assert {"doc_id", "lang", "__row"} <= set(got.columns)
    long = {9004, 9014}
    for r in got.filter("doc_id is null or doc_id not in (9004, 9014)").collect():
        w = brute.words(r.text)
        want = plain_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in want).encode()).hexdigest()
        if want:
            best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (0, None, None, None, None)
    assert {(r.doc_id, r.n_runs, r.length, r.period) for r in got.filter(F.col("doc_id").isin(*long)).collect()} == {(9004, 1, 5000, 1), (9014, 1, 60_000, 7000)}
    assert periodicity.find_runs(docs.filter("false")).isEmpty()
    docs.select("doc_id", "text").filter("doc_id is null or doc_id not in (9004, 9014)").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {r.doc_id: r for r in QUERIES["op13_periodicity"][0](spark, str(tmp_path)).collect() if r.doc_id is not None}
    looped = 0
    for i, t in rows:
        if i is None or i in long:
            continue
        w, h = brute.words(t), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w, looped = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))], looped + 1
        want = plain_runs(w)
        assert seen[i].n_runs == len(want), i
        assert seen[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in want).encode()).hexdigest()
    assert looped > 5


@pytest.fixture(scope="module")
def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    back = {c: x for c, x in alignment.byte_alphabet().items()}

    def tokens(t):
        if not t:
            return [], []
        x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        same = b"".join(p for _, p in x) == (" " + t).encode() == b"".join(p for _, p in y)
        return (x, y) if same else ([], [])
    return tokens


def plain_alignment(x, y):
    """(groups as text, linked id pairs) by walking both lists."""
    end_b, at = {}, 0
    for j, (_, p) in enumerate(y):
        at += len(p)
        end_b[at] = j
    groups, links, i0, j0, at = [], [], 0, 0, 0
    for i, (_, p) in enumerate(x):
        at += len(p)
        if at in end_b:
            j = end_b[at]
            groups.append(",".join(str(k) for k, _ in x[i0:i + 1]) + "|" + ",".join(str(k) for k, _ in y[j0:j + 1]))
            links.append((x[i][0], y[j][0]))
            i0, j0 = i + 1, j + 1
    return ";".join(groups), links


def test_alignment(docs, rows, plain_tokens):
    want, held = [], Counter()
    for i, t in rows:
        x, y = plain_tokens(t)
        groups, links = plain_alignment(x, y)
        held.update(links)
        want.append((i, len(x), len(y), groups, links))
    best = defaultdict(int)
    for (_, b), c in held.items():
        best[b] = max(best[b], c)
    want = bag((i, a, b, len(k), len(k), sum(held[p] == best[p[1]] for p in k), sum(held[p] for p in k),
                hashlib.sha256(g.encode()).hexdigest() if a else "") for i, a, b, g, k in want)
    for hot in (1, 50, alignment.HOT):  # all pairs shuffled, some, or none
        got = alignment.align(docs, keep=["doc_id", "lang"], hot=hot)
        assert bag(tuple(r[c] for c in ("doc_id", *alignment.NAMES)) for r in got.collect()) == want
    assert got.columns == ["doc_id", "lang", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256"]
    assert alignment.align(docs.filter("false")).isEmpty()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab'sT1 .\n\t é漢▁  <|>"), max_size=30))
def test_stretches_tokenise_like_the_text(plain_tokens, text):
    a = _aligner()
    x, y = plain_tokens(text)
    groups, links = plain_alignment(x, y)
    got = a.texts([text])[0]
    if not x:
        assert got == alignment.NONE
    else:
        assert got[:3] == (len(x), len(y), groups) and np.frombuffer(got[3], np.int64).tolist() == [i << 32 | j for i, j in links]


def test_both_merge_loops_give_the_same_ids():
    a = _aligner()
    latin = [chr(x) for x in range(0x180)]
    for x in latin:
        for t in (x, f"a{x}b", f"1{x} {x}{x}a", f" {x}'s{x}\n{x} ", f"{x} {x}  {x}"):
            assert a.fast_a.encode_ordinary(" " + t) == a.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
    draw = random.Random(8)
    for _ in range(3000):
        t = "".join(draw.choices(latin + [" ", "\n", "a", "e", "'", "1"] * 60, k=draw.randrange(40)))
        assert a.fast_a.encode_ordinary(" " + t) == a.a.encode(" " + t, add_special_tokens=False).ids, repr(t)


def _aligner(memo=[]):  # noqa: B006 - one for all examples
    if not memo:
        memo.append(alignment.Aligner())
    return memo[0]
