"""Bracket spans and layout by depth, against a stack and a recursive layout."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.brackets import layout, spans
from tessera.operators.text import fim_samples

LONG = "(rules " + " ".join(f"(move Add{i} (to (sites Empty)))" for i in range(9)) + ")"
CASES = [
    None, "", "no brackets", "(a)", "a(b(c)d)e(", ")(", "(a) (b)", "(a (b)", "(a (b) )", " (a (b))", "(a (b)) ", "(a (b)) x",
    "(game \"X\" (players 2) (equipment {(board (square 3)) (piece \"Disc\" Each)}) (rules (play (move Add))))",
    f"(game \"X\" (players 2) {LONG})", f"(game  \"X\"   (players 2)  lead:  {LONG}  tail )", f"(game (a) lead:{LONG} (b) more {LONG} (c){LONG})",
    f"(game (a) {{ {LONG} {LONG} }} (b {{(a (b)) {{ {LONG} }} }}))", "(" * 6 + "x" * 300 + ")" * 6,
    "(game (a) name:(only " + "x" * 250 + "))", "(game (a) " + "n" * 190 + ":(b (c)) )", "(ü (ß " + "é" * 198 + ") (né (é " + "é" * 193 + ")))",
]


def stack_spans(text):
    out, stack = [], []
    for i, c in enumerate(text or "", 1):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            out.append((stack.pop(), i))
    return sorted(out)


def is_one(text):
    pairs = stack_spans(text)
    return bool(pairs) and (1, len(text)) in pairs and 2 * len(pairs) == text.count("(") + text.count(")")


def lines_of(s):
    """The lines of one section: what leads its first bracket, if anything, else the bracket with its head."""
    if s.count("(") == 1:
        return [s]
    first = s.index("(", 1)
    lines, at, depth, start = [s[:first].rstrip(" ")], first, 0, first
    while at < len(s):
        depth += {"(": 1, ")": -1}.get(s[at], 0)
        if s[at] == ")" and depth == 0:
            child = s[start:at + 1].lstrip(" ")
            lines += ["\t" + x for x in (lines_of(child) if len(child) > 200 else [child])]
            start = at + 1
        at += 1
    return lines + [s[start:].lstrip(" ")]


def made_up(rng, depth):
    inner = "".join(rng.choice(["", " ", "  ", " w", " key:", " {"]) + made_up(rng, depth - 1) for _ in range(rng.randrange(4))) if depth else ""
    return "(" + "n" * rng.randrange(1, 40) + inner + rng.choice(["", " ", " }"]) + ")"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    found = CASES + [made_up(rng, 5) for _ in range(150)]
    found += ["".join(rng.choice("()a ") for _ in range(rng.randrange(30))) for _ in range(100)]
    rows = list(enumerate(found + found[:40]))
    return rows, spark.createDataFrame(rows, "id long, t string")


def test_spans_equal_a_stack(texts):
    rows, df = texts
    got = {}
    for r in spans(df, "id", "t", "x").collect():
        assert r.x == rows[r.id][1][r.start - 1:r.end]
        got.setdefault(r.id, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {i: stack_spans(t) for i, t in rows if stack_spans(t)}


def test_layout_equals_recursion(texts):
    rows, df = texts
    got = {r.id: r for r in layout(df, "t").collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        one = t is not None and is_one(t)
        assert got[i].laid_out == one
        assert got[i].layout == ("\n".join(lines_of(t)) if one else t), t
    assert sum(r.laid_out and "\t\t" in r.layout for r in got.values()) > 50
    assert any(r.laid_out and "\n\t\t\n" in r.layout for r in got.values())  # a led expression's empty last line


def test_deep_nesting(spark):
    deep = spark.createDataFrame([(1, "(" * 100_000 + ")" * 100_000)], "id long, t string")
    s = spans(deep, "id", "t")
    assert s.count() == 100_000 and s.where(F.col("start") + F.col("end") != 200_001).count() == 0
    lines = layout(spark.createDataFrame([("(a" * 3000 + ")" * 3000,)], "t string"), "t").first().layout.split("\n")
    assert max(len(x) - len(x.lstrip("\t")) for x in lines) > 2900


def test_one_shuffle(spark, texts):
    plan = spans(texts[1], "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fim_sequences_put_together(spark, texts):
    rows, df = texts
    f = fim_samples(df, "id", "t", 3, 41, 5, 0, "id").collect()
    assert len(f) == 3 * sum(bool(stack_spans(t)) for _, t in rows)
    for r in f:
        t = rows[r.id][1]
        assert r.prefix + r.middle + r.suffix == t
        assert (len(r.prefix) + 1, len(r.prefix) + len(r.middle)) in stack_spans(t)
        assert r.split == ("validation" if r.id % 5 == 0 else "train")
