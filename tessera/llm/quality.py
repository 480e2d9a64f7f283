"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled good documents outside the held-out fifth;
unlabelled are documents of the web at large, drawn by hashed id whatever
their label.  With the class prior pi, a linear scorer g and the sigmoid loss
l, it minimises  pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]):  where
the second term falls below zero on a batch, the step goes back up its gradient
instead, as the non-negative estimator prescribes.

The prior is the share of good ones among the labelled documents outside the
held-out fifth (smoothed), since labels there are drawn from the same web; with
positives alone it is ``PRIOR``.  The scorer's offset and slope are then set by
Platt scaling on the same positives and unlabelled texts, weighted by the
prior, so that scores read as probabilities.

Features of a whole text are dense shares and means (see ``FEATURES``).  The
two samples hold at most ``SAMPLE_ROWS`` rows each, the only bound; scoring
covers every whole text.  Nulls are empty texts, with all features zero; null
labels are no labels, of several of one id the highest counts; without trusted
positives the score is ``PRIOR``.  Repeated rows get equal scores; further
columns go along, and columns of the input named score are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import P, drawn, held_out, written

SAMPLE_ROWS = 8_000
PRIOR = 0.5
SEED = 31
STEPS, BATCH, RATE = 3_000, 512, 0.05
FEATURES = ("same_as_before", "distinct", "capitals", "symbols", "bars", "exclaiming", "digits", "word_length",
            "stops", "lines", "repeated_lines", "length", "short", "top_word")


def text_features(text: str | None) -> list[float]:
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    has = lambda marks: sum(map(text.count, marks)) / n
    same = sum(map(str.__eq__, words, words[1:])) / n
    upper = sum(map(str.isupper, words)) / n
    return [min(1.0, 4 * same), len(count) / n ** 0.85, upper, min(2.0, has("#$%&*")), min(1.0, has("|")),
            min(1.0, has("!")), min(1.0, has("0123456789")), math.log(size / n), min(1.0, has(".?!")), len(lines) / n,
            1 - len(set(lines)) / max(1, len(lines)), math.log1p(n) / 8, 1.0 / n, max(count.values()) / n]


def add_features(df: DataFrame, text_col: str, out: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts])
    return df.withColumn(out, run(F.col(text_col)))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = SEED):
    """(weights, offset) of the linear scorer with the least non-negative risk."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(pos.shape[1]), 0.0
    mean, var = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        p, u = pos[rng.integers(len(pos), size=BATCH)], unl[rng.integers(len(unl), size=BATCH)]
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        rest = su.mean() - prior * sp.mean()  # the risk of the negatives; the loss of g as negative is sigmoid(g)
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        back = (du, -prior * dp)
        grad_u, grad_p = (back[0], back[1] - prior * dp) if rest >= 0 else (-back[0], -back[1])
        g = np.r_[grad_u @ u + grad_p @ p + (1e-3 * w if rest >= 0 else 0), grad_u.sum() + grad_p.sum()]
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        step = RATE * (mean / (1 - 0.9 ** t)) / (np.sqrt(var / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def platt(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of log odds in the score, from positives and unlabelled scores.

    The good share of unlabelled scores is their top ``prior`` part; the rest are bad.
    """
    u = np.sort(unl)
    cut = int(round((1 - prior) * len(u)))
    z = np.r_[u[:cut], u[cut:], pos]
    y = np.r_[np.zeros(cut), np.ones(len(u) - cut + len(pos))]
    weight = np.r_[np.ones(len(u)), np.full(len(pos), 0.5 * len(u) / max(1, len(pos)))]
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = np.array([((p - y) * z * weight).sum() + 0.05 * a, ((p - y) * weight).sum()])
        v = p * (1 - p) * weight
        h = np.array([[(v * z * z).sum() + 0.05, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        rows: int = SAMPLE_ROWS):
    """A function that adds ``score``, the probability of a good document, to a frame."""
    known = (labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias(P + "id")).agg(F.max(F.col(label).cast("double")).alias("y")))
    n, good = known.agg(F.count("y"), F.sum("y")).first()
    if not good:
        return lambda df: df.withColumn("score", F.lit(PRIOR))
    prior = (good + 1) / (n + 2) if good < n else PRIOR
    key = lambda s: F.xxhash64(P + "id", F.lit(SEED + s))
    trusted = known.filter("y = 1").select(P + "id")
    if good > rows:  # drawn from those that have a document
        trusted = written(trusted.join(docs.select(F.col(id_col).alias(P + "id")).distinct(), P + "id", "left_semi"), "trusted")
        good = trusted.count()
    trusted = drawn(trusted, key(0), good, rows).limit(2 * rows)
    web = docs.select(F.col(id_col).alias(P + "id"), F.col(text_col).alias(P + "text")).filter(~held_out(P + "id"))
    pos = add_features(web.join(F.broadcast(trusted), P + "id"), P + "text", "f").select("f")
    unl = add_features(drawn(web, key(1), docs.count(), rows).limit(2 * rows), P + "text", "f").select("f")
    x, u = (np.array([r["f"] for r in s.toPandas().to_dict("records")], float).reshape(-1, len(FEATURES)) for s in (pos, unl))
    if not len(x) or not len(u):
        return lambda df: df.withColumn("score", F.lit(float(prior)))
    order = lambda m: m[np.lexsort(m.T)]  # noqa: E731  the samples come in any order
    x, u = order(x), order(u)
    mid, wide = u.mean(axis=0), u.std(axis=0) + 1e-6
    x, u = np.clip((x - mid) / wide, -6, 6), np.clip((u - mid) / wide, -6, 6)
    w, b = fit_nnpu(x, u, prior)
    a, c = platt(x @ w + b, u @ w + b, prior)

    def score(df: DataFrame) -> DataFrame:
        cols = [k for k in df.columns if k != "score"]

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                f = np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))
                yield pd.Series(_sigmoid(a * (np.clip((f - mid) / wide, -6, 6) @ w + b) + c))
        return df.select(*cols, run(F.col(text_col)).alias("score"))
    return score
