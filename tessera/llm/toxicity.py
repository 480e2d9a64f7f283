"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text: density and number of words from a learned lexicon
(whole words, and word beginnings for inflected forms), its strongest entry,
its nearness to second-person words, shares of capitals, punctuation and
symbols, the rate of obfuscated words (letters mixed with digits or masking
signs), and the density once such signs are read as letters.

The lexicon is counted on Spark over a bounded, hashed sample of the labelled
documents (``SAMPLE_ROWS``, the only bound).  Each half of the sample gets its
features from a lexicon of the other half, so the trees never see an entry that
their own documents brought in; the trees are fitted on seven tenths and the
isotonic calibration on the rest.  Scoring covers every whole text.

Nulls are empty texts; an empty text has all features zero and gets a score
like any other.  Labels that are null are no labels; of several labels of one
id the highest counts.  With only one class the score is that class's share.
Without any label among the documents nothing tells a toxic one: the score is
``UNKNOWN``, which keeps every document, and a warning says so.  Repeated rows get equal scores; further
columns go along, and columns of the input named score are replaced.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import P, drawn, held_out, written

SAMPLE_ROWS = 12_000
UNKNOWN = 0.0
LEXICON = 600
STEMS = (4, 5, 6)
TREES, DEPTH, SEED = 20, 4, 7
WORDS = re.compile(r"[^\W_]+")
MASK = re.compile(r"(?<=[^\W\d_])[0-9@$*!|+]+(?=[^\W\d_])")
#: Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset(("you", "your", "yours", "yourself", "u", "tu", "toi", "ton", "te", "vous", "votre",
                           "du", "dich", "dir", "dein", "euch", "ihr", "tú", "ti", "usted", "ustedes", "vosotros"))
#: Signs read as the letters they stand for.
LEET = str.maketrans("013457@$!|", "oieastasii")
FEATURES = ("density", "hits", "strongest", "beside_you", "capitals", "punctuation", "symbols", "masked", "unmasked", "length")


def masked_words(text: str) -> list[str]:
    """Words with masking signs between their letters: the letters around each sign."""
    found, end = [], 0
    for m in MASK.finditer(text):
        a, b = m.span()
        if a < end:  # within the word before
            continue
        while a and (text[a - 1].isalpha()):
            a -= 1
        while b < len(text) and (text[b].isalpha() or text[b] in "0123456789@$*!|+"):
            b += 1
        found.append(text[a:b])
        end = b
    return found


def stems(word: str) -> list[str]:
    """The lexicon keys of a lower-case word: the word itself and its beginnings."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


class Scorer:
    """Turns texts into feature rows; remembers the weight of words it has seen."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 500_000:
                self.known.clear()
            get = self.lexicon.get  # the keys of ``stems``; a shorter word's beginnings are the word, and no key
            w = self.known[word] = max(get("=" + word, 0.0), *[get(word[:n], 0.0) for n in STEMS])
        return w

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        if not text:
            return [0.0] * len(FEATURES)
        cased = WORDS.findall(text)
        words = "\n".join(cased).lower().split("\n")
        known = self.known
        weights = [known[w] if w in known else self.weight(w) for w in words]
        n, size = max(len(words), 1), len(text)
        where = [i for i, w in enumerate(weights) if w]
        you = sum(any(x in SECOND_PERSON for x in words[max(0, i - 5):i + 6]) for i in where)
        marks = max(0, size - sum(map(len, words)) - sum(map(text.count, " \n\t\r")))
        symbols = sum(map(text.count, "#$%&*|@"))
        masked = masked_words(text)
        seen = sum(self.weight(m.lower().translate(LEET)) > 0 for m in masked)
        return [sum(weights) / n, math.log1p(len(where)), max(weights, default=0.0), you / n,
                sum(map(str.isupper, cased)) / n, marks / size, symbols / size,
                len(masked) / n, math.log1p(len(where) + seen), math.log1p(n)]


def add_features(df: DataFrame, lexicon: dict[str, float], text_col: str, out: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(lexicon)
        for texts in parts:
            yield pd.Series([scorer.features(t) for t in texts])
    return df.withColumn(out, run(F.col(text_col)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str,
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, y, draw) of about ``rows`` labelled documents outside the held-out fifth, by hashed id.

    Of more labelled ids than that, those are drawn from that have a document.
    Labels of about ``rows`` ids are broadcast, a bound by construction.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias(P + "id")).agg(F.max(F.col(label).cast("double")).alias("y")))
    n = known.count()
    if n > rows:
        known = written(known.join(docs.select(F.col(id_col).alias(P + "id")).distinct(), P + "id", "left_semi"), "labels")
        n = known.count()
    chosen = drawn(known, F.xxhash64(P + "id", F.lit(SEED)), n, rows).limit(2 * rows)
    return written(docs.join(F.broadcast(chosen), F.col(id_col) == F.col(P + "id"))
                   .groupBy(P + "id").agg(F.first("y").alias("y"), F.first(text_col).alias("text"))
                   .withColumn("draw", F.pmod(F.xxhash64(P + "id", F.lit(SEED + 1)), F.lit(10))), "labelled")


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """The ``size`` keys that mark label 1 most surely, weighted by their smoothed log ratio."""
    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({s for w in set(WORDS.findall((t or "").lower())) for s in stems(w)}) for t in texts])

    n = sample.agg(F.sum("y"), F.count("y")).first()
    pos, neg = float(n[0] or 0), float((n[1] or 0) - (n[0] or 0))
    if not pos or not neg:
        return {}
    counts = (sample.select("y", F.explode(keys("text")).alias("k")).groupBy("k")
              .agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).filter("p >= 3")).checkpoint()
    # so many marked documents that chance would not bring them together for any of the keys
    least = (math.log(counts.count() + 20) + 6) / math.log((pos + neg) / pos)
    ratio = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))
    best = (counts.withColumn("w", ratio).filter((F.col("p") >= least) & (F.col("w") > 1.5) & (F.col("q") <= 0.02 * F.col("p") + 0.5))
            .orderBy(F.desc(F.col("w") * F.log1p("p")), "k").limit(size).collect())
    return {r["k"]: float(r["w"]) for r in best}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        rows: int = SAMPLE_ROWS):
    """A function that adds ``score`` to a frame."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, rows)
    classes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("y").alias("n")).collect()}
    if not classes:
        warnings.warn(f"toxicity: no labelled document to learn from, every score is {UNKNOWN}", stacklevel=2)
    if len(classes) < 2:
        flat = float(next(iter(classes), UNKNOWN))
        return lambda df: df.withColumn("score", F.lit(flat))
    lexicon = learn_lexicon(sample)
    even, odd = sample.filter("draw % 2 = 0"), sample.filter("draw % 2 = 1")
    crossed = add_features(even, learn_lexicon(odd), "text", "f").union(add_features(odd, learn_lexicon(even), "text", "f"))
    ready = written(crossed.select("y", "draw", array_to_vector("f").alias("features")), "features")
    gbt = GBTClassifier(labelCol="y", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.2)
    part = ready.filter("draw < 7") if ready.filter("draw < 7").select("y").distinct().count() == 2 else ready
    model = gbt.fit(part.repartition(2))
    raw = vector_to_array("probability")[1]
    rest = ready.filter("draw >= 7") if ready.filter("draw >= 7").select("y").distinct().count() == 2 else ready
    iso = IsotonicRegression(labelCol="y", featuresCol="p", predictionCol="iso").fit(
        model.transform(rest).select("y", raw.alias("p")).coalesce(1))

    def score(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c != "score"]
        f = add_features(df.select(*cols), lexicon, text_col, P + "f")
        f = f.select(*cols, array_to_vector(P + "f").alias(P + "v"))
        f = model.setFeaturesCol(P + "v").setPredictionCol(P + "y").setProbabilityCol(P + "pr").setRawPredictionCol(P + "raw").transform(f)
        f = f.select(*cols, vector_to_array(P + "pr")[1].alias(P + "p"))
        f = iso.setFeaturesCol(P + "p").setPredictionCol(P + "iso").transform(f)
        # calibration ties whole stretches; the trees' own score keeps their order
        return f.select(*cols, (F.lit(0.98) * F.least(F.greatest(P + "iso", F.lit(0.0)), F.lit(1.0)) + F.lit(0.02) * F.col(P + "p")).alias("score"))
    return score
