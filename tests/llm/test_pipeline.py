"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import brute
import pytest
import corpus_pipeline as cp
from conftest import SMALL
from pyspark.sql import functions as F
from tessera.llm.common import written
from tessera.llm.queries import QUERIES


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(8001, None, None, None, None), (8002, "", "en", "src1", 0), (8003, "twice", "en", "src1", 5),
                                 (8003, "twice", "en", "src1", 5), (None, "no id but a few words", "en", None, 1)], docs.schema)
    docs = written(docs.union(odd), "stage_in")
    columns = docs.columns
    kept = []
    for name, stage in cp.STAGES:
        after = written(stage(spark, docs, SMALL), "stage_out")
        kept.append((docs.toPandas(), after.toPandas()))
        if name != cp.STAGES[-1][0]:
            assert after.columns == columns
        docs = after
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = kept
    assert 0.8 * len(d0) < len(d1) <= len(d0)
    prints = [brute.fingerprint(t) for t in d1["text"]]
    ids = d1["doc_id"].tolist()
    least = {}
    for i, c in zip(ids, brute.classes(prints)):
        least[c] = min(least.get(c, 1e18), i if i == i else 1e18)
    assert sorted(d2["doc_id"].fillna(1e18)) == sorted(least.values())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [i for i, x in zip(d2["doc_id"], brute.contamination(d2["text"], bench)) if not x[4]]
    assert sorted(map(repr, clean)) == sorted(map(repr, d3["doc_id"]))
    size = [len(brute.words(t)) for t in d3["text"]]
    weight = [max(0.05, 1.0 - 4.0 * (sum(c in "#$%&*|!" for c in t or "") / max(len(t or ""), 1))) for t in d3["text"]]
    key = [None if i != i else int(i) for i in d3["doc_id"]]
    src = [None if s != s else s for s in d3["source"]]
    want = Counter()
    for i, n, k in zip(key, size, brute.taken(list(zip(key, src, size, weight, d3["text"])))):
        if k:
            want[i] += k // n
    assert want == Counter(None if i != i else int(i) for i in d4["doc_id"])
    assert len(d5) == len(d4)
    for _, g in d5.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert d5.groupby("doc_id")["shard"].nunique().max() == 1


def test_no_labels_keep_documents(spark, tmp_path):
    """An empty labels table, and labels of other documents only: nothing is rejected unseen."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, some in (("none", labels.filter("false")), ("others", labels.withColumn("doc_id", -1 - F.col("doc_id")))):
        some.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        with pytest.warns(UserWarning, match="no labelled document"):
            kept = cp.toxic(spark, docs, f"{tmp_path}/{name}")
        assert kept.count() == docs.count()
        assert QUERIES["op8_toxicity"][0](spark, f"{tmp_path}/{name}").filter("predicted = 1 or score is null").isEmpty()


def test_run_ends_as_its_stages(spark):
    out = cp.run(spark, SMALL)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("x")).filter("x <> 0").isEmpty()
