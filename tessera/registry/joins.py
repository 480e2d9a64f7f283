"""J1-J13 joins and U1-U6 set operations."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import reshape as R
from tessera.plans import reconcile as rc
from tessera.plans.fixtures import COMPONENTS, MATCHES_SQL, PREDICTIONS_SQL, matches, predictions, row_key
from tessera.registry import register
from tessera.registry.flagship import _PAIRS_SQL, _pairs
from tessera.sources.tables import table

_ROWID = ("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
          "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))")


@register("j1_strict_lookup_report", """
SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NULL AS missing
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j1(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return J.strict_lookup(docs, table(spark, d, "labels"), "doc_id", ["quality", "toxic"], on_miss="report")


@register("j2_defaulted_lookup", """
SELECT d.doc_id, round(coalesce(CAST(l.quality AS DOUBLE), (SELECT avg(quality) FROM labels)), 6) AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j2(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    r = J.defaulted_lookup(docs, table(spark, d, "labels"), "doc_id", "quality", default="mean")
    return r.select("doc_id", F.round("quality", 6).alias("quality"))


@register("j3_multi_dictionary", """
SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def j3(spark, d):
    c = table(spark, d, "customer")
    n = F.broadcast(table(spark, d, "nation"))  # fixed-size dimensions
    r = F.broadcast(table(spark, d, "region"))
    return J.multi_lookup(c, [(n, "c_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")]) \
        .select("c_custkey", "n_name", "r_name")


@register("j4_membership_weight", f"""
SELECT {_ROWID} AS row_id, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
  THEN CAST(0.25 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS sample_weight FROM lineitem""")
def j4(spark, d):
    li = table(spark, d, "lineitem").withColumn("row_id", row_key())
    promo = table(spark, d, "part").where(F.col("p_type") == "PROMO")
    return J.membership_weight(li, "l_partkey", promo, "p_partkey", 0.25).select("row_id", "sample_weight")


@register("j5_anti_join", f"""
SELECT {_ROWID} AS row_id FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def j5(spark, d):
    li = table(spark, d, "lineitem")
    done = table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return li.join(done, "l_orderkey", "left_anti").select(
        row_key().alias("row_id"))


_J6_DIM = "SELECT sha256(text) AS h, doc_id AS match_id FROM documents"


@register("j6_exactly_one_match", f"""
WITH dim AS ({_J6_DIM}), c AS (SELECT h FROM dim GROUP BY h HAVING count(*) = 1)
SELECT l.doc_id, dim.match_id FROM (SELECT doc_id, sha256(text) AS h FROM documents) l
JOIN dim ON l.h = dim.h WHERE l.h IN (SELECT h FROM c)""")
def j6(spark, d):
    """Documents looked up by text hash in the documents dictionary: texts
    with copies have several matches and are skipped."""
    docs = table(spark, d, "documents")
    left = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    dim = docs.select(F.sha2("text", 256).alias("h"), F.col("doc_id").alias("match_id"))
    joined, _ = J.exactly_one(left, dim, "h")
    return joined.select("doc_id", "match_id")


@register("j6_match_counters", f"""
WITH dim AS ({_J6_DIM}), c AS (SELECT h, count(*) AS cnt FROM dim GROUP BY h),
l AS (SELECT sha256(text) AS h FROM benchmark UNION ALL SELECT sha256(text) FROM documents)
SELECT count(*) FILTER (WHERE cnt = 1) AS matched, count(*) FILTER (WHERE cnt IS NULL) AS missing,
       count(*) FILTER (WHERE cnt > 1) AS multiple FROM l LEFT JOIN c USING (h)""")
def j6c(spark, d):
    docs = table(spark, d, "documents")
    left = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("h")).unionByName(
        docs.select(F.sha2("text", 256).alias("h")))
    dim = docs.select(F.sha2("text", 256).alias("h"), F.col("doc_id").alias("match_id"))
    return J.exactly_one(left, dim, "h")[1]


@register("j7_one_to_many", f"""
SELECT p.p_partkey, p.p_name, m.agent1, m.agent2 FROM part p JOIN ({MATCHES_SQL}) m ON p.p_partkey = m.game""")
def j7(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    m = matches(spark, d).select(F.col("game").alias("p_partkey"), "agent1", "agent2")
    return p.join(m, "p_partkey")


@register("j8_rowid_alignment", f"""
WITH p AS ({PREDICTIONS_SQL})
SELECT a.row_id, a.p1, b.p2 FROM (SELECT row_id, p1 FROM p) a JOIN (SELECT row_id, p2 FROM p) b USING (row_id)""")
def j8(spark, d):
    p = predictions(spark, d)
    return p.select("row_id", "p1").join(p.select("row_id", "p2"), "row_id")


_SEL_PAIRS = [(a, b) for a in COMPONENTS["selection"] for b in COMPONENTS["selection"]]


@register("j9_task_grid", "SELECT p_partkey, a AS agent_a, b AS agent_b FROM part, (VALUES "
          + ", ".join(f"('{a}', '{b}')" for a, b in _SEL_PAIRS) + ") AS t(a, b)")
def j9(spark, d):
    """Items × a parameter list of option pairs: an explode of the bounded
    list, not a join."""
    pairs = F.array(*[F.struct(F.lit(a).alias("agent_a"), F.lit(b).alias("agent_b")) for a, b in _SEL_PAIRS])
    return table(spark, d, "part").select("p_partkey", F.explode(pairs).alias("t")).select(
        "p_partkey", "t.agent_a", "t.agent_b")


@register("j11_first_match_lookup", f"""
WITH f AS (SELECT p_name, p_retailprice AS ref_price FROM
  (SELECT p_name, p_retailprice, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1)
SELECT {_ROWID} AS row_id, f.ref_price FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN f ON p.p_name = f.p_name""")
def j11(spark, d):
    li = table(spark, d, "lineitem").withColumn("row_id", row_key())
    part = table(spark, d, "part")
    named = li.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    dim = part.select("p_name", "p_partkey", F.col("p_retailprice").alias("ref_price"))
    return J.first_match(named, dim, "p_name", ["p_partkey"]).select("row_id", "ref_price")


@register("j12_run_self_join", f"WITH {_PAIRS_SQL} SELECT key, run, feature, a, b FROM pairs")
def j12(spark, d):
    return _pairs(spark, d).select("key", "run", "feature", "a", "b")


@register("j13_keys_in_all_runs", """
SELECT l_partkey FROM lineitem GROUP BY l_partkey
HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)""")
def j13(spark, d):
    return J.keys_in_all(table(spark, d, "lineitem"), "l_partkey", "l_linenumber")


# ---- set operations ------------------------------------------------------

@register("u1_distinct", "SELECT DISTINCT p_name FROM part")
def u1(spark, d):
    return table(spark, d, "part").select("p_name").distinct()


@register("u2_distinct_union", f"""
SELECT agent1 AS value FROM ({MATCHES_SQL}) UNION SELECT agent2 FROM ({MATCHES_SQL})""")
def u2(spark, d):
    return R.distinct_union(matches(spark, d), "agent1", "agent2")


_RUNS = range(1, 8)


@register("u3_intersect", " INTERSECT ".join(f"SELECT l_partkey FROM lineitem WHERE l_linenumber = {r}" for r in _RUNS))
def u3(spark, d):
    """Keys that every run has."""
    li = table(spark, d, "lineitem")
    return reduce(DataFrame.intersect, [li.where(F.col("l_linenumber") == r).select("l_partkey") for r in _RUNS])


@register("u4_except", """
SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 7""")
def u4(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").subtract(li)


_U5_SQL = f"""
SELECT row_id AS key, utility AS y, 'train' AS source, CAST(1.0 AS DOUBLE) AS sample_weight FROM ({MATCHES_SQL})
UNION ALL SELECT CAST(event_id AS VARCHAR), value / 500.0, 'extra', CAST(0.25 AS DOUBLE) FROM events"""


def _u5(spark, d):
    train = matches(spark, d).select(F.col("row_id").alias("key"), F.col("utility").alias("y"))
    extra = table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"),
                                             (F.col("value") / 500.0).alias("y"))
    return R.bag_union({"train": (train, 1.0), "extra": (extra, 0.25)})


register("u5_bag_union", _U5_SQL)(_u5)


@register("u6_split_by_source", f"SELECT key, y, source, sample_weight FROM ({_U5_SQL}) WHERE source = 'extra'")
def u6(spark, d):
    return R.split_by_source(_u5(spark, d), "source", "extra")
