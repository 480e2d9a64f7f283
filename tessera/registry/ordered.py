"""W1-W11 ordered operators, folds and splits; T1-T6 sorts and draws; K4."""

from pyspark.sql import functions as F

from tessera.functions.hashing import sql_hash_int
from tessera.operators import folds as W
from tessera.operators import ordered as O
from tessera.plans.fixtures import MATCHES_SQL, matches
from tessera.registry import register
from tessera.registry.aggs import FOLD_SQL
from tessera.session import fresh_path
from tessera.sources import sinks
from tessera.sources.tables import table

M = f"m AS ({MATCHES_SQL})"


@register("w1_dedup_keep_first", """
SELECT doc_id, h FROM (SELECT doc_id, sha256(text) AS h,
  row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def w1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return O.dedup_first(docs, ["h"], ["doc_id"]).select("doc_id", "h")


@register("w2_group_kfold", f"""WITH f AS ({FOLD_SQL(10, 42, 'o_custkey', 'orders')})
SELECT o_orderkey, fold FROM orders JOIN f USING (o_custkey)""")
def w2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return W.group_kfold(o, "o_custkey", 10, 42).select("o_orderkey", "fold")


@register("w3_heldout_run_rotation", f"""WITH {M}
SELECT fold, CASE WHEN fold % 7 = run - 1 THEN 'test' ELSE 'train' END AS role, count(*) AS n,
       CAST(sum(run) AS BIGINT) AS run_sum
FROM m, (SELECT unnest(range(10)) AS fold) GROUP BY 1, 2""")
def w3(spark, d):
    r = W.heldout_run_rotation(matches(spark, d).select("row_id", "run"), "run", 10, 7)
    return r.groupBy(F.col("fold").cast("bigint").alias("fold"), "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("run").cast("bigint").alias("run_sum"))


@register("w4_balanced_group_folds", """
WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY size DESC, o_custkey) - 1 AS r FROM s),
f AS (SELECT o_custkey, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS BIGINT) AS fold FROM r)
SELECT o_orderkey, fold FROM orders JOIN f USING (o_custkey)""")
def w4(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return W.balanced_group_folds(o, "o_custkey", 5).select("o_orderkey", "fold")


@register("w5_row_folds_hash", f"""WITH {M}
SELECT row_id, {sql_hash_int(3, 'row_id')} % 5 AS fold FROM m""")
def w5h(spark, d):
    return W.row_folds(matches(spark, d).select("row_id"), "row_id", 5, 3)


@register("w5_row_folds_exact", f"""WITH {M}
SELECT row_id, CAST(ntile(5) OVER (ORDER BY md5('3|' || row_id), row_id) - 1 AS BIGINT) AS fold FROM m""")
def w5e(spark, d):
    return W.row_folds(matches(spark, d).select("row_id"), "row_id", 5, 3, exact=True)


_T5 = "SELECT h, CAST(row_number() OVER (ORDER BY h) - 1 AS BIGINT) AS \"index\" FROM (SELECT DISTINCT sha256(text) AS h FROM documents)"


@register("t5_stable_index", _T5)
def t5(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("h"))
    d2 = docs.distinct()
    return O.rank_by_hash(d2, "h", out="index", total=None)


@register("w6_index_mod_folds", f"SELECT h, \"index\", \"index\" % 4 AS fold FROM ({_T5})")
def w6(spark, d):
    return W.index_mod_folds(t5(spark, d), "index", 4)


@register("w7_group_holdout", """
WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('8|' || CAST(o_custkey AS VARCHAR))) - 1 AS r,
                  count(*) OVER () AS total FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, r < ceil(total * 0.2) AS is_test FROM orders JOIN g USING (o_custkey)""")
def w7(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return W.group_holdout(o, "o_custkey", 0.2, 8).select("o_orderkey", "is_test")


@register("w8_average_rank", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS avg_rank
FROM lineitem""")
def w8(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return O.average_rank(li, "l_extendedprice").drop("l_extendedprice")


_LO, _HI, _N = -0.4, 0.4, 40
_CELL = lambda e: (f"least({_N - 1}, greatest(0, CAST(trunc(least({_N}, greatest(-1, ({e} - ({_LO})) / "  # noqa: E731
                   f"({_HI} - ({_LO})) * {_N}))) AS INTEGER)))")


def _cells(spark, d):
    e = table(spark, d, "embeddings")
    x, y = F.col("embedding")[0], F.col("embedding")[1]
    return e.select("vec_id", "label", O.grid_cell(x, _LO, _HI, _N).alias("cell_x"),
                    O.grid_cell(y, _LO, _HI, _N).alias("cell_y"), F.col("embedding")[2].alias("fitness"))


@register("w9_grid_elites", f"""
SELECT cell_x, cell_y, fitness, vec_id FROM (
  SELECT {_CELL('embedding[1]')} AS cell_x, {_CELL('embedding[2]')} AS cell_y, embedding[3] AS fitness, vec_id,
         row_number() OVER (PARTITION BY {_CELL('embedding[1]')}, {_CELL('embedding[2]')}
                            ORDER BY embedding[3] DESC, vec_id) AS rn FROM embeddings) WHERE rn = 1""")
def w9(spark, d):
    return O.grid_elites(_cells(spark, d), ["cell_x", "cell_y"], "fitness", [], ["vec_id"])


@register("w10_elite_merge_report", f"""
WITH c AS (SELECT {_CELL('embedding[1]')} AS cell_x, {_CELL('embedding[2]')} AS cell_y, label AS generation,
                  max(embedding[3]) AS best FROM embeddings GROUP BY 1, 2, 3),
p AS (SELECT *, max(best) OVER (PARTITION BY cell_x, cell_y ORDER BY generation
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c)
SELECT generation, CAST(sum(CASE WHEN prev IS NULL OR best > prev THEN 1 ELSE 0 END) AS BIGINT) AS cells_taken,
       count(*) AS cells_tried FROM p GROUP BY generation""")
def w10(spark, d):
    c = _cells(spark, d).withColumnRenamed("label", "generation")
    return O.elite_merge_report(c, ["cell_x", "cell_y"], "generation", "fitness")


@register("w10_merged_elites", f"""
WITH c AS (SELECT {_CELL('embedding[1]')} AS cell_x, {_CELL('embedding[2]')} AS cell_y, embedding[3] AS fitness, label AS generation, vec_id
           FROM embeddings),
b AS (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY fitness DESC, generation, vec_id) AS rn FROM c)
SELECT cell_x, cell_y, fitness, generation, vec_id FROM b
WHERE rn = 1 AND vec_id NOT IN (SELECT vec_id FROM c WHERE generation = (SELECT min(generation) FROM c))""")
def w10_merged(spark, d):
    """The merged elite grid; elites that are among the first generation's candidates are left out."""
    c = _cells(spark, d).withColumnRenamed("label", "generation")
    return O.merged_elites(c, ["cell_x", "cell_y"], "generation", "fitness", "vec_id")


_IMP_FEATS = ["l_quantity", "l_extendedprice", "l_tax", "run", "agent1_idx", "agent2_idx"]


def _fold_train_corr(spark, d):
    """|corr(feature, y)| on each fold's training rows, from per-fold
    sufficient statistics (train = total − own fold): no row replication."""
    from pyspark.sql import Window
    m = W.group_kfold(matches(spark, d), "game", 5, 4)
    long = m.unpivot(["fold", "utility"], _IMP_FEATS, "feature", "x").withColumn("x", F.col("x").cast("double"))
    y = F.col("utility")
    s = long.groupBy("fold", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"),
                                           F.sum(y).alias("sy"), F.sum(F.col("x") * y).alias("sxy"),
                                           F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(y * y).alias("syy"))
    w = Window.partitionBy("feature")
    for c in ("n", "sx", "sy", "sxy", "sxx", "syy"):
        s = s.withColumn(f"t_{c}", F.sum(c).over(w) - F.col(c))
    n, sx, sy = F.col("t_n"), F.col("t_sx"), F.col("t_sy")
    cov = F.col("t_sxy") - sx * sy / n
    r = cov / F.sqrt((F.col("t_sxx") - sx * sx / n) * (F.col("t_syy") - sy * sy / n))
    return s.select("fold", "feature", F.abs(r).alias("importance"))


@register("w11_topk_importance", f"""WITH {M},
f AS (SELECT m.*, k.fold FROM m JOIN ({FOLD_SQL(5, 4, 'game', 'm')}) k USING (game)),
t AS (SELECT f.fold AS fold, """ + ", ".join(
    f"abs(corr(CAST(g.{c} AS DOUBLE), g.utility)) AS {c}" for c in _IMP_FEATS) + """
      FROM (SELECT DISTINCT fold FROM f) f JOIN f g ON g.fold <> f.fold GROUP BY f.fold),
l AS (UNPIVOT t ON """ + ", ".join(_IMP_FEATS) + """ INTO NAME feature VALUE importance)
SELECT fold, feature, round(importance, 6) AS importance, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS BIGINT) AS rank FROM l)
WHERE rank <= 3""")
def w11(spark, d):
    imp = _fold_train_corr(spark, d)
    r = O.top_k_per_group(imp, ["fold"], "importance", "feature", 3)
    return r.select("fold", "feature", F.round("importance", 6).alias("importance"), "rank")


@register("t1_sort", f"""WITH {M} SELECT row_id, l_extendedprice FROM m ORDER BY l_extendedprice DESC, row_id""")
def t1(spark, d):
    return matches(spark, d).select("row_id", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "row_id")


@register("t2_sample_k", """
SELECT doc_id FROM documents ORDER BY md5('13|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 20""")
def t2(spark, d):
    return W.sample_k(table(spark, d, "documents").select("doc_id"), "doc_id", 20, 13)


_SEL = ["UCB1", "UCB1GRAVE", "ProgressiveHistory", "UCB1Tuned"]


@register("t3_categorical_draw", f"""WITH {M}
SELECT row_id, {[*_SEL]}[1 + {sql_hash_int(21, 'row_id')} % 4] AS drawn FROM m""".replace('"', "'"))
def t3(spark, d):
    return matches(spark, d).select("row_id", W.categorical_draw(_SEL, 21, "row_id").alias("drawn"))


_T4_SQL = f"""
w AS (SELECT s_suppkey, CAST(round(s_acctbal * 1000000) AS BIGINT) AS wi FROM supplier WHERE round(s_acctbal * 1000000) > 0),
c AS (SELECT s_suppkey, sum(wi) OVER (ORDER BY s_suppkey) AS hi, sum(wi) OVER (ORDER BY s_suppkey) - wi AS lo FROM w),
tot AS (SELECT max(hi) AS total FROM c),
t AS (SELECT o_orderkey, ({sql_hash_int(17, 'CAST(o_orderkey AS VARCHAR)')}::HUGEINT * total) // 4294967296 AS r FROM orders, tot),
a AS (SELECT t.o_orderkey, c.s_suppkey AS worker FROM t JOIN c ON t.r >= c.lo AND t.r < c.hi)"""


@register("t4_weighted_bucket", f"WITH {_T4_SQL} SELECT o_orderkey, worker FROM a")
def t4(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    s = table(spark, d, "supplier")
    return W.weighted_bucket(o, "o_orderkey", s, "s_suppkey", "s_acctbal", 17).select("o_orderkey", "worker")


@register("k4_per_worker_sink", f"WITH {_T4_SQL} SELECT worker, count(*) AS n_tasks FROM a GROUP BY worker")
def k4(spark, d):
    path = sinks.write_per_worker(t4(spark, d), "worker", fresh_path(spark, "workers"))
    back = spark.read.schema("o_orderkey long, worker long").json(path)
    return back.groupBy("worker").agg(F.count(F.lit(1)).alias("n_tasks"))


@register("t6_fewshot_draws", """
WITH ex AS (SELECT item_id, row_number() OVER (ORDER BY md5('9|' || CAST(item_id AS VARCHAR)), item_id) - 1 AS pos
            FROM benchmark),
n AS (SELECT count(*) AS n FROM benchmark),
r AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id, shot, (('0x' || substr(md5('9|' || CAST(conv_id AS VARCHAR)), 1, 8))::BIGINT + shot) % n AS pos
      FROM r, n, (SELECT unnest(range(3)) AS shot))
SELECT conv_id, CAST(shot AS INTEGER) AS shot, item_id FROM s JOIN ex USING (pos)""")
def t6(spark, d):
    req = table(spark, d, "conversations").select("conv_id").distinct()
    ex = table(spark, d, "benchmark").select("item_id")
    return W.fewshot_draws(req, "conv_id", ex, "item_id", 3, 9).select("conv_id", "shot", "item_id")
