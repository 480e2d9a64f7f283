"""Invariants of the operators whose results have no SQL oracle, and
brute-force checks of the driver-side pieces on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from tessera.functions.udfs import t_two_sided_p, _norm_ppf
from tessera.operators import folds as W
from tessera.operators import joins as J
from tessera.operators import learn as L
from tessera.operators import ordered as O
from tessera.plans.fixtures import matches, predictions
from tessera.sources.tables import table

Q = E.queries()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["row_id", "feature", "original", "estimate", "augmented"]


def test_group_folds_partition_groups(spark):
    o = table(spark, SMALL, "orders")
    f = W.group_kfold(o, "o_custkey", 7, 3).toPandas()
    assert len(f) == o.count()
    assert (f.groupby("o_custkey")["fold"].nunique() == 1).all()
    sizes = f.groupby("fold")["o_custkey"].nunique()
    assert sizes.max() - sizes.min() <= 1  # array_split sizes


def test_balanced_folds_sizes(spark):
    o = table(spark, SMALL, "orders")
    f = W.balanced_group_folds(o, "o_custkey", 4).toPandas()
    assert (f.groupby("o_custkey")["fold"].nunique() == 1).all()
    per = f.groupby("fold").size()
    biggest = f.groupby("o_custkey").size().max()
    assert per.max() - per.min() <= 2 * biggest


def test_rank_by_hash_is_a_permutation(spark):
    t = table(spark, SMALL, "lineitem").select("l_orderkey").distinct().withColumn(
        "h", F.md5(F.col("l_orderkey").cast("string")))
    r = O.rank_by_hash(t, "h").toPandas()
    assert sorted(r["rank"]) == list(range(len(r)))
    assert (r.sort_values("h")["rank"].to_numpy() == np.arange(len(r))).all()


def test_global_prefix_sum_matches_pandas(spark):
    key = ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # a total order
    t = table(spark, SMALL, "lineitem").select(*key)
    r = O.global_prefix_sum(t, key, out="cum").toPandas()
    p = t.toPandas().sort_values(key)
    p["cum"] = np.arange(1, len(p) + 1)
    m = r.merge(p, on=key, suffixes=("", "_p"))
    assert len(m) == len(p)
    assert (m["cum"] == m["cum_p"]).all()


def test_strict_lookup_raises_on_miss(spark):
    docs = table(spark, SMALL, "documents").select("doc_id")
    with pytest.raises(Exception):
        J.strict_lookup(docs, table(spark, SMALL, "labels"), "doc_id", ["quality"]).count()


def test_weighted_bucket_shares(spark):
    tasks = table(spark, SMALL, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("t"))
    workers = spark.createDataFrame([(1, 1.0), (2, 3.0)], "w long, weight double")
    a = W.weighted_bucket(tasks, "t", workers, "w", "weight", 5).toPandas()
    assert len(a) == tasks.count()  # every task lands exactly once
    share = (a["worker"] == 2).mean()
    assert abs(share - 0.75) < 0.03


def test_pretty_query_roundtrip(spark):
    out = Q["p20_pretty_roundtrip"](spark, SMALL)
    assert out.where("NOT roundtrip_ok").count() == 0
    assert out.where("laid_out AND n_lines > 10").count() > 0


def test_t_pvalue_and_ppf():
    # t = 2.0, dof = 10 → two-sided p ≈ 0.0734
    assert abs(t_two_sided_p(np.array([2.0]), np.array([10.0]))[0] - 0.07338803) < 1e-6
    assert abs(t_two_sided_p(np.array([0.0]), np.array([5.0]))[0] - 1.0) < 1e-9
    assert abs(_norm_ppf(np.array([0.975]))[0] - 1.959963985) < 1e-6


def test_isotonic_monotone(spark):
    iso = Q["m12_isotonic_cv"](spark, SMALL)
    pred = predictions(spark, SMALL)
    p = iso.toPandas()
    assert len(p) == pred.count()
    for _, g in p.groupby("fold"):
        g = g.sort_values(["raw_clipped", "iso"])
        fitted = g[g["iso"] != g["raw_clipped"]]
        assert (np.diff(fitted["iso"].to_numpy()) >= -1e-12).all()
        raw = g.loc[g["iso"] == g["raw_clipped"], "raw_clipped"]  # a centred fit has no value beyond its first and last x
        assert len(fitted) > 0.5 * len(g) and g["centred"].all()
        assert ((raw < fitted["raw_clipped"].min()) | (raw > fitted["raw_clipped"].max())).all()


def test_oof_each_row_once(spark):
    oof = Q["m8_grouped_cv_gbt"](spark, SMALL)
    m = matches(spark, SMALL)
    assert oof.count() == m.count()
    assert oof.select("row_id").distinct().count() == m.select("row_id").distinct().count()


def test_nested_cv_rows(spark):
    r = Q["m24_nested_cv"](spark, SMALL)
    n = predictions(spark, SMALL).count()
    assert r.count() == 4 * n  # once as outer-test + three times as outer-train
    assert r.select("outer_fold", "row_id").distinct().count() == 4 * predictions(spark, SMALL).select("row_id").distinct().count()


def test_gram_selection_matches_numpy(spark):
    m = matches(spark, SMALL).withColumn("fold", F.pmod(F.col("game"), F.lit(3)))
    feats = ["l_quantity", "l_tax"]
    grams = L.fold_gram(m, "fold", feats, "utility")
    pdf = m.select("fold", *feats, "utility").toPandas()
    sse, n = 0.0, 0
    for f in range(3):
        tr, te = pdf[pdf.fold != f], pdf[pdf.fold == f]
        X = np.column_stack([np.ones(len(tr)), tr[feats].to_numpy()])
        beta = np.linalg.lstsq(X, tr["utility"].to_numpy(), rcond=None)[0]
        Xt = np.column_stack([np.ones(len(te)), te[feats].to_numpy()])
        sse += ((te["utility"].to_numpy() - Xt @ beta) ** 2).sum()
        n += len(te)
    assert abs(L.cv_rmse_from_gram(grams, [0, 1]) - np.sqrt(sse / n)) < 1e-6


def _elo_brute(sched: pd.DataFrame) -> dict:
    out = {}
    for game, g in sched.sort_values(["game", "step"]).groupby("game"):
        r = {}
        for a1, a2, s in zip(g.agent1, g.agent2, g.score):
            for comp, o1, o2 in zip(range(4), a1.split("-")[1:], a2.split("-")[1:]):
                k1, k2 = (comp, o1), (comp, o2)
                r1, r2 = r.get(k1, 1000.0), r.get(k2, 1000.0)
                r[k1] = r1 + 4 * (s - 1 / (1 + 10 ** ((r2 - r1) / 400)))
                r[k2] = r.get(k2, 1000.0) + 4 * ((1 - s) - 1 / (1 + 10 ** ((r1 - r2) / 400)))
        for (c, o), v in r.items():
            out[(game, c, o)] = v
    return out


def test_elo_batch_matches_brute_force_and_stream(spark):
    from tessera.operators.ratings import COMPONENT_NAMES
    from tessera.operators.ratings import elo_ratings
    from tessera.registry.ratings import STREAM_DRAWS, elo_schedule, m35
    sched = elo_schedule(spark, SMALL)
    batch = m35(spark, SMALL, n_draws=STREAM_DRAWS).toPandas()
    rows = elo_ratings(sched).toPandas().merge(batch, on=["game", "component", "option"], suffixes=("", "_b"))
    assert len(rows) == len(batch)
    assert (rows[["elo", "match_count", "agent_count"]].to_numpy() == rows[["elo_b", "match_count_b", "agent_count_b"]].to_numpy()).all()
    brute = _elo_brute(sched.toPandas())
    comp_idx = {c: i for i, c in enumerate(COMPONENT_NAMES)}
    for r in batch.itertuples():
        want = brute.get((r.game, comp_idx[r.component], r.option), 1000.0)  # unseen options keep 1000
        assert abs(want - r.elo) < 1e-9
        assert (r.match_count == 0) == ((r.game, comp_idx[r.component], r.option) not in brute)
    # rating mass is conserved per (game, component) up to the K·(e1+e2-1) drift
    tot = batch.groupby(["game", "component"])["elo"].sum()
    cnt = batch.groupby(["game", "component"])["elo"].count()
    assert (abs(tot - 1000 * cnt) < 1e-6 * cnt * 1000 + 1e-6).all()
    stream = Q["r3_stream_running_elo"](spark, SMALL).toPandas()
    m = batch.merge(stream, on=["game", "component", "option"], suffixes=("", "_s"))
    assert len(m) == len(batch) == len(stream)
    assert np.allclose(m["elo"], m["elo_s"], atol=1e-9)
    assert (m["match_count"] == m["match_count_s"]).all()


def test_stream_plays_all_draws(spark):
    """The stream ends as the registered batch query, over its whole schedule."""
    key = ["game", "component", "option"]
    m = Q["m35_elo_ratings"](spark, SMALL).toPandas().merge(Q["r3_stream_running_elo"](spark, SMALL).toPandas(), on=key, how="outer", suffixes=("", "_s"))
    assert np.allclose(m["elo"], m["elo_s"], atol=1e-9)
    assert (m["match_count"] == m["match_count_s"]).all() and (m["agent_count"] == m["agent_count_s"]).all()


def test_elo_plays_all_draws(spark):
    full = Q["m35_elo_ratings"](spark, SMALL).groupBy("game", "component").agg(F.sum("match_count").alias("n"))
    assert {r.n for r in full.collect()} == {20_000}  # two sides a draw


def test_stream_elites_equal_batch(spark):
    a = Q["r2_stream_running_elites"](spark, SMALL).toPandas().sort_values(["cell_x", "cell_y"])
    b = Q["w9_grid_elites"](spark, SMALL).toPandas().sort_values(["cell_x", "cell_y"])
    assert a[["cell_x", "cell_y", "vec_id"]].to_numpy().tolist() == b[["cell_x", "cell_y", "vec_id"]].to_numpy().tolist()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    df = Q[name](spark, SMALL)
    assert df.count() >= 0 and len(df.columns) > 0


def test_hot_key_operators_stay_exact(spark):
    """One key holding a third of all rows (derived from lineitem): the
    skew-safe operators still give exact answers."""
    from tessera.operators.aggs import indexed_list
    li = table(spark, SMALL, "lineitem")
    hot = li.select(F.when(F.pmod("l_orderkey", F.lit(3)) == 0, F.lit(-1)).otherwise(F.col("l_partkey")).alias("k"),
                    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pdf = hot.toPandas().sort_values(["k", *order])
    assert (pdf["k"] == -1).mean() > 0.3
    # keep-first dedup
    first = O.dedup_first(hot, ["k"], order).toPandas().set_index("k")
    want = pdf.groupby("k").first()
    assert (first.loc[want.index, "l_orderkey"].to_numpy() == want["l_orderkey"].to_numpy()).all()
    # exact per-key list positions
    pos = indexed_list(hot, "k", order).toPandas().sort_values(["k", "pos"])
    assert (pos["pos"].to_numpy() == pos.groupby("k").cumcount().to_numpy()).all()  # 0..n-1 per key
    keys = list(zip(*[pos[c] for c in order]))
    same_k = pos["k"].to_numpy()[1:] == pos["k"].to_numpy()[:-1]
    assert all(a <= b for a, b, s in zip(keys[:-1], keys[1:], same_k) if s)  # positions follow the order
    # group folds with a hot group: the group stays in one fold
    f = W.group_kfold(hot, "k", 5, 1).toPandas()
    assert len(f) == len(pdf) and (f.groupby("k")["fold"].nunique() == 1).all()
    # running sums under heavy ties (a third of all values equal)
    tied = hot.withColumn("v", F.when(F.col("k") == -1, F.lit(0.0)).otherwise(F.col("l_quantity")))
    r = O.global_prefix_sum(tied, ["v", *order], out="cum").toPandas().sort_values(["v", *order])
    assert (r["cum"].to_numpy() == np.arange(1, len(r) + 1)).all()
