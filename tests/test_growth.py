"""What is shuffled, and how often: plans and values on rows made here."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import aggs as A
from tessera.operators import ratings as RT
from tessera.operators import reshape as R
from tessera.operators import text as X
from tessera.plans.fixtures import COMPONENTS


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df) -> int:
    return _plan(df).count("Exchange hashpartitioning")


AGENTS = ["MCTS-UCB1-0.1-MAST-true", "MCTS-UCB1Tuned-0.6-NST-false", "MCTS-UCB1-0.6-NST-true", "MCTS"]


def _matches(spark):
    rows = [(g, AGENTS[i % 4], AGENTS[(i + (g or 0)) % 3], i % 3, 0.2 * (i % 7) - 0.5) for g in (1, 2, None) for i in range(11 + (g or 0))]
    return spark.createDataFrame(rows, "game long, agent1 string, agent2 string, run int, utility double")


def _sides(spark):
    m = _matches(spark).toPandas()
    out = []
    for _, r in m.iterrows():
        for agent, v in ((r.agent1, r.utility), (r.agent2, -r.utility)):
            parts = agent.split("-")[1:] + [None] * 4
            out += [(r.game, agent, c, parts[i], r.run, v) for i, c in enumerate(RT.COMPONENT_NAMES)]
    return pd.DataFrame(out, columns=["game", "agent", "component", "option", "run", "v"])


def test_component_tables_shuffle_matches_once(spark):
    m = _matches(spark)
    counts, scores = RT.component_counts(m, "game", "agent1", "agent2"), RT.component_scores(m, "game", "agent1", "agent2", "utility")
    wide = R.wide_labels(scores, "game", "component", "option", "score", "n", COMPONENTS)
    assert _exchanges(counts) == _exchanges(scores) == _exchanges(wide) == 1
    by = _sides(spark).groupby(["game", "component", "option"], dropna=False)
    want = by.agg(n=("v", "size"), agents=("agent", "nunique"), score=("v", "mean")).reset_index()
    key = lambda g, c, o: (None if pd.isna(g) else int(g), c, None if pd.isna(o) else o)
    want = {key(*r[:3]): r[3:] for r in want.itertuples(index=False, name=None)}
    least = {}
    for (g, c, _), (n, _, _) in want.items():
        least[g, c] = min(n, least.get((g, c), n))
    got = counts.collect()
    assert len(got) == len(want)
    for r in got:
        assert want[r.game, r.component, r.option][:2] == (r.match_count, r.agent_count) and r.min_count == least[r.game, r.component]
    for r in scores.collect():
        assert want[r.game, r.component, r.option][0] == r.n and abs(want[r.game, r.component, r.option][2] - r.score) < 1e-12


def test_profile_pivot_shuffles_matches_once(spark):
    rows = [(g, i % 4, (i * g) % 4, 0.1 * i) for g in (1, 2, 3) for i in range(13)]
    p = A.profile_pivot(spark.createDataFrame(rows, "game long, a long, b long, y double"), "game", "a", "b", "y", range(4))
    assert _exchanges(p) == 1
    for r in p.collect():
        mine = [(a, b, y) for g, a, b, y in rows if g == r.game]
        for k in range(4):
            one, two = [y for a, _, y in mine if a == k], [-y for _, b, y in mine if b == k]
            for name, v in (("a1", one), ("a2", two), ("all", one + two)):
                got = r[f"{name}_{k}"]
                assert got is None if not v else abs(got - np.mean(v)) < 1e-12


def test_elo_games_keep_their_partitions(spark):
    pairs = _matches(spark).where("agent1 <> 'MCTS'").groupBy("game", "agent1", "agent2").agg(
        F.count_if(F.col("utility") > 0).alias("wins"), F.count_if(F.col("utility") == 0).alias("draws"), F.count_if(F.col("utility") < 0).alias("losses"))
    elo = RT.elo_of_pairs(pairs, 5, 71)
    assert "REPARTITION_BY_NUM" in _plan(elo)  # AQE merges others by bytes
    played = elo.groupBy("game", "component").agg(F.sum("match_count").alias("n")).collect()
    assert len(played) == 3 * len(COMPONENTS) and {r.n for r in played} == {10}  # the null game is one too


def test_elo_update_against_a_loop(monkeypatch):
    rng = np.random.default_rng(5)
    start = rng.normal(1000, 50, 3 * 2 * 4)
    o1, o2 = rng.integers(0, 4, (40, 3, 2)), rng.integers(0, 4, (40, 3, 2))
    score = rng.integers(0, 3, (40, 3)) / 2
    place = 4 * (np.arange(2) + 2 * np.arange(3)[:, None])
    got = start.copy()
    RT.elo_update(got, o1 + place, o2 + place, score)
    r = start.reshape(3, 2, 4).copy()
    for s, g, c in np.ndindex(40, 3, 2):
        i, j = o1[s, g, c], o2[s, g, c]
        a, b = r[g, c, i], r[g, c, j]
        r[g, c, i] = a + RT.ELO_K * (score[s, g] - 1 / (1 + 10 ** ((b - a) / 400)))
        r[g, c, j] += RT.ELO_K * (1 - score[s, g] - 1 / (1 + 10 ** ((a - b) / 400)))
    assert np.allclose(got, r.ravel(), rtol=0, atol=1e-10)


def test_char_grams_one_scan(spark):
    texts = ["", "a", "ABab  ab", "héé \n\n x😀😀x😀", "".join(chr(200 + i * 37 % 900) for i in range(2000)), "ab" * 300, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = X.char_gram_counts(docs.select("doc_id", X.char_text(F.col("text")).alias("c")), "doc_id", "c", 7)
    assert _plan(got).count("Scan") == 1 and "Union" not in _plan(got)
    chars = {r.doc_id: r.c for r in docs.select("doc_id", X.char_array(F.col("text")).alias("c")).collect()}
    rows = got.collect()
    assert len(rows) == 7 * len(texts)
    for r in rows:
        c = chars[r.doc_id]
        if c is None:
            assert r.n_grams == r.n_distinct and r.n_grams in (None, -1)
            continue
        grams = ["".join(c[i:i + r.n]) for i in range(len(c) - r.n + 1)]
        assert (r.n_grams, r.n_distinct) == (len(grams), len(set(grams))), (r, texts[r.doc_id][:20])


def test_tfidf_deals_weights_by_text_once(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb bb"), (3, "cc dd"), (3, "aa bb cc"), (None, None)], "doc_id long, text string")
    r = X.tfidf(docs, "doc_id", "text")
    assert "SortMergeJoin [term" not in _plan(r) and _plan(r).count("Window") >= 1
    got = {}
    for x in r.collect():
        got.setdefault((x.doc_id, x.term), []).append(x.weight)
    idf = {t: np.log(5 / (1 + n)) + 1 for t, n in {"aa": 2, "bb": 2, "cc": 2, "dd": 1}.items()}  # four texts: the null is one
    norm = np.sqrt(idf["cc"] ** 2 + idf["dd"] ** 2)
    assert abs(got[3, "dd"][0] - idf["dd"] / norm) < 1e-12 and len(got[3, "cc"]) == 2 and len(got) == 9


def test_augment_joins_before_rows_are_long(spark):
    """Each row meets its key's estimates once; null keys and keys without an estimate keep their values."""
    from tessera.plans import reconcile as rc
    meas = spark.createDataFrame([(1, 1, 2.0, 5.0), (1, 2, 4.0, None), (2, 3, 1.0, 1.0), (None, 4, 3.0, 3.0), (1, 1, 2.0, 5.0)],
                                 "key long, ord long, a double, b double")
    est = spark.createDataFrame([(1, "a", 3.0), (1, "b", 7.0), (2, "b", None), (None, "a", 9.0)], "key long, feature string, estimate double")
    out = rc.augment(meas, est, "key", ["ord", "key"], ["a", "b"], 7)
    plan = _plan(out)
    assert plan.index("Generate") < plan.index("Join") and "Expand" not in plan
    got = sorted(((r.row_id, r.feature, r.original, r.estimate) for r in out.collect()), key=str)
    assert got == sorted([("1|1", "a", 2.0, 3.0), ("1|1", "b", 5.0, 7.0)] * 2 + [("2|1", "a", 4.0, 3.0), ("2|1", "b", None, 7.0)]
                         + [("3|2", "a", 1.0, None), ("3|2", "b", 1.0, None), ("4", "a", 3.0, None), ("4", "b", 3.0, None)], key=str)
    for r in out.collect():
        lo, hi = sorted((r.original if r.original is not None else r.estimate, r.estimate if r.estimate is not None else r.original))
        assert lo <= r.augmented <= hi


def test_stream_plays_games_side_by_side(spark):
    """Batches of a few games each, with options of no list, agents of few parts and games that a batch leaves out."""
    from tessera.session import fresh_path
    from tessera.streaming import incremental as S
    names = [*AGENTS, "MCTS-Other-0.1-New-true", "MCTS-Other-0.6-MAST"]
    rows = [(g, s, names[(s + g) % 6], names[(s * s + 2 * g) % 6], (s % 3) / 2) for g in range(5) for s in range(40 + 20 * g) if g != 3 or s >= 20]
    draws = spark.createDataFrame(rows, "game long, step int, agent1 string, agent2 string, score double")
    blocks = ((b, draws.where(F.floor(F.col("step") / 20) == b).repartition(5)) for b in range(6))
    got = S.running_elo(spark, *S.stage_blocks(blocks, "block", "game", fresh_path(spark, "blocks"))).collect()
    rating, count, agents = {}, {}, {}
    for g, _, a1, a2, s in sorted(rows):
        k1, k2 = ([(g, c, o) for c, o in zip(RT.COMPONENT_NAMES, a.split("-")[1:])] for a in (a1, a2))
        for a, ks in ((a1, k1), (a2, k2)):
            for k in ks:
                count[k] = count.get(k, 0) + 1
                agents.setdefault(k, set()).add(a)
        for k, m in zip(k1, k2):
            x, y = rating.get(k, 1000.0), rating.get(m, 1000.0)
            e = 1 / (1 + 10 ** ((y - x) / 400))
            if k != m:
                rating[k], rating[m] = x + 4 * (s - e), y + 4 * (e - s)
    assert len(got) == 5 * sum(map(len, COMPONENTS.values()))
    for r in got:
        k = (r.game, r.component, r.option)
        assert abs(r.elo - rating.get(k, 1000.0)) < 1e-9
        assert (r.match_count, r.agent_count) == (count.get(k, 0), len(agents.get(k, ())))
