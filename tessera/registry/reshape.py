"""N1-N5 reshape queries and J10 packed-field lookup."""

from pyspark.sql import functions as F

from tessera.operators import reshape as R
from tessera.operators.ratings import component_scores, packed_field_lookup
from tessera.plans.fixtures import COMPONENTS, MATCHES_SQL, matches, row_key
from tessera.registry import register
from tessera.sources.tables import table

M = f"m AS ({MATCHES_SQL})"
COMP_SQL = """x AS (SELECT game, row_id, side, agent, v, c.component, string_split(agent, '-')[c.idx + 1] AS option FROM
  (SELECT game, row_id, 1 AS side, agent1 AS agent, utility AS v FROM m
   UNION ALL SELECT game, row_id, -1, agent2, -utility FROM m) s,
  (VALUES ('selection', 1), ('exploration_const', 2), ('playout', 3), ('score_bounds', 4)) c(component, idx)),
scores AS (SELECT game, component, option, avg(v) AS score, count(*) AS n FROM x GROUP BY game, component, option)"""

_PAIRS = [(c, o) for c, opts in COMPONENTS.items() for o in opts]
_NAME = lambda c, o: f"{c}_{o}_score".replace(".", "_")


def _n1_sql(cols):
    need = "CASE component " + " ".join(f"WHEN '{c}' THEN {len(o)}" for c, o in COMPONENTS.items()) + " END"
    return (f"WITH {M}, {COMP_SQL}, ok AS (SELECT game, component, min(n) > 0 AND count(*) = {need} AS ok "
            f"FROM scores GROUP BY game, component) SELECT game, " + ", ".join(
                f"round(max(CASE WHEN s.component = '{c}' AND option = '{o}' AND ok THEN score END), 6) AS {_NAME(c, o)}"
                for c, o in cols) + " FROM scores s JOIN ok USING (game, component) GROUP BY game")


def _wide(spark, d):
    long = component_scores(matches(spark, d), "game", "agent1", "agent2", "utility")
    w = R.wide_labels(long, "game", "component", "option", "score", "n", COMPONENTS, suffix="score")
    return w.select("game", *[F.round(c, 6).alias(c) for c in w.columns if c != "game"])


register("n1_wide_labels", _n1_sql(_PAIRS))(_wide)


@register("n5_label_partition", _n1_sql([p for p in _PAIRS if p[0] == "selection"]))
def n5(spark, d):
    return R.label_partition(_wide(spark, d), "selection_", [f"{c}_" for c in COMPONENTS])


@register("n2_unpivot", """
SELECT row_id, feature, value FROM (SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
  CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS row_id, l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem) UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))""")
def n2(spark, d):
    li = table(spark, d, "lineitem").select(row_key().alias("row_id"),
                                           "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return R.unpivot(li, ["row_id"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("n3_nested_map", """
SELECT l_partkey, 'r' || CAST(l_linenumber AS VARCHAR) AS run, CAST(min(l_quantity) AS DOUBLE) AS quantity
FROM lineitem GROUP BY l_partkey, l_linenumber""")
def n3(spark, d):
    """Long (part, run) → one nested VARIANT per part (run → quantity), read back path by path."""
    li = table(spark, d, "lineitem")
    first = li.groupBy("l_partkey", "l_linenumber").agg(F.min("l_quantity").cast("double").alias("q"))
    m = R.nested_map(first.withColumn("run", F.concat(F.lit("r"), F.col("l_linenumber").cast("string"))),
                     "l_partkey", "run", "q")
    return R.variant_paths(R.as_variant(m, "m"), "l_partkey", "m", "run", "quantity", "double")


@register("n4_drop_incomplete", """
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""")
def n4(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return R.drop_incomplete(j, ["quality", "toxic"])


@register("j10_packed_field_lookup", f"""WITH {M}, {COMP_SQL}
SELECT x.row_id, round(avg(CASE WHEN side = 1 THEN score END) - avg(CASE WHEN side = -1 THEN score END) + 1e-10, 6) AS delta
FROM x LEFT JOIN scores USING (game, component, option) GROUP BY x.row_id""")
def j10(spark, d):
    m = matches(spark, d)
    ratings = component_scores(m, "game", "agent1", "agent2", "utility")
    r = packed_field_lookup(m, "row_id", "game", "agent1", "agent2", ratings)
    # +1e-10 keeps exact decimal ties (dyadic means) off the rounding boundary
    return r.select("row_id", F.round(F.col("delta") + 1e-10, 6).alias("delta"))
