"""Roles of the driver tables (FIXTURES.md §B), written once for Spark and
once as DuckDB SQL so queries and oracles start from the same rows.

* matches      — one row per lineitem: game = part, two agents, outcome,
                 utility in [-1, 1], run = line number.
* predictions  — base predictions p1..p3 = fixed expressions of the
                 target plus a hashed uniform.
* measurements — repeated measurements (key = part, run = line number,
                 two positive features) in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import hkey, sql_key, sql_uniform, uniform
from tessera.sources.tables import table

# The agent option lists (component → options, in order).
SELECTIONS = ["UCB1", "UCB1GRAVE", "ProgressiveHistory", "UCB1Tuned"]
EXPLORATION_CONSTS = ["0.1", "0.6", "1.41421356237"]
PLAYOUTS = ["Random200", "MAST", "NST"]
SCORE_BOUNDS = ["true", "false"]
COMPONENTS = {
    "selection": SELECTIONS,
    "exploration_const": EXPLORATION_CONSTS,
    "playout": PLAYOUTS,
    "score_bounds": SCORE_BOUNDS,
}
N_AGENTS = 4 * 3 * 3 * 2

# mixed-radix digits of an agent number: (divisor, radix) per component
_RADIX = [(1, 4), (4, 3), (12, 3), (36, 2)]


def agent_string(k: Column) -> Column:
    """P22 — ``MCTS-<selection>-<c>-<playout>-<bounds>`` from an integer."""
    parts = [F.lit("MCTS")]
    for (div, rad), opts in zip(_RADIX, COMPONENTS.values()):
        idx = F.pmod((k / div).cast("bigint"), F.lit(rad)) + 1
        parts.append(F.element_at(F.array(*[F.lit(o) for o in opts]), idx.cast("int")))
    return F.concat_ws("-", *parts)


def sql_agent_string(k: str) -> str:
    out = ["'MCTS'"]
    for (div, rad), opts in zip(_RADIX, COMPONENTS.values()):
        lst = "[" + ", ".join(f"'{o}'" for o in opts) + "]"
        out.append(f"{lst}[1 + (({k} // {div}) % {rad})]")
    return " || '-' || ".join(out)


def row_key() -> Column:
    """A key of its own for every lineitem row (the four keys alone repeat at the smallest size)."""
    return hkey("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"))


ROW_KEY_SQL = sql_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT)")


def matches(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        row_key().alias("row_id"),
        F.col("l_partkey").alias("game"),
        F.col("l_linenumber").alias("run"),
        agent_string(F.col("l_suppkey")).alias("agent1"),
        agent_string(F.col("l_orderkey")).alias("agent2"),
        F.pmod(F.col("l_suppkey"), F.lit(N_AGENTS)).alias("agent1_idx"),
        F.pmod(F.col("l_orderkey"), F.lit(N_AGENTS)).alias("agent2_idx"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0)
         .otherwise(-1).alias("outcome"),
        (F.lit(1.0) - F.lit(20.0) * F.col("l_discount")).alias("utility"),
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


MATCHES_SQL = f"""
SELECT {ROW_KEY_SQL} AS row_id,
       l_partkey AS game, l_linenumber AS run,
       {sql_agent_string('l_suppkey')} AS agent1,
       {sql_agent_string('l_orderkey')} AS agent2,
       l_suppkey % {N_AGENTS} AS agent1_idx, l_orderkey % {N_AGENTS} AS agent2_idx,
       CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 0 ELSE -1 END AS outcome,
       1.0 - 20.0 * l_discount AS utility,
       l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Target y and three base predictions per match row."""
    m = matches(spark, d)
    y = F.col("utility")
    return m.select(
        "row_id", "game", "run", "agent1", "agent2", "outcome", y.alias("y"),
        (y * 0.6 + (uniform(1, "row_id") - 0.5) * 0.8).alias("p1"),
        (y * 0.4 + (uniform(2, "row_id") - 0.5) * 0.6 + 0.1).alias("p2"),
        (y * 0.8 + (uniform(3, "row_id") - 0.5) * 1.2 - 0.05).alias("p3"),
    )


PREDICTIONS_SQL = f"""
SELECT row_id, game, run, agent1, agent2, outcome, utility AS y,
       utility * 0.6 + ({sql_uniform(1, 'row_id')} - 0.5) * 0.8 AS p1,
       utility * 0.4 + ({sql_uniform(2, 'row_id')} - 0.5) * 0.6 + 0.1 AS p2,
       utility * 0.8 + ({sql_uniform(3, 'row_id')} - 0.5) * 1.2 - 0.05 AS p3
FROM ({MATCHES_SQL}) m"""

MEASURED_FEATURES = ("l_quantity", "l_extendedprice")


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """Long repeated-measurement table (key, run, ord_a, ord_b, feature, value)."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("run"),
        F.col("l_orderkey").alias("ord_a"), F.col("l_suppkey").alias("ord_b"),
        *MEASURED_FEATURES)


MEASUREMENTS_SQL = """
SELECT l_partkey AS key, l_linenumber AS run, l_orderkey AS ord_a, l_suppkey AS ord_b,
       l_quantity, l_extendedprice
FROM lineitem"""


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH name AS (sql), … body``."""
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


# Tags that pages leave unclosed become spaces; all others are brackets.
_WORD_TAGS = r"</?(?:p|b|br|hr|img|meta|link|input|td|tr|th)(?:[ /][^>]*)?>"
_NO_TREE = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<![^>]*>"
_TAGS = ((_NO_TREE, " "), (_WORD_TAGS, " "), (r"</[^>]*>", ")"), (r"<([a-z0-9]+)[^>]*>", r"(\1 "), (r"\s+", " "))


def expressions(spark: SparkSession, d: str) -> DataFrame:
    """Bracketed expressions: a page's elements as ``(name ...)``, minified (expr_id, expression)."""
    x = F.translate("html", "()", "[]")
    for pattern, new in _TAGS:
        x = F.regexp_replace(x, pattern, new.replace("\\1", "$1"))
    return table(spark, d, "pages").select(F.col("page_id").alias("expr_id"), F.trim(x).alias("expression"))


def _sql_tags() -> str:
    x = "translate(html, '()', '[]')"
    for pattern, new in _TAGS:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


EXPRESSIONS_SQL = f"SELECT page_id AS expr_id, trim({_sql_tags()}) AS expression FROM pages"
