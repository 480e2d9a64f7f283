"""P1-P27 projection / predicate / expression queries."""

from pyspark.sql import functions as F

from tessera.operators import columns as C
from tessera.operators.reshape import split_packed
from tessera.plans.fixtures import MATCHES_SQL, PREDICTIONS_SQL, matches, predictions, row_key
from tessera.registry import register
from tessera.registry.scans import s9
from tessera.sources.tables import table

LI_DROP = ["l_tax", "l_comment", "l_shipdate", "l_receiptdate"]


@register("p1_drop_if_present", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_returnflag, l_linestatus FROM lineitem""")
def p1(spark, d):
    return C.drop_if_present(table(spark, d, "lineitem"), LI_DROP)


@register("p2_packed_split", f"""
SELECT row_id,
  string_split(agent1, '-')[2] AS agent1_1, string_split(agent1, '-')[3] AS agent1_2,
  string_split(agent1, '-')[4] AS agent1_3, string_split(agent1, '-')[5] AS agent1_4,
  string_split(agent2, '-')[2] AS agent2_1, string_split(agent2, '-')[3] AS agent2_2,
  string_split(agent2, '-')[4] AS agent2_3, string_split(agent2, '-')[5] AS agent2_4
FROM ({MATCHES_SQL})""")
def p2(spark, d):
    m = matches(spark, d)
    return m.select("row_id", *split_packed(F.col("agent1"), "-", 5, "agent1"),
                    *split_packed(F.col("agent2"), "-", 5, "agent2"))


@register("p3_value_replace", f"""
SELECT row_id, replace(agent2, '-Random200-', '-random-') AS agent2 FROM ({MATCHES_SQL})""")
def p3(spark, d):
    m = matches(spark, d)
    return m.select("row_id", F.replace("agent2", F.lit("-Random200-"), F.lit("-random-")).alias("agent2"))


@register("p4_cast_by_name_rule", f"""
SELECT row_id, CAST(agent1_idx AS VARCHAR) AS agent1_idx, CAST(agent2_idx AS VARCHAR) AS agent2_idx,
       CAST(agent1_idx * 1.5 AS FLOAT) AS agent1_elo, CAST(utility AS FLOAT) AS utility,
       CAST(l_extendedprice AS FLOAT) AS l_extendedprice, CAST(run AS FLOAT) AS run
FROM ({MATCHES_SQL})""")
def p4(spark, d):
    m = matches(spark, d).select("row_id", "agent1_idx", "agent2_idx",
                                 (F.col("agent1_idx") * 1.5).alias("agent1_elo"),
                                 "utility", "l_extendedprice", "run")
    return C.cast_by_name_rule(m)


@register("p5_align_columns", """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment
FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(NULL AS VARCHAR) FROM supplier""")
def p5(spark, d):
    cust = table(spark, d, "customer").toDF("key", "name", "nationkey", "acctbal", "segment")
    supp = table(spark, d, "supplier").toDF("key", "name", "nationkey", "acctbal")
    return cust.unionByName(C.align_columns(supp, cust))


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("p6_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 1 AS keep FROM lineitem"
    for c in _LI_COLS))
def p6(spark, d):
    return C.distinct_counts(table(spark, d, "lineitem").select(*_LI_COLS))


@register("p6_constant_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) > 1 AS keep FROM lineitem" for c in _LI_COLS))
def p6_keep(spark, d):
    return C.varying_columns(table(spark, d, "lineitem").select(*_LI_COLS))


_SUBS = ["the", "le", "and", "(", "en"]


@register("p7_text_stats", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, " + ", ".join(
    f"CAST((length(text) - length(replace(text, '{s}', ''))) // {len(s)} AS BIGINT) AS n_{i}"
    for i, s in enumerate(_SUBS)) + " FROM documents")
def p7(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                       *[C._count(F.col("text"), s).cast("bigint").alias(f"n_{i}") for i, s in enumerate(_SUBS)])


# id → (name, shape, inputs) over lineitem columns
FEATURES = {
    0: ("qty_x_disc", "product", ("l_quantity", "l_discount")),
    1: ("tax_eq_disc", "equal_flag", ("l_tax", "l_discount")),
    2: ("price_per_qty", "guarded_ratio", ("l_extendedprice", "l_quantity")),
    3: ("tax_per_disc", "guarded_ratio", ("l_tax", "l_discount")),
    4: ("disc_per_tax", "guarded_ratio", ("l_discount", "l_tax")),
    5: ("tax_plus_disc", "sum", ("l_tax", "l_discount")),
    6: ("qty_tax_disc", "sum", ("l_quantity", "l_tax", "l_discount")),
    7: ("price_x_tax", "product", ("l_extendedprice", "l_tax")),
    8: ("price_over_qty_plain", "plain_ratio", ("l_extendedprice", "l_quantity")),
    9: ("qty_per_price", "guarded_ratio", ("l_quantity", "l_extendedprice")),
    10: ("price_per_tax", "guarded_ratio", ("l_extendedprice", "l_tax")),
    11: ("price_per_disc", "guarded_ratio", ("l_extendedprice", "l_discount")),
    12: ("qty_per_tax", "guarded_ratio", ("l_quantity", "l_tax")),
    13: ("qty_per_disc", "guarded_ratio", ("l_quantity", "l_discount")),
    14: ("tax_per_qty", "guarded_ratio", ("l_tax", "l_quantity")),
    15: ("disc_per_qty", "guarded_ratio", ("l_discount", "l_quantity")),
    16: ("tax_per_price", "guarded_ratio", ("l_tax", "l_extendedprice")),
    17: ("disc_per_price", "guarded_ratio", ("l_discount", "l_extendedprice")),
    18: ("line_per_qty", "guarded_ratio", ("l_linenumber", "l_quantity")),
    19: ("line_qty_tax_disc", "sum", ("l_linenumber", "l_quantity", "l_tax", "l_discount")),
}


@register("p8_engineered_features", f"""
SELECT {"concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))"} AS row_id,
  l_quantity * l_discount AS qty_x_disc, CAST(l_tax = l_discount AS TINYINT) AS tax_eq_disc,
  l_extendedprice / (l_quantity + 1e-15) AS price_per_qty, l_tax / (l_discount + 1e-15) AS tax_per_disc,
  l_discount / (l_tax + 1e-15) AS disc_per_tax, l_tax + l_discount AS tax_plus_disc,
  l_quantity + l_tax + l_discount AS qty_tax_disc, l_extendedprice * l_tax AS price_x_tax,
  CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS price_over_qty_plain,
  l_quantity / (l_extendedprice + 1e-15) AS qty_per_price, l_extendedprice / (l_tax + 1e-15) AS price_per_tax,
  l_extendedprice / (l_discount + 1e-15) AS price_per_disc, l_quantity / (l_tax + 1e-15) AS qty_per_tax,
  l_quantity / (l_discount + 1e-15) AS qty_per_disc, l_tax / (l_quantity + 1e-15) AS tax_per_qty,
  l_discount / (l_quantity + 1e-15) AS disc_per_qty, l_tax / (l_extendedprice + 1e-15) AS tax_per_price,
  l_discount / (l_extendedprice + 1e-15) AS disc_per_price, l_linenumber / (l_quantity + 1e-15) AS line_per_qty,
  l_linenumber + l_quantity + l_tax + l_discount AS line_qty_tax_disc
FROM lineitem""")
def p8(spark, d):
    li = table(spark, d, "lineitem").withColumn(
        "row_id", row_key())
    return C.add_features(li, FEATURES, sorted(FEATURES)).select("row_id", *[v[0] for v in FEATURES.values()])


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_SIZES = [1, 10, 20, 30, 40, 50]


@register("p9_value_indicators", "SELECT p_partkey, " + ", ".join(
    [f"CAST(p_type = '{v}' AS TINYINT) AS p_type_{v}" for v in _TYPES]
    + [f"CAST(p_size = {v} AS TINYINT) AS p_size_{v}" for v in _SIZES]) + " FROM part")
def p9(spark, d):
    return C.indicators(table(spark, d, "part"), {"p_type": _TYPES, "p_size": _SIZES}, keep=["p_partkey"])


@register("p10_clip", f"""
SELECT row_id, greatest(-1.0, least(1.0, p3)) AS p3_clipped FROM ({PREDICTIONS_SQL})""")
def p10(spark, d):
    from tessera.functions.exprs import clip
    return predictions(spark, d).select("row_id", clip("p3", -1.0, 1.0).alias("p3_clipped"))


@register("p11_missing_default", """
SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), 0.0) AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p11(spark, d):
    from tessera.functions.exprs import nan_to_default
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", nan_to_default(F.col("quality").cast("double"), 0.0).alias("quality"))


@register("p12_text_predicate", """
SELECT doc_id FROM documents WHERE contains(text, ' the ') AND NOT contains(text, 'ou')""")
def p12(spark, d):
    return C.text_filter(table(spark, d, "documents"), "text", [" the "], ["ou"]).select("doc_id")


@register("p13_candidate_validation", """
SELECT d.doc_id, CASE WHEN trim(d.text) = '' THEN 'blank'
  WHEN b.h IS NOT NULL THEN 'copy_of_example'
  WHEN length(d.text) - length(replace(d.text, '(', '')) <> length(d.text) - length(replace(d.text, ')', ''))
    OR length(d.text) - length(replace(d.text, '{', '')) <> length(d.text) - length(replace(d.text, '}', ''))
  THEN 'unbalanced' END AS reason
FROM documents d LEFT JOIN (SELECT DISTINCT sha256(text) AS h FROM benchmark) b ON sha256(d.text) = b.h""")
def p13(spark, d):
    v = C.validate_candidates(table(spark, d, "documents"), "text", table(spark, d, "benchmark"), "text")
    return v.select("doc_id", "reason")


@register("p14_quote_normalise", """
SELECT doc_id, sha256(translate(text, '„“', '""')) AS h FROM documents""")
def p14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(C.normalize_quotes(F.col("text")), 256).alias("h"))


_REC = r"(?s)<title>(.*?)</title>.*?<h1>(.*?)</h1>.*?<p>(.*?)</p>"


@register("p15_regex_record_parse", f"""
SELECT page_id, regexp_extract(html, '{_REC}', 1) AS title, regexp_extract(html, '{_REC}', 2) AS h1,
       sha256(regexp_extract(html, '{_REC}', 3)) AS first_p
FROM pages WHERE regexp_matches(html, '{_REC}')""")
def p15(spark, d):
    p = table(spark, d, "pages")
    rec = F.struct(*[F.regexp_extract("html", _REC, i).alias(n) for i, n in ((1, "title"), (2, "h1"), (3, "p"))])
    x = p.where(F.col("html").rlike(_REC)).select("page_id", rec.alias("r"))
    return x.select("page_id", "r.title", "r.h1", F.sha2("r.p", 256).alias("first_p"))


@register("p16_lazy_regex", """
SELECT page_id, regexp_extract(html, '<a href="/(.*?)">', 1) AS first_link,
       CAST(len(regexp_extract_all(html, '<a href="/(.*?)">', 1)) AS BIGINT) AS n_links FROM pages""")
def p16(spark, d):
    p = table(spark, d, "pages")
    pat = r'<a href="/(.*?)">'
    return p.select("page_id", F.regexp_extract("html", pat, 1).alias("first_link"),
                    F.size(F.regexp_extract_all("html", F.lit(pat), 1)).cast("bigint").alias("n_links"))


@register("p17_packed_first_utility", """
WITH r AS (SELECT o_custkey AS c_custkey,
             CASE o_orderstatus WHEN 'F' THEN '1.0;-1.0' WHEN 'O' THEN '0.0;0.0' ELSE '-1.0;1.0' END AS utilities,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
           FROM orders)
SELECT c.c_custkey, CAST(string_split(coalesce(r.utilities, '0;0'), ';')[1] AS DOUBLE) AS utility
FROM customer c LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (c_custkey)""")
def p17(spark, d):
    return s9(spark, d).select("c_custkey", F.split("utilities", ";")[0].cast("double").alias("utility"))


@register("p18_content_hash", """
SELECT doc_id, substr(sha256(text), 1, 8) AS short_hash, sha256(text) AS sha, md5(text) AS md5 FROM documents""")
def p18(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.substring(F.sha2(t, 256), 1, 8).alias("short_hash"), F.sha2(t, 256).alias("sha"),
        F.md5(t).alias("md5"))


@register("p19_minify", r"""
SELECT doc_id, sha256(m) AS h, CAST(length(m) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '\n', ''), '\t', ''), chr(13), ''),
         chr(10), ' '), chr(9), ''), ' {2,}', ' ', 'g') AS m FROM documents)""")
def p19(spark, d):
    m = C.minify(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(m, 256).alias("h"),
                                               F.length(m).cast("bigint").alias("n_chars"))


@register("p22_agent_synthesis", f"""
SELECT DISTINCT l_suppkey, agent1 AS agent FROM ({MATCHES_SQL})""")
def p22(spark, d):
    return matches(spark, d).select("l_suppkey", F.col("agent1").alias("agent")).distinct()


@register("p23_array_to_columns", "SELECT vec_id, " + ", ".join(
    f"embedding[{i + 1}] AS x_{i}" for i in range(64)) + " FROM embeddings")
def p23(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].alias(f"x_{i}") for i in range(64)])


_PACKED_ARRAY = ("concat('[ ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' ', CAST(-l_linenumber AS VARCHAR), "
                 "'  ', CAST(l_suppkey AS VARCHAR), ']')")


@register("p24_string_array_parse", f"""
SELECT row_id, CAST(a[1] AS DOUBLE) AS e0, CAST(a[2] AS DOUBLE) AS e1, CAST(a[3] AS DOUBLE) AS e2,
       CAST(len(a) AS BIGINT) AS n FROM (
  SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS row_id,
         regexp_split_to_array(trim(regexp_replace({_PACKED_ARRAY}, '[\\[\\]]', '', 'g')), '\\s+') AS a
  FROM lineitem)""")
def p24(spark, d):
    li = table(spark, d, "lineitem")
    s = F.concat(F.lit("[ "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" "),
                 (-F.col("l_linenumber")).cast("string"), F.lit("  "), F.col("l_suppkey").cast("string"), F.lit("]"))
    a = C.parse_array_string(s)
    x = li.select(row_key().alias("row_id"), a.alias("a"))
    return x.select("row_id", *[F.col("a")[i].alias(f"e{i}") for i in range(3)],
                    F.size("a").cast("bigint").alias("n"))


@register("p25_class_mapping", f"""
SELECT row_id, outcome + 1 AS outcome_class,
       CAST(utility > 0.999 AS INTEGER) - CAST(utility < -0.999 AS INTEGER) AS saturated
FROM ({MATCHES_SQL})""")
def p25(spark, d):
    m = matches(spark, d)
    return m.select("row_id", C.outcome_class(F.col("outcome")).alias("outcome_class"),
                    C.saturation_class(F.col("utility")).alias("saturated"))


@register("p26_log_exp", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(l_extendedprice), 6) AS log_price,
       round(exp(l_discount), 6) AS exp_disc FROM lineitem""")
def p26(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.round(F.ln("l_extendedprice"), 6).alias("log_price"),
                     F.round(F.exp("l_discount"), 6).alias("exp_disc"))


@register("p27_throughput_normalise", """
SELECT c.c_custkey, c.c_acctbal / (1.0 + r.r_regionkey / 10.0) AS acctbal_norm
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def p27(spark, d):
    """Per-source coefficient table (one row per region: fixed-size TPC-H
    dimension, broadcast) joined and divided."""
    coef = table(spark, d, "region").select("r_regionkey", (F.lit(1.0) + F.col("r_regionkey") / 10.0).alias("coef"))
    nat = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    dims = F.broadcast(nat.join(F.broadcast(coef), nat.n_regionkey == coef.r_regionkey))
    c = table(spark, d, "customer")
    j = c.join(dims, c.c_nationkey == F.col("n_nationkey"))
    return j.select("c_custkey", (F.col("c_acctbal") / F.col("coef")).alias("acctbal_norm"))
