"""S1-S10 scans and K1-K6 sinks (written to the shared folder, read back)."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tessera.functions.hashing import hash_int, sql_hash_int
from tessera.operators.ordered import dedup_first
from tessera.plans.fixtures import MEASUREMENTS_SQL, PREDICTIONS_SQL, measurements, predictions
from tessera.registry import register
from tessera.session import fresh_path
from tessera.sources import sinks
from tessera.sources import tables as S


@register("s1_scan_projection", """
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45""")
def s1(spark, d):
    """Projection + filter reach the parquet scan (PushedFilters / ReadSchema)."""
    return S.scan(spark, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_quantity",
                                                           "l_extendedprice"],
                  where=F.col("l_quantity") > 45)


ORDERS_CSV_SCHEMA = StructType([
    StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
    StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
    StructField("o_orderpriority", StringType())])


@register("k1_csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def k1(spark, d):
    """K1 table sink (CSV with header) → S1 CSV scan with an explicit schema."""
    src = S.table(spark, d, "orders").select(*[f.name for f in ORDERS_CSV_SCHEMA.fields])
    path = fresh_path(spark, "orders_csv")
    src.write.mode("overwrite").option("header", True).csv(path)
    return S.scan(spark, path, fmt="csv", schema=ORDERS_CSV_SCHEMA)


@register("s2_multi_source_union", """
SELECT 'customer' AS source, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name,
       CAST(NULL AS INTEGER) AS s_nationkey, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer
UNION ALL
SELECT 'supplier', NULL, NULL, NULL, NULL, NULL, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def s2(spark, d):
    """Two files with drifting columns → one frame with provenance."""
    return S.scan_many(spark, [f"{d}/customer.parquet", f"{d}/supplier.parquet"])


@register("s3_json_map", """
SELECT event_id, k AS key, CAST(json_extract(props, '$."' || k || '"') AS DOUBLE) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def s3(spark, d):
    return S.json_map(S.table(spark, d, "events"), "props", keep=["event_id"])


@register("s4_keymap_merge_last_wins", f"""
SELECT key, l_quantity FROM (
  SELECT key, l_quantity, row_number() OVER (PARTITION BY key ORDER BY run DESC, ord_a DESC, ord_b DESC) AS rn
  FROM ({MEASUREMENTS_SQL})) WHERE rn = 1""")
def s4(spark, d):
    """Files = runs (rank by run), rows ranked inside a file; the last wins."""
    return S.merge_last_wins(measurements(spark, d), "key", "l_quantity", ["run", "ord_a", "ord_b"])


@register("s5_whole_text_stats", """
SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes,
       CAST(len(string_split(html, chr(10))) AS BIGINT) AS n_lines FROM pages""")
def s5(spark, d):
    """Whole documents, one row each (the table form of a wholetext scan)."""
    p = S.table(spark, d, "pages")
    return p.select("page_id", F.length("html").cast("bigint").alias("n_chars"),
                    F.octet_length("html").cast("bigint").alias("n_bytes"),
                    F.size(F.split("html", "\n")).cast("bigint").alias("n_lines"))


@register("s6_regex_first_float", """
SELECT page_id, CASE WHEN regexp_extract(url, '/([0-9]+)', 1) = '' THEN NULL
                     ELSE CAST(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) END AS value FROM pages""")
def s6(spark, d):
    p = S.table(spark, d, "pages")
    return p.select("page_id", S.regex_first_float(F.col("url"), r"/([0-9]+)").alias("value"))


@register("s7_regex_last_float", """
SELECT page_id, TRY_CAST(regexp_extract_all(url, '([0-9]+)', 1)[-1] AS DOUBLE) AS value FROM pages""")
def s7(spark, d):
    p = S.table(spark, d, "pages")
    return p.select("page_id", S.regex_last_float(F.col("url"), r"([0-9]+)").alias("value"))


@register("s8_path_keys", r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
       regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang,
       regexp_replace(regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1), '\.[^.]*$', '') AS stem
FROM pages""")
def s8(spark, d):
    p = S.table(spark, d, "pages")
    keys = S.url_keys(F.col("url"))
    return p.select("page_id", *[c.alias(n) for n, c in keys.items()])


_PACKED = {"F": "1.0;-1.0", "O": "0.0;0.0", "P": "-1.0;1.0"}


@register("s9_placeholder_results", """
WITH r AS (SELECT o_custkey AS c_custkey,
             CASE o_orderstatus WHEN 'F' THEN '1.0;-1.0' WHEN 'O' THEN '0.0;0.0' ELSE '-1.0;1.0' END AS utilities,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
           FROM orders)
SELECT c.c_custkey, coalesce(r.utilities, '0;0') AS utilities, CAST(r.utilities IS NULL AS INTEGER) AS failed
FROM customer c LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (c_custkey)""")
def s9(spark, d):
    """Configs = customers; result = first order's packed utilities (a third of customers have none)."""
    o = S.table(spark, d, "orders")
    packed = F.element_at(F.create_map(*[F.lit(x) for kv in _PACKED.items() for x in kv]), F.col("o_orderstatus"))
    res = dedup_first(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey",
                               packed.alias("utilities")), ["c_custkey"], ["o_orderkey"])
    return S.with_placeholder(S.table(spark, d, "customer").select("c_custkey"), res, "c_custkey", "utilities")


@register("k5_s10_fold_partition_read", f"""
SELECT row_id, round(p2, 6) AS prediction FROM ({PREDICTIONS_SQL})
WHERE {sql_hash_int(2, 'row_id')} % 5 = 3""")
def k5(spark, d):
    """K5 writes OOF rows partitioned by (seed, fold); S10 reads one
    (seed, fold) back with partition pruning."""
    p = predictions(spark, d)
    oof = None
    for seed, col in ((1, "p1"), (2, "p2")):
        part = p.select("row_id", F.col(col).alias("prediction"), F.lit(seed).alias("seed"),
                        F.pmod(hash_int(seed, "row_id"), F.lit(5)).alias("fold"))
        oof = part if oof is None else oof.unionByName(part)
    path = sinks.write_oof(oof, fresh_path(spark, "oof"))
    return S.read_fold(spark, path, 2, 3).select("row_id", F.round("prediction", 6).alias("prediction"))


@register("k2_keymap_json", """
SELECT CAST(doc_id AS VARCHAR) AS key, CAST(quality AS DOUBLE) AS value FROM labels""")
def k2(spark, d):
    lab = S.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("k"),
                                            F.col("quality").cast("double").alias("v"))
    path = sinks.write_keymap_json(lab, "k", "v", fresh_path(spark, "keymap"))
    return spark.read.schema("key string, value double").json(path)


@register("k3_keyed_table", """
SELECT doc_id, sha256(text) AS key FROM documents""")
def k3(spark, d):
    """One-file-per-key re-aimed: a bucketed keyed table, read back."""
    docs = S.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    path = sinks.write_keyed(docs, "key", fresh_path(spark, "keyed"), buckets=16)
    return spark.read.parquet(path).select("doc_id", "key")


@register("k6_snapshot_delta", """
SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)""")
def k6(spark, d):
    """Previous snapshot (benchmark texts) written, then the new-keys delta."""
    prev = S.table(spark, d, "benchmark").select(F.sha2("text", 256).alias("key"))
    path = sinks.write_table(prev, fresh_path(spark, "snapshot"))
    cur = S.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return sinks.snapshot_delta(cur, path, "key", spark).select("doc_id")
