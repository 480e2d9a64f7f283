"""The operators over the given tables: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import (alignment, decontam, exactdedup, html, mixing, ordermh, periodicity, quality, secrets, sharding, simhash,
                         suffixdedup, toxicity)
from tessera.llm.common import ASCII_LOW, ASCII_UP, held_out, read, text_of

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return put


_OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    greatest(0.05, 1.0::DOUBLE - 4.0::DOUBLE * ((length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#$%&*|!', '')))::DOUBLE
      / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS weight,
    (('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|'
      || (row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) - 1)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size::DOUBLE * 3.0 AS cap FROM s),
l AS (SELECT *, cap / w AS cut, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least((SELECT arg_min(level, cut) FROM l WHERE level <= cut) * w, cap), cap) AS target FROM l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, coalesce(d.doc_id::VARCHAR, ''), d.size, u) - d.size AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE least(epochs + (before + size / 2.0 <= target - epochs * source_size)::INT, 3) * size END)::BIGINT AS taken
FROM k"""


@query("op1_mixing", _OP1_SQL)
def op1_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    m = mixing.mix(docs, mixing.word_count(), mixing.symbol_weight())
    return m.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    t = text_of("text")
    d = read(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    s = sharding.shard_rows(d, n_shards=24)
    return s.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    near = simhash.near_duplicates(read(spark, sf_dir, "documents"), k=3, radius=3, keep=["doc_id"])
    return near.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query("op3_secrets")
def op3_secrets(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _scored(docs, score, cut):
    return (score(docs.select("doc_id", "text"))
            .select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return _scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic"), 0.5)


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return _scored(docs, quality.fit(docs, read(spark, sf_dir, "labels"), "quality"), 0.3)


@query("op6_html")
def op6_html(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return html.extract(pages.select("page_id", "url", "html"), html.fit(pages)).drop("html")


_WORDS4 = (f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UP}', '{ASCII_LOW}'), "
           "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

_OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS4} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS4} AS w FROM benchmark),
b AS (SELECT DISTINCT item, least(len(w), {decontam.WINDOW}) AS m, w[s + 1 : s + least(len(w), {decontam.WINDOW})] AS g
      FROM i, unnest(range(len(w) - least(len(w), {decontam.WINDOW}) + 1)) t(s) WHERE len(w) > 0),
x AS (SELECT doc_id, s, m, w[s + 1 : s + m] AS g FROM d, (SELECT DISTINCT m FROM b), unnest(range(len(w) - m + 1)) t(s)),
h AS (SELECT doc_id, s, x.m, item FROM x JOIN b ON x.m = b.m AND x.g = b.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + m)) t(p) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN j USING (doc_id)"""


@query("op4_decontam", _OP4_SQL)
def op4_decontam(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_suffixdedup")
def op2_suffixdedup(spark, sf_dir):
    return suffixdedup.remove_repeats(read(spark, sf_dir, "documents"), length=400, keep=["doc_id"]).drop("spans")


@query("op10_ordermh")
def op10_ordermh(spark, sf_dir):
    d = ordermh.edited_pairs(read(spark, sf_dir, "documents").select("doc_id", "text"), long_bytes=ordermh.LONG_BYTES)
    return d.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                    ordermh.as_text(F.col("signature")).alias("fingerprint"),
                    ordermh.as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    return alignment.align(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


_OP12_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d"""


@query("op12_exactdedup", _OP12_SQL)
def op12_exactdedup(spark, sf_dir):
    return exactdedup.exact_groups(read(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op13_periodicity")
def op13_periodicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", periodicity.looped().alias("text"))
    return periodicity.find_runs(docs).drop("text", "runs")
