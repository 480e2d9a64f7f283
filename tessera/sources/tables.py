"""Scans (S1-S10).  All readers return lazy DataFrames; Catalyst pushes the
filters/projections of later operators into the parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet",
         schema: StructType | str | None = None, columns: Sequence[str] | None = None,
         where: Column | str | None = None, header: bool = True) -> DataFrame:
    """S1 — table scan.  CSV gets an explicit schema when one is given
    (inference is a full extra pass over the data)."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", header).option("mode", "PERMISSIVE")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    elif schema is not None:
        r = r.schema(schema)
    df = r.load(list(path) if not isinstance(path, str) else path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return df


def file_stem(path_col: Column) -> Column:
    """S8 — last path segment without its extension."""
    return F.regexp_extract(path_col, r"([^/]+?)(\.[^./]*)?$", 1)


def scan_many(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
              provenance: str = "source") -> DataFrame:
    """S2 — many files → one frame with a provenance column.

    Parquet: one scan with ``mergeSchema`` (column drift becomes NULLs) so
    the file listing and split planning stay in one job.  Other formats:
    per-path reads unioned by name with missing columns allowed.
    """
    if fmt == "parquet":
        df = spark.read.option("mergeSchema", "true").parquet(*paths)
        return df.withColumn(provenance, file_stem(F.col("_metadata.file_path")))
    out = None
    for p in paths:
        part = scan(spark, p, fmt).withColumn(provenance, file_stem(F.col("_metadata.file_path")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def json_map(df: DataFrame, col: str, value_type: str = "double", key: str = "key",
             value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """S3 — a JSON object column ``{k: v}`` → long ``(key, value)`` rows."""
    m = F.from_json(F.col(col), f"map<string,{value_type}>")
    return df.select(*keep, F.explode(m).alias(key, value))


def merge_last_wins(df: DataFrame, key: str, value: str, rank_cols: Sequence[str]) -> DataFrame:
    """S4 — key-map merge where the later file (then later row) wins.

    ``max_by`` is a declarative aggregate: partial per map task, so a hot
    key is combined before the shuffle.
    """
    order = F.struct(*[F.col(c) for c in rank_cols])
    return df.groupBy(key).agg(F.max_by(F.col(value), order).alias(value))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """S5 — one row per file, the whole file as ``value``, with its path."""
    return (spark.read.text(path, wholetext=True)
            .withColumn("path", F.col("_metadata.file_path")))


def regex_first_float(c: Column, pattern: str) -> Column:
    """S6 — first match of group 1 as a double; NULL when absent."""
    s = F.regexp_extract(c, pattern, 1)
    return F.when(s == "", None).otherwise(s.try_cast(DoubleType()))


def regex_last_float(c: Column, pattern: str) -> Column:
    """S7 — last match of group 1 (append-only reports)."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), 1), F.lit(-1)).try_cast(DoubleType())


def url_keys(url: Column) -> dict[str, Column]:
    """S8 — keys derived from a path/URL."""
    return {
        "scheme": F.regexp_extract(url, r"^([a-z]+)://", 1),
        "host": F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1),
        "lang": F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})/", 1),
        "stem": file_stem(F.regexp_extract(url, r"/([^/?#]*)(?:[?#].*)?$", 1)),
    }


def with_placeholder(configs: DataFrame, results: DataFrame, key: str, packed: str,
                     placeholder: str = "0;0") -> DataFrame:
    """S9 — every config gets a result row; missing results get a
    placeholder and a ``failed`` flag (count them with ``sum(failed)``)."""
    r = results.select(key, packed)
    return (configs.join(r, key, "left")
            .withColumn("failed", F.col(packed).isNull().cast("int"))
            .withColumn(packed, F.coalesce(F.col(packed), F.lit(placeholder))))


def read_fold(spark: SparkSession, path: str, seed: int, fold: int) -> DataFrame:
    """S10 — prediction file of one (seed, fold): a partition-pruned read."""
    return spark.read.parquet(path).where((F.col("seed") == seed) & (F.col("fold") == fold))
