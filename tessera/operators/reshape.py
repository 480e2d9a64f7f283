"""Reshape, nested data and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "feature",
            val: str = "value") -> DataFrame:
    """N2 — wide → long."""
    return df.unpivot(list(ids), list(values), var, val)


def nested_map(df: DataFrame, key: str, sub: str, value: str, out: str = "m") -> DataFrame:
    """N3 — long → one map per key (``{sub: value}``), JSON-able with to_json.
    The map of one key is bounded by the number of distinct ``sub`` values
    (features), not by data size."""
    return df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(sub, value))).alias(out))


def wide_labels(long: DataFrame, key: str, component: str, option: str, value: str,
                count: str, options: dict[str, Sequence[str]], suffix: str = "elo") -> DataFrame:
    """N1 — ``{component}_{option}_{suffix}`` columns; a component whose
    options include one with 0 (or missing) matches is NULL throughout.
    Pivot values are listed explicitly (bounded width)."""
    w = Window.partitionBy(key, component)
    pairs = [(c, o) for c, opts in options.items() for o in opts]
    n_opts = F.size(F.collect_set(option).over(w))
    want = {c: len(o) for c, o in options.items()}
    need = F.element_at(F.create_map(*[x for c, n in want.items() for x in (F.lit(c), F.lit(n))]), F.col(component))
    ok = (F.min(count).over(w) > 0) & (n_opts == need)
    cell = F.concat_ws("_", component, option)
    x = long.withColumn("_v", F.when(ok, F.col(value))).withColumn("_cell", cell)
    names = [f"{c}_{o}" for c, o in pairs]
    p = x.groupBy(key).pivot("_cell", names).agg(F.first("_v"))
    return p.select(key, *[F.col(f"`{n}`").alias(f"{n}_{suffix}".replace(".", "_")) for n in names])


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """N4 — keep rows where every label in ``subset`` is present."""
    return df.na.drop(subset=list(subset))


def label_partition(df: DataFrame, target_prefix: str, label_prefixes: Sequence[str]) -> DataFrame:
    """N5 — keep the target component's label columns and every non-label
    column; drop other components' labels (name rule)."""
    keep = [c for c in df.columns
            if c.startswith(target_prefix) or not any(c.startswith(p) for p in label_prefixes)]
    return df.select(*keep)


def bag_union(parts: dict[str, tuple[DataFrame, float]], source: str = "source",
              weight: str = "sample_weight") -> DataFrame:
    """U5 — union by name with a source tag and per-source weight."""
    out = None
    for name, (df, w) in parts.items():
        t = df.withColumn(source, F.lit(name)).withColumn(weight, F.lit(float(w)))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def split_by_source(df: DataFrame, source: str, name: str) -> DataFrame:
    """U6 — one source's rows back out of a combined result."""
    return df.where(F.col(source) == name)


def distinct_union(df: DataFrame, a: str, b: str, out: str = "value") -> DataFrame:
    """U2 — distinct values across two columns."""
    return df.select(F.col(a).alias(out)).union(df.select(F.col(b).alias(out))).distinct()


def split_packed(c: Column, sep_regex: str, n: int, prefix: str, drop_first: bool = True) -> list[Column]:
    """P2 — packed string → fields ``prefix_i`` (1-based), first dropped."""
    arr = F.split(c, sep_regex)
    start = 1 if drop_first else 0
    return [F.try_element_at(arr, F.lit(i + 1)).alias(f"{prefix}_{i}") for i in range(start, n)]


def as_variant(df: DataFrame, col: str) -> DataFrame:
    """N3 — the map or struct column as a VARIANT: one nested value per key, whose fields may differ from row to row."""
    return df.withColumn(col, F.to_variant_object(F.col(col)))


def variant_paths(df: DataFrame, key: str, col: str, name: str, value: str, kind: str) -> DataFrame:
    """N3 — (key, name, value): the fields of a VARIANT object, one row each."""
    fields = df.sparkSession.tvf.variant_explode(F.col(col).outer())
    return df.select(key, col).lateralJoin(fields).select(
        key, F.col("key").alias(name), F.try_variant_get(F.col("value"), "$", kind).alias(value))
