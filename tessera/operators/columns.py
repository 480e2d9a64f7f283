"""Projections, predicates and column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def drop_if_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """P1 — drop listed columns, ignoring absent ones."""
    return df.drop(*[n for n in names if n in df.columns])


def cast_by_name_rule(df: DataFrame, categorical_prefixes: Sequence[str] = ("agent1", "agent2"),
                      exclude_token: str = "elo", numeric_type: str = "float") -> DataFrame:
    """P4 — prefix columns become strings unless the name holds the
    exclusion token; other numeric columns become ``numeric_type``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name[:6] in categorical_prefixes and exclude_token not in f.name:
            out.append(c.cast("string").alias(f.name))
        elif isinstance(f.dataType, NumericType):
            out.append(c.cast(numeric_type).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def align_report(df: DataFrame, template: DataFrame) -> list[tuple[str, str]]:
    """P5 — (column, 'missing' | 'extraneous') between a frame and a template
    (schema only, no data touched)."""
    a, t = set(df.columns), template.columns
    return [(c, "missing") for c in t if c not in a] + [(c, "extraneous") for c in df.columns if c not in set(t)]


def align_columns(df: DataFrame, template: DataFrame) -> DataFrame:
    """P5 — reorder to the template's columns; missing ones become typed NULLs."""
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in template.schema.fields])


def varying_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P6 — (column, keep): whether a column has more than one non-null value.
    Its least and greatest tell, so one pass serves any number of columns."""
    cols = list(columns or df.columns)
    row = df.agg(*[F.coalesce(F.min(F.col(f"`{c}`")) < F.max(F.col(f"`{c}`")), F.lit(False)).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "keep")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                    batch: int = 200) -> DataFrame:
    """P6 — (column, n_distinct, keep = n_distinct > 1) in one pass per
    batch of ≤200 columns (stays under codegen limits on wide tables).
    ``approx=True`` uses HyperLogLog++ (bounded memory per column)."""
    cols = list(columns or df.columns)
    out = None
    for i in range(0, len(cols), batch):
        part = cols[i:i + batch]
        fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
        row = df.agg(*[fn(F.col(f"`{c}`")).cast("bigint").alias(c) for c in part])
        long = row.unpivot([], part, "column", "n_distinct")
        out = long if out is None else out.union(long)
    return out.withColumn("keep", F.col("n_distinct") > 1)


# Feature formula shapes used by the engineered-feature registry.
def _product(a, b):
    return F.col(a) * F.col(b)


def _sum(*cs):
    e = F.col(cs[0])
    for c in cs[1:]:
        e = e + F.col(c)
    return e


def _guarded_ratio(a, b):
    return F.col(a) / (F.col(b) + F.lit(1e-15))


def _equal_flag(a, b):
    return (F.col(a) == F.col(b)).cast("byte")


def _plain_ratio(a, b):
    return F.try_divide(F.col(a), F.col(b))


SHAPES: dict[str, Callable[..., Column]] = {
    "product": _product, "sum": _sum, "guarded_ratio": _guarded_ratio,
    "equal_flag": _equal_flag, "plain_ratio": _plain_ratio,
}


def add_features(df: DataFrame, registry: dict[int, tuple[str, str, tuple[str, ...]]],
                 ids: Sequence[int]) -> DataFrame:
    """P8 — add engineered features by id; ``registry[id] = (name, shape,
    input columns)``.  One ``withColumns`` → one projection."""
    return df.withColumns({registry[i][0]: SHAPES[registry[i][1]](*registry[i][2]) for i in ids})


def indicators(df: DataFrame, spec: dict[str, Sequence], keep: Sequence[str] = ()) -> DataFrame:
    """P9 — ``(col == v)`` as int8 for each listed category (one select)."""
    cols = [(F.col(c) == F.lit(v)).cast("byte").alias(f"{c}_{v}") for c, vs in spec.items() for v in vs]
    return df.select(*keep, *cols)


def text_filter(df: DataFrame, text: str, must: Sequence[str] = (), must_not: Sequence[str] = ()) -> DataFrame:
    """P12 — literal substring predicates."""
    cond = F.lit(True)
    for s in must:
        cond = cond & F.col(text).contains(s)
    for s in must_not:
        cond = cond & ~F.col(text).contains(s)
    return df.where(cond)


def _count(t: Column, s: str) -> Column:
    return (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / F.lit(len(s))


def validate_candidates(df: DataFrame, text: str, examples: DataFrame, example_text: str,
                        out: str = "reason") -> DataFrame:
    """P13 — reject reason per candidate (NULL = valid): blank, copy of an
    example (hash semi-join, text never shuffled), unbalanced () or {}."""
    ex = examples.select(F.sha2(F.col(example_text), 256).alias("_eh")).distinct() \
                 .withColumn("_is_copy", F.lit(True))
    x = df.withColumn("_eh", F.sha2(F.col(text), 256)).join(ex, "_eh", "left")
    t = F.col(text)
    reason = (F.when(F.trim(t) == "", "blank")
              .when(F.col("_is_copy"), "copy_of_example")
              .when((_count(t, "(") != _count(t, ")")) | (_count(t, "{") != _count(t, "}")), "unbalanced"))
    return x.withColumn(out, reason).drop("_eh", "_is_copy")


def normalize_quotes(c: Column) -> Column:
    """P14 — typographic double quotes → ASCII."""
    return F.translate(c, "„“", '""')


def minify(c: Column) -> Column:
    """P19 — literal escape sequences and line breaks removed/flattened,
    runs of spaces collapsed to one."""
    x = F.replace(c, F.lit("\\n"), F.lit(""))
    x = F.replace(x, F.lit("\\t"), F.lit(""))
    x = F.replace(x, F.lit("\r"), F.lit(""))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    x = F.replace(x, F.lit("\t"), F.lit(""))
    return F.regexp_replace(x, " {2,}", " ")


def parse_array_string(c: Column) -> Column:
    """P24 — ``"[ 0.1 -0.2 …]"`` → array<double> (no eval)."""
    body = F.trim(F.regexp_replace(c, r"[\[\]]", ""))
    return F.transform(F.split(body, r"\s+"), lambda s: s.try_cast("double"))


def outcome_class(c: Column) -> Column:
    """P25 — {-1, 0, 1} → {0, 1, 2}."""
    return F.element_at(F.create_map(F.lit(-1), F.lit(0), F.lit(0), F.lit(1), F.lit(1), F.lit(2)), c)


def saturation_class(c: Column, t: float = 0.999) -> Column:
    """P25 — ``(y > t) - (y < -t)``."""
    return (c > t).cast("int") - (c < -t).cast("int")


def whitespace_free(c: Column) -> Column:
    """X8 helper — drop spaces, newlines and tabs."""
    return F.regexp_replace(c, "[ \n\t]", "")
