"""Column selection and table profiling (plan-time checks and one-pass aggregates)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed

_NOT_TEXT = (T.NumericType, T.BooleanType)


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Raise once, naming every missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Các cột không tồn tại: {', '.join(missing)}; có: {', '.join(df.columns)}")


def detect_text_column(df: DataFrame, sample_schema: T.StructType | None = None) -> str | None:
    """``MESSAGE`` if present, else the first column whose type is neither numeric nor boolean.

    For all-string input (CSV read without inference) pass the schema inferred from a
    sample, so a numeric ``ID`` column is not picked.
    """
    if fixed.DEFAULT_TEXT_COLUMN in df.columns:
        return fixed.DEFAULT_TEXT_COLUMN
    schema = sample_schema or df.schema
    for f in schema.fields:
        if f.name in df.columns and not isinstance(f.dataType, _NOT_TEXT):
            return f.name
    return None


def select_columns(df: DataFrame, spec: str) -> list[str]:
    """``"1,3,5"`` (1-based ordinals) or ``"a,b"`` (names) -> column names in the given order."""
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    if not parts:
        raise ValueError("no columns selected")
    if all(p.isdigit() for p in parts):
        bad = [p for p in parts if not 1 <= int(p) <= len(df.columns)]
        if bad:
            raise ValueError(f"ordinals out of range 1..{len(df.columns)}: {', '.join(bad)}")
        return [df.columns[int(p) - 1] for p in parts]
    require_columns(df, parts)
    return parts


def with_result_column(df: DataFrame, name: str = fixed.RESULT_COLUMN) -> DataFrame:
    """Add an empty result column when the table has none."""
    return df if name in df.columns else df.withColumn(name, F.lit(""))


def profile_columns(df: DataFrame, key: str, cols: Sequence[str] | None = None, width: int = 50) -> DataFrame:
    """One row per column: ``column_name, n_rows, sample`` where sample is the first
    non-NULL value by ``key`` (cut to ``width`` + '...', 'N/A' when none). One aggregate pass."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.expr(f"min_by(cast(`{c}` as string), `{key}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"_v{i}"))
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', _v{i}" for i, c in enumerate(cols))
    long = one.selectExpr("n_rows", f"stack({len(cols)}, {stack}) as (column_name, v)")
    sample = F.coalesce(F.when(F.length("v") > width, F.concat(F.substring("v", 1, width), F.lit("..."))).otherwise(F.col("v")),
                        F.lit(fixed.MISSING_VALUE))
    return long.select("column_name", "n_rows", sample.alias("sample"))
