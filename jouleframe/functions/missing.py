"""NaN and NULL: one notion of a missing number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN orders above every number in Spark, so it must not reach a filter or a max."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def optional(df: DataFrame, name: str, dtype: str = "double", default=None) -> Column:
    """Column ``name`` when the frame has it, else ``default`` typed as ``dtype``."""
    return F.col(name) if name in df.columns else F.lit(default).cast(dtype)


def require_columns(df: DataFrame, names, hint: str = "") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"frame is missing {missing}" + (f"; {hint}" if hint else ""))


def log_floored(x: Column, floor: float = 1e-30) -> Column:
    return F.ln(F.greatest(x, F.lit(floor)))
