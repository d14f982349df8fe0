"""Kernel identity: canonical parameter text, signatures, and wide <-> map forms.

A kernel's parameters live in nullable ``p_<name>`` columns. Their canonical form is a
JSON literal per parameter; the signature is the first 16 hex digits of the SHA-1 over the
sorted JSON text, so the same kernel hashes the same whatever file it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The parameters known to the built-in categories and their types.
PARAM_TYPES = {
    "m": "bigint", "n": "bigint", "k": "bigint", "bias": "boolean",
    "b": "bigint", "h": "bigint", "h_kv": "bigint", "s_q": "bigint", "s_kv": "bigint",
    "d": "bigint", "causal": "boolean", "block_q": "bigint", "block_kv": "bigint",
    "c_in": "bigint", "c_out": "bigint", "w": "bigint", "kh": "bigint", "kw": "bigint",
    "stride": "bigint", "pad": "bigint", "groups": "bigint",
    "rows": "bigint", "dim": "bigint", "affine": "boolean",
    "n_elem": "bigint", "threads": "bigint", "elems_per_thread": "bigint",
    "kind": "string",
}

_UNSAFE_TEXT = r'[^ -~]|["\\]'


def param_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("p_"))


def canonical_param(col: Column, dtype: T.DataType) -> Column:
    """JSON literal of one parameter; NULL stays NULL.

    Whole-valued floats become integers and the words True/False become booleans, so a
    round trip through CSV does not change the signature. Text or fractions whose JSON
    form Spark cannot reproduce exactly raise an error.
    """
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "true").when(~col, "false")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("string")
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        v = col.cast("double")
        plain = (F.abs(v) >= 1e-3) & (F.abs(v) < 1e7)
        return (
            F.when(F.isnan(v), F.lit(None).cast("string"))
            .when((v == F.floor(v)) & (F.abs(v) < 1e18), v.cast("bigint").cast("string"))
            .when(plain, v.cast("string"))
            .when(v.isNotNull(), F.raise_error(F.concat(F.lit("parameter has no canonical form: "), v.cast("string"))))
        )
    if isinstance(dtype, T.StringType):
        return (
            F.when(col.isin("True", "False"), F.lower(col))
            .when(col.rlike(_UNSAFE_TEXT), F.raise_error(F.concat(F.lit("parameter text needs escaping: "), col)))
            .when(col.isNotNull(), F.concat(F.lit('"'), col, F.lit('"')))
        )
    raise TypeError(f"parameters of type {dtype.simpleString()} have no canonical form")


def _literals(df: DataFrame) -> dict[str, Column]:
    return {c[2:]: canonical_param(F.col(c), df.schema[c].dataType) for c in param_columns(df)}


def _digest(category: Column, dtype: Column, params_text: Column) -> Column:
    text = F.concat(
        F.lit('{"category": "'), category, F.lit('", "dtype": "'), dtype,
        F.lit('", "params": {'), params_text, F.lit("}}"),
    )
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def signature(df: DataFrame, category: str = "category", dtype: str = "dtype") -> Column:
    """Signature over the frame's ``p_*`` columns."""
    lits = _literals(df)
    parts = [F.concat(F.lit(f'"{k}": '), lits[k]) for k in sorted(lits)]
    return _digest(F.col(category), F.col(dtype), F.concat_ws(", ", *parts) if parts else F.lit(""))


def signature_of_map(category: Column, dtype: Column, params: Column) -> Column:
    """Signature over a map of JSON literals."""
    entries = F.array_sort(F.map_entries(params))
    text = F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    return _digest(category, dtype, F.array_join(text, ", "))


def params_to_map(df: DataFrame, out: str = "params") -> DataFrame:
    """Collapse the ``p_*`` columns into a map of JSON literals without absent entries."""
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(_literals(df).items())]
    if not pairs:
        return df.withColumn(out, F.expr("map_from_entries(cast(array() as array<struct<key:string,value:string>>))"))
    entries = F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())
    return df.withColumn(out, F.map_from_entries(entries)).drop(*param_columns(df))


def params_to_columns(df: DataFrame, names: dict[str, str] | list[str], params: str = "params") -> DataFrame:
    """Spread a parameter map into typed ``p_*`` columns (types default to the known ones)."""
    types = names if isinstance(names, dict) else {n: PARAM_TYPES.get(n, "string") for n in names}
    spread = {}
    for name, dtype in types.items():
        text = F.regexp_replace(F.col(params).getItem(name), '^"|"$', "")
        value = text.try_cast("double") if dtype in ("bigint", "int") else text
        spread[f"p_{name}"] = value.try_cast(dtype)
    return df.withColumns(spread).drop(params)


def describe(df: DataFrame, category: str = "category", dtype: str = "dtype") -> Column:
    """Readable form ``category[dtype](a=1,b=2)`` with parameters in name order."""
    shown = []
    for k, lit in sorted(_literals(df).items()):
        text = (F.when(lit == "true", "True").when(lit == "false", "False")
                .otherwise(F.regexp_replace(lit, '^"|"$', "")))
        shown.append(F.concat(F.lit(f"{k}="), text))
    return F.concat(F.col(category), F.lit("["), F.col(dtype), F.lit("]("), F.concat_ws(",", *shown), F.lit(")"))
