"""Readers. Every table gets an explicit schema; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jouleframe import schema as S
from jouleframe.functions.missing import nan_to_null
from jouleframe.operators.catalogue import build_catalogue, split_calls
from jouleframe.operators.merge import union_ragged

# Whole numbers may be written as 4608.0, so they are read as double and narrowed.
_WHOLE = ("int", "bigint")


def _typed_csv(spark: SparkSession, paths: list[str], header: list[str], table: dict[str, str]) -> DataFrame:
    types = {c: S.column_type(c, table) for c in header}
    read_as = ", ".join(f"`{c}` {'double' if t in _WHOLE else t}" for c, t in types.items())
    raw = (spark.read.option("header", True).option("mode", "FAILFAST").option("nanValue", "NaN")
           .schema(read_as).csv(paths))
    narrowed = nan_to_null(raw)
    cols = [F.col(c).cast(t).alias(c) if t in _WHOLE else F.col(c) for c, t in types.items()]
    return narrowed.select(*cols, F.col("_metadata.file_name").alias("file_name"))


def _csv_by_header(spark: SparkSession, path: str, table: dict[str, str], first: str, pattern: str | None) -> DataFrame:
    """Files whose headers differ (each category has its own ``p_*``) are read per header.

    The header of a file is its line starting with the column name ``first``; empty files
    have none and are left out.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    lines = reader.text(path)
    headers = (lines.filter(F.col("value").startswith(f"{first},"))
               .select("value", F.col("_metadata.file_path").alias("p")).distinct()
               .groupBy("value").agg(F.collect_list("p").alias("paths")).collect())
    if not headers:
        raise FileNotFoundError(f"no non-empty files under {path}" + (f" matching {pattern}" if pattern else ""))
    frames = [_typed_csv(spark, sorted(r["paths"]), r["value"].strip().split(","), table)
              for r in sorted(headers, key=lambda r: r["value"])]
    return union_ragged(frames)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture rows from one file or every ``capture__*.csv`` of a folder."""
    return _csv_by_header(spark, path, S.CAPTURE, "kernel_sig", None if path.endswith(".csv") else "capture__*.csv")


def read_measurements(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Every non-empty per-(card, category, shard) file of a folder, with its ``file_name``."""
    return _csv_by_header(spark, path, S.MEASUREMENT, "kernel_sig", pattern)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """One results table, CSV or parquet."""
    if path.endswith((".csv", ".csv.gz")):
        header = spark.read.option("header", True).csv(path).columns
        return _typed_csv(spark, [path], header, S.MEASUREMENT).drop("file_name")
    return nan_to_null(spark.read.parquet(path))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A written catalogue back in catalogue form; calls are divided evenly over its models."""
    header = spark.read.option("header", True).csv(path).columns
    rows = _typed_csv(spark, [path], header, S.CATALOGUE).drop("file_name", *[c for c in header if c.startswith("calls_") and c != "calls_total"])
    return build_catalogue(split_calls(rows), add_elementwise=False, max_working_set_gb=None)


def read_e2e(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, calls) of a folder, each tagged by file; runs without a calls file are left out."""
    runs = _csv_by_header(spark, path, S.E2E_RUN, "gpu_key", "e2e__*.csv")
    calls = _csv_by_header(spark, path, S.E2E_CALLS, "kernel_sig", "e2e_calls__*.csv")
    tag = lambda prefix: F.regexp_replace("file_name", f"^{prefix}|\\.csv$", "")
    runs = runs.withColumn("tag", tag("e2e__")).drop("file_name")
    calls = calls.withColumn("tag", tag("e2e_calls__")).drop("file_name")
    return runs.join(calls.select("tag").distinct(), "tag", "left_semi"), calls


def read_training_moments(spark: SparkSession, path: str) -> DataFrame:
    """One row per operator: feature names, mean vector, precision matrix, distance quantiles."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", S.MOMENTS)).alias("operator", "m")).select("operator", "m.*")


def read_tile_reference(spark: SparkSession, path: str) -> DataFrame:
    """Launch-geometry table (one CSV, gzip or not) with ``idx``, the row order of the file."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(S.TILE_REFERENCE) - set(header))
    if missing:
        raise ValueError(f"tile reference lacks {missing}")
    types = {c: S.column_type(c, S.TILE_REFERENCE) for c in header}
    # Flags are written as 0/1; one partition keeps file order.
    read_as = ", ".join(f"`{c}` {'string' if t in ('string', 'boolean') else 'double'}" for c, t in types.items())
    raw = spark.read.option("header", True).schema(read_as).csv(path).coalesce(1).withColumn("idx", F.monotonically_increasing_id())
    flag = F.lower("is_split_k").isin("1", "1.0", "true")
    return raw.select("idx", *[flag.alias(c) if c == "is_split_k" else F.col(c).cast(t).alias(c) for c, t in types.items()])


def read_telemetry(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False, table: dict[str, str] = S.TELEMETRY) -> DataFrame:
    """Power samples as a table or a stream."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in table.items())
    reader = spark.readStream if stream else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return nan_to_null(reader.format(fmt).schema(ddl).load(path))
