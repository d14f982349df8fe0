"""Sinks."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from jouleframe.operators.catalogue import ordered, pivot_calls
from jouleframe.runtime import path_exists
from jouleframe.schema import MEASUREMENT


def write_catalogue(catalogue: DataFrame, path: str, models: list[str] | None = None) -> None:
    """CSV sorted by category, then most-called first, with one calls column per model."""
    flat = pivot_calls(ordered(catalogue), models)
    flat.write.mode("overwrite").option("header", True).csv(path)


def check_columns(df: DataFrame, table: dict[str, str], extra: list[str] = ()) -> None:
    """Refuse columns that are neither in the table nor kernel parameters."""
    unknown = sorted(c for c in df.columns if c not in table and c not in extra and not c.startswith("p_") and not c.endswith("_version"))
    if unknown:
        raise ValueError(f"rows introduce columns {unknown} that the table does not have")


def content_token(df: DataFrame) -> str:
    """A name for the rows of ``df`` that neither their order nor their partitioning changes."""
    parts = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h"), F.xxhash64(F.lit(1), *sorted(df.columns)).alias("g"))
    r = parts.agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).first()
    return hashlib.sha1(f"{sorted(df.columns)}:{r['n']}:{r['h']}:{r['g']}".encode()).hexdigest()


COMMIT = "job string, attempt string, name string, n_rows long"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The attempt that counts of every committed job: job, attempt, name, n_rows."""
    if not path_exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMIT)
    found = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    # Several attempts of one job may commit at the same time; all readers take the same one.
    return found.groupBy("job").agg(F.min(F.struct("attempt", "name", "n_rows")).alias("c")).select("job", "c.*")


def append_measurements(df: DataFrame, path: str, job: str | None = None) -> bool:
    """Append the rows of ``job`` to a parquet table laid out by job, card and category; False if they were there.

    A job that is retried or repeated adds nothing. Without ``job`` the rows name themselves,
    so the same rows are not appended twice. Each attempt writes to folders of its own and is
    entered in the manifest when its rows are complete, so a lost attempt leaves no rows
    behind and writers do not disturb each other. Columns the table lacks are refused.
    """
    spark = df.sparkSession
    check_columns(df, MEASUREMENT)
    name = job if job is not None else content_token(df)
    # Letters in front keep these folder names text.
    token, attempt = f"j{hashlib.sha1(name.encode()).hexdigest()}", f"a{uuid.uuid4().hex}"
    done = commits(spark, path)
    if not done.where(F.col("job") == token).isEmpty():
        return False
    if not done.isEmpty():
        unseen = sorted(set(df.columns) - set(read_appended(spark, path).columns))
        if unseen:
            raise ValueError(f"rows introduce columns {unseen} not in the existing table at {path}")
    place = f"job={token}/attempt={attempt}"
    df.write.partitionBy("gpu_key", "category").parquet(f"{path}/rows/{place}")
    written = spark.read.schema(df.schema).parquet(f"{path}/rows/{place}").count()
    spark.createDataFrame([(name, written)], "name string, n_rows long").coalesce(1).write.parquet(f"{path}/commits/{place}")
    return True


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``append_measurements`` keeps: rows of committed jobs, each job once."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/rows")
    return rows.join(commits(spark, path).select("job", "attempt"), ["job", "attempt"], "left_semi").drop("job", "attempt")


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_predictions(predictions: DataFrame, path: str, fold: str, fmt: str = "parquet") -> None:
    """One partition per fold; rewriting a fold leaves the others in place."""
    tagged = predictions.withColumn("fold", F.lit(fold))
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_report_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One small CSV table per fold."""
    for fold, table in tables.items():
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{fold}")
