"""Merging measurement shards and filtering unreliable rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from jouleframe.functions.missing import optional

KEY = ["kernel_sig", "gpu_key"]


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_contended(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(optional(df, "contended", "int"), F.lit(0)) == 0)


def merge_measurements(df: DataFrame, later: list[str], keys: list[str] = KEY, clean_only: bool = False) -> DataFrame:
    """One row per key: a clean row beats a contended one, then the latest wins.

    ``later`` lists the columns that define "later", most significant first; make it total.
    The filter on the row number lets Spark keep one row per key on the map side before the
    shuffle, so a hot key never gathers in one task.
    """
    flagged = df.withColumn("contended", F.coalesce(optional(df, "contended", "int").cast("int"), F.lit(0)))
    if clean_only:
        flagged = flagged.filter(F.col("contended") == 0)
    w = Window.partitionBy(*keys).orderBy(F.col("contended").asc(), *[F.col(c).desc_nulls_last() for c in later])
    return flagged.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def unstable(max_energy_sd_rel: float = 0.05):
    return F.coalesce(F.col("energy_sd_rel"), F.lit(0.0)) > max_energy_sd_rel


def filter_reliable(df: DataFrame, max_energy_sd_rel: float = 0.05, min_latency_s: float = 5e-6) -> DataFrame:
    """Drop rows with unstable repeats, then rows too short to trust (or without a latency)."""
    return df.filter(~unstable(max_energy_sd_rel)).filter(F.col("latency_s") > min_latency_s)


def reliability_counts(df: DataFrame, max_energy_sd_rel: float = 0.05, min_latency_s: float = 5e-6) -> DataFrame:
    """Rows in, dropped as unstable, dropped as tiny, kept - in one pass."""
    bad = unstable(max_energy_sd_rel)
    long_enough = F.coalesce(F.col("latency_s") > min_latency_s, F.lit(False))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(bad).alias("n_unstable"),
        F.count_if(~bad & ~long_enough).alias("n_tiny"), F.count_if(~bad & long_enough).alias("n_kept"))
