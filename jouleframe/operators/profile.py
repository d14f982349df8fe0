"""Profiler tables: what costs the runtime and how much of it is modelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jouleframe.functions.labels import IMPLEMENTED, categorise_kernel, is_device_kernel
from jouleframe.operators.ordering import with_running


def device_kernels(records: DataFrame, name: str = "kernel", time: str = "cuda_time_us") -> DataFrame:
    """Device-side rows with time, tagged with their category."""
    return (records.filter(is_device_kernel(F.col(name)) & (F.col(time) > 0))
            .withColumn("category", categorise_kernel(F.col(name))))


def kernel_shares(profile: DataFrame, run: list[str], name: str = "kernel", time: str = "cuda_time_us") -> DataFrame:
    """Share of each kernel in its run and the running share, most expensive first.

    ``name`` must be unique within a run. Run totals come from an aggregate joined back, so
    a hot run is pre-summed per task instead of gathered in a window.
    """
    totals = profile.groupBy(*run).agg(F.sum(time).alias("_total"))
    shared = profile.join(totals, run).withColumn("share", F.col(time) / F.col("_total")).drop("_total")
    return with_running(shared, run, [F.desc(time), F.col(name)], {"cumshare": F.col("share")})


def coverage_report(profile: DataFrame, run: list[str] = (), implemented=IMPLEMENTED,
                    name: str = "kernel", time: str = "cuda_time_us") -> DataFrame:
    """Per category time, calls, distinct kernels and share, plus a ``__covered__`` row per run."""
    run = list(run)
    per_kernel = profile.groupBy(*run, "category", name).agg(F.sum(time).alias("t"), F.sum("calls").alias("c"))
    by_cat = per_kernel.groupBy(*run, "category").agg(
        F.sum("t").alias("cuda_time_us"), F.sum("c").alias("calls"), F.count("*").alias("n_kernels"))
    by_cat = by_cat.withColumn("implemented", F.col("category").isin(*implemented))
    mine = lambda c: F.coalesce(F.sum(F.when(F.col("implemented"), F.col(c))), F.lit(0))
    covered = by_cat.groupBy(*run).agg(
        mine("cuda_time_us").alias("cuda_time_us"), mine("calls").alias("calls"), mine("n_kernels").alias("n_kernels"),
        F.sum("cuda_time_us").alias("_total"))
    covered = covered.withColumns({"category": F.lit("__covered__"), "implemented": F.lit(True)})
    if run:
        rows = by_cat.join(covered.select(*run, "_total"), run)
    else:
        rows = by_cat.withColumn("_total", covered.select("_total").scalar())
    out = rows.unionByName(covered.select(*rows.columns))
    return out.withColumn("share", F.col("cuda_time_us") / F.col("_total")).drop("_total")


def top_uncovered(profile: DataFrame, n: int = 15, implemented=IMPLEMENTED, name: str = "kernel",
                  time: str = "cuda_time_us") -> DataFrame:
    """The most expensive kernels no category describes."""
    keep = [c for c in (name, "category", "calls", time, "share") if c in profile.columns]
    return profile.filter(~F.col("category").isin(*implemented)).orderBy(F.desc(time), name).limit(n).select(*keep)


def device_time(profile: DataFrame, run: list[str], time: str = "cuda_time_us") -> DataFrame:
    """Device seconds of each run, in total and in named categories."""
    t = F.col(time) / 1e6
    return profile.groupBy(*run).agg(
        F.sum(t).alias("device_time_s"),
        F.sum(F.when(F.col("category") != "other", t).otherwise(0.0)).alias("device_time_covered_s"))
