"""Data quality and campaign progress reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jouleframe.functions.categories import REGISTRY
from jouleframe.operators.quantiles import Quantile, group_quantiles, median


def validate_efficiency(df: DataFrame, by: list[str] = ("category", "gpu_key")) -> DataFrame:
    """Where the analytical floor exceeds the measured time, worst first."""
    eta = F.col("eta")
    out = group_quantiles(
        df, list(by), [median("eta_median", eta), Quantile("eta_p95", eta, 0.95)],
        [F.count("*").alias("n"), F.max(eta).alias("eta_max"),
         F.avg(F.coalesce(eta > 1.0, F.lit(False)).cast("double")).alias("frac_over_1")])
    return out.select(*by, "n", "eta_median", "eta_p95", "eta_max", "frac_over_1").orderBy(F.desc("frac_over_1"), *by)


def coverage(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Rows per card and category with a total over all rows.

    Columns are the given categories (default: the registered ones); rows of any other, or of
    none, are counted in ``other``, which is there only when the list leaves rows out.
    """
    cats = list(categories or REGISTRY.names())
    counts = [F.count_if(F.col("category") == c).alias(c) for c in cats]
    outside = ~F.coalesce(F.col("category").isin(*cats), F.lit(False))
    left_out = [] if df.where(outside).isEmpty() else [F.count_if(outside).alias("other")]
    return df.groupBy("gpu_key").agg(*counts, *left_out, F.count("*").alias("total"))


def instrument_agreement(df: DataFrame) -> DataFrame:
    r = F.col("energy_check_ratio")
    return group_quantiles(df, ["gpu_key"], [median("median", r)],
                           [F.stddev_samp(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max")])


def power_regime(df: DataFrame) -> DataFrame:
    return group_quantiles(
        df, ["gpu_key"],
        [median("clock_frac", F.col("sm_clock_median_mhz")), median("power_frac", F.col("pi")), median("util", F.col("eta"))],
        [F.avg("frac_sw_power_cap").alias("frac_capped"), F.avg("frac_sw_thermal").alias("frac_thermal")])


def target_description(df: DataFrame, columns: list[str] = ("eta", "pi", "power_avg_w")) -> DataFrame:
    """count, mean, sample sd, min, quartiles, max of each target per category (tidy rows)."""
    quantiles, aggs = [], []
    for c in columns:
        v = F.col(c)
        aggs += [F.count(v).alias(f"{c}|count"), F.avg(v).alias(f"{c}|mean"), F.stddev_samp(v).alias(f"{c}|std"),
                 F.min(v).alias(f"{c}|min"), F.max(v).alias(f"{c}|max")]
        quantiles += [Quantile(f"{c}|q25", v, 0.25), Quantile(f"{c}|q50", v, 0.5), Quantile(f"{c}|q75", v, 0.75)]
    wide = group_quantiles(df, ["category"], quantiles, aggs)
    names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("target"), *[F.col(f"`{c}|{n}`").alias(n) for n in names]) for c in columns])).alias("r")
    return wide.select("category", rows).select("category", "r.*")


def quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """The tables worth reading before trusting a fold result; optional ones need their columns."""
    out = {"efficiency": validate_efficiency(df), "coverage": coverage(df)}
    if "energy_check_ratio" in df.columns:
        out["instrument_agreement"] = instrument_agreement(df)
    if {"frac_sw_power_cap", "frac_sw_thermal", "sm_clock_median_mhz"} <= set(df.columns):
        out["power_regime"] = power_regime(df)
    out["targets"] = target_description(df)
    return out


def power_cap_audit(df: DataFrame) -> DataFrame:
    """Rows flagged when the enforced power limit differs from the default or the table's TDP."""
    limit, default, tdp = (F.col(c).cast("double") for c in ("power_limit_w", "power_limit_default_w", "tdp_w"))
    return df.withColumns({
        "limit_below_default": F.coalesce(F.abs(limit - default) > 1.0, F.lit(False)),
        "limit_off_tdp": F.coalesce((limit > 0) & (F.abs(limit / tdp - 1.0) > 0.02), F.lit(False)),
    })


def pi_floor_audit(df: DataFrame, idle_fraction: str = "idle_fraction", by: list[str] = ("gpu_key",)) -> DataFrame:
    """Training rows below their card's idle fraction: how many and how far."""
    below = F.col("pi") < F.col(idle_fraction)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(below).alias("n_below"),
        F.min(F.when(below, F.col("pi"))).alias("worst_pi"),
        F.max(F.when(below, F.col(idle_fraction))).alias("highest_floor"))


def progress(measurements: DataFrame, catalogue: DataFrame, expected_cards: list[str]) -> DataFrame:
    """Distinct kernels per card against the catalogue, with unexpected, missing and total rows.

    A card's shard files are counted when the frame carries ``file_name``.
    """
    files = F.col("file_name") if "file_name" in measurements.columns else F.lit(None).cast("string")
    # Two levels keep the distinct counts spread over tasks.
    per_kernel = measurements.groupBy("gpu_key", "kernel_sig").agg(F.lit(1).alias("one"))
    n_files = (measurements.select("gpu_key", files.alias("f")).distinct()
               .groupBy("gpu_key").agg(F.count("f").alias("n_files")))
    found = per_kernel.groupBy("gpu_key").agg(F.count("*").alias("n_kernels")).join(n_files, "gpu_key")
    spark = measurements.sparkSession
    expected = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in expected_cards])).alias("gpu_key"))
    size = catalogue.select("kernel_sig").distinct().agg(F.count("*").alias("n_catalogue")).scalar()
    joined = found.withColumn("on_disk", F.lit(True)).join(
        expected.withColumn("expected", F.lit(True)), "gpu_key", "full_outer")
    cards = joined.select(
        "gpu_key", F.coalesce("n_kernels", F.lit(0)).cast("bigint").alias("n_kernels"),
        F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"),
        F.when(F.col("expected").isNull(), "unexpected").when(F.col("on_disk").isNull(), "missing").otherwise("ok").alias("state"))
    total = cards.agg(F.lit("TOTAL").alias("gpu_key"), F.sum("n_kernels").alias("n_kernels"),
                      F.sum("n_files").alias("n_files"), F.lit("total").alias("state"))
    sized = cards.unionByName(total).withColumn("n_catalogue", size)
    pct = F.when((F.col("n_catalogue") > 0) & (F.col("state") != "total"), 100.0 * F.col("n_kernels") / F.col("n_catalogue"))
    return sized.withColumn("pct_of_catalogue", pct)


def sweep_outcome(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of measured / skipped / failed / remaining work over an outcome log with ``status``."""
    s = F.col("status")
    return log.groupBy(*by).agg(
        F.count_if(s == "measured").alias("measured"), F.count_if(s == "done").alias("skipped_done"),
        F.count_if(s == "oom").alias("skipped_oom"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "remaining").alias("remaining"))


# Log lines that mean a row or a config needs attention.
LOG_WARNINGS = ["CONTENDED", "skip (oom)", "FAILED", "PREFLIGHT FAILED", "exiting 64"]


def log_warnings(lines: DataFrame, patterns: list[str] = LOG_WARNINGS, text: str = "value", log: str = "file_name") -> DataFrame:
    """How many logs contain each pattern; patterns found nowhere give no row."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).contains(p), F.lit(p)) for p in patterns]))
    per_log = lines.select(F.col(log).alias("_log"), F.explode(hits).alias("pattern")).distinct()
    return per_log.groupBy("pattern").agg(F.count("*").alias("n_logs"))
