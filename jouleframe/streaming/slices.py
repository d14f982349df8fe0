"""Telemetry cut into short time slices, and longer spans put together from slices.

A slice is one row of mergeable numbers: counts, sums, extremes, its own integral, its end
points, and the sorted values that exact medians need. Streams keep state per slice only,
which the watermark clears as soon as the slice is over; how long a window, run or session
lasts does not matter to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jouleframe.functions.labels import throttle_set
from jouleframe.operators.quantiles import group_quantiles, median

SLICE = "60 seconds"
MEANS = {"sm_clock": "sm_clock_mean_mhz", "mem_clock": "mem_clock_mean_mhz", "temp": "temperature_mean_c",
         "util_gpu": "util_gpu_mean_pct", "util_mem": "util_mem_mean_pct"}
PEAKS = {"power_w": "power_max_w", "sm_clock": "sm_clock_max_mhz", "temp": "temperature_max_c"}
FLAGS = {"frac_sw_power_cap": "sw_power_cap", "frac_hw_slowdown": "hw_slowdown", "frac_sw_thermal": "sw_thermal_slowdown", "frac_hw_thermal": "hw_thermal_slowdown"}
MEDIANS = {"power_w": "power_median_w", "sm_clock": "sm_clock_median_mhz"}


def micros(spark: SparkSession, interval: str) -> int:
    """Length of an interval of days or less, such as ``6 hours``."""
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {interval})")).first()[0]


def slice_for(spark: SparkSession, slice_: str, *spans: str | None) -> str:
    """The longest slice up to ``slice_`` of which every span is a multiple."""
    return f"{math.gcd(*[micros(spark, s) for s in (slice_, *spans) if s])} microseconds"


def slice_columns(columns: list[str]) -> dict[str, str]:
    """Number columns of a slice and how those of two slices combine: ``sum`` or ``max``."""
    has = set(columns)
    out = {"n_samples": "sum", "power_w_n": "sum", "power_w_sum": "sum", "power_w_squares": "sum", "energy_integrated_j": "sum"}
    for c in MEANS:
        if c in has:
            out |= {f"{c}_n": "sum", f"{c}_sum": "sum"}
    out |= {f"{c}_max": "max" for c in PEAKS if c in has}
    if "throttle" in has:
        out |= {"throttle_n": "sum"} | {f"{f}_n": "sum" for f in FLAGS}
    return out


def sliced(samples: DataFrame, keys: list[str], slice_: str = SLICE, tie: list[str] = (), delay: str | None = None) -> DataFrame:
    """One row per (slice, keys) of a table, or of a stream with a watermark of ``delay``.

    The state of a slice is its samples: as many as come in ``slice_`` at the sampling rate.
    """
    has = set(samples.columns)
    number = lambda c: F.col(c).cast("double")
    aggs = [F.count("*").alias("n_samples"), F.count("power_w").alias("power_w_n"), F.sum(number("power_w")).alias("power_w_sum"),
            F.sum(number("power_w") * number("power_w")).alias("power_w_squares")]
    for c in MEANS:
        if c in has:
            aggs += [F.count(c).alias(f"{c}_n"), F.sum(number(c)).alias(f"{c}_sum")]
    aggs += [F.max(number(c)).alias(f"{c}_max") for c in PEAKS if c in has]
    if "throttle" in has:
        aggs += [F.count("throttle").alias("throttle_n")] + [F.count_if(throttle_set(F.col("throttle"), r)).alias(f"{f}_n") for f, r in FLAGS.items()]
    if "counter_mj" in has:
        at = F.when(F.col("counter_mj").isNotNull(), F.unix_micros("ts"))
        for name, f, g in (("first", F.min, F.min_by), ("last", F.max, F.max_by)):
            aggs += [f(at).alias(f"counter_{name}_t"), g(number("counter_mj"), at).alias(f"counter_{name}")]
    points = F.collect_list(F.struct(F.unix_micros("ts").alias("t"), *tie, number("power_w").alias("p")))
    aggs.append(F.array_sort(points).alias("_points"))
    aggs += [F.array_sort(F.collect_list(number(c))).alias(f"{c}_values") for c in MEDIANS if c in has]
    timed = samples.withWatermark("ts", delay) if delay else samples
    out = timed.groupBy(F.window("ts", slice_).alias("_slice"), *keys).agg(*aggs)
    start = F.struct(F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("e"))
    step = lambda a, s: F.struct(s["t"].alias("t"), s["p"].alias("p"),
                                 (a["e"] + F.coalesce(0.5 * (a["p"] + s["p"]) * ((s["t"] - a["t"]) / 1e6), F.lit(0.0))).alias("e"))
    first, last = F.element_at("_points", 1), F.element_at("_points", -1)
    kept = [c for c in out.columns if c not in ("_slice", "_points", *keys)]
    return out.select(
        F.window_time("_slice").alias("slice_time") if samples.isStreaming else F.col("_slice.start").alias("slice_time"),
        F.col("_slice.start").alias("slice_start"), *keys, *kept, F.aggregate("_points", start, step, lambda a: a["e"]).alias("energy_integrated_j"),
        first["t"].alias("first_t"), first["p"].alias("first_p"), last["t"].alias("last_t"), last["p"].alias("last_p"))


def summary(columns: list[str]) -> list[Column]:
    """The summary of a span from its combined slice columns, without medians."""
    has = set(columns)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    mean = ratio("power_w_sum", "power_w_n")
    out = [F.col("n_samples").cast("bigint").alias("n_samples"), F.greatest((F.col("last_t") - F.col("first_t")) / 1e6, F.lit(1e-9)).alias("duration_s"),
           mean.alias("power_mean_w"), F.col("power_w_max").alias("power_max_w"),
           F.sqrt(F.greatest(ratio("power_w_squares", "power_w_n") - mean * mean, F.lit(0.0))).alias("power_sd_w")]
    out += [ratio(f"{c}_sum", f"{c}_n").alias(name) for c, name in MEANS.items() if f"{c}_n" in has]
    out += [F.col(f"{c}_max").alias(name) for c, name in PEAKS.items() if c != "power_w" and f"{c}_max" in has]
    if "throttle_n" in has:
        out += [ratio(f"{f}_n", "throttle_n").alias(f) for f in FLAGS]
    if "counter_last" in has:
        out.append(((F.col("counter_last") - F.col("counter_first")) / 1000.0).alias("energy_counter_j"))
    return [*out, "energy_integrated_j"]


def assembled(slices: DataFrame, keys: list[str]) -> DataFrame:
    """One summary per ``keys`` from slice rows: combined numbers, bridges between slices, exact medians."""
    sources = [c.removesuffix("_values") for c in slices.columns if c.endswith("_values")] + [
        c.removesuffix("_sum") for c in slices.columns if c.endswith("_sum")] + (["throttle"] if "throttle_n" in slices.columns else [])
    along = Window.partitionBy(*keys).orderBy("slice_start")
    bridge = 0.5 * (F.col("first_p") + F.lag("last_p").over(along)) * ((F.col("first_t") - F.lag("last_t").over(along)) / 1e6)
    joined = slices.withColumn("energy_integrated_j", F.col("energy_integrated_j") + F.coalesce(bridge, F.lit(0.0)))
    combine = {"sum": F.sum, "max": F.max}
    aggs = [combine[how](c).alias(c) for c, how in slice_columns(sources).items()]
    aggs += [F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t")]
    if "counter_last" in slices.columns:
        aggs += [F.min_by("counter_first", "counter_first_t").alias("counter_first"), F.max_by("counter_last", "counter_last_t").alias("counter_last")]
    plain = joined.groupBy(*keys).agg(*aggs)
    out = plain.select(*keys, *summary(plain.columns))
    values = [c for c in slices.columns if c.endswith("_values")]
    tall = slices.select(*keys, F.explode(F.arrays_zip(*values)).alias("v")).select(*keys, "v.*")
    middle = group_quantiles(tall, keys, [median(MEDIANS[c.removesuffix("_values")], F.col(c)) for c in values])
    return out.join(middle, keys, "left")
