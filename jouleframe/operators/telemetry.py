"""Power telemetry and repeat windows rolled up to one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jouleframe.functions.labels import throttle_set
from jouleframe.functions.metrics import population_sd_rel
from jouleframe.functions.missing import optional
from jouleframe.operators.quantiles import group_quantiles, median

SLICE_SECONDS = 60


def sample_stats(columns: list[str]) -> list[Column]:
    """The plain aggregates of one sampling window, over the columns the frame carries."""
    has = set(columns)
    out = [F.count("*").alias("n_samples"),
           F.greatest((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, F.lit(1e-9)).alias("duration_s"),
           F.avg("power_w").alias("power_mean_w"), F.max("power_w").alias("power_max_w"),
           F.stddev_pop("power_w").alias("power_sd_w")]
    if "sm_clock" in has:
        out += [F.avg("sm_clock").alias("sm_clock_mean_mhz"), F.max("sm_clock").alias("sm_clock_max_mhz")]
    if "mem_clock" in has:
        out.append(F.avg("mem_clock").alias("mem_clock_mean_mhz"))
    if "temp" in has:
        out += [F.avg("temp").alias("temperature_mean_c"), F.max("temp").alias("temperature_max_c")]
    out += [F.avg(c).alias(f"{c}_mean_pct") for c in ("util_gpu", "util_mem") if c in has]
    if "throttle" in has:
        for reason, name in (("sw_power_cap", "frac_sw_power_cap"), ("hw_slowdown", "frac_hw_slowdown"),
                             ("sw_thermal_slowdown", "frac_sw_thermal"), ("hw_thermal_slowdown", "frac_hw_thermal")):
            out.append(F.avg(throttle_set(F.col("throttle"), reason).cast("double")).alias(name))
    if "counter_mj" in has:
        out.append(counter_delta_j().alias("energy_counter_j"))
    return out


def counter_delta_j() -> Column:
    """Joules between the first and last reading of the cumulative millijoule counter (aggregate)."""
    at = F.when(F.col("counter_mj").isNotNull(), F.col("ts"))
    return (F.max_by("counter_mj", at) - F.min_by("counter_mj", at)) / 1000.0


def trapezoid_energy(samples: DataFrame, keys: list[str], slice_s: int = SLICE_SECONDS, tie: list[str] = ()) -> DataFrame:
    """Trapezoidal integral of ``power_w`` over ``ts`` per group.

    Each group is cut into time slices that are integrated on their own; the gaps between
    consecutive slices are added from their end samples. A group of any length is spread
    over tasks.
    """
    t = F.unix_micros("ts")
    cut = samples.select(*keys, *tie, F.col("power_w").cast("double").alias("_p"), t.alias("_t"),
                         F.floor(t / (slice_s * 1_000_000)).alias("_slice"))
    w = Window.partitionBy(*keys, "_slice").orderBy("_t", *tie, "_p")
    area = 0.5 * (F.col("_p") + F.lag("_p").over(w)) * ((F.col("_t") - F.lag("_t").over(w)) / 1e6)
    point = F.struct("_t", *tie, "_p")
    slices = cut.withColumn("_area", area).groupBy(*keys, "_slice").agg(
        F.sum("_area").alias("_inner"), F.min(point).alias("_first"), F.max(point).alias("_last"))
    between = Window.partitionBy(*keys).orderBy("_slice")
    prev = F.lag("_last").over(between)
    bridge = 0.5 * (F.col("_first._p") + prev["_p"]) * ((F.col("_first._t") - prev["_t"]) / 1e6)
    return (slices.withColumn("_bridge", bridge).groupBy(*keys)
            .agg(F.sum(F.coalesce("_inner", F.lit(0.0)) + F.coalesce("_bridge", F.lit(0.0))).alias("energy_integrated_j")))


def with_sessions(samples: DataFrame, keys: list[str], gap: str, slice_s: int = SLICE_SECONDS, out: str = "session") -> DataFrame:
    """Number each group's runs of samples separated by silence of at least ``gap``.

    Breaks are counted inside time slices and the slices are numbered through, so a group
    that never falls silent is still spread over tasks.
    """
    t = F.unix_micros("ts")
    cut = samples.withColumns({"_t": t, "_slice": F.floor(t / (slice_s * 1_000_000))})
    broken = lambda before, now: F.expr(f"CAST(unix_micros(timestamp_micros({before}) + INTERVAL {gap}) <= {now} AS INT)")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t")
    marked = cut.withColumn("_prev", F.lag("_t").over(inside)).withColumn("_brk", F.coalesce(broken("_prev", "_t"), F.lit(0)))
    slices = marked.groupBy(*keys, "_slice").agg(F.sum("_brk").alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_slice")
    edged = slices.withColumn("_prev", F.lag("_last").over(along)).withColumn("_edge", F.coalesce(broken("_prev", "_first"), F.lit(1)))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = edged.select(*keys, "_slice", (F.sum(F.col("_edge") + F.col("_n")).over(upto) - F.col("_n")).alias("_base"))
    running = F.sum("_brk").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = marked.withColumn("_in", running).join(offsets, [*keys, "_slice"])
    return numbered.withColumn(out, F.col("_base") + F.col("_in")).select(*samples.columns, out)


def summarise_telemetry(samples: DataFrame, keys: list[str], slice_s: int = SLICE_SECONDS, tie: list[str] = ()) -> DataFrame:
    """One row per window: power, clocks, temperature, throttling and both energy estimates."""
    medians = [median("power_median_w", F.col("power_w"))]
    if "sm_clock" in samples.columns:
        medians.append(median("sm_clock_median_mhz", F.col("sm_clock")))
    stats = group_quantiles(samples, keys, medians, sample_stats(samples.columns))
    return stats.join(trapezoid_energy(samples, keys, slice_s, tie), keys, "left")


def idle_baseline(samples: DataFrame, keys: list[str], settle_s: float = 5.0) -> DataFrame:
    """Resting power per group after discarding its settling period."""
    start = samples.groupBy(*keys).agg(F.min(F.unix_micros("ts")).alias("_t0"))
    settled = samples.join(start, keys).filter(F.unix_micros("ts") >= F.col("_t0") + int(settle_s * 1_000_000))
    return group_quantiles(
        settled, keys, [median("power_w", F.col("power_w")), median("sm_clock_mhz", F.col("sm_clock"))],
        [F.stddev_pop("power_w").alias("power_sd_w"), F.avg("temp").alias("temperature_c"),
         F.count("*").alias("samples"),
         ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("seconds")])


def repeat_energy(df: DataFrame) -> Column:
    """Energy of one measured window: counter, else integral, else mean power times duration."""
    integral = optional(df, "energy_integrated_j")
    fallback = F.when(integral != 0, integral).otherwise(optional(df, "power_mean_w") * optional(df, "duration_s"))
    return F.coalesce(optional(df, "energy_counter_j"), fallback)


def summarise_repeats(windows: DataFrame, keys: list[str] = ("kernel_sig", "gpu_key"), order: str = "repeat",
                      latency: str = "latency_s", energy: str = "energy_j") -> DataFrame:
    """Median latency and energy over repeat windows with their relative spread.

    The counter/integral ratio is the last repeat's, and only when both are present.
    """
    lat, en = F.col(latency), F.col(energy)
    quantiles = [median("latency_s", lat), median("energy_raw_j", en)]
    aggs = [population_sd_rel(lat, 1e-30).alias("latency_sd_rel"), population_sd_rel(en, 1e-30).alias("energy_sd_rel"),
            F.count("*").alias("n_repeats")]
    if "duration_s" in windows.columns:
        quantiles.append(median("window_s", F.col("duration_s")))
    if {"energy_counter_j", "energy_integrated_j"} <= set(windows.columns):
        c, i = F.col("energy_counter_j"), F.col("energy_integrated_j")
        aggs.append(F.max_by(F.when((c != 0) & (i != 0), c / i), F.col(order)).alias("energy_check_ratio"))
    return group_quantiles(windows, list(keys), quantiles, aggs, bounded_groups=True)  # the repeats of one kernel on one card


def summarise_e2e_repeats(runs: DataFrame, keys: list[str], latency: str = "latency_s", energy: str = "energy_j") -> DataFrame:
    """Whole-run repeats: medians, spreads, and power as median energy over median latency."""
    lat, en = F.col(latency), F.col(energy)
    out = group_quantiles(runs, keys, [median("latency_s", lat), median("energy_j", en)], [
        population_sd_rel(lat, 1e-12).alias("latency_sd_rel"), population_sd_rel(en, 1e-12).alias("energy_sd_rel"),
        F.count("*").alias("n_repeats")], bounded_groups=True)  # the repeats of one run
    return out.withColumn("power_avg_w", F.col("energy_j") / F.col("latency_s"))


def launch_overhead(windows: DataFrame, session: list[str], latency: str = "latency_s", energy: str = "energy_j") -> DataFrame:
    """Median seconds and joules per empty launch, per session."""
    return group_quantiles(windows, session, [
        median("overhead_s", F.col(latency)), median("overhead_j", F.coalesce(F.col(energy), F.lit(0.0)))])
