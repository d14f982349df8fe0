"""Sum of kernels against whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jouleframe.functions.missing import optional

E2E_KEYS = ["steps", "model", "gpu_key"]
SUMMARY_COLUMNS = ["gpu_key", "model", "steps", "e2e_energy_j", "A_total_j", "B_total_j", "A_ratio", "B_ratio",
                   "A_residual_frac", "busy_fraction", "call_coverage", "profiler_coverage", "A_latency_ratio",
                   "B_latency_ratio"]


def calls_frame(runs: DataFrame, keys: list[str], calls: str = "calls") -> DataFrame:
    """Explode a run's kernel -> calls map into rows that carry the run's keys."""
    return runs.select(*keys, F.explode(calls).alias("kernel_sig", "calls"))


def attach_calls(runs: DataFrame, calls: DataFrame, keys: list[str] = E2E_KEYS) -> DataFrame:
    """Run rows joined to their call rows; height and width join too when both sides have them."""
    extra = [c for c in ("height", "width") if c in runs.columns and c in calls.columns and c not in keys]
    return runs.join(calls, [*keys, *extra])


def run_derived(runs: DataFrame) -> DataFrame:
    """Gap, busy and coverage fractions, and call counts when a calls map is present."""
    device = F.col("device_time_s")
    out = {"gap_s": F.col("latency_s") - device, "busy_fraction": device / F.greatest(F.col("latency_s"), F.lit(1e-12))}
    if "device_time_covered_s" in runs.columns:
        out["coverage_fraction"] = F.col("device_time_covered_s") / F.greatest(device, F.lit(1e-12))
    if "calls" in runs.columns:
        out["n_configs"] = F.size("calls")
        out["total_calls"] = F.aggregate(F.map_values("calls"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return runs.withColumns(out)


def _weighted(value: str, calls: Column) -> Column:
    return F.coalesce(F.sum(F.col(value) * calls), F.lit(0.0))


def sum_over_calls(calls: DataFrame, table: DataFrame, run: list[str], values: dict[str, str]) -> DataFrame:
    """Call-weighted sums of kernel values per run, with matched and missing calls.

    ``values`` maps a column of ``table`` to an output name. ``table`` has one row per
    (gpu_key, kernel_sig); ``calls`` carries ``run``, ``gpu_key``, ``kernel_sig``, ``calls``.
    The first value decides what counts as matched.
    """
    return _sum_levels(calls, _kernel_values(table, values), run, {"": list(values.values())})


def _kernel_values(table: DataFrame, values: dict[str, str]) -> DataFrame:
    return table.select("gpu_key", "kernel_sig", *[F.col(c).alias(f"_v_{o}") for c, o in values.items()])


def _sum_levels(calls: DataFrame, side: DataFrame, run: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """Sums of several levels of kernel values from one join; the first value of a level decides what it matches."""
    n = F.col("calls")
    aggs = []
    for level, outs in levels.items():
        first = F.col(f"_v_{outs[0]}")
        aggs += [*[_weighted(f"_v_{o}", n).alias(o) for o in outs],
                 F.coalesce(F.sum(F.when(first.isNotNull(), n)), F.lit(0)).alias(f"{level}matched"),
                 F.coalesce(F.sum(F.when(first.isNull(), n)), F.lit(0)).alias(f"{level}missing")]
    return calls.join(side, ["gpu_key", "kernel_sig"], "left").groupBy(*run).agg(*aggs)


def split_known_cards(runs: DataFrame, dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs whose card has measurements, runs whose card has none)."""
    cards = dataset.select("gpu_key").distinct()
    return runs.join(cards, "gpu_key", "left_semi"), runs.join(cards, "gpu_key", "left_anti")


def reconcile(runs: DataFrame, calls: DataFrame, dataset: DataFrame, predictions: DataFrame | None = None,
              run: list[str] = ("run_id",), energy_pred: str = "energy_pred", latency_pred: str = "latency_pred") -> DataFrame:
    """Accounting identity of each run: kernels plus idle power over the gap, against the measurement.

    Level A sums measured kernel values, level B predicted ones. Latency is compared with
    device time. Runs of a card without measurements are left out; see ``split_known_cards``.
    """
    run = list(run)
    known, _ = split_known_cards(runs, dataset)
    if "gpu_key" not in calls.columns:
        calls = calls.join(known.select(*run, "gpu_key"), run)
    keys = [c for c in run if c in calls.columns]
    # Measured and predicted values side by side per kernel and card: the calls, the largest table, move once.
    side = _kernel_values(dataset, {"energy_j": "A_kernel_energy_j", "latency_s": "A_kernel_latency_s"})
    levels = {"": ["A_kernel_energy_j", "A_kernel_latency_s"]}
    with_b = predictions is not None and energy_pred in predictions.columns
    if with_b:
        values = {energy_pred: "B_kernel_energy_j"}
        if latency_pred in predictions.columns:
            values[latency_pred] = "B_kernel_latency_s"
        side = side.join(_kernel_values(predictions, values), ["gpu_key", "kernel_sig"], "full_outer")
        levels["_b_"] = list(values.values())
    out = known.join(_sum_levels(calls, side, keys, levels), keys, "left").withColumns({
        "A_kernel_energy_j": F.coalesce("A_kernel_energy_j", F.lit(0.0)),
        "A_kernel_latency_s": F.coalesce("A_kernel_latency_s", F.lit(0.0)),
        "calls_matched": F.coalesce("matched", F.lit(0)), "calls_missing": F.coalesce("missing", F.lit(0))})
    e2e, lat, dev = F.col("energy_j"), F.col("latency_s"), F.col("device_time_s")
    safe_e, safe_dev = F.greatest(e2e, F.lit(1e-12)), F.greatest(dev, F.lit(1e-12))
    n_calls = F.greatest(F.col("calls_matched") + F.col("calls_missing"), F.lit(1))
    gap = F.greatest(lat - dev, F.lit(0.0))
    ids = [c for c in dict.fromkeys([*run, "gpu_key", "model", "steps", "height", "width"]) if c in runs.columns]
    power = F.col("power_avg_w") if "power_avg_w" in runs.columns else e2e / lat
    staged = out.withColumns({"gap_s": gap, "A_gap_energy_j": F.col("idle_power_w") * gap,
                              "A_total_j": F.col("A_kernel_energy_j") + F.col("idle_power_w") * gap})
    total = F.col("A_total_j")
    cols = {
        "e2e_energy_j": e2e, "e2e_latency_s": lat, "e2e_power_w": power, "device_time_s": dev, "gap_s": F.col("gap_s"),
        "busy_fraction": dev / F.greatest(lat, F.lit(1e-12)),
        "profiler_coverage": optional(runs, "device_time_covered_s") / safe_dev,
        "call_coverage": F.col("calls_matched") / n_calls, "calls_matched": F.col("calls_matched"),
        "calls_missing": F.col("calls_missing"), "A_kernel_energy_j": F.col("A_kernel_energy_j"),
        "A_gap_energy_j": F.col("A_gap_energy_j"), "A_total_j": total, "A_ratio": total / safe_e,
        "A_residual_j": e2e - total, "A_residual_frac": (e2e - total) / safe_e,
        "A_kernel_latency_s": F.col("A_kernel_latency_s"), "A_latency_ratio": F.col("A_kernel_latency_s") / safe_dev,
    }
    if with_b:
        # A card without any prediction has no level B at all.
        predicted = predictions.select("gpu_key").distinct().withColumn("_has_b", F.lit(True))
        staged = staged.join(predicted, "gpu_key", "left")
        has = lambda c: F.when(F.col("_has_b"), c)
        kernel = F.coalesce("B_kernel_energy_j", F.lit(0.0))
        b_total = kernel + F.col("A_gap_energy_j")
        cols |= {"B_kernel_energy_j": has(kernel), "B_total_j": has(b_total), "B_ratio": has(b_total / safe_e),
                 "B_residual_frac": has((e2e - b_total) / safe_e),
                 "B_call_coverage": has(F.coalesce("_b_matched", F.lit(0)) / n_calls)}
        if len(values) > 1:
            spent = F.coalesce("B_kernel_latency_s", F.lit(0.0))
            cols |= {"B_kernel_latency_s": has(spent), "B_latency_ratio": has(spent / safe_dev)}
    return staged.select(*ids, *[v.alias(k) for k, v in cols.items()])


def summarise(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in SUMMARY_COLUMNS if c in rows.columns])


def step_model(rows: DataFrame, value: str = "e2e_energy_j") -> DataFrame:
    """Energy = fixed + per_step * steps per (card, model), for measured, A and B.

    Cells with fewer than three runs are left out; a series with any missing value is NULL.
    """
    x = F.col("steps").cast("double")
    series = [(value, "measured")] + [(c, c[0]) for c in ("A_total_j", "B_total_j") if c in rows.columns]
    aggs = [F.count("*").alias("n_points")]
    for c, tag in series:
        y = F.col(c).cast("double")
        whole = F.count(y) == F.count("*")
        aggs += [F.when(whole, F.regr_intercept(y, x)).alias(f"{tag}_fixed_j"),
                 F.when(whole, F.regr_slope(y, x)).alias(f"{tag}_per_step_j"),
                 F.when(whole & (F.var_pop(y) > 0), F.regr_r2(y, x)).alias(f"{tag}_r2")]
    out = rows.groupBy("gpu_key", "model").agg(*aggs).filter(F.col("n_points") >= 3)
    ratios = {}
    for _, tag in series[1:]:
        ratios[f"{tag}_slope_ratio"] = F.try_divide(F.col(f"{tag}_per_step_j"), F.col("measured_per_step_j"))
        ratios[f"{tag}_fixed_ratio"] = F.when(
            F.abs("measured_fixed_j") > 1e-9, F.col(f"{tag}_fixed_j") / F.col("measured_fixed_j"))
    return out.withColumns(ratios) if ratios else out


def reconstruct(runs: DataFrame, catalogue_calls: DataFrame, dataset: DataFrame, idle_on: str = "run") -> DataFrame:
    """Older reconstruction from one-step captures: convolutions run once, the rest per step.

    ``catalogue_calls`` has (kernel_sig, category, model, calls). ``idle_on="run"`` charges
    idle power over the whole run, "gap" only while no kernel runs. Kernel sums are taken
    per (card, model) first, so runs never meet individual kernels.
    """
    if idle_on not in ("run", "gap"):
        raise ValueError("idle_on must be 'run' or 'gap'")
    once = F.col("category") == "conv"
    calls = F.col("calls").cast("double")
    part = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0.0))
    total = catalogue_calls.groupBy("model").agg(
        part(~once, calls).alias("_all_step"), part(once, calls).alias("_all_once"), F.count("*").alias("n_configs_total"))
    joined = catalogue_calls.join(
        dataset.select("gpu_key", "kernel_sig", F.col("energy_j").alias("_e"), F.col("latency_s").alias("_t")), "kernel_sig")
    matched = joined.filter(F.col("_e").isNotNull()).groupBy("gpu_key", "model").agg(
        *[part(t, calls * F.col(v)).alias(f"{v}{tag}") for tag, t in (("_step", ~once), ("_once", once)) for v in ("_e", "_t")],
        part(~once, calls).alias("_n_step"), part(once, calls).alias("_n_once"), F.count("*").alias("n_configs_matched"))
    steps = F.col("steps").cast("double")
    whole = runs.join(total, "model").join(matched, ["gpu_key", "model"], "left")
    scaled = lambda v: F.coalesce(F.col(f"{v}_step") * steps + F.col(f"{v}_once"), F.lit(0.0))
    idle_s = F.col("latency_s") if idle_on == "run" else F.greatest(F.col("latency_s") - F.col("device_time_s"), F.lit(0.0))
    e = scaled("_e") + F.col("idle_power_w") * idle_s
    ids = [c for c in ("run_id", "gpu_key", "model", "steps") if c in runs.columns]
    return whole.select(
        *ids, F.col("energy_j").alias("e2e_energy_j"), F.col("latency_s").alias("e2e_latency_s"),
        scaled("_e").alias("kernel_sum_energy_j"), scaled("_t").alias("kernel_sum_latency_s"),
        e.alias("reconstructed_energy_j"), (e / F.greatest("energy_j", F.lit(1e-12))).alias("energy_ratio"),
        (scaled("_t") / F.greatest("latency_s", F.lit(1e-12))).alias("latency_ratio"),
        (scaled("_n") / F.greatest(F.col("_all_step") * steps + F.col("_all_once"), F.lit(1.0))).alias("catalogue_call_coverage"),
        F.coalesce("n_configs_matched", F.lit(0)).alias("n_configs_matched"), "n_configs_total")
