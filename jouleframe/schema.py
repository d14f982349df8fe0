"""Table schemas. Missing numbers are NULL; ``p_*`` columns follow dynamically per category."""

from __future__ import annotations

from jouleframe.functions.keys import PARAM_TYPES

# The measurement table's column names, in order, with their types.
MEASUREMENT = {
    "kernel_sig": "string", "category": "string", "dtype": "string", "gpu_key": "string",
    "source_model": "string", "source_module": "string", "op_name": "string",
    "latency_s": "double", "energy_j": "double", "energy_raw_j": "double", "power_avg_w": "double",
    "latency_sd_rel": "double", "energy_sd_rel": "double",
    "n_iters": "bigint", "n_repeats": "int", "window_s": "double", "idle_power_w": "double",
    "sm_clock_mean_mhz": "double", "sm_clock_median_mhz": "double", "mem_clock_mean_mhz": "double",
    "temperature_mean_c": "double", "temperature_max_c": "double",
    "frac_sw_power_cap": "double", "frac_hw_slowdown": "double", "frac_sw_thermal": "double", "frac_hw_thermal": "double",
    "power_limit_w": "double", "power_limit_default_w": "double", "energy_counter_used": "int",
    "energy_check_ratio": "double", "n_buffers": "int",
    "cuda_index": "int", "nvml_index": "int", "gpu_uuid": "string", "contended": "int",
    "gpu_name": "string", "architecture": "string", "compute_capability": "double", "sms": "int", "ops_per_clk": "int",
    "tensor_clock_mhz": "double", "boost_clock_mhz": "double", "peak_tensor_flops": "double",
    "mem_bandwidth_gbs": "double", "l2_bandwidth_gbs": "double", "l2_cache_mb": "double", "tdp_w": "double", "is_hbm": "int",
    "theoretical_time_s": "double", "bottleneck": "string", "analytic_flops": "double", "analytic_bytes_global": "double",
    "timestamp": "timestamp", "host": "string", "slurm_job": "string", "shard": "string", "driver_version": "string",
    "torch_version": "string", "cuda_version": "string", "tool_version": "string", "notes": "string",
}

CAPTURE = {
    "kernel_sig": "string", "category": "string", "dtype": "string", "source_model": "string", "source_module": "string",
    "op_name": "string", "count": "bigint", "height": "int", "width": "int",
}
CATALOGUE = CAPTURE | {"n_models": "int", "calls_total": "bigint"}

E2E_RUN = {
    "gpu_key": "string", "model": "string", "steps": "int", "height": "int", "width": "int",
    "latency_s": "double", "energy_j": "double", "power_avg_w": "double", "latency_sd_rel": "double", "energy_sd_rel": "double",
    "n_repeats": "int", "energy_counter_used": "boolean", "idle_power_w": "double", "sm_clock_median_mhz": "double",
    "frac_sw_power_cap": "double", "frac_sw_thermal": "double", "temperature_max_c": "double",
    "device_time_s": "double", "device_time_covered_s": "double", "profiled_latency_s": "double",
    "n_configs": "int", "total_calls": "bigint", "gap_s": "double", "busy_fraction": "double", "coverage_fraction": "double",
    "notes": "string",
}
E2E_CALLS = {"kernel_sig": "string", "calls": "bigint", "gpu_key": "string", "model": "string", "steps": "int", "height": "int", "width": "int"}

TELEMETRY = {
    "gpu_key": "string", "run_id": "string", "ts": "timestamp", "power_w": "double", "sm_clock": "double", "mem_clock": "double",
    "temp": "double", "util_gpu": "double", "util_mem": "double", "throttle": "bigint", "counter_mj": "bigint",
}

TILE_REFERENCE = {
    "hardware": "string", "arch": "string", "num_sms": "int", "M": "bigint", "N": "bigint", "K": "bigint",
    "tile_M": "bigint", "tile_N": "bigint", "tile_K": "bigint", "cta_count": "bigint", "is_split_k": "boolean",
}

MOMENTS = ("map<string, struct<features: array<string>, n: bigint, source: string, mean: array<double>, "
           "precision: array<array<double>>, md_p50: double, md_p95: double, md_p99: double, md_max: double>>")


def column_type(name: str, table: dict[str, str]) -> str:
    """Type of a file column: the table's, a known parameter's, a call count's, else text."""
    if name in table:
        return table[name]
    if name.startswith("p_"):
        return PARAM_TYPES.get(name[2:], "string")
    if name.startswith("calls_"):
        return "bigint"
    return "string"
