"""Synthetic measurements with a known law, for tests.

Shapes come from a small family of invented networks. Efficiency saturates with the number of
waves (a hyperbola) and falls with the share of memory time; power is a straight line in the
achieved efficiency between an idle share and a ceiling of the kernel's kind. Noise is a
uniform factor drawn from the row's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jouleframe.functions.keys import signature
from jouleframe.functions.roofline import FEATURE_COLUMNS
from jouleframe.operators.dataset import attach_features
from jouleframe.operators.merge import union_ragged
from jouleframe.operators.planning import planned_pairs
from jouleframe.sources.hardware import FLEET_KEYS, attach_hardware

# Name, width, heads of the invented networks; their sequence lengths; image sides of the convolutions.
NETWORKS = [("reed", 1536, 12), ("oak", 2560, 20), ("fern", 4096, 32)]
LENGTHS = [640, 1280, 2560, 5120]
SIDES = [(96, 384), (192, 192)]


def _draw(tag: str, seed: int) -> Column:
    """Uniform in [0, 1) from the row's key alone, so partitioning cannot change it."""
    return F.pmod(F.hash("kernel_sig", "gpu_key", "source_model", F.lit(tag), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def _spread(tag: str, seed: int, width: float) -> Column:
    """A factor within ``width`` of 1."""
    return 1.0 + width * (2.0 * _draw(tag, seed) - 1.0)


def synthetic_configs(spark: SparkSession) -> DataFrame:
    """Kernels of each network: projections, attention, row-wise and pointwise steps, convolutions."""
    nets = spark.createDataFrame(NETWORKS, "source_model string, width long, heads long")
    at = nets.withColumn("length", F.explode(F.array(*[F.lit(n).cast("long") for n in LENGTHS])))

    def rows(frame: DataFrame, category: str, module: str, **params) -> DataFrame:
        cols = [(v if isinstance(v, Column) else F.lit(v)).alias(f"p_{k}") for k, v in params.items()]
        return frame.select(F.lit(category).alias("category"), F.lit("bf16").alias("dtype"), "source_model", F.lit(module).alias("source_module"), *cols)

    length, width, heads, one = F.col("length"), F.col("width"), F.col("heads"), F.lit(1).cast("long")
    parts = [
        rows(at, "gemm", "mix", m=length, n=width * 2, k=width), rows(at, "gemm", "up", m=length, n=width * 5, k=width),
        rows(at, "gemm", "down", m=length, n=width, k=width * 5),
        rows(at, "attention", "self", b=one, h=heads, s_q=length, s_kv=length, d=F.lit(128).cast("long")),
        rows(at, "attention", "cross", b=one, h=heads, s_q=length, s_kv=F.lit(320).cast("long"), d=F.lit(128).cast("long")),
        rows(at, "norm", "pre", rows=length, dim=width, kind="rms"), rows(at, "norm", "post", rows=length, dim=width, kind="layer"),
        rows(at, "elementwise", "gate", n_elem=length * width * 5, kind="gelu"), rows(at, "elementwise", "residual", n_elem=length * width, kind="add"),
    ]
    for side, channels in SIDES:
        big = lambda v: F.lit(v).cast("long")
        parts.append(rows(nets, "conv", "stem", n=one, c_in=big(channels), c_out=big(channels), h=big(side), w=big(side), kh=big(3), kw=big(3)))
    configs = union_ragged(parts)
    return configs.withColumn("kernel_sig", signature(configs))


def synthetic_measurements(spark: SparkSession, seed: int = 0, cards: list[str] = FLEET_KEYS) -> DataFrame:
    """Every config on every card with latency and energy from the law above."""
    f = attach_features(planned_pairs(synthetic_configs(spark), list(cards)))
    waves = F.exp(F.col("log_n_waves"))
    memory = 1.0 / (1.0 + F.exp(-F.col("log_bytes_per_flop") - 4.0))  # near 1: bound by memory
    eta = (0.15 + 0.6 * waves / (waves + 2.0)) * (1.0 - 0.35 * memory) * _spread("eta", seed, 0.08)
    pi = (F.col("idle_fraction") + (0.55 + 0.35 * F.col("uses_tensor_core") - F.col("idle_fraction")) * (0.4 + 0.6 * eta)) * _spread("pi", seed, 0.06)
    inside = lambda x: F.greatest(F.lit(0.002), F.least(x, F.lit(0.98)))
    specs = attach_hardware(f.withColumns({"_eta": inside(eta), "_pi": inside(pi)}).drop(*FEATURE_COLUMNS))
    latency = F.col("theoretical_time_s") / F.col("_eta")
    energy = F.col("_pi") * F.col("hw_tdp_w") * latency
    taken = ("architecture", "compute_capability", "sms", "ops_per_clk", "tensor_clock_mhz", "boost_clock_mhz", "peak_tensor_flops", "mem_bandwidth_gbs",
             "l2_bandwidth_gbs", "l2_cache_mb", "tdp_w", "idle_power_w", "is_hbm")
    out = specs.withColumns({
        **{c: F.col(f"hw_{c}") for c in taken}, "gpu_name": F.col("hw_name"),
        "latency_s": latency, "energy_j": energy, "energy_raw_j": energy, "power_avg_w": energy / latency,
        "latency_sd_rel": 0.01 * _draw("ls", seed), "energy_sd_rel": 0.015 * _draw("es", seed),
        "n_iters": F.lit(400).cast("bigint"), "n_repeats": F.lit(5), "window_s": F.lit(2.0), "n_buffers": F.lit(1), "contended": F.lit(0),
        "sm_clock_median_mhz": F.col("hw_boost_clock_mhz") * (0.8 + 0.2 * _draw("clock", seed)),
        "frac_sw_power_cap": F.round(_draw("cap", seed), 1), "energy_counter_used": F.lit(1),
        "energy_check_ratio": _spread("check", seed, 0.04), "notes": F.lit("generated")})
    return out.drop(*[c for c in out.columns if c.startswith(("hw_", "_"))])
