"""Names, categories, bit fields and verdict words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IMPLEMENTED = ("gemm", "attention", "conv", "norm", "elementwise")

# Profiler kernel-name patterns, first match wins.
KERNEL_PATTERNS = [
    ("attention", r"flash|fmha|attention|mha_|sdpa|cudnn_.*attn"),
    ("conv", r"conv|winograd|cudnn::|implicit_gemm"),
    ("norm", r"layer_?norm|rms_?norm|group_?norm|batch_norm|rowwisemoments|welford|reduce_kernel.*(meanops|normtwoops)"),
    ("gemm", r"gemm|cutlass|sm\d+_.*_tensorop|nvjet|xmma|cublas|ampere_\w*|addmm|baddbmm|matmul|gemv"),
    ("elementwise", r"elementwise|vectorized|unrolled|gelu|silu|swish|catarraybatchedcopy|copy_|fill_|mul_|add_|upsample|interpolate"),
    ("softmax", r"softmax"),
    ("reduce", r"reduce|sum_|mean_"),
    ("memory", r"memcpy|memset|transpose|permute|contiguous"),
]
# Prefixes of host-side profiler records.
HOST_PREFIXES = ["aten::", "autograd::", "torch::", "cuda", "Optimizer", "ProfilerStep", "nn.Module", "enumerate("]

# Throttle reasons by bit.
THROTTLE_BITS = {
    "gpu_idle": 0x1, "applications_clocks_setting": 0x2, "sw_power_cap": 0x4, "hw_slowdown": 0x8,
    "sync_boost": 0x10, "sw_thermal_slowdown": 0x20, "hw_thermal_slowdown": 0x40,
    "hw_power_brake_slowdown": 0x80, "display_clock_setting": 0x100,
}

CATEGORY_TO_OPERATOR = {"gemm": "gemm", "conv": "gemm", "attention": "attn", "norm": "rmsnorm", "elementwise": "siluandmul"}


def categorise_kernel(name: Column) -> Column:
    out = None
    for category, pattern in KERNEL_PATTERNS:
        hit = name.rlike(f"(?i){pattern}")
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.when(name.isNotNull(), out.otherwise("other"))


def is_device_kernel(name: Column) -> Column:
    on_host = F.lit(False)
    for prefix in HOST_PREFIXES:
        on_host = on_host | name.startswith(prefix)
    return ~on_host


def throttle_set(mask: Column, reason: str) -> Column:
    return mask.bitwiseAND(F.lit(THROTTLE_BITS[reason]).cast("bigint")) != 0


def decode_throttle(mask: Column) -> Column:
    """Struct of nine booleans."""
    return F.struct(*[throttle_set(mask, r).alias(r) for r in THROTTLE_BITS])


def operator_of(category: Column, kind: Column) -> Column:
    """External model family a kernel belongs to; group norms are their own operator."""
    pairs = [F.lit(x) for item in CATEGORY_TO_OPERATOR.items() for x in item]
    return (F.when((category == "norm") & (F.coalesce(kind, F.lit("layer")) == "group"), "groupnorm")
            .otherwise(F.try_element_at(F.create_map(*pairs), category)))


def transfer_verdict(zeroshot: Column, finetuned: Column, scratch: Column, hybrid: Column) -> dict[str, Column]:
    """Readings of a pooled transfer row."""
    best = F.least(zeroshot, finetuned, hybrid)
    return {
        "finetuning": F.when(finetuned > zeroshot * 1.05, "damaging").when(finetuned < zeroshot * 0.95, "helped").otherwise("no change"),
        "hybrid_best": hybrid < F.least(zeroshot, finetuned) * 0.95,
        "pretraining": F.when(scratch < best * 0.95, "liability").when(best < scratch * 0.85, "working").otherwise("unclear"),
    }


def seed_verdict(wins: Column, seeds: Column, p_sign: Column) -> Column:
    return (F.when((wins == seeds) & (seeds >= 5), "unanimous")
            .when(p_sign > 0.2, "not separable").otherwise("leaning"))
