"""Closed-form roofline features over (kernel, card) rows.

Every category is a homogeneous grid, so placing ``count`` tasks on ``sms`` units gives
``ceil(count/sms)`` to the busiest unit whichever way they are dealt. All features follow
from the per-task demand by arithmetic. The work is staged (tile, demand, sums, features)
so each stage refers to columns of the one before and no expression is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from jouleframe.functions.categories import (
    DEMAND_FIELDS, TOTAL_FIELDS, CategoryRegistry, Params, REGISTRY, choose_tile, dtype_bytes, struct_text, tile_count,
)

MATH_PIPES = {"tensor": ("mma", "ops_per_clk"), "fma": ("fma", "fma_per_clk"), "xu": ("xu", "xu_per_clk")}
MEMORY_LEVELS = {"global": "hbm", "l2": "l2", "shared": "smem"}
SLACK_PIPES = ["tensor", "fma", "xu", "mem_global", "mem_global_sm", "mem_l2", "mem_l2_sm",
               "mem_shared", "mem_shared_sm", "mem_compulsory"]
# Only spec-sheet-exact pipes may set the floor; on ties the earlier one is named.
FLOOR_PIPES = ["tensor", "fma", "xu", "mem_compulsory"]

FEATURE_COLUMNS = (
    [f"log_{kind}_{p}_{scope}" for p in MATH_PIPES for kind in ("ops", "cycles") for scope in ("gpu", "sm_max")]
    + [f"log_{kind}_{lv}_{scope}" for lv in MEMORY_LEVELS for kind in ("bytes", "cycles_mem") for scope in ("gpu", "sm_max")]
    + ["log_l2_residency", "compulsory_miss_fraction", "fits_in_l2", "log_theoretical_time"]
    + [f"slack_{p}" for p in SLACK_PIPES]
    + ["log_n_tasks", "log_n_waves", "tail_fraction", "sm_occupancy", "imbalance_mma", "imbalance_bytes", "is_persistent"]
    + ["log_flops", "log_bytes_per_flop", "log_l2_reuse", "log_arithmetic_intensity"]
    + ["log_peak_flops", "log_mem_bw", "log_sms", "log_ops_per_clk", "log_clock", "log_smem_kb", "log_l2_bw"]
    + ["log_tdp", "log_idle_power", "idle_fraction", "log_watt_per_tflop", "log_watt_per_gbs", "is_hbm", "compute_capability"]
    + ["log_dsize", "uses_tensor_core"]
)
ANALYTIC_COLUMNS = ["theoretical_time_s", "bottleneck", "analytic_flops", "analytic_bytes_global"]


def _ratio(a: str, b: str) -> str:
    return f"IF({b} > 0, {a} / {b}, 0D)"


def _log(x: str) -> str:
    return f"ln(greatest({x}, 1e-30D))"


def _stage(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{text} AS {name}" for name, text in columns.items()])


def with_demand(df: DataFrame, prefix: str = "hw_", registry: CategoryRegistry | None = None) -> DataFrame:
    """Add the tile (``_tile``) and per-task demand (``_demand``) of each row."""
    reg = registry or REGISTRY
    p = Params(df)

    def matmul(cat):
        return None if cat.matmul is None else struct_text(dict(zip(("m", "n", "k"), cat.matmul(p))))

    nothing = struct_text({"m": "NULL", "n": "NULL", "k": "NULL"})
    staged = _stage(df, {"_width": dtype_bytes(), "_mm": reg.pick(matmul, nothing)})
    staged = _stage(staged, {"_pick": choose_tile("_mm.m", "_mm.n", f"{prefix}sms")})
    tiles = tile_count("_mm.m", "_mm.n", "_pick.m", "_pick.n")
    staged = _stage(staged, {"_tile": struct_text({"m": "_pick.m", "n": "_pick.n", "k": "_pick.k", "tiles": tiles})})

    def demand(cat):
        d, t = cat.demand(p), cat.totals(p)
        return struct_text({f: d[f] for f in DEMAND_FIELDS} | {f: t[f] for f in TOTAL_FIELDS})

    # The one-row explode keeps filters on derived columns above this point: pushed further
    # down, each would carry its own copy of the tile and demand formulas.
    return _stage(staged, {"_demand": f"explode(array({reg.pick(demand)}))"})


def roofline_features(df: DataFrame, clock: str = "tensor", n_buffers: str | None = None,
                      prefix: str = "hw_", registry: CategoryRegistry | None = None) -> DataFrame:
    """Append the 65 features and the four analytic columns to rows with hardware attached.

    Columns of ``df`` that carry a feature's name are kept (a measured value wins); the
    analytic columns are always recomputed. Rows must have passed ``analysis_failure``.
    """
    if clock not in ("tensor", "boost"):
        raise ValueError(f"clock must be 'tensor' or 'boost', got {clock!r}")
    reg = registry or REGISTRY
    base = [c for c in df.columns if c not in ANALYTIC_COLUMNS]
    df = df.select(*base)
    hw = lambda c: f"{prefix}{c}"

    # Sums over the card and over its busiest unit.
    buffers = n_buffers or ("n_buffers" if "n_buffers" in df.columns else "1")
    sums = {}
    for f in ("mma", "fma", "xu", "hbm", "l2", "smem"):
        sums[f"_tot_{f}"] = f"_demand.{f} * _demand.count"
        sums[f"_max_{f}"] = f"_demand.{f} * CAST(ceil(_demand.count / {hw('sms')}) AS DOUBLE)"
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    sums |= {
        "_sms": f"CAST({hw('sms')} AS DOUBLE)", "_count": "_demand.count", "_flops": "_demand.flops",
        "_clk": f"{hw(clock + '_clock_mhz')} * 1e6D",
        "_peak": f"{hw('sms')} * {hw('ops_per_clk')} * {hw(clock + '_clock_mhz')} * 1e6D * 2D",
        "_bw_global": f"{hw('mem_bandwidth_gbs')} * 1e9D", "_bw_l2": f"{hw('l2_bandwidth_gbs')} * 1e9D",
        "_bw_shared": f"{hw('sms')} * {hw('smem_bandwidth_b_per_clk_sm')} * {hw(clock + '_clock_mhz')} * 1e6D",
        "_buffers": f"greatest(CAST(floor(coalesce(CAST({buffers} AS DOUBLE), 1D)) AS DOUBLE), 1D)",
        "_slots": f"{hw('sms')} * " + reg.pick(lambda c: f"{max(c.blocks_per_sm, 1)}D", "2D"),
        "_persistent": reg.pick(lambda c: f"{hw('architecture')} IN ({quoted(c.persistent_on)})" if c.persistent_on else None, "false"),
    }
    staged = _stage(with_demand(df, prefix, reg), sums)

    # Time each pipeline would need alone.
    times = {"_res": f"_tot_hbm * _buffers / greatest({hw('l2_cache_mb')} * 1048576D, 1D)", "_waves": "_count / _slots"}
    for pipe, (f, rate) in MATH_PIPES.items():
        times[f"_cyc_{pipe}_gpu"] = _ratio(f"_tot_{f}", f"(_sms * {hw(rate)})")
        times[f"_cyc_{pipe}_sm_max"] = _ratio(f"_max_{f}", hw(rate))
        times[f"_t_{pipe}"] = _ratio(f"_max_{f}", hw(rate)) + " / _clk"
    for level, f in MEMORY_LEVELS.items():
        times[f"_t_mem_{level}"] = _ratio(f"_tot_{f}", f"_bw_{level}")
        times[f"_t_mem_{level}_sm"] = _ratio(f"_max_{f}", f"(_bw_{level} / _sms)")
    staged = _stage(staged, times)
    staged = _stage(staged, {"_miss": "IF(_res > 1D, 1D - 1D / _res, 0D)"})
    staged = _stage(staged, {"_t_mem_compulsory": _ratio("_tot_hbm * _miss", "_bw_global")})
    staged = _stage(staged, {"_floor": "greatest(" + ", ".join(f"_t_{p}" for p in FLOOR_PIPES) + ")"})
    theory = "greatest(_floor, 1e-30D)"

    feats: dict[str, str] = {}
    for pipe, (f, _) in MATH_PIPES.items():
        feats[f"log_ops_{pipe}_gpu"], feats[f"log_ops_{pipe}_sm_max"] = _log(f"_tot_{f}"), _log(f"_max_{f}")
        for scope in ("gpu", "sm_max"):
            feats[f"log_cycles_{pipe}_{scope}"] = _log(f"_cyc_{pipe}_{scope}")
    for level, f in MEMORY_LEVELS.items():
        feats[f"log_bytes_{level}_gpu"], feats[f"log_bytes_{level}_sm_max"] = _log(f"_tot_{f}"), _log(f"_max_{f}")
        feats[f"log_cycles_mem_{level}_gpu"] = _log(f"_t_mem_{level} * _clk")
        feats[f"log_cycles_mem_{level}_sm_max"] = _log(f"_t_mem_{level}_sm * _clk")
    feats |= {f"slack_{p}": f"ln(greatest(_t_{p}, 1e-30D) / {theory})" for p in SLACK_PIPES}
    imbalance = lambda f: f"IF(_tot_{f} > 0, _max_{f} / (_tot_{f} / _sms), 1D)"
    feats |= {
        "log_l2_residency": _log("_res"), "compulsory_miss_fraction": "_miss", "fits_in_l2": "CAST(_res <= 1D AS DOUBLE)",
        "log_theoretical_time": f"ln({theory})",
        "log_n_tasks": _log("_count"), "log_n_waves": _log("_waves"), "tail_fraction": "CAST(ceil(_waves) AS DOUBLE) - _waves",
        "sm_occupancy": "least(_count, _sms) / _sms", "imbalance_mma": imbalance("mma"), "imbalance_bytes": imbalance("hbm"),
        "is_persistent": "CAST(_persistent AS DOUBLE)",
        "log_flops": _log("_flops"), "log_bytes_per_flop": _log("_tot_hbm / greatest(_flops, 1e-30D)"),
        "log_l2_reuse": _log("_tot_l2 / greatest(_tot_hbm, 1e-30D)"),
        "log_arithmetic_intensity": _log("_flops / greatest(_tot_hbm, 1e-30D)"),
        "log_peak_flops": _log("_peak"), "log_mem_bw": _log(hw("mem_bandwidth_gbs")), "log_sms": _log("_sms"),
        "log_ops_per_clk": _log(f"CAST({hw('ops_per_clk')} AS DOUBLE)"), "log_clock": _log("_clk"),
        "log_smem_kb": _log(hw("smem_size_kb_sm")), "log_l2_bw": _log(hw("l2_bandwidth_gbs")),
        "log_tdp": _log(hw("tdp_w")), "log_idle_power": _log(hw("idle_power_w")), "idle_fraction": f"{hw('idle_power_w')} / {hw('tdp_w')}",
        "log_watt_per_tflop": _log(f"{hw('tdp_w')} / greatest(_peak / 1e12D, 1e-30D)"),
        "log_watt_per_gbs": _log(f"{hw('tdp_w')} / greatest({hw('mem_bandwidth_gbs')}, 1e-30D)"),
        "is_hbm": f"CAST({hw('is_hbm')} AS DOUBLE)", "compute_capability": hw("compute_capability"),
        "log_dsize": _log("_width"), "uses_tensor_core": "CAST(_tot_mma > 0 AS DOUBLE)",
    }
    named = "coalesce(" + ", ".join(f"IF(_t_{p} = _floor, '{p}', NULL)" for p in FLOOR_PIPES) + ")"
    analytic = {"theoretical_time_s": theory, "bottleneck": named, "analytic_flops": "_flops", "analytic_bytes_global": "_tot_hbm"}
    return staged.selectExpr(
        *[f"`{c}`" for c in base], *[f"{feats[c]} AS {c}" for c in FEATURE_COLUMNS if c not in base],
        *[f"{analytic[c]} AS {c}" for c in ANALYTIC_COLUMNS])


def project_model_features(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Exactly the model features, in order; a missing one is an error."""
    gaps = [c for c in FEATURE_COLUMNS if c not in df.columns]
    if gaps:
        raise KeyError(f"frame is missing features {gaps}")
    return df.select(*extra, *FEATURE_COLUMNS)
