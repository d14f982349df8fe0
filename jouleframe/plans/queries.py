"""Registered queries: every operator over the benchmark tables, with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from jouleframe.functions import categories, keys, labels, metrics, roofline, targets
from jouleframe.functions.categories import with_kernel_totals
from jouleframe.operators import (
    catalogue as cat, dataset as dset, external as ext, folds, merge, models, ood, planning, profile as prof,
    quality, reconcile as rec, seeds, telemetry as tel,
)
from jouleframe.operators.dataset import build_dataset
from jouleframe.plans import files
from jouleframe.plans.bindings import LATER, MODELS, Tables
from jouleframe.plans.oracle import CTES, rounded, sql
from jouleframe.runtime import shared_dir, spread, written
from jouleframe.sources.hardware import FLEET_KEYS, attach_hardware, external_hardware_frame, identify_device, power_descriptors
from jouleframe.streaming import ingest, rollup

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        return df.withColumns({c: F.round(c, d) for c, d in self.digits.items()}) if self.digits else df

    def oracle(self) -> str | None:
        return None if self.sql is None else rounded(sql(self.sql), self.digits)


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, **digits: int):
    def add(build):
        REGISTRY[name] = Entry(build, oracle, digits)
        return build
    return add


# --- merging and filtering ----------------------------------------------------------------

_MERGE_COLS = ["kernel_sig", "gpu_key", "source_model", "latency_s", "energy_j", "contended", "l_orderkey", "l_linenumber"]


@query("merge_measurements", f"SELECT {', '.join(_MERGE_COLS)} FROM merged")
def _(t):
    return t.merged.select(*_MERGE_COLS)


@query("merge_clean_only", """SELECT kernel_sig, gpu_key, l_orderkey, contended FROM (SELECT *, row_number() OVER (PARTITION BY kernel_sig, gpu_key
 ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM measurements WHERE contended = 0) WHERE rn = 1""")
def _(t):
    return merge.merge_measurements(t.measured, LATER, clean_only=True).select("kernel_sig", "gpu_key", "l_orderkey", "contended")


@query("drop_contended", "SELECT gpu_key, count(*) AS n FROM measurements WHERE contended = 0 GROUP BY gpu_key")
def _(t):
    return merge.drop_contended(t.measured).groupBy("gpu_key").agg(F.count("*").alias("n"))


@query("filter_reliable", "SELECT kernel_sig, gpu_key, latency_s, energy_sd_rel FROM reliable")
def _(t):
    return merge.filter_reliable(t.merged).select("kernel_sig", "gpu_key", "latency_s", "energy_sd_rel")


@query("reliability_counts", """SELECT count(*) AS n_rows, count(*) FILTER (coalesce(energy_sd_rel, 0) > 0.05) AS n_unstable,
 count(*) FILTER (coalesce(energy_sd_rel, 0) <= 0.05 AND latency_s <= 5e-6) AS n_tiny,
 count(*) FILTER (coalesce(energy_sd_rel, 0) <= 0.05 AND latency_s > 5e-6) AS n_kept FROM measurements""")
def _(t):
    return merge.reliability_counts(t.measured)


@query("union_ragged", """SELECT category, count(*) AS n, count(p_m) AS with_m, count(p_n) AS with_n FROM (
 SELECT 'gemm' AS category, p_m, p_n FROM kernels WHERE category = 'gemm' UNION ALL SELECT 'norm', NULL, NULL FROM kernels WHERE category = 'norm'
 UNION ALL SELECT 'conv', NULL, 1 FROM kernels WHERE category = 'conv') GROUP BY category""")
def _(t):
    k = t.kernel_params
    parts = [k.filter(F.col("category") == "gemm").select("category", "p_m", "p_n", "p_k"),
             k.filter(F.col("category") == "norm").select("category", "p_rows", "p_dim"),
             k.filter(F.col("category") == "conv").select("category", "p_n", "p_c_in")]
    return merge.union_ragged(parts).groupBy("category").agg(
        F.count("*").alias("n"), F.count("p_m").alias("with_m"), F.count("p_n").alias("with_n"))


# --- keys and parameters --------------------------------------------------------------------


@query("kernel_signature", "SELECT kernel_sig, sig FROM signed")
def _(t):
    return t.kernel_params.select("kernel_sig", keys.signature(t.kernel_params).alias("sig"))


@query("signature_of_map", "SELECT kernel_sig, sig FROM signed")
def _(t):
    m = keys.params_to_map(t.kernel_params)
    return m.select("kernel_sig", keys.signature_of_map(F.col("category"), F.col("dtype"), F.col("params")).alias("sig"))


@query("params_round_trip", "SELECT kernel_sig, CASE WHEN category = 'gemm' THEN p_k END AS p_k, CASE WHEN category = 'norm' THEN p_m END AS p_rows, CASE WHEN category = 'elementwise' THEN kind END AS p_kind FROM kernels")
def _(t):
    back = keys.params_to_columns(keys.params_to_map(t.kernel_params), ["k", "rows", "kind"])
    return back.select("kernel_sig", "p_k", "p_rows", "p_kind")


@query("describe_kernels", """SELECT kernel_sig, category || '[' || dtype || '](' || replace(replace(replace(ptext, '": ', '='), '"', ''), ', ', ',') || ')' AS text FROM sigs""")
def _(t):
    return t.kernel_params.select("kernel_sig", keys.describe(t.kernel_params).alias("text"))


@query("analysis_failures", """SELECT 'elementwise: missing kind' AS reason, count(*) AS n_rows FROM kernels WHERE category = 'elementwise' AND p_partkey % 3 = 0 HAVING count(*) > 0
 UNION ALL SELECT 'gemm: missing k', count(*) FROM kernels WHERE category = 'gemm' AND p_partkey % 3 = 0 HAVING count(*) > 0
 UNION ALL SELECT 'unknown card P40', count(*) FROM kernels WHERE p_partkey % 7 = 0 HAVING count(*) > 0
 ORDER BY n_rows DESC, reason LIMIT 5""")
def _(t):
    broken = F.col("partkey") % 3 == 0
    k = t.kernel_params.withColumns({
        "p_k": F.when(~broken, F.col("p_k")), "p_kind": F.when(~broken, F.col("p_kind")), "gpu_key": F.lit("L4")})
    lost = t.kernel_params.filter(F.col("partkey") % 7 == 0).withColumn("gpu_key", F.lit("P40"))
    _, failed = dset.split_failures(k.unionByName(lost))
    return dset.failure_causes(failed)


@query("analysable_rows", "SELECT category, count(*) AS n FROM kernels WHERE NOT (category IN ('gemm','elementwise') AND p_partkey % 3 = 0) GROUP BY category")
def _(t):
    broken = F.col("partkey") % 3 == 0
    k = t.kernel_params.withColumns({"p_k": F.when(~broken, F.col("p_k")), "p_kind": F.when(~broken, F.col("p_kind"))})
    return k.filter(categories.analysis_failure(k).isNull()).groupBy("category").agg(F.count("*").alias("n"))


# --- hardware ---------------------------------------------------------------------------------


@query("attach_hardware", "SELECT gpu_key, architecture, count(*) AS n, max(hw_tdp_w) AS tdp FROM lineitem JOIN hw ON l_suppkey % 8 = gpu_idx GROUP BY ALL", tdp=3)
def _(t):
    # Keys arrive in mixed spellings, some as product names.
    spelled = F.when(F.col("l_linenumber") % 3 == 0, F.lower(F.translate("gpu_key", "_", "-"))).otherwise(F.col("gpu_key"))
    named = F.when((F.col("gpu_key") == "H100") & (F.col("l_linenumber") % 2 == 0), F.lit("nvidia h100 sxm5 80gb")).otherwise(spelled)
    rows = attach_hardware(t.measured.select(named.alias("gpu_key")))
    return rows.groupBy(F.col("hw_gpu_key").alias("gpu_key"), F.col("hw_architecture").alias("architecture")).agg(
        F.count("*").alias("n"), F.max("hw_tdp_w").alias("tdp"))


@query("unknown_cards", "SELECT 'Z' || h.gpu_key AS gpu_key, count(*) AS n FROM orders JOIN hw h ON o_custkey % 8 = gpu_idx WHERE o_custkey % 3 = 0 GROUP BY ALL")
def _(t):
    odd = F.pmod(F.col("o_custkey"), F.lit(3)) == 0
    runs = t.raw("orders").select("o_custkey", F.element_at(F.array(*[F.lit(k) for k in FLEET_KEYS]), (F.col("o_custkey") % 8 + 1).cast("int")).alias("g"))
    placed = attach_hardware(runs.select(F.when(odd, F.concat(F.lit("Z"), "g")).otherwise(F.col("g")).alias("gpu_key")))
    return placed.filter(F.col("hw_gpu_key").isNull()).groupBy("gpu_key").agg(F.count("*").alias("n"))


@query("identify_device", """SELECT name, CASE WHEN regexp_matches(name, '(?i)\\bL4\\b') THEN 'L4' WHEN regexp_matches(name, '(?i)L40S') THEN 'L40S' WHEN regexp_matches(name, '(?i)L40([^S]|$)') THEN 'L40'
 WHEN regexp_matches(name, '(?i)A100.*PCI') THEN 'A100_PCIE' WHEN regexp_matches(name, '(?i)A100.*SXM') THEN 'A100_SXM4' WHEN regexp_matches(name, '(?i)H100') THEN 'H100'
 WHEN regexp_matches(name, '(?i)H200\\s*NVL') THEN 'H200_NVL' WHEN regexp_matches(name, '(?i)H200') THEN 'H200_SXM' END AS gpu_key, count(*) AS n
 FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'Tesla P40' WHEN o_orderkey % 2 = 0 THEN lower(hw_name) ELSE hw_name END AS name FROM orders JOIN hw ON o_custkey % 8 = gpu_idx) GROUP BY ALL""")
def _(t):
    from jouleframe.sources.hardware import FLEET

    nm = F.element_at(F.array(*[F.lit(r[1]) for r in FLEET]), (F.col("o_custkey") % 8 + 1).cast("int"))
    name = F.when(F.col("o_orderkey") % 11 == 0, "Tesla P40").when(F.col("o_orderkey") % 2 == 0, F.lower(nm)).otherwise(nm)
    # Names repeat: match each distinct one once.
    distinct = t.raw("orders").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return distinct.select("name", identify_device(F.col("name")).alias("gpu_key"), "n")


@query("power_descriptors", """SELECT gpu_key, ln(hw_tdp_w/(sms*ops_per_clk*tensor_clock_mhz*1e6*2/1e12)) AS log_watt_per_tflop, hw_idle_w/hw_tdp_w AS idle_fraction, ln(hw_tdp_w/mem_bandwidth_gbs) AS log_watt_per_gbs, count(*) AS n
 FROM lineitem JOIN hw ON l_suppkey % 8 = gpu_idx GROUP BY ALL""", log_watt_per_tflop=9, idle_fraction=9, log_watt_per_gbs=9)
def _(t):
    per_card = t.measured.groupBy("gpu_key").agg(F.count("*").alias("n"))
    d = power_descriptors(["idle_fraction", "log_watt_per_tflop", "log_watt_per_gbs"])
    return attach_hardware(per_card).select("gpu_key", "n", *[c.alias(k) for k, c in d.items()])


@query("derived_peaks", "SELECT gpu_key, sms*ops_per_clk*tensor_clock_mhz*1e6*2 AS tensor, sms*ops_per_clk*boost_clock_mhz*1e6*2 AS tensor_boost, sms*fma_per_clk*boost_clock_mhz*1e6*2 AS fma, count(*) AS n FROM events JOIN hw ON user_id % 8 = gpu_idx GROUP BY ALL")
def _(t):
    placed = attach_hardware(t.telemetry.groupBy("gpu_key").agg(F.count("*").alias("n")))
    return placed.select("gpu_key", F.col("hw_peak_tensor_flops").alias("tensor"), F.col("hw_peak_tensor_flops_boost").alias("tensor_boost"),
                         F.col("hw_peak_fma_flops").alias("fma"), "n")


# --- demand and features ----------------------------------------------------------------------


@query("kernel_totals", """SELECT kernel_sig, category, flops AS kernel_flops, bytes AS kernel_bytes_global, flops/bytes AS arithmetic_intensity, ws AS working_set_bytes FROM (
 SELECT kernel_sig, category, flops,
 CASE category WHEN 'gemm' THEN (pm*pk + pk*pn)*w + pm*pn*4 + pn*w WHEN 'attention' THEN 4*8*pm*64*w WHEN 'conv' THEN pk*gm*w + pn*gm*4 + pn*pk*9*w WHEN 'norm' THEN 2*pm*pn*w + 2*pn*w ELSE et*pm*pn*w END AS bytes,
 CASE category WHEN 'gemm' THEN (pm*pk + pk*pn)*w + pm*pn*w WHEN 'attention' THEN 4*8*pm*64*w WHEN 'conv' THEN pk*gm*w + pn*gm*w + pn*pk*9*w WHEN 'norm' THEN 2*pm*pn*w ELSE et*pm*pn*w END AS ws
 FROM demand WHERE gpu_key = 'L4')""", arithmetic_intensity=9)
def _(t):
    return with_kernel_totals(t.kernel_params).select("kernel_sig", "category", "kernel_flops", "kernel_bytes_global", "arithmetic_intensity", "working_set_bytes")


@query("gemm_tiles", "SELECT kernel_sig, gpu_key, tm AS tile_m, tn AS tile_n, cnt AS n_tiles, CASE WHEN ceil(gm/tm)*ceil(gn/tn) > 4*sms THEN 1 ELSE 0 END AS many FROM task WHERE category IN ('gemm','conv')")
def _(t):
    k = planning.planned_pairs(spread(t.kernel_params.filter(F.col("category").isin("gemm", "conv")), "kernel_sig"), FLEET_KEYS)
    d = roofline.with_demand(attach_hardware(k))
    many = F.col("_tile.tiles") > categories.PERSISTENT_TILES_PER_SM * F.col("hw_sms")
    return d.select("kernel_sig", "gpu_key", F.col("_tile.m").alias("tile_m"), F.col("_tile.n").alias("tile_n"), F.col("_tile.tiles").alias("n_tiles"), many.cast("int").alias("many"))


@query("task_demand", "SELECT kernel_sig, gpu_key, category, cnt AS n_tasks, mma, fma, xu, hbm, l2, smem FROM demand", hbm=3)
def _(t):
    k = planning.planned_pairs(spread(t.kernel_params, "kernel_sig"), FLEET_KEYS)
    d = roofline.with_demand(attach_hardware(k))
    return d.select("kernel_sig", "gpu_key", "category", F.col("_demand.count").alias("n_tasks"), *[F.col(f"_demand.{c}").alias(c) for c in ("mma", "fma", "xu", "hbm", "l2", "smem")])


_LOG = lambda x: f"ln(greatest({x}, 1e-30))"


def _feature_sql() -> str:
    f = {}
    for pipe, (col, rate) in {"tensor": ("mma", "ops_per_clk"), "fma": ("fma", "fma_per_clk"), "xu": ("xu", "xu_per_clk")}.items():
        f[f"log_ops_{pipe}_gpu"], f[f"log_ops_{pipe}_sm_max"] = _LOG(f"t_{col}"), _LOG(f"x_{col}")
        f[f"log_cycles_{pipe}_gpu"], f[f"log_cycles_{pipe}_sm_max"] = _LOG(f"t_{col}/(sms*{rate})"), _LOG(f"x_{col}/{rate}")
    bw = {"global": "(mem_bandwidth_gbs*1e9)", "l2": "(l2_bandwidth_gbs*1e9)", "shared": "(sms*smem_b_per_clk_sm*clk_t)"}
    cols = {"global": "hbm", "l2": "l2", "shared": "smem"}
    time = {"tensor": "s_tensor", "fma": "s_fma", "xu": "s_xu"}
    for level, c in cols.items():
        time[f"mem_{level}"], time[f"mem_{level}_sm"] = f"(t_{c}/{bw[level]})", f"(x_{c}/({bw[level]}/sms))"
        f[f"log_bytes_{level}_gpu"], f[f"log_bytes_{level}_sm_max"] = _LOG(f"t_{c}"), _LOG(f"x_{c}")
        f[f"log_cycles_mem_{level}_gpu"] = _LOG(f"{time[f'mem_{level}']}*clk_t")
        f[f"log_cycles_mem_{level}_sm_max"] = _LOG(f"{time[f'mem_{level}_sm']}*clk_t")
    time["mem_compulsory"] = "s_miss"
    f |= {"log_l2_residency": _LOG("res"), "compulsory_miss_fraction": "miss", "fits_in_l2": "CASE WHEN res <= 1 THEN 1e0 ELSE 0e0 END", "log_theoretical_time": "ln(theory)"}
    f |= {f"slack_{p}": f"ln(greatest({x}, 1e-30)/theory)" for p, x in time.items()}
    f |= {"log_n_tasks": _LOG("cnt"), "log_n_waves": _LOG("cnt/(sms*ctas)"), "tail_fraction": "ceil(cnt/(sms*ctas)) - cnt/(sms*ctas)", "sm_occupancy": "least(cnt, sms)/sms",
          "imbalance_mma": "CASE WHEN t_mma > 0 THEN x_mma/(t_mma/sms) ELSE 1e0 END", "imbalance_bytes": "CASE WHEN t_hbm > 0 THEN x_hbm/(t_hbm/sms) ELSE 1e0 END", "is_persistent": "persistent",
          "log_flops": _LOG("flops"), "log_bytes_per_flop": _LOG("t_hbm/greatest(flops, 1e-30)"), "log_l2_reuse": _LOG("t_l2/greatest(t_hbm, 1e-30)"), "log_arithmetic_intensity": _LOG("flops/greatest(t_hbm, 1e-30)"),
          "log_peak_flops": _LOG("sms*ops_per_clk*clk_t*2"), "log_mem_bw": _LOG("mem_bandwidth_gbs"), "log_sms": "ln(sms)", "log_ops_per_clk": "ln(ops_per_clk)", "log_clock": "ln(clk_t)", "log_smem_kb": "ln(smem_size_kb_sm)", "log_l2_bw": "ln(l2_bandwidth_gbs)",
          "log_tdp": "ln(hw_tdp_w)", "log_idle_power": "ln(hw_idle_w)", "idle_fraction": "hw_idle_w/hw_tdp_w", "log_watt_per_tflop": "ln(hw_tdp_w/(sms*ops_per_clk*clk_t*2/1e12))", "log_watt_per_gbs": "ln(hw_tdp_w/mem_bandwidth_gbs)",
          "is_hbm": "CAST(is_hbm AS DOUBLE)", "compute_capability": "compute_capability", "log_dsize": "ln(w)", "uses_tensor_core": "CASE WHEN t_mma > 0 THEN 1e0 ELSE 0e0 END"}
    assert list(f) == roofline.FEATURE_COLUMNS, [a for a in roofline.FEATURE_COLUMNS if a not in f]
    body = ", ".join(f"{v} AS {k}" for k, v in f.items())
    return f"""SELECT kernel_sig, gpu_key, {body}, theory*1e6 AS theory_us,
 CASE WHEN s_tensor = theory THEN 'tensor' WHEN s_fma = theory THEN 'fma' WHEN s_xu = theory THEN 'xu' ELSE 'mem_compulsory' END AS bottleneck, flops AS analytic_flops, t_hbm AS analytic_bytes_global
 FROM (SELECT *, greatest(s_tensor, s_fma, s_xu, s_miss, 1e-30) AS theory FROM (SELECT *, t_hbm*miss/(mem_bandwidth_gbs*1e9) AS s_miss FROM (
 SELECT *, CASE WHEN res > 1 THEN 1 - 1/res ELSE 0e0 END AS miss FROM (SELECT *, t_hbm/(l2_cache_mb*1048576e0) AS res FROM math))))"""


@query("roofline_features", _feature_sql(), theory_us=6, analytic_bytes_global=1, **{c: 8 for c in roofline.FEATURE_COLUMNS})
def _(t):
    k = planning.planned_pairs(spread(t.kernel_params, "kernel_sig"), FLEET_KEYS)
    out = roofline.roofline_features(attach_hardware(k))
    return out.select("kernel_sig", "gpu_key", *roofline.FEATURE_COLUMNS, (F.col("theoretical_time_s") * 1e6).alias("theory_us"), "bottleneck", "analytic_flops", "analytic_bytes_global")


@query("model_features", "SELECT count(*) AS n, avg(ln(greatest(t_mma, 1e-30))) AS m FROM math", m=6)
def _(t):
    out = roofline.roofline_features(attach_hardware(planning.planned_pairs(t.kernel_params, FLEET_KEYS)))
    return roofline.project_model_features(out).agg(F.count("*").alias("n"), F.avg("log_ops_tensor_gpu").alias("m"))


@query("registered_category", "SELECT gpu_key, count(*) AS n, sum(flops) AS total FROM (SELECT gpu_key, CAST(p_m AS DOUBLE)*p_n*2 AS flops FROM kernels CROSS JOIN hw WHERE category = 'norm') GROUP BY gpu_key")
def _(t):
    # A user-defined category, local to this query: one task per row, two operations per element.
    reg = categories.CategoryRegistry(dict(categories.REGISTRY.by_name))
    reg.register(categories.Category(
        "scan", ("rows", "dim"),
        lambda p: {"flops": f"2D * {p.num('rows')} * {p.num('dim')}", "bytes_global": f"{p.num('rows')} * {p.num('dim')} * _width", "working_set": f"{p.num('rows')} * {p.num('dim')} * _width"},
        lambda p: {"count": p.num("rows"), "mma": "0D", "fma": f"2D * {p.num('dim')}", "xu": "0D", "hbm": f"{p.num('dim')} * _width", "l2": f"{p.num('dim')} * _width", "smem": "0D"}))
    k = t.kernel_params.filter(F.col("category") == "norm").withColumn("category", F.lit("scan"))
    out = dset.attach_features(planning.planned_pairs(k, FLEET_KEYS), registry=reg)
    return out.groupBy("gpu_key").agg(F.count("*").alias("n"), F.sum("analytic_flops").alias("total"))


# --- dataset and targets ------------------------------------------------------------------------

_TARGETS = ["eta", "power_avg_w", "pi", "pi_dynamic", "energy_dynamic_j", "pi_limit", "power_cap_ratio", "log_energy", "log_latency", "pj_per_flop", "pj_per_byte"]


@query("build_dataset", """SELECT kernel_sig, gpu_key, eta, power_avg_w, pi, greatest((power_avg_w - idle_power_w)/greatest(tdp_w - idle_power_w, 1e-6), 1e-6) AS pi_dynamic,
 greatest(energy_j - idle_power_w*latency_s, 0e0) AS energy_dynamic_j, power_avg_w/coalesce(power_limit_w, tdp_w) AS pi_limit, coalesce(power_limit_w, tdp_w)/tdp_w AS power_cap_ratio,
 ln(energy_j) AS log_energy, ln(latency_s) AS log_latency, energy_j/greatest(flops, 1e0)*1e12 AS pj_per_flop, energy_j/greatest(t_hbm, 1e0)*1e12 AS pj_per_byte FROM ds""", eta=7, log_energy=8, log_latency=8, pj_per_flop=6, pj_per_byte=6)
def _(t):
    return t.dataset().select("kernel_sig", "gpu_key", *_TARGETS)


@query("energy_from_heads", "SELECT kernel_sig, gpu_key, 1e6*(least(eta, 1e0)*0 + 0.5e0*tdp_w*theory/greatest(eta, 1e-6)) AS energy_uj, 1e6*theory/greatest(eta, 1e-6) AS latency_us FROM ds", energy_uj=6, latency_us=6)
def _(t):
    theory = F.col("theoretical_time_s")
    return t.dataset().select("kernel_sig", "gpu_key", (1e6 * targets.energy_from_heads(F.col("eta"), F.lit(0.5), theory, F.col("tdp_w"))).alias("energy_uj"),
                              (1e6 * targets.latency_from_eta(F.col("eta"), theory)).alias("latency_us"))


@query("energy_floored", """SELECT d.gpu_key, count(*) AS n, sum(1e6*0.5e0*tdp_w*theory/greatest(eta*0.01, greatest(lo*0.5, 1e-8))) AS energy_uj FROM ds d JOIN (
 SELECT k.gpu_key, min(o.eta) AS lo FROM (SELECT DISTINCT gpu_key FROM ds) k JOIN ds o ON o.gpu_key <> k.gpu_key GROUP BY k.gpu_key) f ON f.gpu_key = d.gpu_key GROUP BY d.gpu_key""", energy_uj=3)
def _(t):
    d = t.dataset()
    floor = targets.complement_eta_floors(d, "gpu_key")
    e = targets.energy_from_heads(F.col("eta") * 0.01, F.lit(0.5), F.col("theoretical_time_s"), F.col("tdp_w"), F.col("floor"))
    return d.join(floor, "gpu_key").groupBy("gpu_key").agg(F.count("*").alias("n"), F.sum(1e6 * e).alias("energy_uj"))


@query("validate_efficiency", """SELECT category, gpu_key, count(*) AS n, median(eta) AS eta_median, quantile_cont(eta, 0.95) AS eta_p95, max(eta) AS eta_max,
 avg(CASE WHEN eta > 1 THEN 1e0 ELSE 0e0 END) AS frac_over_1 FROM ds GROUP BY ALL""", eta_median=7, eta_p95=7, eta_max=7, frac_over_1=9)
def _(t):
    return quality.validate_efficiency(t.dataset())


@query("coverage", "SELECT gpu_key, count(*) FILTER (category = 'gemm') AS gemm, count(*) FILTER (category = 'attention') AS attention, count(*) FILTER (category = 'conv') AS conv, count(*) FILTER (category = 'norm') AS norm, count(*) FILTER (category = 'elementwise') AS elementwise, count(*) AS total FROM reliable GROUP BY gpu_key")
def _(t):
    return quality.coverage(merge.filter_reliable(t.merged_kernels), ["gemm", "attention", "conv", "norm", "elementwise"])


@query("instrument_agreement", "SELECT gpu_key, median(energy_check_ratio) AS median, stddev_samp(energy_check_ratio) AS std, min(energy_check_ratio) AS min, max(energy_check_ratio) AS max FROM measurements GROUP BY gpu_key", median=9, std=9, min=9, max=9)
def _(t):
    return quality.instrument_agreement(t.measured)


@query("power_regime", """SELECT gpu_key, avg(frac_sw_power_cap) AS frac_capped, avg(frac_sw_thermal) AS frac_thermal, median(sm_clock_median_mhz) AS clock_frac, median(pi) AS power_frac, median(eta) AS util FROM ds GROUP BY gpu_key""",
       frac_capped=8, frac_thermal=8, clock_frac=3, power_frac=8, util=7)
def _(t):
    return quality.power_regime(t.dataset())


_DESCRIBE = " UNION ALL ".join(
    f"SELECT category, '{c}' AS target, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, median({c}) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM ds GROUP BY category"
    for c in ("eta", "pi", "power_avg_w"))


@query("target_description", _DESCRIBE, mean=5, std=5, min=7, q25=6, q50=6, q75=6, max=5)
def _(t):
    return quality.target_description(t.dataset())


@query("power_cap_audit", "SELECT gpu_key, count(*) AS n, count(*) FILTER (abs(power_limit_w - power_limit_default_w) > 1) AS n_below, count(*) FILTER (abs(power_limit_w/tdp_w - 1) > 0.02) AS n_off FROM measurements GROUP BY gpu_key")
def _(t):
    return quality.power_cap_audit(t.measured).groupBy("gpu_key").agg(
        F.count("*").alias("n"), F.count_if("limit_below_default").alias("n_below"), F.count_if("limit_off_tdp").alias("n_off"))


@query("pi_floor_audit", "SELECT gpu_key, count(*) AS n, count(*) FILTER (pi < idle_power_w/tdp_w) AS n_below, min(pi) FILTER (pi < idle_power_w/tdp_w) AS worst_pi, max(idle_power_w/tdp_w) FILTER (pi < idle_power_w/tdp_w) AS highest_floor FROM ds GROUP BY gpu_key", worst_pi=9, highest_floor=9)
def _(t):
    return quality.pi_floor_audit(t.dataset())


@query("split_failures", "SELECT CASE WHEN category = 'gemm' AND CAST(substr(kernel_sig, 2) AS BIGINT) % 3 = 0 THEN 'failed' ELSE 'ok' END AS state, count(*) AS n FROM merged GROUP BY 1")
def _(t):
    """A third of the matrix products has lost a parameter."""
    lost = (F.col("category") == "gemm") & (F.substring("kernel_sig", 2, 20).cast("bigint") % 3 == 0)
    ok, failed = dset.split_failures(t.merged_kernels.withColumn("p_k", F.when(~lost, F.col("p_k"))))
    both = ok.select(F.lit("ok").alias("state")).unionByName(failed.select(F.lit("failed").alias("state")))
    return both.groupBy("state").agg(F.count("*").alias("n"))


# --- catalogue --------------------------------------------------------------------------------------

_CAT_COLS = ["kernel_sig", "category", "dtype", "source_model", "op_name", "n_models", "calls_total"]
_CALL_COLS = [f"calls_{m}" for m in MODELS]


_CALL_PARAMS = dict(
    p_m=dict(gemm="p_m"), p_n=dict(gemm="p_n", conv="1"), p_k=dict(gemm="p_k"), p_b=dict(attention="1"), p_h=dict(attention="8", conv="p_m // 8"), p_s_q=dict(attention="p_m"),
    p_s_kv=dict(attention="p_m"), p_d=dict(attention="64"), p_c_in=dict(conv="p_k"), p_c_out=dict(conv="p_n"), p_w=dict(conv="p_m // 8"), p_kh=dict(conv="3"), p_kw=dict(conv="3"),
    p_rows=dict(norm="p_m"), p_dim=dict(norm="p_n"), p_n_elem=dict(elementwise="p_m * p_n"), p_kind=dict(elementwise="kind"))


@query("capture_counts", "SELECT source_model, k.category, dtype, " + ", ".join(f"{p}_ AS {p}" for p in _CALL_PARAMS) + ", count(*) AS count FROM measurements m JOIN (SELECT kernel_sig, category, dtype, "
       + ", ".join(f"CASE category {' '.join(f'WHEN {k!r} THEN {v}' for k, v in c.items())} END AS {p}_" for p, c in _CALL_PARAMS.items()) + " FROM kernels) k ON k.kernel_sig = m.kernel_sig GROUP BY ALL")
def _(t):
    return cat.capture_counts(t.op_calls.drop("count")).select("source_model", "category", "dtype", *_CALL_PARAMS, "count")


@query("category_counts", "SELECT category, count(*) AS count FROM measurements GROUP BY category")
def _(t):
    return cat.category_counts(cat.capture_counts(t.op_calls.drop("count")))


@query("build_catalogue", f"SELECT {', '.join(_CAT_COLS)}, " + ", ".join(f'"{c}"' for c in _CALL_COLS) + " FROM catalogue WHERE ws/1073741824 <= 40")
def _(t):
    return cat.pivot_calls(cat.build_catalogue(t.op_calls), MODELS).select(*_CAT_COLS, *[F.col(f"`{c}`") for c in _CALL_COLS])


@query("summarise_catalogue", "SELECT category, count(*) AS n_configs, CAST(sum(calls_total) AS BIGINT) AS calls, count(*)/(SELECT count(*) FROM catalogue) AS share_of_configs FROM catalogue GROUP BY category", share_of_configs=9)
def _(t):
    return cat.summarise(cat.build_catalogue(t.op_calls))


@query("filter_catalogue", "SELECT kernel_sig, category, calls_total FROM catalogue WHERE category IN ('gemm', 'norm') AND calls_total >= 700 AND ws/1073741824 <= 0.02")
def _(t):
    full = cat.build_catalogue(t.op_calls, max_working_set_gb=None)
    return cat.filter_catalogue(full, ["gemm", "norm"], 0.02, 700).select("kernel_sig", "category", "calls_total")


@query("reload_catalogue", """SELECT kernel_sig, model, greatest(calls_total // n_models, 1) AS count FROM catalogue, unnest(string_split(source_model, '|')) u(model)""")
def _(t):
    flat = cat.build_catalogue(t.op_calls, max_working_set_gb=None)
    return cat.split_calls(flat.drop("calls", "models")).select("kernel_sig", F.col("source_model").alias("model"), "count")


# --- profile -------------------------------------------------------------------------------------------


def _profile(t):
    rows = prof.device_kernels(t.profile_records)
    return rows.groupBy("run_id", "kernel", "category").agg(F.sum("calls").alias("calls"), F.sum("cuda_time_us").alias("cuda_time_us"))


@query("categorise_kernels", "SELECT kernel, category, count(*) AS n FROM prof0 WHERE category <> 'host' GROUP BY ALL")
def _(t):
    return prof.device_kernels(t.profile_records).groupBy("kernel", "category").agg(F.count("*").alias("n"))


_SHARE = "SELECT run_id, kernel, category, share, sum(share) OVER (PARTITION BY run_id ORDER BY cuda_time_us DESC, kernel ROWS UNBOUNDED PRECEDING) AS cumshare FROM (SELECT *, cuda_time_us/sum(cuda_time_us) OVER (PARTITION BY run_id) AS share FROM prof)"


@query("kernel_shares", _SHARE, share=9, cumshare=9)
def _(t):
    return prof.kernel_shares(_profile(t), ["run_id"]).select("run_id", "kernel", "category", "share", "cumshare")


@query("coverage_report", """SELECT run_id, category, sum(cuda_time_us) AS cuda_time_us, CAST(sum(calls) AS BIGINT) AS calls, count(*) AS n_kernels, category IN ('gemm','attention','conv','norm','elementwise') AS implemented,
 sum(cuda_time_us)/(SELECT sum(cuda_time_us) FROM prof p WHERE p.run_id = q.run_id) AS share FROM prof q GROUP BY run_id, category
 UNION ALL SELECT run_id, '__covered__', sum(cuda_time_us) FILTER (category IN ('gemm','attention','conv','norm','elementwise')), CAST(sum(calls) FILTER (category IN ('gemm','attention','conv','norm','elementwise')) AS BIGINT),
 count(*) FILTER (category IN ('gemm','attention','conv','norm','elementwise')), true, sum(cuda_time_us) FILTER (category IN ('gemm','attention','conv','norm','elementwise'))/sum(cuda_time_us) FROM prof GROUP BY run_id""", cuda_time_us=3, share=9)
def _(t):
    return prof.coverage_report(_profile(t), ["run_id"])


@query("top_uncovered", "SELECT kernel, category, calls, cuda_time_us FROM prof WHERE category NOT IN ('gemm','attention','conv','norm','elementwise') ORDER BY cuda_time_us DESC, kernel LIMIT 15", cuda_time_us=3)
def _(t):
    return prof.top_uncovered(_profile(t))


@query("device_time", "SELECT run_id, sum(cuda_time_us/1e6) AS device_time_s, sum(CASE WHEN category <> 'other' THEN cuda_time_us/1e6 ELSE 0 END) AS device_time_covered_s FROM prof GROUP BY run_id", device_time_s=9, device_time_covered_s=9)
def _(t):
    return prof.device_time(_profile(t), ["run_id"])


# --- planning ----------------------------------------------------------------------------------------------


@query("remaining_work", "SELECT k.kernel_sig, h.gpu_key FROM kernels k CROSS JOIN hw h WHERE NOT EXISTS (SELECT 1 FROM measurements m WHERE m.kernel_sig = k.kernel_sig AND m.gpu_key = h.gpu_key AND m.contended = 0)")
def _(t):
    return planning.remaining_work(t.kernels.select("kernel_sig"), FLEET_KEYS, merge.drop_contended(t.measured))


@query("planned_pairs", "SELECT gpu_key, category, count(*) AS n FROM kernels CROSS JOIN hw GROUP BY ALL")
def _(t):
    return planning.planned_pairs(t.kernels, FLEET_KEYS).groupBy("gpu_key", "category").agg(F.count("*").alias("n"))


_COST = """(SELECT kernel_sig, 13.25e0 + 0.4e0*(ws*4/1073741824e0) AS cost_s FROM (SELECT kernel_sig, CASE category WHEN 'gemm' THEN (pm*pk + pk*pn)*w + pm*pn*w WHEN 'attention' THEN 4*8*pm*64*w WHEN 'conv' THEN pk*gm*w + pn*gm*w + pn*pk*9*w
 WHEN 'norm' THEN 2*pm*pn*w ELSE et*pm*pn*w END AS ws FROM demand WHERE gpu_key = 'L4'))"""


def _costed(t):
    k = with_kernel_totals(t.kernel_params)
    return k.select("kernel_sig", "category", planning.estimate_cost_s(F.col("working_set_bytes")).alias("cost_s"))


_SHARDS = f"""SELECT kernel_sig, shard FROM (WITH RECURSIVE costs AS MATERIALIZED (SELECT kernel_sig, CAST(round(cost_s*1e6) AS BIGINT) AS c, row_number() OVER (ORDER BY CAST(round(cost_s*1e6) AS BIGINT) DESC, kernel_sig) AS i FROM {_COST}),
 step(i, kernel_sig, shard, loads) AS (SELECT CAST(0 AS BIGINT), '', CAST(-1 AS INTEGER), [CAST(0 AS BIGINT) for x in range(7)]
 UNION ALL SELECT s.i + 1, n.kernel_sig, CAST(list_position(s.loads, list_min(s.loads)) - 1 AS INTEGER), list_transform(s.loads, lambda x, j: x + CASE WHEN j = list_position(s.loads, list_min(s.loads)) THEN n.c ELSE 0 END)
 FROM step s JOIN costs n ON n.i = s.i + 1) SELECT kernel_sig, shard FROM step WHERE i > 0)"""


@query("balanced_shards", _SHARDS)
def _(t):
    return planning.balanced_shards(_costed(t), 7).select("kernel_sig", "shard")


@query("within_budget", f"SELECT kernel_sig, elapsed_s FROM (SELECT kernel_sig, sum(cost_s) OVER (ORDER BY kernel_sig ROWS UNBOUNDED PRECEDING) AS elapsed_s FROM {_COST}) WHERE elapsed_s <= 10000", elapsed_s=4)
def _(t):
    return planning.within_budget(_costed(t), 10_000.0, [F.col("kernel_sig")]).select("kernel_sig", "elapsed_s")


@query("progress", """SELECT * FROM (SELECT coalesce(f.gpu_key, e.k) AS gpu_key, coalesce(n, 0) AS n_kernels, coalesce(nf, 0) AS n_files, CASE WHEN e.k IS NULL THEN 'unexpected' WHEN f.gpu_key IS NULL THEN 'missing' ELSE 'ok' END AS state,
 (SELECT count(*) FROM kernels) AS n_catalogue, 100e0*coalesce(n, 0)/(SELECT count(*) FROM kernels) AS pct_of_catalogue
 FROM (SELECT gpu_key, count(DISTINCT kernel_sig) AS n, count(DISTINCT category) AS nf FROM measurements GROUP BY gpu_key) f FULL JOIN (VALUES ('L4'), ('L40S'), ('H100'), ('B200')) e(k) ON e.k = f.gpu_key)
 UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), CAST(sum(nf) AS BIGINT), 'total', (SELECT count(*) FROM kernels), NULL FROM (SELECT gpu_key, count(DISTINCT kernel_sig) AS n, count(DISTINCT category) AS nf FROM measurements GROUP BY gpu_key)""", pct_of_catalogue=6)
def _(t):
    return quality.progress(t.measurements.withColumn("file_name", F.col("category")), t.kernels, ["L4", "L40S", "H100", "B200"])


@query("sweep_outcome", """SELECT gpu_key, count(*) FILTER (s = 0) AS measured, count(*) FILTER (s = 1) AS skipped_done, count(*) FILTER (s = 2) AS skipped_oom, count(*) FILTER (s = 3) AS failed, count(*) FILTER (s = 4) AS remaining
 FROM (SELECT gpu_key, l_orderkey % 5 AS s FROM measurements) GROUP BY gpu_key""")
def _(t):
    status = F.element_at(F.array(*[F.lit(s) for s in ("measured", "done", "oom", "failed", "remaining")]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return quality.sweep_outcome(t.measured.withColumn("status", status), ["gpu_key"])


@query("log_warnings", """SELECT pattern, count(DISTINCT doc_id) AS n_logs FROM documents CROSS JOIN (VALUES ('the'), ('error'), ('License'), ('@'), ('no such text')) p(pattern) WHERE contains(text, pattern) GROUP BY pattern""")
def _(t):
    # Documents stand in for job logs: each is one log, read whole.
    lines = t.raw("documents").select(F.col("doc_id").alias("file_name"), F.explode(F.split("text", "\n")).alias("value"))
    return quality.log_warnings(lines, ["the", "error", "License", "@", "no such text"])


# --- telemetry -----------------------------------------------------------------------------------------------

_TRAP = """(SELECT gpu_key, hour, sum(coalesce(0.5*(power_w + p0)*(us - u0)/1e6, 0)) AS e FROM (SELECT *, lag(power_w) OVER w AS p0, lag(us) OVER w AS u0 FROM telemetry WINDOW w AS (PARTITION BY gpu_key, hour ORDER BY us, event_id, power_w)) GROUP BY ALL)"""
_TEL_SQL = f"""SELECT t.gpu_key, t.hour, count(*) AS n_samples, greatest((max(us) - min(us))/1e6, 1e-9) AS duration_s, avg(power_w) AS power_mean_w, max(power_w) AS power_max_w, stddev_pop(power_w) AS power_sd_w, median(power_w) AS power_median_w,
 avg(sm_clock) AS sm_clock_mean_mhz, max(sm_clock) AS sm_clock_max_mhz, median(sm_clock) AS sm_clock_median_mhz, avg(mem_clock) AS mem_clock_mean_mhz, avg(temp) AS temperature_mean_c, max(temp) AS temperature_max_c,
 avg(util_gpu) AS util_gpu_mean_pct, avg(util_mem) AS util_mem_mean_pct, avg(CASE WHEN throttle & 4 <> 0 THEN 1e0 ELSE 0e0 END) AS frac_sw_power_cap, avg(CASE WHEN throttle & 8 <> 0 THEN 1e0 ELSE 0e0 END) AS frac_hw_slowdown,
 avg(CASE WHEN throttle & 32 <> 0 THEN 1e0 ELSE 0e0 END) AS frac_sw_thermal, avg(CASE WHEN throttle & 64 <> 0 THEN 1e0 ELSE 0e0 END) AS frac_hw_thermal, (max_by(counter_mj, us) - min_by(counter_mj, us))/1000.0 AS energy_counter_j, any_value(e) AS energy_integrated_j
 FROM telemetry t JOIN {_TRAP} x ON x.gpu_key = t.gpu_key AND x.hour = t.hour GROUP BY t.gpu_key, t.hour"""
_TEL_DIGITS = {c: 6 for c in ("duration_s", "power_mean_w", "power_max_w", "power_sd_w", "power_median_w", "sm_clock_mean_mhz", "sm_clock_median_mhz", "mem_clock_mean_mhz", "temperature_mean_c",
                              "util_gpu_mean_pct", "util_mem_mean_pct", "frac_sw_power_cap", "frac_hw_slowdown", "frac_sw_thermal", "frac_hw_thermal", "energy_counter_j")} | {"energy_integrated_j": 4}


def _hourly(t):
    return t.telemetry.withColumn("hour", F.date_trunc("hour", "ts"))


@query("summarise_telemetry", _TEL_SQL, **_TEL_DIGITS)
def _(t):
    return tel.summarise_telemetry(_hourly(t), ["gpu_key", "hour"], tie=["event_id"])


@query("trapezoid_energy", f"SELECT gpu_key, sum(e0) AS energy_integrated_j FROM (SELECT gpu_key, coalesce(0.5*(power_w + lag(power_w) OVER w)*(us - lag(us) OVER w)/1e6, 0) AS e0 FROM telemetry WINDOW w AS (PARTITION BY gpu_key ORDER BY us, event_id, power_w)) GROUP BY gpu_key", energy_integrated_j=2)
def _(t):
    return tel.trapezoid_energy(t.telemetry, ["gpu_key"], tie=["event_id"])


@query("idle_baseline", """SELECT gpu_key, median(power_w) AS power_w, median(sm_clock) AS sm_clock_mhz, stddev_pop(power_w) AS power_sd_w, avg(temp) AS temperature_c, count(*) AS samples, (max(us) - min(us))/1e6 AS seconds
 FROM (SELECT *, min(us) OVER (PARTITION BY gpu_key) AS u0 FROM telemetry) WHERE us >= u0 + 600000000 GROUP BY gpu_key""", power_w=6, sm_clock_mhz=6, power_sd_w=6, temperature_c=6, seconds=6)
def _(t):
    return tel.idle_baseline(t.telemetry, ["gpu_key"], settle_s=600.0)


@query("decode_throttle", "SELECT gpu_key, " + ", ".join(f"count(*) FILTER (throttle & {b} <> 0) AS {n}" for n, b in labels.THROTTLE_BITS.items()) + " FROM telemetry GROUP BY gpu_key")
def _(t):
    d = t.telemetry.select("gpu_key", labels.decode_throttle(F.col("throttle")).alias("d"))
    return d.groupBy("gpu_key").agg(*[F.count_if(F.col(f"d.{n}")).alias(n) for n in labels.THROTTLE_BITS])


_WIN_SQL = """SELECT gpu_key, ws AS window_start, ws + INTERVAL 6 HOUR AS window_end, count(*) AS n_samples, avg(power_w) AS power_mean_w, median(power_w) AS power_median_w, median(sm_clock) AS sm_clock_median_mhz, sum(coalesce(0.5*(power_w + p0)*(us - u0)/1e6, 0)) AS energy_integrated_j
 FROM (SELECT *, lag(power_w) OVER w AS p0, lag(us) OVER w AS u0 FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS ws FROM telemetry) WINDOW w AS (PARTITION BY gpu_key, ws ORDER BY us, event_id, power_w)) GROUP BY gpu_key, ws"""
_WIN_COLS = ["gpu_key", "window_start", "window_end", "n_samples", "power_mean_w", "power_median_w", "sm_clock_median_mhz", "energy_integrated_j"]
_WIN_DIGITS = dict(power_mean_w=6, power_median_w=6, sm_clock_median_mhz=6, energy_integrated_j=3)


@query("windowed_rollup", _WIN_SQL, **_WIN_DIGITS)
def _(t):
    return rollup.windowed_rollup(t.telemetry, ["gpu_key"], "6 hours", tie=["event_id"]).select(*_WIN_COLS)


@query("stream_rollup", _WIN_SQL, **_WIN_DIGITS)
def _(t):
    from jouleframe.plans.bindings import _telemetry

    events = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    out = _fresh_folder(t.spark, "rollup")
    rolled = rollup.windowed_rollup(_telemetry(events), ["gpu_key"], "6 hours", delay="1 hour", tie=["event_id"])
    rollup.start_rollup(rolled, f"{out}/windows", f"{out}/state", available_now=True).awaitTermination()
    return rollup.read_rollup(t.spark, f"{out}/windows", ["gpu_key"], "6 hours").select(*_WIN_COLS)


@query("stream_ingest", f"SELECT {', '.join(_MERGE_COLS)} FROM merged")
def _(t):
    facts = t.spark.readStream.schema(t.raw("lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(t.dir)

    class Streamed(Tables):
        def raw(self, name):
            return facts if name == "lineitem" else super().raw(name)

    rows = Streamed(t.spark, t.dir).measured.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select(*dict.fromkeys([*merge.KEY, "contended", *_MERGE_COLS, *LATER]))
    out = _fresh_folder(t.spark, "ingest")
    ingest.start_ingest(rows, f"{out}/rows", f"{out}/state", LATER, available_now=True).awaitTermination()
    return ingest.read_ingested(t.spark, f"{out}/rows", LATER).select(*_MERGE_COLS)


@query("stream_sessions", """SELECT gpu_key, count(*) AS n_samples, avg(power_w) AS power_mean_w FROM (SELECT *, sum(fresh) OVER (PARTITION BY gpu_key ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (
 SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY gpu_key ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM telemetry)) GROUP BY gpu_key, s
 HAVING max(us) + 1800000000 <= (SELECT max(us) FROM telemetry) - 3600000000""", power_mean_w=6)
def _(t):
    """Sessions that the watermark has passed, each written once."""
    from jouleframe.plans.bindings import _telemetry

    events = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    out = _fresh_folder(t.spark, "sessions")
    spans = rollup.run_rollup(_telemetry(events), gap="30 minutes", delay="1 hour", tie=["event_id"], slice_="10 seconds")
    rollup.start_rollup(spans, f"{out}/windows", f"{out}/state", available_now=True, mode="append").awaitTermination()
    return rollup.read_sessions(t.spark, f"{out}/windows").select("gpu_key", "n_samples", "power_mean_w")


@query("session_rollup", """SELECT gpu_key, count(*) AS n_samples, avg(power_w) AS power_mean_w FROM (SELECT *, sum(fresh) OVER (PARTITION BY gpu_key ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (
 SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY gpu_key ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM telemetry)) GROUP BY gpu_key, s""", power_mean_w=6)
def _(t):
    return rollup.run_rollup(t.telemetry, gap="30 minutes", tie=["event_id"]).select("gpu_key", "n_samples", "power_mean_w")


def _fresh_folder(spark, prefix: str) -> str:
    """A new folder under the one all executors reach."""
    return f"{shared_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


@query("summarise_repeats", """SELECT kernel_sig, gpu_key, median(latency_s)*1e6 AS latency_us, median(energy_j)*1e6 AS energy_uj, stddev_pop(latency_s)/greatest(avg(latency_s), 1e-30) AS latency_sd_rel,
 stddev_pop(energy_j)/greatest(avg(energy_j), 1e-30) AS energy_sd_rel, count(*) AS n_repeats, median(l_quantity) AS window_s FROM measurements GROUP BY ALL""",
       latency_us=6, energy_uj=6, latency_sd_rel=8, energy_sd_rel=8, window_s=6)
def _(t):
    w = t.measured.withColumns({"repeat": F.col("l_orderkey"), "duration_s": F.col("l_quantity")})
    out = tel.summarise_repeats(w)
    return out.select("kernel_sig", "gpu_key", (F.col("latency_s") * 1e6).alias("latency_us"), (F.col("energy_raw_j") * 1e6).alias("energy_uj"), "latency_sd_rel", "energy_sd_rel", "n_repeats", "window_s")


@query("counter_ratio", "SELECT gpu_key, max_by(CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice/l_quantity END, l_orderkey*1000000000 + l_linenumber*100000000 + l_suppkey*1000000 + CAST(l_extendedprice AS BIGINT)) AS energy_check_ratio FROM measurements GROUP BY gpu_key", energy_check_ratio=6)
def _(t):
    """The last ratio of each card: repeats without a counter reading have no place in the order (SQL's max_by passes over them)."""
    order = F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 100_000_000 + F.col("l_suppkey") * 1_000_000 + F.rint("l_extendedprice").cast("bigint")
    read = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_extendedprice"))
    placed = F.when(read.isNotNull() & F.col("l_quantity").isNotNull(), order)
    w = t.measured.withColumns({"repeat": placed, "energy_counter_j": read, "energy_integrated_j": F.col("l_quantity")})
    return tel.summarise_repeats(w, ["gpu_key"]).select("gpu_key", "energy_check_ratio")


@query("summarise_e2e_repeats", """SELECT gpu_key, model, steps, median(latency_s) AS latency_s, median(energy_j) AS energy_j, median(energy_j)/median(latency_s) AS power_avg_w, stddev_pop(latency_s)/greatest(avg(latency_s), 1e-12) AS latency_sd_rel, count(*) AS n_repeats FROM runs GROUP BY ALL""",
       latency_s=9, energy_j=9, power_avg_w=8, latency_sd_rel=8)
def _(t):
    return tel.summarise_e2e_repeats(t.e2e_runs, ["gpu_key", "model", "steps"]).drop("energy_sd_rel")


@query("launch_overhead", "SELECT gpu_key, median(latency_s)*1e6 AS overhead_us, median(coalesce(CASE WHEN l_linenumber <> 3 THEN energy_j END, 0))*1e6 AS overhead_uj FROM measurements GROUP BY gpu_key", overhead_us=6, overhead_uj=6)
def _(t):
    w = t.measured.withColumn("energy_j", F.when(F.col("l_linenumber") != 3, F.col("energy_j")))
    return tel.launch_overhead(w, ["gpu_key"]).select("gpu_key", (F.col("overhead_s") * 1e6).alias("overhead_us"), (F.col("overhead_j") * 1e6).alias("overhead_uj"))


@query("subtract_overhead", """SELECT kernel_sig, gpu_key, l*1e6 AS latency_us, e*1e6 AS energy_uj, e/greatest(l, 1e-12) AS power_avg_w FROM (SELECT m.kernel_sig, m.gpu_key, greatest(latency_s - oh, 1e-9) AS l, greatest(energy_j - oe, 1e-12) AS e FROM merged m JOIN
 (SELECT gpu_key, min(latency_s) AS oh, min(energy_j) AS oe FROM measurements GROUP BY gpu_key) o ON o.gpu_key = m.gpu_key)""", latency_us=9, energy_uj=9)
def _(t):
    floor = t.measured.groupBy("gpu_key").agg(F.min("latency_s").alias("overhead_s"), F.min("energy_j").alias("overhead_j"))
    out = targets.subtract_overhead(t.merged.withColumnRenamed("energy_j", "energy_raw_j").join(floor, "gpu_key"))
    return out.select("kernel_sig", "gpu_key", (F.col("latency_s") * 1e6).alias("latency_us"), (F.col("energy_j") * 1e6).alias("energy_uj"), "power_avg_w")


# --- folds and models ---------------------------------------------------------------------------------------------


def _fold_sql(col: str) -> str:
    """Roofline and constant baselines; the constant is the median of every other group."""
    return f"""SELECT coalesce(g, 'POOLED') AS "group", count(*) AS n_test, avg(abs(er - energy_j)/greatest(abs(energy_j), 1e-8)*100) AS roofline, avg(abs(ec - energy_j)/greatest(abs(energy_j), 1e-8)*100) AS "constant" FROM fold_rows GROUP BY ROLLUP (g)
 UNION ALL SELECT 'MEAN', CAST(sum(n) AS BIGINT), avg(r), avg(c) FROM (SELECT g, count(*) AS n, avg(abs(er - energy_j)/greatest(abs(energy_j), 1e-8)*100) AS r, avg(abs(ec - energy_j)/greatest(abs(energy_j), 1e-8)*100) AS c FROM fold_rows GROUP BY g)""".replace(
        "fold_rows", f"""(SELECT d.{col} AS g, energy_j, tdp_w*theory AS er, mp*tdp_w*theory/greatest(me, 1e-6) AS ec FROM ds d JOIN (
 SELECT k.{col} AS g, median(o.eta) AS me, median(o.pi) AS mp FROM (SELECT DISTINCT {col} FROM ds) k JOIN ds o ON o.{col} <> k.{col} GROUP BY 1) c ON c.g = d.{col})""")


for _fold, _col in folds.FOLDS.items():
    REGISTRY[f"baseline_table_{_fold}"] = Entry(
        (lambda f: lambda t: folds.baseline_table(t.dataset(), f))(_fold), _fold_sql(_col), {"roofline": 4, "constant": 4})


@query("assign_folds", """SELECT gpu_key AS "group", count(*) AS n_test, (SELECT count(*) FROM ds) - count(*) AS n_train, count(*) >= 10 AND (SELECT count(*) FROM ds) - count(*) >= 10 AS evaluated FROM ds GROUP BY gpu_key""")
def _(t):
    return folds.complement_overview(t.dataset(), "hardware")


@query("complement_medians", """SELECT k.category AS "group", median(o.eta) AS eta_const, median(o.pi) AS pi_const FROM (SELECT DISTINCT category FROM ds) k JOIN ds o ON o.category <> k.category GROUP BY 1""", eta_const=7, pi_const=9)
def _(t):
    return folds.complement_medians(t.dataset(), "category", ["attention", "conv", "elementwise", "gemm", "norm"])


_CLOCK_ROWS = """(SELECT gpu_key AS g, abs(tdp_w*theory - energy_j)/greatest(abs(energy_j), 1e-8)*100 AS t, abs(tdp_w*theory_boost - energy_j)/greatest(abs(energy_j), 1e-8)*100 AS b FROM ds)"""


@query("clock_comparison", f"""SELECT coalesce(g, 'POOLED') AS "group", count(*) AS n_test_tensor, avg(t) AS roofline_tensor, count(*) AS n_test_boost, avg(b) AS roofline_boost FROM {_CLOCK_ROWS} GROUP BY ROLLUP (g)
 UNION ALL SELECT 'MEAN', CAST(sum(n) AS BIGINT), avg(t), CAST(sum(n) AS BIGINT), avg(b) FROM (SELECT g, count(*) AS n, avg(t) AS t, avg(b) AS b FROM {_CLOCK_ROWS} GROUP BY g)""", roofline_tensor=4, roofline_boost=4)
def _(t):
    # Both clocks read the same merged rows, written once; the answer holds the roofline's errors only.
    rows = written(merge.filter_reliable(t.merged).drop("l_extendedprice", "l_quantity", "l_suppkey", "ts"))
    rows = rows.join(t.kernel_params.drop("kernel_sig"), "partkey")
    a, b = (folds.baseline_table(build_dataset(rows, clock=c), "hardware", constant=False).select("group", "n_test", "roofline") for c in ("tensor", "boost"))
    return folds.clock_comparison(a, b)


@query("ridge_baseline")
def _(t):
    """All features; each held-out card's errors, MEAN and POOLED."""
    return folds.baseline_table(t.dataset(), "hardware", roofline.FEATURE_COLUMNS, ridge=True)


@query("evaluate_category")
def _(t):
    return models.evaluate(t.dataset(), "category").table


@query("category_specialists")
def _(t):
    """Cards held out; categories with enough rows elsewhere have a model of their own."""
    return models.evaluate(t.dataset(), "hardware", per_category=True).table


@query("run_seeds")
def _(t):
    return models.run_seeds(t.dataset(), fold="architecture")


def _histories(t):
    """Loss arrays per fit, derived from the measured latencies of each card and model."""
    rows = t.measured.withColumn("epoch", (F.col("l_orderkey") % 40).cast("int"))
    per_epoch = rows.groupBy(F.col("gpu_key").alias("group"), F.col("source_model").alias("model"), "epoch").agg(F.avg("l_quantity").alias("v"), F.max("l_quantity").alias("m"), F.min("l_extendedprice").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("epoch", "v", "m", "x")))
    packed = per_epoch.groupBy("group", "model").agg(ordered.alias("e"))
    return packed.select(F.lit("hardware").alias("fold"), "group", "model", F.col("e.v").alias("train"), F.col("e.m").alias("val"), F.col("e.x").alias("test"), F.lit(7).alias("best_epoch"))


_HIST = """(SELECT gpu_key AS "group", source_model AS model, CAST(row_number() OVER (PARTITION BY gpu_key, source_model ORDER BY l_orderkey % 40) - 1 AS INTEGER) AS epoch, avg(l_quantity) AS v, max(l_quantity) AS m, min(l_extendedprice) AS x FROM measurements GROUP BY gpu_key, source_model, l_orderkey % 40)"""


@query("histories_frame", f"""SELECT 'hardware' AS fold, "group", model, 7 AS best_epoch, split, epoch, loss FROM (SELECT "group", model, epoch, v AS train, m AS val, x AS test FROM {_HIST}) UNPIVOT (loss FOR split IN (train, val, test))""", loss=6)
def _(t):
    return models.histories_frame(_histories(t))


@query("curve_summary", f"""SELECT 'hardware' AS fold, "group", model, CAST(7 AS INTEGER) AS best_epoch, max(v) FILTER (epoch = 7) AS train_at_best, max(m) FILTER (epoch = 7) AS val_at_best, max(x) FILTER (epoch = 7) AS test_at_best,
 arg_max(v, epoch) AS train_at_last, arg_max(m, epoch) AS val_at_last, arg_max(x, epoch) AS test_at_last, CAST(count(*) AS INTEGER) AS epochs FROM {_HIST} GROUP BY "group", model""", train_at_best=6, train_at_last=6)
def _(t):
    return models.curve_summary(models.histories_frame(_histories(t)))


# Losses as they fall over a fit: the average so far, which also improves by less than the threshold.
_FALLING = """(SELECT "group", model, list(m ORDER BY epoch) AS losses FROM (SELECT "group", model, epoch, round(avg(v) OVER (PARTITION BY "group", model ORDER BY epoch ROWS UNBOUNDED PRECEDING), 3) - epoch*2e-7 AS m FROM _HIST) GROUP BY "group", model)""".replace("_HIST", _HIST)


@query("best_epochs", f"""SELECT 'hardware' AS fold, "group", model, b.epoch AS best_epoch, b.loss AS best_val FROM (SELECT "group", model, list_reduce(list_transform(losses, lambda x, i: {{'epoch': CAST(i - 1 AS INTEGER), 'loss': CAST(x AS DOUBLE)}}),
 lambda best, x: CASE WHEN x.loss < best.loss - 1e-6 THEN x ELSE best END, {{'epoch': CAST(-1 AS INTEGER), 'loss': CAST('inf' AS DOUBLE)}}) AS b FROM {_FALLING})""", best_val=9)
def _(t):
    from pyspark.sql import Window

    tidy = models.histories_frame(_histories(t)).filter("split = 'train'")
    so_far = Window.partitionBy("group", "model").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = F.round(F.avg("loss").over(so_far), 3) - F.col("epoch") * 2e-7
    return models.best_epochs(tidy.withColumns({"loss": falling, "split": F.lit("val")}))


# --- reconciliation ---------------------------------------------------------------------------------------------


def _reliable(t):
    return merge.filter_reliable(t.merged)


def _predictions(t, reliable=None):
    d = (_reliable(t) if reliable is None else reliable).join(t.kernels.select("partkey", "category"), "partkey")
    return d.filter((F.col("category") != "conv") & (F.col("gpu_key") != "L4")).select(
        "gpu_key", "kernel_sig", (F.col("energy_j") * 1.1).alias("energy_pred"), (F.col("latency_s") * 0.9).alias("latency_pred"))


def _reconciled(t):
    # Cards, measured and predicted values all read the merged rows: merged and written once.
    reliable = written(_reliable(t).select("partkey", "gpu_key", "kernel_sig", "energy_j", "latency_s"))
    return rec.reconcile(t.e2e_runs, t.e2e_calls, reliable, _predictions(t, reliable))


_REC_DIGITS = dict(call_coverage=11, A_kernel_energy_j=13, A_total_j=13, A_ratio=9, A_residual_j=13, A_residual_frac=9, A_kernel_latency_s=13,
                   A_latency_ratio=9, B_kernel_energy_j=13, B_total_j=13, B_ratio=9, B_residual_frac=9, B_call_coverage=11, B_kernel_latency_s=13, B_latency_ratio=9)


@query("reconcile", "SELECT * FROM rec", **_REC_DIGITS)
def _(t):
    return _reconciled(t)


@query("reconcile_summary", "SELECT gpu_key, model, steps, e2e_energy_j, A_total_j, B_total_j, A_ratio, B_ratio, A_residual_frac, busy_fraction, call_coverage, profiler_coverage, A_latency_ratio, B_latency_ratio FROM rec",
       **{c: _REC_DIGITS[c] for c in ("A_total_j", "B_total_j", "A_ratio", "B_ratio", "A_residual_frac", "call_coverage", "A_latency_ratio", "B_latency_ratio")})
def _(t):
    return rec.summarise(_reconciled(t))


def _fit(c, tag):
    whole = f"count({c}) = count(*)"
    return (f"CASE WHEN {whole} THEN regr_intercept({c}, steps) END AS {tag}_fixed_j, CASE WHEN {whole} THEN regr_slope({c}, steps) END AS {tag}_per_step_j, "
            f"CASE WHEN {whole} AND var_pop({c}) > 0 THEN regr_r2({c}, steps) END AS {tag}_r2")


_STEP = f"""SELECT *, A_per_step_j/measured_per_step_j AS A_slope_ratio, CASE WHEN abs(measured_fixed_j) > 1e-9 THEN A_fixed_j/measured_fixed_j END AS A_fixed_ratio, B_per_step_j/measured_per_step_j AS B_slope_ratio,
 CASE WHEN abs(measured_fixed_j) > 1e-9 THEN B_fixed_j/measured_fixed_j END AS B_fixed_ratio FROM (SELECT gpu_key, model, count(*) AS n_points, {_fit('e2e_energy_j', 'measured')}, {_fit('A_total_j', 'A')}, {_fit('B_total_j', 'B')} FROM rec GROUP BY gpu_key, model HAVING count(*) >= 3)"""


@query("step_model", _STEP, **{f"{tag}_{c}": 8 for tag in ("measured", "A", "B") for c in ("fixed_j", "per_step_j", "r2")}, **{f"{tag}_{c}": 4 for tag in ("A", "B") for c in ("slope_ratio", "fixed_ratio")})
def _(t):
    return rec.step_model(_reconciled(t))


@query("sum_over_calls", "SELECT c.run_id, coalesce(sum(d.energy_j*c.calls), 0) AS energy, CAST(coalesce(sum(c.calls) FILTER (d.energy_j IS NOT NULL), 0) AS BIGINT) AS matched, CAST(coalesce(sum(c.calls) FILTER (d.energy_j IS NULL), 0) AS BIGINT) AS missing FROM calls c JOIN runs r ON r.run_id = c.run_id LEFT JOIN reliable d ON d.kernel_sig = c.kernel_sig AND d.gpu_key = r.gpu_key GROUP BY c.run_id", energy=13)
def _(t):
    calls = t.e2e_calls.join(t.e2e_runs.select("run_id", "gpu_key"), "run_id")
    return rec.sum_over_calls(calls, _reliable(t), ["run_id"], {"energy_j": "energy"})


@query("calls_frame", "SELECT run_id, kernel_sig, calls FROM calls")
def _(t):
    as_map = t.e2e_calls.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("kernel_sig", "calls"))).alias("calls"))
    return rec.calls_frame(as_map, ["run_id"])


@query("run_derived", """SELECT r.run_id, latency_s - device_time_s AS gap_s, device_time_s/greatest(latency_s, 1e-12) AS busy_fraction, CAST(n AS INTEGER) AS n_configs, CAST(tc AS BIGINT) AS total_calls FROM runs r JOIN (SELECT run_id, count(*) AS n, sum(calls) AS tc FROM calls GROUP BY run_id) c ON c.run_id = r.run_id""", gap_s=9, busy_fraction=9)
def _(t):
    as_map = t.e2e_calls.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("kernel_sig", "calls"))).alias("calls"))
    return rec.run_derived(t.e2e_runs.join(as_map, "run_id")).select("run_id", "gap_s", "busy_fraction", "n_configs", "total_calls")


@query("attach_calls", "SELECT r.gpu_key, r.model, count(*) AS n, CAST(sum(c.calls) AS BIGINT) AS calls FROM runs r JOIN calls c ON c.run_id = r.run_id GROUP BY ALL")
def _(t):
    return rec.attach_calls(t.e2e_runs, t.e2e_calls, ["run_id"]).groupBy("gpu_key", "model").agg(F.count("*").alias("n"), F.sum("calls").alias("calls"))


@query("rejected_runs", "SELECT gpu_key, count(*) AS n FROM runs WHERE gpu_key = 'H100' GROUP BY gpu_key")
def _(t):
    _, rejected = rec.split_known_cards(t.e2e_runs, t.measured.filter(F.col("gpu_key") != "H100"))
    return rejected.groupBy("gpu_key").agg(F.count("*").alias("n"))


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _model_calls(t):
    """Call counts per kernel and generation model, from the runs of that model."""
    c = t.e2e_calls.join(t.e2e_runs.select("run_id", "model"), "run_id").groupBy("kernel_sig", "model").agg(F.sum("calls").alias("calls"))
    return c.join(t.kernels.select("kernel_sig", "category"), "kernel_sig")


def _recon_sql(idle: str) -> str:
    return f"""SELECT r.run_id, r.gpu_key, r.model, r.steps, r.energy_j AS e2e_energy_j, r.latency_s AS e2e_latency_s, coalesce(es*steps + eo, 0) AS kernel_sum_energy_j, coalesce(ts*steps + t_o, 0) AS kernel_sum_latency_s,
 coalesce(es*steps + eo, 0) + idle_power_w*{idle} AS reconstructed_energy_j, (coalesce(es*steps + eo, 0) + idle_power_w*{idle})/greatest(r.energy_j, 1e-12) AS energy_ratio, coalesce(ts*steps + t_o, 0)/greatest(r.latency_s, 1e-12) AS latency_ratio,
 coalesce(ns*steps + no, 0)/greatest(als*steps + alo, 1) AS catalogue_call_coverage, coalesce(nm, 0) AS n_configs_matched, nt AS n_configs_total FROM runs r
 JOIN (SELECT model, sum(CASE WHEN category <> 'conv' THEN calls ELSE 0 END) AS als, sum(CASE WHEN category = 'conv' THEN calls ELSE 0 END) AS alo, count(*) AS nt FROM mcalls GROUP BY model) a ON a.model = r.model
 LEFT JOIN (SELECT gpu_key, model, sum(CASE WHEN m.category <> 'conv' THEN calls*energy_j ELSE 0 END) AS es, sum(CASE WHEN m.category = 'conv' THEN calls*energy_j ELSE 0 END) AS eo,
  sum(CASE WHEN m.category <> 'conv' THEN calls*latency_s ELSE 0 END) AS ts, sum(CASE WHEN m.category = 'conv' THEN calls*latency_s ELSE 0 END) AS t_o,
  sum(CASE WHEN m.category <> 'conv' THEN calls ELSE 0 END) AS ns, sum(CASE WHEN m.category = 'conv' THEN calls ELSE 0 END) AS no, count(*) AS nm
  FROM mcalls m JOIN reliable d ON d.kernel_sig = m.kernel_sig GROUP BY gpu_key, model) s ON s.gpu_key = r.gpu_key AND s.model = r.model"""


CTES["mcalls"] = "SELECT c.kernel_sig, r.model, k.category, sum(c.calls) AS calls FROM calls c JOIN runs r ON r.run_id = c.run_id JOIN kernels k ON k.kernel_sig = c.kernel_sig GROUP BY ALL"
_RECON_DIGITS = dict(kernel_sum_energy_j=11, kernel_sum_latency_s=9, reconstructed_energy_j=11, energy_ratio=6, latency_ratio=7, catalogue_call_coverage=9)


@query("reconstruct_run", _recon_sql("r.latency_s"), **_RECON_DIGITS)
def _(t):
    return rec.reconstruct(t.e2e_runs, _model_calls(t), _reliable(t), "run")


@query("reconstruct_gap", _recon_sql("greatest(r.latency_s - r.device_time_s, 0)"), **_RECON_DIGITS)
def _(t):
    return rec.reconstruct(t.e2e_runs, _model_calls(t), _reliable(t), "gap")


# --- external family ------------------------------------------------------------------------------------------------


@query("operator_of", "SELECT CASE category WHEN 'attention' THEN 'attn' WHEN 'norm' THEN 'rmsnorm' WHEN 'elementwise' THEN 'siluandmul' ELSE 'gemm' END AS pw_operator, count(*) AS n FROM measurements GROUP BY 1")
def _(t):
    return t.measurements.select(labels.operator_of(F.col("category"), F.lit(None).cast("string")).alias("pw_operator")).groupBy("pw_operator").agg(F.count("*").alias("n"))


@query("lowering", """SELECT kernel_sig, CASE category WHEN 'gemm' THEN p_m WHEN 'conv' THEN (p_m//8)*(p_m//8) END AS low_m, CASE WHEN category IN ('gemm','conv') THEN p_n END AS low_n, CASE category WHEN 'gemm' THEN p_k WHEN 'conv' THEN p_k*9 END AS low_k,
 CASE category WHEN 'norm' THEN p_m WHEN 'elementwise' THEN CAST(ceil(p_m*p_n/1024) AS BIGINT) END AS low_seq, CASE category WHEN 'norm' THEN p_n WHEN 'elementwise' THEN 1024 END AS low_dim FROM kernels""")
def _(t):
    return ext.lowering(t.kernel_params).select("kernel_sig", "low_m", "low_n", "low_k", "low_seq", "low_dim")


@query("audit_notes", """SELECT notes, count(*) AS n FROM (SELECT CASE category WHEN 'gemm' THEN '' WHEN 'conv' THEN 'conv lowered to a matrix product; the external data has no convolutions'
 WHEN 'attention' THEN 'non-causal; the external data is causal throughout; one key head per query head; the external data mostly shares them' WHEN 'norm' THEN 'layer norm through an rms model; one reduction pass is not counted'
 ELSE 'element count factored by the launch shape' || CASE WHEN kind IN ('silu','gelu','gelu_tanh','swiglu') THEN '' ELSE '; ' || kind || ' is no gated activation; operation counts stand in' END END AS notes FROM kernels) GROUP BY notes""")
def _(t):
    return t.kernel_params.select(ext.audit_notes(t.kernel_params).alias("notes")).groupBy("notes").agg(F.count("*").alias("n"))


@query("attach_operator_features", "SELECT e.gpu_key, e.category, count(*) AS n, count(x.pw_operator) AS with_features, max(x.pw_global_cycle) AS top FROM (SELECT DISTINCT gpu_key, category, kernel_sig FROM measurements) e LEFT JOIN (SELECT gpu_key, 'k' || vec_id AS kernel_sig, pw_operator, pw_global_cycle FROM ext) x ON x.gpu_key = e.gpu_key AND x.kernel_sig = e.kernel_sig GROUP BY ALL", top=3)
def _(t):
    feats = t.external.drop("category").withColumn("kernel_sig", F.concat(F.lit("k"), F.col("vec_id").cast("string")))
    pairs = t.measurements.select("gpu_key", "category", "kernel_sig").distinct()
    return ext.attach_operator_features(pairs, feats).groupBy("gpu_key", "category").agg(
        F.count("*").alias("n"), F.count("pw_operator").alias("with_features"), F.max("pw_global_cycle").alias("top"))


_NEAR = """SELECT s.gpu_key, s.p_m AS m, s.p_n AS n, s.p_k AS k, b.tile_m, b.tile_n, b.tile_k, sqrt(b.d2) AS neighbour_distance, b.idx FROM shapes s JOIN LATERAL (
 SELECT * FROM (SELECT *, (rm - s.p_m)*(rm - s.p_m) + (rn - s.p_n)*(rn - s.p_n) + (rk - s.p_k)*(rk - s.p_k) AS d2 FROM tile_ref t WHERE t.hardware = s.hardware) ORDER BY d2, idx LIMIT 1) b ON true"""
CTES["shapes"] = """SELECT DISTINCT h.gpu_key, h.ext_arch, h.num_sms, p_m, p_n, p_k, CASE h.ext_arch WHEN 'ampere' THEN 'NVIDIA A100-SXM4-80GB' WHEN 'hopper' THEN 'NVIDIA H100' ELSE 'NVIDIA L40' END AS hardware FROM kernels CROSS JOIN ext_hw h WHERE category = 'gemm'"""
CTES["ranked_launch"] = """SELECT s.gpu_key, s.ext_arch, s.num_sms, s.p_m, s.p_n, s.p_k, t.tile_m, t.tile_n, t.tile_k, t.idx, sqrt((rm - s.p_m)*(rm - s.p_m) + (rn - s.p_n)*(rn - s.p_n) + (rk - s.p_k)*(rk - s.p_k)) AS d,
 row_number() OVER (PARTITION BY s.gpu_key, s.p_m, s.p_n, s.p_k ORDER BY (rm - s.p_m)*(rm - s.p_m) + (rn - s.p_n)*(rn - s.p_n) + (rk - s.p_k)*(rk - s.p_k), idx) AS rn FROM shapes s JOIN tile_ref t ON t.hardware = s.hardware"""


def _launch(t, mode):
    g = t.kernels.filter(F.col("category") == "gemm").select("m", "n", "k").distinct()
    return ext.nearest_launch(planning.planned_pairs(g, FLEET_KEYS), t.tile_reference, mode=mode)


@query("nearest_launch", """SELECT gpu_key, p_m AS m, p_n AS n, p_k AS k, tile_m, tile_n, tile_k, CAST(CASE WHEN ext_arch = 'hopper' THEN greatest(1, least(tiles, num_sms)) ELSE greatest(1, tiles) END AS BIGINT) AS cta_count, ext_arch <> 'hopper' AS is_split_k,
 CASE WHEN ext_arch = 'hopper' THEN 'structural/hopper/' ELSE 'structural/tiled/' END || CASE WHEN gpu_key IN ('A100_SXM4','H100','L40') THEN 'exact' WHEN ext_arch = 'ampere' THEN 'arch:NVIDIA A100-SXM4-80GB' WHEN ext_arch = 'hopper' THEN 'arch:NVIDIA H100' ELSE 'arch:NVIDIA L40' END AS launch_source, d AS neighbour_distance
 FROM (SELECT *, CAST(ceil(p_m/tile_m)*ceil(p_n/tile_n) AS BIGINT) AS tiles FROM ranked_launch WHERE rn = 1)""", neighbour_distance=8)
def _(t):
    return _launch(t, "structural")


@query("nearest_launch_copied", """SELECT gpu_key, p_m AS m, p_n AS n, p_k AS k, tile_m, tile_n, CAST(1 + idx % 200 AS BIGINT) AS cta_count, idx % 2 = 1 AS is_split_k FROM ranked_launch WHERE rn = 1""")
def _(t):
    return _launch(t, "upstream").select("gpu_key", "m", "n", "k", "tile_m", "tile_n", "cta_count", "is_split_k")


@query("prepare_external", "SELECT vec_id, theory_pw_s*1e6 AS theory_us, theory_pw_s/latency_s AS eta_pw FROM cyc", theory_us=8, eta_pw=8)
def _(t):
    return ext.prepare(t.external).select("vec_id", (F.col("theory_pw_s") * 1e6).alias("theory_us"), "eta_pw")


@query("compare_floors", """SELECT gpu_key, category, count(*) AS n, median(theory_pw_s/theoretical_time_s) AS ratio_median, quantile_cont(theory_pw_s/theoretical_time_s, 0.1) AS ratio_p10, quantile_cont(theory_pw_s/theoretical_time_s, 0.9) AS ratio_p90,
 avg(CASE WHEN eta > 1 THEN 1e0 ELSE 0e0 END) AS eta_ours_over_1, avg(CASE WHEN theory_pw_s/latency_s > 1 THEN 1e0 ELSE 0e0 END) AS eta_pw_over_1 FROM cyc GROUP BY ALL""", ratio_median=8, ratio_p10=8, ratio_p90=8, eta_ours_over_1=9, eta_pw_over_1=9)
def _(t):
    return ext.compare_floors(ext.prepare(t.external))


_RANGE = """SELECT t.operator, t.feature, count(*) AS n, avg(CASE WHEN x < mean - std THEN 1e0 ELSE 0e0 END) AS frac_below_min, avg(CASE WHEN x > mean + std THEN 1e0 ELSE 0e0 END) AS frac_above_max,
 (median(x) - any_value(mean))/greatest(any_value(std), 1e-30) AS median_z FROM ext_tall t JOIN fmom m ON m.operator = t.operator AND m.feature = t.feature GROUP BY t.operator, t.feature"""


@query("range_report", _RANGE, frac_below_min=9, frac_above_max=9, median_z=8)
def _(t):
    return ext.range_report(t.external, t.ranges)


@query("worst_ranges", f"SELECT *, frac_below_min + frac_above_max AS out_of_range FROM ({_RANGE}) ORDER BY out_of_range DESC, operator, feature LIMIT 12", frac_below_min=9, frac_above_max=9, median_z=8, out_of_range=9)
def _(t):
    report = ext.range_report(t.external, t.ranges)
    return ext.worst_ranges(report)


@query("mahalanobis", "SELECT vec_id, md FROM dist", md=8)
def _(t):
    return ood.with_distance(t.external, t.moments).select("vec_id", "md")


@query("ood_report", "SELECT operator, gpu_key, count(*) AS n, median(md) AS md_median, quantile_cont(md, 0.95) AS md_p95, 4.0e0 AS train_p99, avg(CASE WHEN md > 4 THEN 1e0 ELSE 0e0 END) AS frac_beyond_train_p99 FROM dist GROUP BY ALL", md_median=8, md_p95=8, frac_beyond_train_p99=9)
def _(t):
    return ood.ood_report(t.external, t.moments)


@query("hybrid_selection", "SELECT operator, count(*) AS n, count(*) FILTER (saturated) AS n_saturated, sum(energy_hybrid) AS total FROM tp GROUP BY operator", total=6)
def _(t):
    return ext.with_hybrid(t.transfer_preds).groupBy("operator").agg(F.count("*").alias("n"), F.count_if("saturated").alias("n_saturated"), F.sum("energy_hybrid").alias("total"))


_TT = "count(*) AS n_test, avg(zs) AS zeroshot, avg(ft) AS finetuned, avg(sc) AS scratch, avg(hy) AS hybrid, avg(CAST(saturated AS DOUBLE)) AS sat, avg(CAST(below_train AS DOUBLE)) AS oob, median(ft) AS ft_med, median(ez) AS eta_zs, median(ef) AS eta_ft, median(pf) AS pi_ft"
_TT_DIGITS = {c: 7 for c in ("zeroshot", "finetuned", "scratch", "hybrid", "sat", "oob", "ft_med", "eta_zs", "eta_ft", "pi_ft")}
_TT_SQL = f"SELECT gpu_key AS gpu, operator, {_TT} FROM te GROUP BY ALL UNION ALL SELECT 'POOLED', '-', {_TT} FROM te"


@query("transfer_table", _TT_SQL, **_TT_DIGITS)
def _(t):
    return ext.transfer_table(ext.with_hybrid(t.transfer_preds))


@query("transfer_cells", "SELECT operator, gpu_key, n_test, CAST(sum(n_test) OVER (PARTITION BY operator) - n_test AS BIGINT) AS n_train, CASE WHEN n_test < 1000 THEN 'too few rows' ELSE 'evaluated' END AS status FROM (SELECT operator, gpu_key, count(*) AS n_test FROM tp GROUP BY ALL)")
def _(t):
    return ext.transfer_cells(t.transfer_preds, min_test=1000)


@query("transfer_verdict", f"""SELECT zeroshot, finetuned, CASE WHEN finetuned > zeroshot*1.05 THEN 'damaging' WHEN finetuned < zeroshot*0.95 THEN 'helped' ELSE 'no change' END AS finetuning, hybrid < least(zeroshot, finetuned)*0.95 AS hybrid_best,
 CASE WHEN scratch < least(zeroshot, finetuned, hybrid)*0.95 THEN 'liability' WHEN least(zeroshot, finetuned, hybrid) < scratch*0.85 THEN 'working' ELSE 'unclear' END AS pretraining FROM (SELECT {_TT} FROM te)""", zeroshot=7, finetuned=7)
def _(t):
    table = ext.transfer_table(ext.with_hybrid(t.transfer_preds)).filter(F.col("operator") == "-")
    v = labels.transfer_verdict(*[F.col(c) for c in ("zeroshot", "finetuned", "scratch", "hybrid")])
    return table.select("zeroshot", "finetuned", *[c.alias(k) for k, c in v.items()])


@query("ape_mean_median", "SELECT gpu_key, avg(ft) AS mean_ape, median(ft) AS median_ape, avg(abs(energy_finetuned - energy_true)/greatest(abs(energy_true), 1e-8)*100) AS mape FROM te GROUP BY gpu_key", mean_ape=7, median_ape=7, mape=7)
def _(t):
    from jouleframe.operators.quantiles import group_quantiles, median

    true, pred = F.col("energy_true"), F.col("energy_finetuned")
    return group_quantiles(t.transfer_preds, ["gpu_key"], [median("median_ape", metrics.ape(true, pred))],
                           [F.avg(metrics.ape(true, pred)).alias("mean_ape"), metrics.mape(true, pred).alias("mape")])


@query("report_table", """SELECT coalesce(g, 'POOLED') AS "group", count(*) AS n_test, avg(e) AS energy, avg(h) AS eta FROM (SELECT gpu_key AS g, abs(energy_finetuned - energy_true)/greatest(abs(energy_true), 1e-8)*100 AS e, abs(eta_finetuned - eta_true)/greatest(abs(eta_true), 1e-8)*100 AS h FROM tp) GROUP BY ROLLUP (g)
 UNION ALL SELECT 'MEAN', CAST(sum(n) AS BIGINT), avg(e), avg(h) FROM (SELECT gpu_key, count(*) AS n, avg(abs(energy_finetuned - energy_true)/greatest(abs(energy_true), 1e-8)*100) AS e, avg(abs(eta_finetuned - eta_true)/greatest(abs(eta_true), 1e-8)*100) AS h FROM tp GROUP BY gpu_key)""", energy=7, eta=7)
def _(t):
    return folds.report_table(t.transfer_preds.select(
        F.col("gpu_key").alias("group"), "energy_true", F.col("energy_finetuned").alias("energy_pred"), "eta_true", F.col("eta_finetuned").alias("eta_pred")))


# --- seeds ---------------------------------------------------------------------------------------------------------------


@query("seed_summary", "SELECT arm, gpu, operator, min(n_test) AS n_test, count(DISTINCT seed) AS seeds, median(finetuned) AS finetuned, (max(finetuned) - min(finetuned))/2 AS finetuned_pm, median(hybrid) AS hybrid, (max(hybrid) - min(hybrid))/2 AS hybrid_pm FROM seed_runs GROUP BY ALL",
       finetuned=7, finetuned_pm=7, hybrid=7, hybrid_pm=7)
def _(t):
    a, b = (seeds.seed_summary(t.seed_runs.filter(F.col("arm") == arm)).withColumn("arm", F.lit(arm)) for arm in ("a", "b"))
    return a.unionByName(b)


_P = "(list_sum([factorial(CAST(n AS INTEGER))/(factorial(CAST(k AS INTEGER))*factorial(CAST(n - k AS INTEGER))) for k in range(w, n + 1)])/power(2, n))"


def _arms(t):
    runs = t.seed_runs
    return seeds.pair_arms(runs.filter(F.col("arm") == "a"), runs.filter(F.col("arm") == "b"))


@query("paired_compare", f"""SELECT gpu, operator, a, b, delta, n_test, n AS seeds, w AS b_wins, CAST({_P} AS DOUBLE) AS p_sign FROM (SELECT gpu, operator, median(a) AS a, median(b) AS b, median(delta) AS delta, min(n_test) AS n_test, count(DISTINCT seed) AS n, count(*) FILTER (delta < 0) AS w FROM pairs WHERE operator <> '-' GROUP BY ALL)""",
       a=7, b=7, delta=7, p_sign=9)
def _(t):
    return seeds.per_cell(_arms(t))


@query("pooled_verdict", f"""SELECT *, CASE WHEN b_wins = seeds AND seeds >= 5 THEN 'unanimous' WHEN p_sign > 0.2 THEN 'not separable' ELSE 'leaning' END AS reading FROM (SELECT n AS seeds, a_min, a_max, b_min, b_max, w AS b_wins, a_median, b_median, delta_median, CAST({_P} AS DOUBLE) AS p_sign FROM (
 SELECT count(*) AS n, min(a) AS a_min, max(a) AS a_max, min(b) AS b_min, max(b) AS b_max, count(*) FILTER (delta < 0) AS w, median(a) AS a_median, median(b) AS b_median, median(delta) AS delta_median FROM pairs WHERE operator = '-'))""",
       a_min=7, a_max=7, b_min=7, b_max=7, a_median=7, b_median=7, delta_median=7, p_sign=9)
def _(t):
    return seeds.pooled_verdict(_arms(t))


@query("sign_test", f"SELECT n, w, CAST({_P} AS DOUBLE) AS p, cnt FROM (SELECT CAST(1 + l_linenumber AS BIGINT) AS n, CAST(least(l_quantity % 8, 1 + l_linenumber) AS BIGINT) AS w, count(*) AS cnt FROM lineitem GROUP BY ALL)", p=9)
def _(t):
    n = (1 + F.col("l_linenumber")).cast("bigint")
    w = F.least((F.col("l_quantity") % 8), n.cast("double")).cast("bigint")
    counts = t.raw("lineitem").groupBy(n.alias("n"), w.alias("w")).agg(F.count("*").alias("cnt"))
    return counts.withColumn("p", metrics.sign_test_p(F.col("w"), F.col("n")))


files.register(query)
