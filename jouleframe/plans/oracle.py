"""Independent SQL for the registered queries, over the same base tables.

``sql(body)`` prepends the named sub-queries the body refers to. Doubles that come from
sums or logarithms are rounded on both sides, since engines add in different orders.
"""

from __future__ import annotations

import re

# Fixed values, written out so that a wrong constant of the engine shows as a difference.
_HW_ROWS = """(0,'L4','NVIDIA L4','Ada',8.9e0,60,1024,128,16,1969e0,2040e0,300e0,2430e0,48e0,128,100e0,72e0,15e0,0),
 (1,'L40S','NVIDIA L40S','Ada',8.9e0,142,1024,128,16,2490e0,2520e0,864e0,2430e0,96e0,128,100e0,350e0,32e0,0),
 (2,'L40','NVIDIA L40','Ada',8.9e0,142,512,128,16,2490e0,2490e0,864e0,2430e0,96e0,128,100e0,300e0,30e0,0),
 (3,'A100_PCIE','NVIDIA A100 80GB PCIe','Ampere',8.0e0,108,2048,64,16,1411e0,1410e0,1935e0,5120e0,40e0,128,164e0,300e0,40e0,1),
 (4,'A100_SXM4','NVIDIA A100-SXM4-80GB','Ampere',8.0e0,108,2048,64,16,1411e0,1410e0,2039e0,5120e0,40e0,128,164e0,400e0,52e0,1),
 (5,'H100','NVIDIA H100 SXM5 80GB','Hopper',9.0e0,132,4096,128,16,1830e0,1980e0,3352e0,8000e0,50e0,128,228e0,700e0,72e0,1),
 (6,'H200_NVL','NVIDIA H200 NVL','Hopper',9.0e0,132,4096,128,16,1545e0,1785e0,4800e0,8000e0,50e0,128,228e0,600e0,68e0,1),
 (7,'H200_SXM','NVIDIA H200','Hopper',9.0e0,132,4096,128,16,1830e0,1980e0,4800e0,8000e0,50e0,128,228e0,700e0,75e0,1)"""
_EXT_ROWS = """('A100_SXM4','NVIDIA A100-SXM4-80GB','ampere',108,1410e0),
 ('H100','NVIDIA H100','hopper',132,1830e0),
 ('H200_SXM','NVIDIA H200','hopper',132,1830e0),
 ('L40','NVIDIA L40','ada',142,2490e0),
 ('A100_PCIE','NVIDIA A100-PCIE-80GB','ampere',108,1410e0),
 ('L40S','NVIDIA L40S','ada',142,2520e0),
 ('L4','NVIDIA L4','ada',58,2040e0),
 ('H200_NVL','NVIDIA H200 NVL','hopper',132,1830e0)"""
_KIND_CASE = ("WHEN 'STANDARD' THEN 'add' WHEN 'ECONOMY' THEN 'mul' WHEN 'MEDIUM' THEN 'gelu' "
              "WHEN 'PROMO' THEN 'silu' WHEN 'SMALL' THEN 'scale_shift' WHEN 'LARGE' THEN 'swiglu'")
_MEMORY = "global_in_flight global_cycle local_cycle sm_max_in_flight sm_max_global_cycle sm_max_shared_cycle sm_max_local_cycle".split()
_TENSOR = "tensor_all_ops tensor_all_cycle tensor_sm_max_ops tensor_sm_max_cycle".split()
_XU = "xu_all_ops xu_all_cycle xu_sm_max_ops xu_sm_max_cycle".split()
_FMA = "fma_all_ops fma_all_cycle fma_sm_max_ops fma_sm_max_cycle".split()
_VECTORS = {"gemm": _TENSOR + _MEMORY, "attn": _TENSOR + _XU + _MEMORY, "rmsnorm": _FMA + _XU + _MEMORY, "siluandmul": _FMA + _XU + _MEMORY}
_FEATURES = _TENSOR + _MEMORY + _XU + _FMA


def _feature_case(f: str) -> str:
    whens = " ".join(f"WHEN pw_operator='{op}' THEN abs(CAST(embedding[{names.index(f) + 1}] AS DOUBLE))*1e6" for op, names in _VECTORS.items() if f in names)
    return f"CASE {whens} END AS pw_{f}"


CTES = {
    "hw": f"""SELECT * FROM (VALUES
 {_HW_ROWS}) AS t(gpu_idx,gpu_key,hw_name,architecture,compute_capability,sms,ops_per_clk,fma_per_clk,xu_per_clk,tensor_clock_mhz,boost_clock_mhz,mem_bandwidth_gbs,l2_bandwidth_gbs,l2_cache_mb,smem_b_per_clk_sm,smem_size_kb_sm,hw_tdp_w,hw_idle_w,is_hbm)""",
    "ext_hw": f"""SELECT * FROM (VALUES
 {_EXT_ROWS}) AS t(gpu_key,ext_name,ext_arch,num_sms,sm_freq)""",
    "kernels": f"""SELECT 'k' || p_partkey AS kernel_sig,
 CASE p_partkey % 5 WHEN 0 THEN 'gemm' WHEN 1 THEN 'attention' WHEN 2 THEN 'conv' WHEN 3 THEN 'norm' ELSE 'elementwise' END AS category,
 CASE WHEN p_size % 3 = 0 THEN 'fp32' ELSE 'bf16' END AS dtype,
 CAST(64 * p_size AS BIGINT) AS p_m, CAST(128 * (1 + p_partkey % 32) AS BIGINT) AS p_n, CAST(64 * (1 + p_partkey % 48) AS BIGINT) AS p_k,
 CASE p_type {_KIND_CASE} END AS kind, p_partkey FROM part""",
    "measurements": """SELECT 'k' || l_partkey AS kernel_sig, h.gpu_key, k.category,
 CASE l_returnflag WHEN 'A' THEN 'flux1-dev' WHEN 'N' THEN 'qwen-image' ELSE 'sd35-large' END AS source_model,
 l_quantity * CAST(1e-6 AS DOUBLE) AS latency_s, l_extendedprice * CAST(1e-8 AS DOUBLE) AS energy_j,
 CASE WHEN l_tax = 0 THEN NULL ELSE l_discount END AS energy_sd_rel,
 CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS contended, 1 + l_linenumber % 4 AS n_buffers,
 CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE h.hw_tdp_w * CAST(0.9 AS DOUBLE) END AS power_limit_w, h.hw_tdp_w AS power_limit_default_w,
 h.hw_tdp_w AS tdp_w, h.hw_idle_w AS idle_power_w, l_shipdate AS ts,
 l_discount * 10 AS frac_sw_power_cap, l_tax * 10 AS frac_sw_thermal, 1000e0 + 100e0 * l_linenumber AS sm_clock_median_mhz,
 1e0 + l_discount - l_tax AS energy_check_ratio, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity
 FROM lineitem JOIN hw h ON l_suppkey % 8 = h.gpu_idx JOIN kernels k ON k.p_partkey = l_partkey""",
    "merged": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY kernel_sig, gpu_key
 ORDER BY contended, ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM measurements) WHERE rn = 1""",
    "reliable": "SELECT * FROM merged WHERE coalesce(energy_sd_rel, 0) <= 0.05 AND latency_s > 5e-6",
    # Per-task demand of every (kernel, card), one formula set per category.
    "kp": """SELECT kernel_sig, category, dtype, kind, CASE WHEN dtype = 'fp32' THEN 4e0 ELSE 2e0 END AS w,
 CAST(p_m AS DOUBLE) AS pm, CAST(p_n AS DOUBLE) AS pn, CAST(p_k AS DOUBLE) AS pk,
 CASE kind WHEN 'gelu' THEN 6e0 WHEN 'silu' THEN 2e0 WHEN 'swiglu' THEN 3e0 WHEN 'scale_shift' THEN 2e0 ELSE 1e0 END AS ef,
 CASE WHEN kind IN ('gelu','silu','swiglu') THEN 1e0 ELSE 0e0 END AS ex,
 CASE WHEN kind IN ('gelu','silu') THEN 1e0 WHEN kind = 'scale_shift' THEN 3e0 ELSE 2e0 END AS et FROM kernels""",
    "shape": """SELECT kp.*, h.*, CASE category WHEN 'gemm' THEN pm WHEN 'conv' THEN (pm/8)*(pm/8) END AS gm,
 CASE WHEN category IN ('gemm','conv') THEN pn END AS gn, CASE category WHEN 'gemm' THEN pk WHEN 'conv' THEN pk*9 END AS gk
 FROM kp CROSS JOIN hw h""",
    "tiled": """SELECT *, CASE
 WHEN ceil(gm/256)*ceil(gn/128) >= 2*sms THEN 256e0 WHEN ceil(gm/128)*ceil(gn/256) >= 2*sms THEN 128e0 WHEN ceil(gm/128)*ceil(gn/128) >= 2*sms THEN 128e0
 WHEN ceil(gm/128)*ceil(gn/64) >= 2*sms THEN 128e0 WHEN ceil(gm/64)*ceil(gn/128) >= 2*sms THEN 64e0 WHEN ceil(gm/64)*ceil(gn/64) >= 2*sms THEN 64e0 ELSE 32e0 END AS tm,
 CASE WHEN ceil(gm/256)*ceil(gn/128) >= 2*sms THEN 128e0 WHEN ceil(gm/128)*ceil(gn/256) >= 2*sms THEN 256e0 WHEN ceil(gm/128)*ceil(gn/128) >= 2*sms THEN 128e0
 WHEN ceil(gm/128)*ceil(gn/64) >= 2*sms THEN 64e0 WHEN ceil(gm/64)*ceil(gn/128) >= 2*sms THEN 128e0 WHEN ceil(gm/64)*ceil(gn/64) >= 2*sms THEN 64e0 ELSE 32e0 END AS tn FROM shape""",
    "task": """SELECT *, CASE WHEN category IN ('gemm','conv') THEN ceil(gm/tm)*ceil(gn/tn) WHEN category = 'attention' THEN 8*ceil(pm/128)
  WHEN category = 'norm' THEN pm ELSE greatest(ceil(pm*pn/1024), 1e0) END AS cnt FROM tiled""",
    "demand": """SELECT *, ceil(cnt/sms) AS top,
 CASE category WHEN 'attention' THEN 4*128*pm*64 WHEN 'norm' THEN 0e0 WHEN 'elementwise' THEN 0e0 ELSE 2*tm*tn*gk END AS mma,
 CASE category WHEN 'attention' THEN 3*128*pm + 2*128*64 WHEN 'norm' THEN 4*pn WHEN 'elementwise' THEN ef*least(1024e0, pm*pn) ELSE tm*tn END AS fma,
 CASE category WHEN 'attention' THEN 128*pm WHEN 'norm' THEN 1e0 WHEN 'elementwise' THEN ex*least(1024e0, pm*pn) ELSE 0e0 END AS xu,
 CASE category WHEN 'gemm' THEN ((pm*pk + pk*pn)*w + pm*pn*4)/cnt WHEN 'conv' THEN (pk*gm*w + pn*gm*4 + pn*pk*9*w)/cnt
  WHEN 'attention' THEN 2*128*64*w + 2*8*pm*64*w/cnt WHEN 'norm' THEN 2*pn*w ELSE et*least(1024e0, pm*pn)*w END AS hbm,
 CASE category WHEN 'gemm' THEN (tm*gk + gk*tn)*w + tm*tn*4 + tn*w WHEN 'conv' THEN ((tm*gk + gk*tn)*w + tm*tn*4)*9
  WHEN 'attention' THEN 2*128*64*w + 2*pm*64*w WHEN 'norm' THEN 4*pn*w ELSE et*least(1024e0, pm*pn)*w END AS l2,
 CASE category WHEN 'attention' THEN 2*pm*64*w + 128*64*w WHEN 'norm' THEN pn*4 WHEN 'elementwise' THEN 0e0 ELSE (tm*gk + gk*tn)*w END AS smem,
 CASE category WHEN 'gemm' THEN 2*pm*pn*pk + pm*pn WHEN 'conv' THEN 2*gm*gn*gk + pn*gm WHEN 'attention' THEN 4*8*pm*pm*64
  WHEN 'norm' THEN pm*pn*4 ELSE pm*pn*(ef+ex) END AS flops FROM task""",
    "load": """SELECT *, mma*cnt AS t_mma, mma*top AS x_mma, fma*cnt AS t_fma, fma*top AS x_fma, xu*cnt AS t_xu, xu*top AS x_xu,
 hbm*cnt AS t_hbm, hbm*top AS x_hbm, l2*cnt AS t_l2, l2*top AS x_l2, smem*cnt AS t_smem, smem*top AS x_smem,
 tensor_clock_mhz*1e6 AS clk_t, boost_clock_mhz*1e6 AS clk_b,
 CASE category WHEN 'norm' THEN 8e0 WHEN 'elementwise' THEN 16e0 ELSE 2e0 END AS ctas,
 CASE WHEN architecture = 'Hopper' AND category IN ('gemm','attention') THEN 1e0 ELSE 0e0 END AS persistent FROM demand""",
    "math": """SELECT *, x_mma/ops_per_clk/clk_t AS s_tensor, x_fma/fma_per_clk/clk_t AS s_fma, x_xu/xu_per_clk/clk_t AS s_xu,
 x_mma/ops_per_clk/clk_b AS b_tensor, x_fma/fma_per_clk/clk_b AS b_fma, x_xu/xu_per_clk/clk_b AS b_xu FROM load""",
    "ds0": """SELECT r.*, m.dtype, m.t_hbm, m.flops, s_tensor, s_fma, s_xu, b_tensor, b_fma, b_xu, mem_bandwidth_gbs, l2_cache_mb,
 t_hbm * r.n_buffers / (l2_cache_mb*1048576e0) AS res FROM reliable r JOIN math m ON r.kernel_sig = m.kernel_sig AND r.gpu_key = m.gpu_key""",
    "ds1": "SELECT *, CASE WHEN res > 1 THEN t_hbm*(1 - 1/res)/(mem_bandwidth_gbs*1e9) ELSE 0e0 END AS s_miss FROM ds0",
    "ds": """SELECT *, greatest(s_tensor, s_fma, s_xu, s_miss, 1e-30) AS theory, greatest(b_tensor, b_fma, b_xu, s_miss, 1e-30) AS theory_boost,
 greatest(s_tensor, s_fma, s_xu, s_miss, 1e-30)/latency_s AS eta, energy_j/latency_s AS power_avg_w, energy_j/latency_s/tdp_w AS pi FROM ds1""",
    "sigs": """SELECT *, CASE category
 WHEN 'gemm' THEN '"k": ' || p_k || ', "m": ' || p_m || ', "n": ' || p_n
 WHEN 'attention' THEN '"b": 1, "d": 64, "h": 8, "s_kv": ' || p_m || ', "s_q": ' || p_m
 WHEN 'conv' THEN '"c_in": ' || p_k || ', "c_out": ' || p_n || ', "h": ' || (p_m // 8) || ', "kh": 3, "kw": 3, "n": 1, "w": ' || (p_m // 8)
 WHEN 'norm' THEN '"dim": ' || p_n || ', "rows": ' || p_m
 ELSE '"kind": "' || kind || '", "n_elem": ' || (p_m * p_n) END AS ptext FROM kernels""",
    "signed": """SELECT *, substr(sha1('{"category": "' || category || '", "dtype": "' || dtype || '", "params": {' || ptext || '}}'), 1, 16) AS sig FROM sigs""",
    "per_model": """SELECT sig, category, dtype, p_m, p_n, p_k, kind, source_model AS model, sum(CAST(l_quantity AS BIGINT)) AS calls
 FROM measurements JOIN (SELECT kernel_sig, sig, dtype, p_m, p_n, p_k, kind FROM signed) USING (kernel_sig) GROUP BY ALL""",
    "captured": """SELECT sig, any_value(category) AS category, any_value(dtype) AS dtype, model, sum(calls) AS calls,
 any_value(CASE category WHEN 'gemm' THEN (p_m*p_k + p_k*p_n)*w + p_m*p_n*w WHEN 'attention' THEN 4*8*p_m*64*w
  WHEN 'conv' THEN p_k*(p_m//8)*(p_m//8)*w + p_n*(p_m//8)*(p_m//8)*w + p_n*p_k*9*w WHEN 'norm' THEN 2*p_m*p_n*w
  ELSE p_m*p_n*w*(CASE WHEN kind IN ('gelu','silu') THEN 1 WHEN kind = 'scale_shift' THEN 3 ELSE 2 END) END) AS ws
 FROM (SELECT *, CASE WHEN dtype = 'fp32' THEN 4 ELSE 2 END AS w FROM per_model) GROUP BY sig, model""",
    "first_norm": "SELECT p_m*p_n AS n_elem, dtype, min(sig) AS sig FROM per_model WHERE category = 'norm' GROUP BY 1, 2",
    "made": """SELECT substr(sha1('{"category": "elementwise", "dtype": "' || dtype || '", "params": {"kind": "' || knd || '", "n_elem": ' || n_elem || '}}'), 1, 16) AS sig,
 'elementwise' AS category, dtype, model, calls*2 AS calls,
 n_elem*(CASE WHEN dtype = 'fp32' THEN 4 ELSE 2 END)*(CASE WHEN knd = 'add' THEN 2 ELSE 3 END) AS ws, 'synth::' || knd AS op_name
 FROM (SELECT DISTINCT f.n_elem, f.dtype, p.model, p.calls FROM first_norm f JOIN (SELECT sig, model, sum(calls) AS calls FROM per_model GROUP BY ALL) p ON p.sig = f.sig)
 CROSS JOIN (VALUES ('scale_shift'), ('gate_residual'), ('add')) k(knd)""",
    "all_made": "SELECT *, '' AS op_name FROM captured UNION ALL SELECT * FROM made",
    "cat_model": "SELECT sig, any_value(category) AS category, any_value(dtype) AS dtype, model, sum(calls) AS calls, any_value(ws) AS ws, min(op_name) AS op_name FROM all_made GROUP BY sig, model",
    "catalogue": """SELECT sig AS kernel_sig, any_value(category) AS category, any_value(dtype) AS dtype, string_agg(model, '|' ORDER BY model) AS source_model,
 min(op_name) AS op_name, CAST(count(*) AS BIGINT) AS n_models, CAST(sum(calls) AS BIGINT) AS calls_total, any_value(ws) AS ws,
 CAST(sum(calls) FILTER (model = 'flux1-dev') AS BIGINT) AS "calls_flux1-dev", CAST(sum(calls) FILTER (model = 'qwen-image') AS BIGINT) AS "calls_qwen-image",
 CAST(sum(calls) FILTER (model = 'sd35-large') AS BIGINT) AS "calls_sd35-large" FROM cat_model GROUP BY sig""",
    "telemetry": """SELECT h.gpu_key, event_id, ts, date_trunc('hour', ts) AS hour, CAST(value AS DOUBLE) AS power_w, CAST(event_id % 512 AS BIGINT) AS throttle,
 CAST(1000 + event_id % 900 AS DOUBLE) AS sm_clock, CAST(500 + event_id % 70 AS DOUBLE) AS mem_clock, CAST(40 + user_id % 40 AS DOUBLE) AS temp,
 CAST(event_id % 101 AS DOUBLE) AS util_gpu, CAST(event_id % 53 AS DOUBLE) AS util_mem, event_id*250 AS counter_mj, epoch_us(ts) AS us
 FROM events JOIN hw h ON user_id % 8 = h.gpu_idx""",
    "prof0": """SELECT CASE p_partkey % 11 WHEN 0 THEN 'flash_fwd_kernel' WHEN 1 THEN 'cudnn::implicit_gemm' WHEN 2 THEN 'RowwiseMomentsCUDAKernel' WHEN 3 THEN 'sm80_xmma_gemm_bf16'
 WHEN 4 THEN 'vectorized_elementwise_kernel' WHEN 5 THEN 'CatArrayBatchedCopy' WHEN 6 THEN 'softmax_warp_forward' WHEN 7 THEN 'reduce_kernel<512, MeanOps>'
 WHEN 8 THEN 'Memcpy DtoD' WHEN 9 THEN 'aten::addmm' ELSE 'triton_custom' END AS kernel,
 CASE p_partkey % 11 WHEN 0 THEN 'attention' WHEN 1 THEN 'conv' WHEN 2 THEN 'norm' WHEN 3 THEN 'gemm' WHEN 4 THEN 'elementwise' WHEN 5 THEN 'elementwise'
 WHEN 6 THEN 'softmax' WHEN 7 THEN 'norm' WHEN 8 THEN 'memory' WHEN 9 THEN 'host' ELSE 'other' END AS category,
 CAST(1 + p_partkey % 100 AS BIGINT) AS calls, p_retailprice * p_size AS cuda_time_us, p_brand AS run_id FROM part""",
    "prof": "SELECT run_id, kernel, category, sum(calls) AS calls, sum(cuda_time_us) AS cuda_time_us FROM prof0 WHERE category <> 'host' AND cuda_time_us > 0 GROUP BY ALL",
    "runs": """SELECT o_orderkey AS run_id, h.gpu_key, o_orderpriority AS model, CAST(1 + o_orderkey % 28 AS BIGINT) AS steps, o_totalprice * CAST(1e-6 AS DOUBLE) AS energy_j,
 CAST(1 + o_custkey % 7 AS DOUBLE) * CAST(1e-3 AS DOUBLE) AS latency_s, CAST(1 + o_custkey % 9 AS DOUBLE) * CAST(0.9e-3 AS DOUBLE) AS device_time_s, h.hw_idle_w AS idle_power_w
 FROM orders JOIN hw h ON o_custkey % 8 = h.gpu_idx""",
    "calls": "SELECT l_orderkey AS run_id, 'k' || l_partkey AS kernel_sig, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS calls FROM lineitem GROUP BY ALL",
    "preds": "SELECT gpu_key, kernel_sig, energy_j*1.1e0 AS energy_pred, latency_s*0.9e0 AS latency_pred FROM reliable WHERE category <> 'conv' AND gpu_key <> 'L4'",
    "sums": """SELECT c.run_id, coalesce(sum(d.energy_j*c.calls), 0) AS ea, coalesce(sum(d.latency_s*c.calls), 0) AS ta,
 coalesce(sum(CASE WHEN d.energy_j IS NOT NULL THEN c.calls END), 0) AS matched, coalesce(sum(CASE WHEN d.energy_j IS NULL THEN c.calls END), 0) AS missing,
 coalesce(sum(p.energy_pred*c.calls), 0) AS eb, coalesce(sum(p.latency_pred*c.calls), 0) AS tb, coalesce(sum(CASE WHEN p.energy_pred IS NOT NULL THEN c.calls END), 0) AS b_matched
 FROM calls c JOIN runs r ON r.run_id = c.run_id LEFT JOIN reliable d ON d.kernel_sig = c.kernel_sig AND d.gpu_key = r.gpu_key
 LEFT JOIN preds p ON p.kernel_sig = c.kernel_sig AND p.gpu_key = r.gpu_key GROUP BY c.run_id""",
    "rec0": """SELECT r.*, coalesce(ea, 0) AS ea, coalesce(ta, 0) AS ta, coalesce(matched, 0) AS matched, coalesce(missing, 0) AS missing,
 coalesce(eb, 0) AS eb, coalesce(tb, 0) AS tb, coalesce(b_matched, 0) AS b_matched, r.gpu_key <> 'L4' AS has_b,
 greatest(r.latency_s - r.device_time_s, 0e0) AS gap_s FROM runs r LEFT JOIN sums s ON s.run_id = r.run_id""",
    "rec": """SELECT run_id, gpu_key, model, steps, energy_j AS e2e_energy_j, latency_s AS e2e_latency_s, energy_j/latency_s AS e2e_power_w, device_time_s, gap_s,
 device_time_s/greatest(latency_s, 1e-12) AS busy_fraction, CAST(NULL AS DOUBLE) AS profiler_coverage, matched/greatest(matched + missing, 1) AS call_coverage,
 CAST(matched AS BIGINT) AS calls_matched, CAST(missing AS BIGINT) AS calls_missing, ea AS A_kernel_energy_j, idle_power_w*gap_s AS A_gap_energy_j,
 ea + idle_power_w*gap_s AS A_total_j, (ea + idle_power_w*gap_s)/greatest(energy_j, 1e-12) AS A_ratio, energy_j - (ea + idle_power_w*gap_s) AS A_residual_j,
 (energy_j - (ea + idle_power_w*gap_s))/greatest(energy_j, 1e-12) AS A_residual_frac, ta AS A_kernel_latency_s, ta/greatest(device_time_s, 1e-12) AS A_latency_ratio,
 CASE WHEN has_b THEN eb END AS B_kernel_energy_j, CASE WHEN has_b THEN eb + idle_power_w*gap_s END AS B_total_j,
 CASE WHEN has_b THEN (eb + idle_power_w*gap_s)/greatest(energy_j, 1e-12) END AS B_ratio,
 CASE WHEN has_b THEN (energy_j - (eb + idle_power_w*gap_s))/greatest(energy_j, 1e-12) END AS B_residual_frac,
 CASE WHEN has_b THEN b_matched/greatest(matched + missing, 1) END AS B_call_coverage, CASE WHEN has_b THEN tb END AS B_kernel_latency_s,
 CASE WHEN has_b THEN tb/greatest(device_time_s, 1e-12) END AS B_latency_ratio FROM rec0""",
    "cells": """SELECT h.gpu_key AS gpu, CASE l_linenumber % 4 WHEN 0 THEN 'gemm' WHEN 1 THEN 'attn' WHEN 2 THEN 'rmsnorm' ELSE 'siluandmul' END AS operator,
 CAST(l_orderkey % 5 AS BIGINT) AS seed, CASE WHEN l_linestatus = 'O' THEN 'a' ELSE 'b' END AS arm, avg(l_extendedprice)/1000 AS hybrid, avg(l_quantity) AS finetuned, count(*) AS n_test
 FROM lineitem JOIN hw h ON l_suppkey % 8 = h.gpu_idx GROUP BY 1, 2, 3, 4""",
    "seed_runs": """SELECT gpu, operator, seed, arm, hybrid, finetuned, n_test FROM cells UNION ALL
 SELECT 'POOLED', '-', seed, arm, avg(hybrid), avg(finetuned), CAST(sum(n_test) AS BIGINT) FROM cells GROUP BY seed, arm""",
    "pairs": """SELECT a.gpu, a.operator, a.seed, a.n_test, a.hybrid AS a, b.hybrid AS b, b.hybrid - a.hybrid AS delta
 FROM (SELECT * FROM seed_runs WHERE arm = 'a') a JOIN (SELECT * FROM seed_runs WHERE arm = 'b') b ON a.gpu = b.gpu AND a.operator = b.operator AND a.seed = b.seed""",
    "tp0": """SELECT gpu_key, CASE category WHEN 'attention' THEN 'attn' WHEN 'norm' THEN 'rmsnorm' WHEN 'elementwise' THEN 'siluandmul' ELSE 'gemm' END AS operator,
 energy_j AS energy_true, energy_j*(0.5e0 + 0.2e0*l_linenumber) AS energy_zeroshot, energy_j*(0.8e0 + 0.1e0*(l_orderkey % 5)) AS energy_finetuned,
 energy_j*(0.7e0 + 0.1e0*(l_suppkey % 7)) AS energy_scratch, 5e0*l_linenumber - 20e0 AS eta_logit, (1e0 + l_linenumber)/10e0 AS eta_true,
 (1e0 + l_linenumber)/10e0*(0.8e0 + 0.1e0*(l_orderkey % 3)) AS eta_zeroshot, (1e0 + l_linenumber)/10e0*(0.9e0 + 0.1e0*(l_orderkey % 2)) AS eta_finetuned,
 0.5e0 AS pi_true, 0.4e0 + 0.05e0*(l_orderkey % 4) AS pi_finetuned, l_quantity < 3 AS below_train FROM measurements""",
    "tp": "SELECT *, abs(eta_logit) > 12 AS saturated, CASE WHEN abs(eta_logit) > 12 THEN energy_scratch ELSE energy_finetuned END AS energy_hybrid FROM tp0",
    "te": """SELECT *, abs(energy_zeroshot - energy_true)/greatest(abs(energy_true), 1e-12)*100 AS zs, abs(energy_finetuned - energy_true)/greatest(abs(energy_true), 1e-12)*100 AS ft,
 abs(energy_scratch - energy_true)/greatest(abs(energy_true), 1e-12)*100 AS sc, abs(energy_hybrid - energy_true)/greatest(abs(energy_true), 1e-12)*100 AS hy,
 abs(eta_zeroshot - eta_true)/greatest(abs(eta_true), 1e-12)*100 AS ez, abs(eta_finetuned - eta_true)/greatest(abs(eta_true), 1e-12)*100 AS ef,
 abs(pi_finetuned - pi_true)/greatest(abs(pi_true), 1e-12)*100 AS pf FROM tp""",
    "ext0": """SELECT vec_id, embedding, CASE label % 4 WHEN 0 THEN 'gemm' WHEN 1 THEN 'attn' WHEN 2 THEN 'rmsnorm' ELSE 'siluandmul' END AS pw_operator,
 CASE label % 4 WHEN 0 THEN 'gemm' WHEN 1 THEN 'attention' WHEN 2 THEN 'norm' ELSE 'elementwise' END AS category, h.gpu_key,
 (1 + vec_id % 50)*CAST(1e-6 AS DOUBLE) AS latency_s, (1 + vec_id % 7)*CAST(1e-6 AS DOUBLE) AS theoretical_time_s, (1 + vec_id % 7)/(1 + vec_id % 50) AS eta
 FROM embeddings JOIN hw h ON vec_id % 8 = h.gpu_idx""",
    "ext": "SELECT *, " + ",\n ".join(_feature_case(f) for f in _FEATURES) + " FROM ext0",
    "ext_tall": " UNION ALL ".join(
        f"SELECT vec_id, gpu_key, pw_operator AS operator, '{f}' AS feature, pw_{f} AS x FROM ext WHERE pw_{f} IS NOT NULL" for f in _FEATURES),
    "fmom": "SELECT operator, feature, avg(x) AS mean, stddev_pop(x) AS std, avg(ln(1 + x)) AS mu, var_pop(ln(1 + x)) AS var FROM ext_tall GROUP BY ALL",
    "dist": """SELECT t.vec_id, any_value(t.gpu_key) AS gpu_key, any_value(t.operator) AS operator, sqrt(sum((ln(1 + x) - mu)*(ln(1 + x) - mu)/var)) AS md
 FROM ext_tall t JOIN fmom m ON m.operator = t.operator AND m.feature = t.feature GROUP BY t.vec_id""",
    "cyc": """SELECT e.*, CASE WHEN pw_operator IN ('gemm','attn') THEN pw_tensor_all_cycle ELSE pw_fma_all_cycle + pw_xu_all_cycle END/(sm_freq*1e6) AS theory_pw_s
 FROM ext e JOIN ext_hw x ON x.gpu_key = e.gpu_key""",
    "tile_ref": """SELECT CASE (p_partkey//5) % 3 WHEN 0 THEN 'NVIDIA A100-SXM4-80GB' WHEN 1 THEN 'NVIDIA H100' ELSE 'NVIDIA L40' END AS hardware,
 p_m AS rm, p_n AS rn, p_k AS rk, 64*(1 + p_partkey % 4) AS tile_m, 32*(1 + p_partkey % 8) AS tile_n, 64 AS tile_k, p_partkey AS idx FROM kernels WHERE category = 'gemm'""",
}


def _needs(text: str) -> set[str]:
    words = set(re.findall(r"\w+", text))
    return {n for n in CTES if n in words}


def sql(body: str) -> str:
    """Body with the sub-queries it needs, in definition order."""
    needed, frontier = set(), _needs(body)
    while frontier:
        needed |= frontier
        frontier = set().union(*(_needs(CTES[n]) - {n} for n in frontier)) - needed
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rounded(text: str, digits: dict[str, int]) -> str:
    if not digits:
        return text
    cols = ", ".join(f'round("{c}", {d}) AS "{c}"' for c, d in digits.items())
    return f"SELECT * REPLACE ({cols}) FROM ({text}) AS result"
