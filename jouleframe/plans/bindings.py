"""The engine's inputs, derived from the benchmark tables of a data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jouleframe.operators.dataset import build_dataset
from jouleframe.operators.external import ALL_FEATURES, OPERATOR_FEATURES, PREFIX
from jouleframe.operators.merge import merge_measurements
from jouleframe.sources.hardware import FLEET, FLEET_KEYS

MODELS = ["flux1-dev", "qwen-image", "sd35-large"]
KINDS = {"STANDARD": "add", "ECONOMY": "mul", "MEDIUM": "gelu", "PROMO": "silu", "SMALL": "scale_shift", "LARGE": "swiglu"}
LATER = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
EXTERNAL_OPERATORS = ["gemm", "attn", "rmsnorm", "siluandmul"]


def _nth(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def card_of(key: Column) -> Column:
    return _nth(FLEET_KEYS, F.pmod(key, F.lit(8)))


def _sig(key: Column) -> Column:
    return F.concat(F.lit("k"), key.cast("string"))


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def kernels(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "concat('k', p_partkey) AS kernel_sig",
            "CASE p_partkey % 5 WHEN 0 THEN 'gemm' WHEN 1 THEN 'attention' WHEN 2 THEN 'conv' WHEN 3 THEN 'norm' ELSE 'elementwise' END AS category",
            "IF(p_size % 3 = 0, 'fp32', 'bf16') AS dtype", "CAST(64 * p_size AS BIGINT) AS m", "128 * (1 + p_partkey % 32) AS n",
            "64 * (1 + p_partkey % 48) AS k", "p_type AS kind_label", "p_partkey AS partkey")

    @cached_property
    def kernel_params(self) -> DataFrame:
        """Kernels with the parameters of their category in ``p_*`` columns."""
        case = lambda **c: "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in c.items()) + " END"
        kinds = "CASE kind_label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
        params = {
            "m": case(gemm="m"), "n": case(gemm="n", conv="1L"), "k": case(gemm="k"), "b": case(attention="1L"),
            "h": case(attention="8L", conv="m div 8"), "s_q": case(attention="m"), "s_kv": case(attention="m"), "d": case(attention="64L"),
            "c_in": case(conv="k"), "c_out": case(conv="n"), "w": case(conv="m div 8"), "kh": case(conv="3L"), "kw": case(conv="3L"),
            "rows": case(norm="m"), "dim": case(norm="n"), "n_elem": case(elementwise="m * n"), "kind": case(elementwise=kinds)}
        return self.kernels.selectExpr("kernel_sig", "category", "dtype", "partkey", *[f"{v} AS p_{k}" for k, v in params.items()])

    @cached_property
    def measured(self) -> DataFrame:
        """Measurement rows straight from the fact table, without the kernel columns."""
        by_card = lambda field: "element_at(array(" + ", ".join(f"{float(r[field])}D" for r in FLEET) + "), CAST(l_suppkey % 8 + 1 AS INT))"
        cards = "element_at(array(" + ", ".join(f"'{k}'" for k in FLEET_KEYS) + "), CAST(l_suppkey % 8 + 1 AS INT))"
        staged = self.raw("lineitem").selectExpr("*", f"{cards} AS gpu_key", f"{by_card(20)} AS tdp_w", f"{by_card(21)} AS idle_power_w")
        return staged.selectExpr(
            "concat('k', l_partkey) AS kernel_sig", "l_partkey AS partkey", "gpu_key",
            f"CASE l_returnflag WHEN 'A' THEN '{MODELS[0]}' WHEN 'N' THEN '{MODELS[1]}' ELSE '{MODELS[2]}' END AS source_model",
            "l_quantity * 1e-6D AS latency_s", "l_extendedprice * 1e-8D AS energy_j", "IF(l_tax != 0, l_discount, NULL) AS energy_sd_rel",
            "IF(l_linestatus = 'O', 1, 0) AS contended", "1 + l_linenumber % 4 AS n_buffers",
            "IF(l_linenumber % 3 != 0, tdp_w * 0.9D, NULL) AS power_limit_w", "tdp_w AS power_limit_default_w", "tdp_w", "idle_power_w",
            "l_shipdate AS ts", "l_discount * 10 AS frac_sw_power_cap", "l_tax * 10 AS frac_sw_thermal",
            "1000D + 100D * l_linenumber AS sm_clock_median_mhz", "1D + l_discount - l_tax AS energy_check_ratio",
            "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")

    @cached_property
    def measurements(self) -> DataFrame:
        return self.measured.join(self.kernels.select("partkey", "category"), "partkey")

    @cached_property
    def merged(self) -> DataFrame:
        """One row per (kernel, card). Merging comes before the kernel join: narrower rows move."""
        return merge_measurements(self.measured, LATER)

    @cached_property
    def merged_kernels(self) -> DataFrame:
        return self.merged.join(self.kernel_params.drop("kernel_sig"), "partkey")

    def dataset(self, clock: str = "tensor") -> DataFrame:
        return build_dataset(self.merged_kernels, clock=clock)

    @cached_property
    def op_calls(self) -> DataFrame:
        li = self.measured.select("partkey", "source_model", F.col("l_quantity").cast("bigint").alias("count"))
        return li.join(self.kernel_params.drop("kernel_sig"), "partkey").drop("partkey")

    @cached_property
    def telemetry(self) -> DataFrame:
        ev = self.raw("events")
        return _telemetry(ev)

    @cached_property
    def profile_records(self) -> DataFrame:
        names = ["flash_fwd_kernel", "cudnn::implicit_gemm", "RowwiseMomentsCUDAKernel", "sm80_xmma_gemm_bf16", "vectorized_elementwise_kernel",
                 "CatArrayBatchedCopy", "softmax_warp_forward", "reduce_kernel<512, MeanOps>", "Memcpy DtoD", "aten::addmm", "triton_custom"]
        key = F.col("p_partkey")
        return self.raw("part").select(
            _nth(names, F.pmod(key, F.lit(11))).alias("kernel"), (1 + key % 100).cast("bigint").alias("calls"),
            (F.col("p_retailprice") * F.col("p_size")).alias("cuda_time_us"), F.col("p_brand").alias("run_id"))

    @cached_property
    def e2e_runs(self) -> DataFrame:
        idle = "element_at(array(" + ", ".join(f"{float(r[21])}D" for r in FLEET) + "), CAST(o_custkey % 8 + 1 AS INT))"
        cards = "element_at(array(" + ", ".join(f"'{k}'" for k in FLEET_KEYS) + "), CAST(o_custkey % 8 + 1 AS INT))"
        return self.raw("orders").selectExpr(
            "o_orderkey AS run_id", f"{cards} AS gpu_key", "o_orderpriority AS model", "1 + o_orderkey % 28 AS steps",
            "o_totalprice * 1e-6D AS energy_j", "CAST(1 + o_custkey % 7 AS DOUBLE) * 1e-3D AS latency_s",
            "CAST(1 + o_custkey % 9 AS DOUBLE) * 0.9e-3D AS device_time_s", f"{idle} AS idle_power_w")

    @cached_property
    def e2e_calls(self) -> DataFrame:
        # Dealt by run alone: the sums per kernel and the join with the runs then need no shuffle of their own.
        calls = self.raw("lineitem").select(
            F.col("l_orderkey").alias("run_id"), _sig(F.col("l_partkey")).alias("kernel_sig"), F.col("l_quantity").cast("bigint").alias("calls"))
        return calls.repartition("run_id").groupBy("run_id", "kernel_sig").agg(F.sum("calls").alias("calls"))

    @cached_property
    def seed_runs(self) -> DataFrame:
        """Cells of two arms over five seeds, plus a pooled row per seed and arm."""
        li = self.raw("lineitem")
        cells = li.groupBy(
            card_of(F.col("l_suppkey")).alias("gpu"), _nth(EXTERNAL_OPERATORS, F.pmod(F.col("l_linenumber"), F.lit(4))).alias("operator"),
            (F.col("l_orderkey") % 5).alias("seed"), F.when(F.col("l_linestatus") == "O", "a").otherwise("b").alias("arm")).agg(
            (F.avg("l_extendedprice") / 1000).alias("hybrid"), (F.avg("l_quantity")).alias("finetuned"), F.count("*").alias("n_test"))
        pooled = cells.groupBy("seed", "arm").agg(
            F.lit("POOLED").alias("gpu"), F.lit("-").alias("operator"), F.avg("hybrid").alias("hybrid"),
            F.avg("finetuned").alias("finetuned"), F.sum("n_test").alias("n_test"))
        return cells.unionByName(pooled)

    @cached_property
    def transfer_preds(self) -> DataFrame:
        eta = "(1D + l_linenumber) / 10D"
        return self.measurements.selectExpr(
            "gpu_key", "CASE category WHEN 'attention' THEN 'attn' WHEN 'norm' THEN 'rmsnorm' WHEN 'elementwise' THEN 'siluandmul' ELSE 'gemm' END AS operator",
            "kernel_sig", "energy_j AS energy_true", "energy_j * (0.5D + 0.2D * l_linenumber) AS energy_zeroshot",
            "energy_j * (0.8D + 0.1D * (l_orderkey % 5)) AS energy_finetuned", "energy_j * (0.7D + 0.1D * (l_suppkey % 7)) AS energy_scratch",
            "5D * l_linenumber - 20D AS eta_logit", f"{eta} AS eta_true", f"{eta} * (0.8D + 0.1D * (l_orderkey % 3)) AS eta_zeroshot",
            f"{eta} * (0.9D + 0.1D * (l_orderkey % 2)) AS eta_finetuned", "0.5D AS pi_true", "0.4D + 0.05D * (l_orderkey % 4) AS pi_finetuned",
            "l_quantity < 3 AS below_train")

    @cached_property
    def external(self) -> DataFrame:
        """Vectors as external features: operator from the label, card from the id."""
        def value(f):
            whens = [f"WHEN '{op}' THEN abs(CAST(element_at(embedding, {OPERATOR_FEATURES[op].index(f) + 1}) AS DOUBLE)) * 1e6D"
                     for op in EXTERNAL_OPERATORS if f in OPERATOR_FEATURES[op]]
            return f"CASE pw_operator {' '.join(whens)} END AS {PREFIX}{f}"

        named = "CASE label % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' ELSE '{}' END"
        cards = "element_at(array(" + ", ".join(f"'{k}'" for k in FLEET_KEYS) + "), CAST(vec_id % 8 + 1 AS INT))"
        tagged = self.raw("embeddings").selectExpr(
            "*", named.format(*EXTERNAL_OPERATORS) + " AS pw_operator", named.format("gemm", "attention", "norm", "elementwise") + " AS category")
        return tagged.selectExpr(
            "vec_id", "pw_operator", f"{cards} AS gpu_key", "category", "(1 + vec_id % 50) * 1e-6D AS latency_s",
            "(1 + vec_id % 7) * 1e-6D AS theoretical_time_s", "(1 + vec_id % 7) / (1 + vec_id % 50) AS eta", *[value(f) for f in ALL_FEATURES])

    @cached_property
    def feature_moments(self) -> DataFrame:
        """Per (operator, feature): mean and population sd, raw and after log1p."""
        tall = self.external.selectExpr("pw_operator AS operator", f"stack({len(ALL_FEATURES)}, " + ", ".join(
            f"'{f}', {PREFIX}{f}" for f in ALL_FEATURES) + ") AS (feature, x)")
        return tall.filter("x IS NOT NULL").groupBy("operator", "feature").agg(
            F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.avg(F.log1p("x")).alias("mu"), F.var_pop(F.log1p("x")).alias("var"))

    @cached_property
    def ranges(self) -> DataFrame:
        m, s = F.col("mean"), F.col("std")
        return self.feature_moments.select("operator", "feature", (m - s).alias("min"), (m + s).alias("max"), "mean", "std")

    @cached_property
    def moments(self) -> DataFrame:
        """Training moments with a diagonal precision matrix."""
        order = None
        for op in EXTERNAL_OPERATORS:
            lit = F.array(*[F.lit(f) for f in OPERATOR_FEATURES[op]])
            order = F.when(F.col("operator") == op, lit) if order is None else order.when(F.col("operator") == op, lit)
        packed = self.feature_moments.groupBy("operator").agg(
            F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mu", "var")))).alias("s"))
        named = packed.withColumn("features", order)
        return named.select(
            "operator", "features", F.transform("features", lambda f: F.try_element_at("s", f)["mu"]).alias("mean"),
            F.transform("features", lambda f, i: F.transform("features", lambda g, j: F.when(i == j, 1.0 / F.try_element_at("s", f)["var"]).otherwise(0.0))).alias("precision"),
            F.lit(4.0).alias("md_p99"))

    @cached_property
    def tile_reference(self) -> DataFrame:
        """Matrix-product kernels as a launch-geometry table over three cards."""
        g = self.kernels.filter(F.col("category") == "gemm")
        slot = F.pmod(F.floor(F.col("partkey") / 5), F.lit(3))
        key = F.col("partkey")
        return g.select(
            _nth(["NVIDIA A100-SXM4-80GB", "NVIDIA H100", "NVIDIA L40"], slot).alias("hardware"), _nth(["ampere", "hopper", "ada"], slot).alias("arch"),
            _nth([108, 132, 142], slot).alias("num_sms"), F.col("m").alias("M"), F.col("n").alias("N"), F.col("k").alias("K"),
            (64 * (1 + key % 4)).alias("tile_M"), (32 * (1 + key % 8)).alias("tile_N"), F.lit(64).cast("bigint").alias("tile_K"),
            (1 + key % 200).alias("cta_count"), (key % 2 == 1).alias("is_split_k"), key.alias("idx"))


def _telemetry(ev: DataFrame) -> DataFrame:
    cards = "element_at(array(" + ", ".join(f"'{k}'" for k in FLEET_KEYS) + "), CAST(user_id % 8 + 1 AS INT))"
    return ev.selectExpr(
        f"{cards} AS gpu_key", "event_id", "CAST(ts AS TIMESTAMP) AS ts", "CAST(value AS DOUBLE) AS power_w", "event_id % 512 AS throttle",
        "CAST(1000 + event_id % 900 AS DOUBLE) AS sm_clock", "CAST(500 + event_id % 70 AS DOUBLE) AS mem_clock",
        "CAST(40 + user_id % 40 AS DOUBLE) AS temp", "CAST(event_id % 101 AS DOUBLE) AS util_gpu", "CAST(event_id % 53 AS DOUBLE) AS util_mem",
        "event_id * 250 AS counter_mj")
