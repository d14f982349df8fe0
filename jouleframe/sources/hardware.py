"""Hardware dimension tables and their overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Published specifications of the built-in cards.
FLEET_FIELDS = [
    ("gpu_key", "string"), ("name", "string"), ("architecture", "string"), ("compute_capability", "double"),
    ("sms", "int"), ("ops_per_clk", "int"), ("ops_per_clk_fp32acc", "int"), ("ops_per_clk_precision", "string"),
    ("fma_per_clk", "int"), ("xu_per_clk", "int"),
    ("boost_clock_mhz", "double"), ("tensor_clock_mhz", "double"), ("max_sm_clock_mhz", "double"),
    ("mem_bandwidth_gbs", "double"), ("l2_bandwidth_gbs", "double"), ("l2_cache_mb", "double"),
    ("smem_bandwidth_b_per_clk_sm", "int"), ("smem_size_kb_sm", "double"), ("regfile_kb_sm", "double"),
    ("mem_tech", "string"), ("tdp_w", "double"), ("idle_power_w", "double"),
]
FLEET = [
    ("L4", "NVIDIA L4", "Ada", 8.9, 60, 1024, 512, "bf16", 128, 16, 2040, 1969, 2010, 300, 2430, 48, 128, 100, 256, "GDDR", 72, 15),
    ("L40S", "NVIDIA L40S", "Ada", 8.9, 142, 1024, 512, "bf16", 128, 16, 2520, 2490, 2520, 864, 2430, 96, 128, 100, 256, "GDDR", 350, 32),
    ("L40", "NVIDIA L40", "Ada", 8.9, 142, 512, 256, "bf16", 128, 16, 2490, 2490, 2490, 864, 2430, 96, 128, 100, 256, "GDDR", 300, 30),
    ("A100_PCIE", "NVIDIA A100 80GB PCIe", "Ampere", 8.0, 108, 2048, 2048, "bf16", 64, 16, 1410, 1411, 1410, 1935, 5120, 40, 128, 164, 256, "HBM", 300, 40),
    ("A100_SXM4", "NVIDIA A100-SXM4-80GB", "Ampere", 8.0, 108, 2048, 2048, "bf16", 64, 16, 1410, 1411, 1410, 2039, 5120, 40, 128, 164, 256, "HBM", 400, 52),
    ("H100", "NVIDIA H100 SXM5 80GB", "Hopper", 9.0, 132, 4096, 4096, "bf16", 128, 16, 1980, 1830, 1980, 3352, 8000, 50, 128, 228, 256, "HBM", 700, 72),
    ("H200_NVL", "NVIDIA H200 NVL", "Hopper", 9.0, 132, 4096, 4096, "bf16", 128, 16, 1785, 1545, 1785, 4800, 8000, 50, 128, 228, 256, "HBM", 600, 68),
    ("H200_SXM", "NVIDIA H200", "Hopper", 9.0, 132, 4096, 4096, "bf16", 128, 16, 1980, 1830, 1980, 4800, 8000, 50, 128, 228, 256, "HBM", 700, 75),
]
FLEET_KEYS = [row[0] for row in FLEET]

# Product-name patterns, tried in this order.
DEVICE_PATTERNS = [
    ("L4", r"\bL4\b"), ("L40S", r"L40S"), ("L40", r"L40(?!S)"),
    ("A100_PCIE", r"A100.*PCI"), ("A100_PCIE", r"A100 80GB PCIe"), ("A100_SXM4", r"A100.*SXM"),
    ("H100", r"H100"), ("H200_NVL", r"H200\s*NVL"), ("H200_SXM", r"H200(?!\s*NVL)"),
]

# The constants of the external model family, a second convention on purpose.
EXTERNAL_FIELDS = [
    ("gpu_key", "string"), ("name", "string"), ("architecture", "string"), ("num_sms", "int"),
    ("tc_bf16", "double"), ("tc_fp8", "double"), ("xu_fp32", "double"), ("fma_fp32", "double"),
    ("sm_freq", "double"), ("mem_bandwidth", "double"), ("l2_cache_bandwidth", "double"),
    ("shared_memory_bandwidth", "double"), ("shared_memory_size", "double"), ("upstream", "boolean"),
]
EXTERNAL_FLEET = [
    ("A100_SXM4", "NVIDIA A100-SXM4-80GB", "ampere", 108, 2048, 0, 16, 64, 1410, 2039.04, 3235, 128, 164, True),
    ("H100", "NVIDIA H100", "hopper", 132, 4096, 8192, 16, 128, 1830, 3352.32, 8820, 128, 228, True),
    ("H200_SXM", "NVIDIA H200", "hopper", 132, 4096, 8192, 16, 128, 1830, 4916.7, 10403, 128, 228, True),
    ("L40", "NVIDIA L40", "ada", 142, 512, 0, 16, 128, 2490, 864.096, 5647, 128, 100, True),
    ("A100_PCIE", "NVIDIA A100-PCIE-80GB", "ampere", 108, 2048, 0, 16, 64, 1410, 1935, 3235, 128, 164, False),
    ("L40S", "NVIDIA L40S", "ada", 142, 1024, 0, 16, 128, 2520, 864.096, 6326, 128, 100, False),
    ("L4", "NVIDIA L4", "ada", 58, 1024, 0, 16, 128, 2040, 300, 2576, 128, 100, False),
    ("H200_NVL", "NVIDIA H200 NVL", "hopper", 132, 4096, 8192, 16, 128, 1830, 4800, 10403, 128, 228, False),
]

INFO_COLUMNS = ["name", "architecture", "sms", "ops_per_clk", "tensor_clock_mhz",
                "peak_tensor_flops", "mem_bandwidth_gbs", "tdp_w"]


def _inline_table(spark: SparkSession, fields, rows) -> DataFrame:
    """A literal relation: Catalyst knows its size and no Python worker reads it."""
    def cell(value, dtype):
        text = "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)
        return f"CAST({text} AS {dtype})"

    body = ",\n".join("(" + ", ".join(cell(v, t) for v, (_, t) in zip(row, fields)) + ")" for row in rows)
    names = ", ".join(n for n, _ in fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def clock_mhz(clock: str, prefix: str = "") -> Column:
    if clock not in ("tensor", "boost"):
        raise ValueError(f"clock must be 'tensor' or 'boost', got {clock!r}")
    return F.col(f"{prefix}{clock}_clock_mhz")


def peak_tensor_flops(clock: str = "tensor", prefix: str = "") -> Column:
    return F.col(f"{prefix}sms") * F.col(f"{prefix}ops_per_clk") * clock_mhz(clock, prefix) * 1e6 * 2.0


def peak_fma_flops(clock: str = "boost", prefix: str = "") -> Column:
    return F.col(f"{prefix}sms") * F.col(f"{prefix}fma_per_clk") * clock_mhz(clock, prefix) * 1e6 * 2.0


def peak_xu_ops(clock: str = "boost", prefix: str = "") -> Column:
    return F.col(f"{prefix}sms") * F.col(f"{prefix}xu_per_clk") * clock_mhz(clock, prefix) * 1e6


def smem_bandwidth_gbs(clock: str = "boost", prefix: str = "") -> Column:
    bytes_per_clk = F.col(f"{prefix}sms") * F.col(f"{prefix}smem_bandwidth_b_per_clk_sm")
    return bytes_per_clk * clock_mhz(clock, prefix) * 1e6 / 1e9


def with_derived(hw: DataFrame) -> DataFrame:
    return hw.withColumns({
        "peak_tensor_flops": peak_tensor_flops("tensor"),
        "peak_tensor_flops_boost": peak_tensor_flops("boost"),
        "peak_fma_flops": peak_fma_flops("boost"),
        "is_hbm": (F.upper("mem_tech") == "HBM").cast("int"),
    })


def hardware_frame(spark: SparkSession, gpus: list[str] | None = None) -> DataFrame:
    """The built-in cards, one row each, with derived peaks."""
    rows = FLEET if gpus is None else [r for r in FLEET if r[0] in set(gpus)]
    return with_derived(_inline_table(spark, FLEET_FIELDS, rows))


def external_hardware_frame(spark: SparkSession) -> DataFrame:
    return _inline_table(spark, EXTERNAL_FIELDS, EXTERNAL_FLEET)


def load_hardware(spark: SparkSession, path: str) -> DataFrame:
    """Built-in table overridden cell by cell from a CSV keyed on ``gpu_key``.

    The result holds the CSV's cards; a card that is neither built in nor fully described
    is an error naming the missing fields.
    """
    header = spark.read.option("header", True).csv(path).columns
    if "gpu_key" not in header:
        raise ValueError("hardware CSV needs a gpu_key column")
    types = dict(FLEET_FIELDS)
    # Whole numbers may be written as 142.0: read numbers as double, narrow afterwards.
    read_type = {"int": "double"}
    schema = ", ".join(f"`{c}` {read_type.get(types.get(c, 'string'), types.get(c, 'string'))}" for c in header)
    given = spark.read.option("header", True).schema(schema).csv(path)
    given = given.withColumn("gpu_key", F.upper(F.trim("gpu_key")))
    twice = given.groupBy("gpu_key").count().where("count > 1").orderBy("gpu_key").take(1)
    if twice:
        raise ValueError(f"{twice[0]['gpu_key']} is described more than once")
    base = _inline_table(spark, FLEET_FIELDS, FLEET)
    joined = given.alias("g").join(F.broadcast(base.alias("b")), "gpu_key", "left")
    cols = [F.col("gpu_key")]
    for name, dtype in FLEET_FIELDS[1:]:
        fallback = F.col(f"b.{name}")
        value = F.coalesce(F.col(f"g.{name}").cast(dtype), fallback) if name in header else fallback
        cols.append(value.alias(name))
    merged = joined.select(*cols)
    absent = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n, _ in FLEET_FIELDS[1:]]))
    bad = merged.select("gpu_key", absent.alias("absent")).filter(F.size("absent") > 0).take(1)
    if bad:
        raise ValueError(f"{bad[0]['gpu_key']}: no built-in default and CSV lacks {sorted(bad[0]['absent'])}")
    return with_derived(merged)


def normal_key(col: Column) -> Column:
    """Case-insensitive card key with ``-`` and blanks read as ``_``."""
    return F.translate(F.upper(F.trim(col)), "- ", "__")


def attach_hardware(df: DataFrame, hardware: DataFrame | None = None, key: str = "gpu_key",
                    prefix: str = "hw_") -> DataFrame:
    """Left join each row to its card by key or product name; unmatched rows keep NULLs.

    The built-in table is eight rows and is broadcast. A supplied table carries no hint:
    Spark broadcasts it only if its own size estimate allows. Of several cards of one key or
    name the one with the smallest ``gpu_key`` counts, so rows are never doubled.
    """
    built_in = hardware is None
    hw = hardware_frame(df.sparkSession) if built_in else hardware
    by_key = hw.selectExpr("translate(upper(trim(gpu_key)), '- ', '__') AS _hw_key", "struct(*) AS _by_key")
    by_name = hw.selectExpr("upper(name) AS _hw_name", "struct(*) AS _by_name")
    if not built_in:
        by_key = by_key.groupBy("_hw_key").agg(F.min_by("_by_key", F.col("_by_key.gpu_key")).alias("_by_key"))
        by_name = by_name.groupBy("_hw_name").agg(F.min_by("_by_name", F.col("_by_name.gpu_key")).alias("_by_name"))
    else:
        by_key, by_name = F.broadcast(by_key), F.broadcast(by_name)
    out = (df.join(by_key, normal_key(F.col(key)) == F.col("_hw_key"), "left")
           .join(by_name, F.upper(F.trim(F.col(key))) == F.col("_hw_name"), "left"))
    kept = [f"`{c}`" for c in df.columns]
    placed = out.selectExpr(*kept, "coalesce(_by_key, _by_name) AS _spec")
    return placed.selectExpr(*kept, *[f"_spec.{c} AS {prefix}{c}" for c in hw.columns])


def identify_device(name: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Card key of a product name: first matching pattern wins, no match is NULL."""
    rules = DEVICE_PATTERNS if patterns is None else patterns
    return F.coalesce(*[F.when(name.rlike(f"(?i){p}"), F.lit(k)) for k, p in rules], F.lit(None).cast("string"))


def identify_devices(df: DataFrame, name: str = "gpu_name", out: str = "gpu_key") -> tuple[DataFrame, DataFrame]:
    """(identified rows, distinct names that matched no card)."""
    tagged = df.withColumn(out, identify_device(F.col(name)))
    return tagged.filter(F.col(out).isNotNull()), tagged.filter(F.col(out).isNull()).select(name).distinct()


# Descriptor names of the power domain.
POWER_DESCRIPTORS = ["idle_fraction", "log_idle_power", "log_tdp", "log_watt_per_tflop", "log_watt_per_gbs"]


def power_descriptors(names: list[str], prefix: str = "hw_") -> dict[str, Column]:
    """Per-card power columns over an attached hardware row."""
    tdp, idle = F.col(f"{prefix}tdp_w"), F.col(f"{prefix}idle_power_w")
    known = {
        "idle_fraction": idle / tdp,
        "log_idle_power": F.ln(idle),
        "log_tdp": F.ln(tdp),
        "log_watt_per_tflop": F.ln(tdp / (peak_tensor_flops("tensor", prefix) / 1e12)),
        "log_watt_per_gbs": F.ln(tdp / F.col(f"{prefix}mem_bandwidth_gbs")),
    }
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise KeyError(f"unknown power descriptors {unknown}; known: {sorted(known)}")
    return {n: known[n] for n in names}


def info(spark: SparkSession) -> tuple[DataFrame, list[str]]:
    """Headline hardware columns and the list of model features."""
    from jouleframe.functions.roofline import FEATURE_COLUMNS

    return hardware_frame(spark).select("gpu_key", *INFO_COLUMNS), list(FEATURE_COLUMNS)
