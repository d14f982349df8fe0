import math

import pytest
from pyspark.sql import functions as F

from jouleframe.functions import categories as C, roofline as R
from jouleframe.operators.dataset import attach_features, failure_causes, split_failures
from jouleframe.operators.planning import planned_pairs
from jouleframe.sources.hardware import FLEET_KEYS, attach_hardware, hardware_frame, identify_device, load_hardware

SCHEMA = ("name string, category string, dtype string, p_m long, p_n long, p_k long, p_b long, p_h long, p_s_q long, p_s_kv long, p_d long, p_h_kv long, p_causal boolean, "
          "p_c_in long, p_c_out long, p_w long, p_kh long, p_kw long, p_stride long, p_pad long, p_groups long, p_rows long, p_dim long, p_kind string, p_n_elem long, p_bias boolean")


def frame(spark, *rows):
    names = [p.strip().split()[0] for p in SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r.get(n[2:] if n.startswith("p_") else n) for n in names) for r in rows], SCHEMA)


def cfg(category, dtype="bf16", name="", **p):
    return {"category": category, "dtype": dtype, "name": name, **p}


FIVE = [
    cfg("gemm", m=4096, n=3072, k=3072), cfg("attention", b=1, h=24, s_q=4608, s_kv=4608, d=128),
    cfg("conv", n=1, c_in=128, c_out=128, h=512, w=512, kh=3, kw=3), cfg("norm", rows=4608, dim=3072),
    cfg("elementwise", n_elem=4608 * 3072, kind="silu"),
]


def analysed(spark, rows, cards=FLEET_KEYS, **kw):
    return R.roofline_features(attach_hardware(planned_pairs(frame(spark, *rows), list(cards))), **kw)


def test_all_features_finite_on_every_card_and_category(spark):
    rows = analysed(spark, FIVE).collect()
    assert len(rows) == 40 and len(R.FEATURE_COLUMNS) == 65
    for r in rows:
        assert all(r[c] is not None and math.isfinite(r[c]) for c in R.FEATURE_COLUMNS)
        assert r["theoretical_time_s"] > 0 and r["bottleneck"] in R.FLOOR_PIPES


def test_kernel_totals_closed_forms(spark):
    rows = {r["name"]: r for r in C.with_kernel_totals(frame(
        spark, cfg("gemm", name="g", m=1024, n=2048, k=512, bias=False), cfg("attention", name="full", b=1, h=16, s_q=4096, s_kv=4096, d=64),
        cfg("attention", name="half", b=1, h=16, s_q=4096, s_kv=4096, d=64, causal=True),
        cfg("attention", name="shared", b=1, h=16, s_q=4096, s_kv=4096, d=64, h_kv=4),
        cfg("conv", name="c", n=2, c_in=64, c_out=128, h=64, w=64, kh=3, kw=3, bias=False),
        cfg("conv", name="grouped", n=2, c_in=64, c_out=128, h=64, w=64, kh=3, kw=3, bias=False, groups=4, stride=2, pad=0),
        cfg("norm", name="layer", rows=4096, dim=3072), cfg("norm", name="rms", rows=4096, dim=3072, kind="rms"))).collect()}
    assert rows["g"]["kernel_flops"] == 2 * 1024 * 2048 * 512
    assert rows["half"]["kernel_flops"] == rows["full"]["kernel_flops"] / 2 == 2 * 16 * 4096 * 4096 * 64
    assert rows["shared"]["kernel_bytes_global"] < rows["full"]["kernel_bytes_global"]
    assert rows["c"]["kernel_flops"] == 2.0 * 2 * 128 * 64 * 64 * 64 * 9
    side = (64 - 3) // 2 + 1
    assert rows["grouped"]["kernel_flops"] == 2.0 * (2 * side * side) * (128 // 4) * (64 // 4 * 9) * 4
    assert rows["rms"]["kernel_flops"] < rows["layer"]["kernel_flops"]
    assert rows["layer"]["arithmetic_intensity"] < 1


def ladder(m, n, sms):
    for tm, tn in ((256, 128), (128, 256), (128, 128), (128, 64), (64, 128), (64, 64)):
        if -(-m // tm) * -(-n // tn) >= 2 * sms:
            return tm, tn
    return 32, 32


def deal(count, sms):
    """Hand tasks out one at a time; (busiest, units used)."""
    load = [0] * sms
    for i in range(count):
        load[i % sms] += 1
    return max(load), sum(1 for x in load if x)


@pytest.mark.parametrize("card,sms", [("L4", 60), ("H100", 132)])
def test_gemm_tiling_and_placement_by_brute_force(spark, card, sms):
    shapes = [(64, 64, 64), (1000, 777, 512), (4096, 3072, 3072), (8192, 8192, 1024), (333, 9000, 64)]
    out = analysed(spark, [cfg("gemm", name=f"{m},{n},{k}", m=m, n=n, k=k, bias=False) for m, n, k in shapes], [card]).collect()
    for r in out:
        m, n, k = map(int, r["name"].split(","))
        tm, tn = ladder(m, n, sms)
        count = -(-m // tm) * -(-n // tn)
        busiest, used = deal(count, sms)
        assert r["log_n_tasks"] == pytest.approx(math.log(count))
        assert r["log_ops_tensor_gpu"] == pytest.approx(math.log(2.0 * tm * tn * k * count))
        assert r["log_ops_tensor_sm_max"] == pytest.approx(math.log(2.0 * tm * tn * k * busiest))
        assert r["sm_occupancy"] == pytest.approx(used / sms)
        assert r["imbalance_mma"] == pytest.approx(busiest / (count / sms))
        waves = count / (sms * 2)
        assert r["tail_fraction"] == pytest.approx(math.ceil(waves) - waves)


def test_causal_mean_matches_a_loop(spark):
    out = analysed(spark, [cfg("attention", name=f"{q},{kv}", b=2, h=8, s_q=q, s_kv=kv, d=64, causal=True) for q, kv in ((1000, 700), (128, 4096), (4096, 4096))], ["A100_PCIE"]).collect()
    for r in out:
        q, kv = map(int, r["name"].split(","))
        blocks = -(-q // 128)
        mean = sum(min(kv, (i + 1) * 128) for i in range(blocks)) / blocks
        assert r["log_ops_tensor_gpu"] == pytest.approx(math.log(4.0 * 128 * mean * 64 * 16 * blocks))


def test_residency_and_floor(spark):
    small = analysed(spark, [cfg("norm", rows=4608, dim=3072)], ["L40S"]).first()
    assert small["fits_in_l2"] == 1 and small["compulsory_miss_fraction"] == 0 and small["bottleneck"] in ("tensor", "fma", "xu")
    names = {r["name"]: r["bottleneck"] for r in analysed(spark, [cfg("gemm", name="g", m=8192, n=8192, k=8192), cfg("norm", name="n", rows=65536, dim=4096)], ["A100_PCIE"]).collect()}
    assert names == {"g": "tensor", "n": "mem_compulsory"}


def test_buffers_change_residency_not_traffic(spark):
    add = cfg("elementwise", n_elem=32 * 1024 * 1024, kind="add")
    full = 2.0 * 32 * 1024 * 1024 * 2 / (864 * 1e9)
    last = 0.0
    for n in (1, 2, 4, 8, 64):
        r = analysed(spark, [add], ["L40S"], n_buffers=str(n)).first()
        assert last <= r["theoretical_time_s"] <= full * 1.000001
        assert r["analytic_bytes_global"] == 2.0 * 32 * 1024 * 1024 * 2
        last = r["theoretical_time_s"]


def test_persistent_only_on_hopper_products(spark):
    got = {(r["category"], r["gpu_key"]): r["is_persistent"] for r in analysed(spark, FIVE, ["H100", "A100_PCIE"]).collect()}
    assert {k for k, v in got.items() if v == 1} == {("gemm", "H100"), ("attention", "H100")}


def test_failures_are_named_and_counted(spark):
    rows = frame(spark, cfg("gemm", m=1, n=1), cfg("elementwise", n_elem=5, kind="nope"), cfg("fft"), cfg("norm", "fp12", rows=1, dim=1), FIVE[0], FIVE[0]).withColumn(
        "gpu_key", F.lit("h200-sxm"))
    ok, bad = split_failures(rows)
    assert ok.count() == 2
    assert {r["reason"] for r in failure_causes(bad).collect()} == {"gemm: missing k", "unknown elementwise kind nope", "unknown category fft", "unknown dtype fp12"}
    assert attach_features(rows).count() == 2
    with pytest.raises(Exception, match="missing k|unknown"):
        attach_features(rows, on_error="raise").count()
    lost = frame(spark, FIVE[0]).withColumn("gpu_key", F.lit("P40"))
    assert split_failures(lost)[1].first()["reason"] == "unknown card P40"


def test_measured_columns_win_and_analytic_ones_do_not(spark):
    rows = frame(spark, FIVE[0]).withColumns({"gpu_key": F.lit("L4"), "is_hbm": F.lit(7), "theoretical_time_s": F.lit(1.0)})
    r = attach_features(rows).first()
    assert r["is_hbm"] == 7 and r["theoretical_time_s"] < 1.0
    assert not [c for c in r.asDict() if c.startswith(("hw_", "_"))]


def test_filters_on_features_stay_small(spark):
    """A filter on a derived column must not copy the demand formulas down the plan."""
    out = analysed(spark, FIVE).filter("log_theoretical_time < 0 AND sm_occupancy IS NOT NULL")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_cards(spark):
    peaks = {r["gpu_key"]: r["peak_tensor_flops"] / 1e12 for r in hardware_frame(spark).collect()}
    published = {"L4": 242, "L40": 362, "L40S": 724, "A100_PCIE": 624, "A100_SXM4": 624, "H100": 1979, "H200_NVL": 1671, "H200_SXM": 1979}
    assert all(peaks[k] == pytest.approx(v, rel=0.01) for k, v in published.items())
    names = [("NVIDIA L4", "L4"), ("NVIDIA L40", "L40"), ("NVIDIA L40S", "L40S"), ("NVIDIA A100 80GB PCIe", "A100_PCIE"), ("NVIDIA A100-SXM4-80GB", "A100_SXM4"),
             ("NVIDIA H100 80GB HBM3", "H100"), ("NVIDIA H200", "H200_SXM"), ("nvidia h200 nvl", "H200_NVL"), ("Tesla P40", None)]
    df = spark.createDataFrame(names, "n string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", identify_device(F.col("n"))).collect())
    odd = spark.createDataFrame([("h100 ",), ("A100-SXM4",), ("nvidia l40s",), ("nope",)], "gpu_key string")
    assert [r["hw_gpu_key"] for r in attach_hardware(odd).collect()] == ["H100", "A100_SXM4", "L40S", None]


def test_hardware_override(spark, tmp_path):
    (tmp_path / "hw.csv").write_text("gpu_key,tdp_w,sms\nl4,80,58.0\nH100,,\n")
    got = {r["gpu_key"]: r for r in load_hardware(spark, str(tmp_path / "hw.csv")).collect()}
    assert got["L4"]["tdp_w"] == 80 and got["L4"]["sms"] == 58 and got["H100"]["tdp_w"] == 700 and len(got) == 2
    (tmp_path / "bad.csv").write_text("gpu_key,tdp_w\nB200,1000\n")
    with pytest.raises(ValueError, match="B200"):
        load_hardware(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "none.csv").write_text("key,tdp_w\nB200,1000\n")
    with pytest.raises(ValueError, match="gpu_key"):
        load_hardware(spark, str(tmp_path / "none.csv"))
