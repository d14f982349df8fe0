import math

import pytest
from pyspark.sql import functions as F

from jouleframe.functions import targets
from jouleframe.functions.missing import nan_to_null
from jouleframe.operators import merge, quality

ROW = "kernel_sig string, gpu_key string, contended int, ts int, v int"


def test_clean_beats_late_and_order_does_not_matter(spark):
    rows = [("a", "L4", 0, 1, 10), ("a", "L4", 1, 9, 11), ("a", "L4", 0, 2, 12), ("b", "L4", 1, 1, 13), ("b", "L4", None, 0, 14), ("c", "L4", 1, 5, 15)]
    want = {"a": 12, "b": 14, "c": 15}
    for n in (1, 3, 8):
        df = spark.createDataFrame(rows[::-1] if n == 3 else rows, ROW).repartition(n)
        assert {r["kernel_sig"]: r["v"] for r in merge.merge_measurements(df, ["ts", "v"]).collect()} == want
    assert merge.merge_measurements(spark.createDataFrame(rows, ROW), ["ts", "v"], clean_only=True).count() == 2


def test_unreliable_rows_with_missing_values(spark):
    nan = float("nan")
    df = nan_to_null(spark.createDataFrame([(nan, 1e-5), (0.01, nan), (0.2, 1e-5), (0.05, 6e-6), (0.0, 5e-6), (0.2, 1e-9)], "energy_sd_rel double, latency_s double"))
    assert merge.filter_reliable(df).count() == 2
    assert merge.reliability_counts(df).first().asDict() == {"n_rows": 6, "n_unstable": 2, "n_tiny": 2, "n_kept": 2}


def test_ragged_union(spark):
    a = spark.createDataFrame([(1, 2)], "x int, p_m int")
    b = spark.createDataFrame([(3, "k")], "x int, p_kind string")
    assert {tuple(r) for r in merge.union_ragged([a, b]).select("x", "p_m", "p_kind").collect()} == {(1, 2, None), (3, None, "k")}


def one(spark, **extra):
    base = {"latency_s": 1e-3, "energy_j": 0.04, "theoretical_time_s": 4e-4, "tdp_w": 72.0, "idle_power_w": 15.0, **extra}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base))


def test_targets_by_hand(spark):
    r = targets.add_targets(one(spark, power_limit_w=60.0)).first()
    assert r["eta"] == pytest.approx(0.4) and r["power_avg_w"] == pytest.approx(40) and r["pi"] == pytest.approx(40 / 72)
    assert r["pi_dynamic"] == pytest.approx(25 / 57) and r["energy_dynamic_j"] == pytest.approx(0.025)
    assert r["pi_limit"] == pytest.approx(40 / 60) and r["power_cap_ratio"] == pytest.approx(60 / 72)
    assert r["log_energy"] == pytest.approx(math.log(0.04))


@pytest.mark.parametrize("limit", [0.0, None])
def test_no_usable_limit_falls_back_to_tdp(spark, limit):
    r = targets.add_targets(one(spark, power_limit_w=limit)).first()
    assert r["pi_limit"] == r["pi"] and r["power_cap_ratio"] == 1.0


def test_optional_columns_degrade(spark):
    r = targets.add_targets(one(spark).drop("idle_power_w")).first()
    assert r["pi_dynamic"] is None and r["energy_dynamic_j"] is None and r["pi_limit"] == r["pi"]
    assert targets.add_targets(one(spark, energy_j=None)).first()["log_energy"] is None


def test_heads_invert_targets(spark):
    d = targets.add_targets(one(spark))
    e = targets.energy_from_heads(F.col("eta"), F.col("pi"), F.col("theoretical_time_s"), F.col("tdp_w"))
    r = d.select(e.alias("e"), targets.latency_from_eta(F.col("eta"), F.col("theoretical_time_s")).alias("t")).first()
    assert r["e"] == pytest.approx(0.04, rel=1e-9) and r["t"] == pytest.approx(1e-3, rel=1e-9)


def test_impossible_efficiency_is_reported(spark):
    d = spark.createDataFrame([("gemm", "H100", e) for e in (0.4, 0.5, 1.7)], "category string, gpu_key string, eta double")
    for by in (["category", "gpu_key"], ["gpu_key"]):
        r = quality.validate_efficiency(d, by).first()
        assert r["frac_over_1"] == pytest.approx(1 / 3) and r["n"] == 3 and r["eta_median"] == 0.5 and r["eta_max"] == 1.7


def test_quality_report_and_audits(spark):
    rows = [("gemm", "L4", 0.2, 0.5, 30.0, 72.0, 72.0, 72.0, 0.6), ("norm", "L4", 0.4, 0.1, 10.0, 60.0, 72.0, 72.0, 0.2), ("gemm", "H100", 0.3, 0.6, 400.0, None, 700.0, 700.0, 0.1)]
    d = spark.createDataFrame(rows, "category string, gpu_key string, eta double, pi double, power_avg_w double, power_limit_w double, power_limit_default_w double, tdp_w double, idle_fraction double")
    rep = quality.quality_report(d)
    assert set(rep) == {"efficiency", "coverage", "targets"}
    cov = {r["gpu_key"]: r for r in rep["coverage"].collect()}
    assert cov["L4"]["gemm"] == 1 and cov["L4"]["norm"] == 1 and cov["L4"]["total"] == 2 and cov["H100"]["conv"] == 0
    caps = [(r["limit_below_default"], r["limit_off_tdp"]) for r in quality.power_cap_audit(d).orderBy("power_avg_w").collect()]
    assert caps == [(True, True), (False, False), (False, False)]
    floor = {r["gpu_key"]: r for r in quality.pi_floor_audit(d).collect()}
    assert floor["L4"]["n_below"] == 2 and floor["L4"]["worst_pi"] == 0.1 and floor["H100"]["n_below"] == 0


def test_log_warnings(spark):
    lines = spark.createDataFrame([("a", "x CONTENDED y"), ("a", "CONTENDED"), ("b", "PREFLIGHT FAILED"), ("c", "fine")], "file_name string, value string")
    assert {r["pattern"]: r["n_logs"] for r in quality.log_warnings(lines).collect()} == {"CONTENDED": 1, "FAILED": 1, "PREFLIGHT FAILED": 1}


def test_select_rows(spark):
    from jouleframe.operators.dataset import select_rows

    df = spark.createDataFrame([("b", "L40S", "norm", "rms"), ("a", "L40S", "norm", "group"), ("c", "A100_PCIE", "conv", None), ("d", "L4", "gemm", None)],
                               "kernel_sig string, gpu_key string, category string, kind string")
    names = lambda d: sorted(r["kernel_sig"] for r in d.collect())
    assert names(select_rows(df)) == ["a", "b", "c", "d"] and names(select_rows(df, cards=["l40s", "a100 pcie"])) == ["a", "b", "c"]
    assert names(select_rows(df, operators=["gemm", "rmsnorm"])) == ["b", "c", "d"] and names(select_rows(df, categories=["norm"], limit=1)) == ["a"]
    assert names(select_rows(df, cards=[])) == []
