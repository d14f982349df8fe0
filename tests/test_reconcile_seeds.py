import pytest
from pyspark.sql import functions as F

from jouleframe.functions import labels, metrics
from jouleframe.operators import reconcile as rec, seeds

RUN = "run_id int, gpu_key string, model string, steps int, latency_s double, energy_j double, device_time_s double, idle_power_w double"


def setup(spark, energy=3030.0, extra=()):
    runs = spark.createDataFrame([(1, "L40S", "m", 20, 10.0, energy, 9.0, 30.0)], RUN)
    calls = spark.createDataFrame([(1, "k1", 100), (1, "k2", 50), *extra], "run_id int, kernel_sig string, calls long")
    data = spark.createDataFrame([("k1", "L40S", 20.0, 0.05), ("k2", "L40S", 20.0, 0.08), ("k1", "L4", 9.0, 9.0)], "kernel_sig string, gpu_key string, energy_j double, latency_s double")
    return runs, calls, data


def test_the_account_closes_exactly(spark):
    r = rec.reconcile(*setup(spark)).first()
    assert (r["A_kernel_energy_j"], r["A_gap_energy_j"], r["A_total_j"]) == (3000, 30, 3030)
    assert r["A_ratio"] == 1 and r["A_residual_j"] == 0 and r["call_coverage"] == 1 and r["busy_fraction"] == 0.9
    assert r["A_latency_ratio"] == pytest.approx(9.0 / 9.0)


def test_unmatched_calls_show_as_coverage_and_residual(spark):
    r = rec.reconcile(*setup(spark, 5030.0, [(1, "unknown", 100)])).first()
    assert r["call_coverage"] == pytest.approx(0.6) and r["calls_missing"] == 100 and r["A_residual_j"] == 2000


def test_level_b_uses_predictions(spark):
    preds = spark.createDataFrame([("k1", "L40S", 22.0), ("k2", "L40S", 18.0)], "kernel_sig string, gpu_key string, energy_pred double")
    r = rec.reconcile(*setup(spark), preds).first()
    assert r["B_kernel_energy_j"] == 3100 and r["B_total_j"] == 3130 and r["B_call_coverage"] == 1
    other = rec.reconcile(*setup(spark), preds.withColumn("gpu_key", F.lit("L4"))).first()
    assert other["B_total_j"] is None and other["A_total_j"] == 3030


def test_overlap_clamps_the_gap_and_unknown_cards_are_left_out(spark):
    runs, calls, data = setup(spark)
    runs = runs.withColumn("device_time_s", F.lit(11.0)).unionByName(runs.withColumns({"run_id": F.lit(2), "gpu_key": F.lit("H100")}))
    out = rec.reconcile(runs, calls, data).collect()
    assert [r["run_id"] for r in out] == [1] and out[0]["gap_s"] == 0
    assert rec.split_known_cards(runs, data)[1].first()["gpu_key"] == "H100"


def test_step_model(spark):
    rows = [("L4", "m", s, 100.0 + 50 * s, 110.0 + 50 * s, None if s == 3 else 1.0 * s) for s in (1, 2, 3, 4)] + [("L4", "flat", s, 7.0, 7.0, 7.0) for s in (1, 2, 3)] + [("L4", "few", 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "gpu_key string, model string, steps int, e2e_energy_j double, A_total_j double, B_total_j double")
    out = {r["model"]: r for r in rec.step_model(df).collect()}
    m = out["m"]
    assert m["measured_fixed_j"] == pytest.approx(100) and m["measured_per_step_j"] == pytest.approx(50) and m["measured_r2"] == pytest.approx(1)
    assert m["A_slope_ratio"] == pytest.approx(1) and m["A_fixed_ratio"] == pytest.approx(1.1) and m["B_fixed_j"] is None
    assert out["flat"]["measured_r2"] is None and "few" not in out


def test_reconstruct_and_its_double_count(spark):
    runs, _, data = setup(spark)
    cat = spark.createDataFrame([("k1", "gemm", "m", 5), ("k2", "conv", "m", 2), ("zz", "gemm", "m", 5)], "kernel_sig string, category string, model string, calls long")
    whole, gap = (rec.reconstruct(runs, cat, data, mode).first() for mode in ("run", "gap"))
    assert whole["kernel_sum_energy_j"] == 20 * 5 * 20 + 2 * 20 and whole["reconstructed_energy_j"] - gap["reconstructed_energy_j"] == 30 * 9
    assert whole["catalogue_call_coverage"] == pytest.approx(102 / 202) and (whole["n_configs_matched"], whole["n_configs_total"]) == (2, 3)


def test_run_derived_and_calls(spark):
    df = spark.createDataFrame([(1, 10.0, 9.0, 8.1, {"a": 3, "b": 4})], "run_id int, latency_s double, device_time_s double, device_time_covered_s double, calls map<string,long>")
    r = rec.run_derived(df).first()
    assert (r["gap_s"], r["busy_fraction"], r["n_configs"], r["total_calls"]) == (1, 0.9, 2, 7) and r["coverage_fraction"] == pytest.approx(0.9)
    assert {tuple(x) for x in rec.calls_frame(df, ["run_id"]).collect()} == {(1, "a", 3), (1, "b", 4)}


@pytest.mark.parametrize("wins,n,p", [(5, 5, 1 / 32), (4, 5, 6 / 32), (3, 5, 0.5), (0, 5, 1.0), (10, 10, 1 / 1024), (60, 100, 0.0284439668), (1, 0, None)])
def test_sign_test(spark, wins, n, p):
    got = spark.range(1).select(metrics.sign_test_p(F.lit(wins), F.lit(n))).first()[0]
    assert got == (pytest.approx(p, rel=1e-6) if p is not None else None)


def arm(spark, name, shift):
    rows = [(g, o, s, 20, 10.0 + s + shift * (1 if s != 2 else -1), name) for g, o in (("L4", "gemm"), ("POOLED", "-")) for s in range(5)]
    return spark.createDataFrame(rows, "gpu string, operator string, seed int, n_test int, hybrid double, arm string")


def test_paired_compare(spark):
    cells, verdict = seeds.paired_compare(arm(spark, "a", 0.0), arm(spark, "b", -1.0))
    c, v = cells.first(), verdict.first()
    assert (c["delta"], c["b_wins"], c["seeds"]) == (-1, 4, 5) and c["p_sign"] == pytest.approx(6 / 32)
    assert v["seeds"] == 5 and v["reading"] == "leaning" and v["a_median"] == 12
    s = seeds.seed_summary(arm(spark, "a", 0.0)).filter("gpu = 'L4'").first()
    assert s["hybrid"] == 12 and s["hybrid_pm"] == 2 and s["seeds"] == 5
    with pytest.raises(ValueError, match="share no"):
        seeds.paired_compare(arm(spark, "a", 0.0), arm(spark, "b", 0.0).withColumn("seed", F.col("seed") + 100))


def test_verdict_words(spark):
    df = spark.createDataFrame([(10.0, 12.0, 30.0, 9.0), (10.0, 9.0, 5.0, 9.0), (10.0, 10.0, 11.0, 10.0)], "z double, f double, s double, h double")
    v = labels.transfer_verdict(*[F.col(c) for c in "zfsh"])
    assert [tuple(r) for r in df.select(*v.values()).collect()] == [("damaging", True, "working"), ("helped", False, "liability"), ("no change", False, "unclear")]
    r = spark.createDataFrame([(5, 5, 0.03), (2, 5, 0.8), (4, 5, 0.19), (3, 3, 0.125)], "w int, n int, p double")
    assert [x[0] for x in r.select(labels.seed_verdict(F.col("w"), F.col("n"), F.col("p"))).collect()] == ["unanimous", "not separable", "leaning", "leaning"]
