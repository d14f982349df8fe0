import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from jouleframe.operators import external as ext, ood
from jouleframe.operators.catalogue import build_catalogue
from jouleframe.sources import readers, writers


def moments(spark, names, op="gemm", mean=(0.0, 0.0), p99=1.5):
    eye = [[1.0 if i == j else 0.0 for j in range(len(names))] for i in range(len(names))]
    return spark.createDataFrame([(op, list(names), list(mean), eye, p99)], "operator string, features array<string>, mean array<double>, precision array<array<double>>, md_p99 double")


def test_distance_with_identity_precision(spark):
    names = {"gemm": ["u", "v"], "groupnorm": ["u", "v"]}
    df = spark.createDataFrame([(1, "gemm", "L4", math.e - 1, math.e**2 - 1), (2, "gemm", "L4", 0.0, None), (3, "gemm", "L4", 0.0, 0.0)], "id int, pw_operator string, gpu_key string, pw_u double, pw_v double")
    got = {r["id"]: r["md"] for r in ood.with_distance(df, moments(spark, ["u", "v"]), names).collect()}
    assert got == {1: pytest.approx(math.sqrt(5)), 3: 0.0}
    rep = ood.ood_report(df, moments(spark, ["u", "v"]), features=names).first()
    assert rep["n"] == 2 and rep["frac_beyond_train_p99"] == 0.5 and rep["md_median"] == pytest.approx(math.sqrt(5) / 2)
    group = df.withColumn("pw_operator", F.lit("groupnorm"))
    assert ood.with_distance(group, moments(spark, ["u", "v"], "rmsnorm"), names).count() == 2
    with pytest.raises(Exception, match="feature order"):
        ood.with_distance(df, moments(spark, ["v", "u"]), names).collect()


REF = "idx long, hardware string, arch string, num_sms int, M long, N long, K long, tile_M long, tile_N long, tile_K long, cta_count long, is_split_k boolean"


@pytest.mark.parametrize("block", [7, 1024])
def test_nearest_launch_by_brute_force(spark, block):
    rows = [(i, hw, arch, sms, 64 * (i % 7), 32 * (i % 11), 128 * (i % 5), 64, 32, 64, i, i % 2 == 0)
            for i, (hw, arch, sms) in enumerate([("NVIDIA H100", "hopper", 132), ("NVIDIA L40", "ada", 142), ("Other Ada", "ada", 60)] * 40)]
    ref = spark.createDataFrame(rows, REF)
    shapes = [(c, m, n, k) for c in ("H100", "L4", "L40") for m, n, k in ((100, 100, 100), (64, 32, 128), (500, 1, 300))]
    df = spark.createDataFrame(shapes * 2, "gpu_key string, m long, n long, k long")
    home = {"H100": "NVIDIA H100", "L40": "NVIDIA L40", "L4": "Other Ada"}
    for mode in ("structural", "upstream"):
        got = {(r["gpu_key"], r["m"], r["n"], r["k"]): r for r in ext.nearest_launch(df, ref, mode=mode, block=block).collect()}
        assert len(got) == 9
        for (c, m, n, k), r in got.items():
            best = min((math.dist((x[4], x[5], x[6]), (m, n, k)), x[0]) for x in rows if x[1] == home[c])
            assert r["neighbour_distance"] == pytest.approx(best[0])
            tiles = math.ceil(m / 64) * math.ceil(n / 32)
            want = best[1] if mode == "upstream" else (max(1, min(tiles, 132)) if c == "H100" else max(1, tiles))
            assert r["cta_count"] == want
            if mode == "structural":
                assert r["is_split_k"] == (c != "H100") and r["launch_source"].endswith("arch:Other Ada" if c == "L4" else "exact")
    with pytest.raises(ValueError, match="mode"):
        ext.nearest_launch(df, ref, mode="x")
    lost = df.union(spark.createDataFrame([("mystery", 1, 2, 3), ("A100_SXM4", 1, 2, 3)], df.schema))
    with pytest.raises(ValueError, match="no reference"):
        ext.nearest_launch(lost, ref)
    kept = ext.nearest_launch(lost, ref, missing="keep").collect()
    assert len(kept) == 11 and {r["gpu_key"] for r in kept if r["tile_m"] is None} == {"mystery", "A100_SXM4"}


def test_prepare_floors_and_ranges(spark):
    df = spark.createDataFrame([("gemm", "h100", 1.83e9, None, None, 2.0, 0.5, 0.25, "gemm"), ("rmsnorm", "H100", None, 1.83e9, 1.83e9, 4.0, 1.0, 2.0, "norm")],
                               "pw_operator string, gpu_key string, pw_tensor_all_cycle double, pw_fma_all_cycle double, pw_xu_all_cycle double, latency_s double, theoretical_time_s double, eta double, category string")
    full = df
    for f in ext.ALL_FEATURES:
        if "pw_" + f not in full.columns:
            full = full.withColumn("pw_" + f, F.lit(1.0))
    got = {r["pw_operator"]: (r["theory_pw_s"], r["eta_pw"]) for r in ext.prepare(full).collect()}
    assert got == {"gemm": (pytest.approx(1.0), pytest.approx(0.5)), "rmsnorm": (pytest.approx(2.0), pytest.approx(0.5))}
    fl = {r["category"]: r for r in ext.compare_floors(ext.prepare(full)).collect()}
    assert fl["gemm"]["ratio_median"] == pytest.approx(2.0) and fl["norm"]["eta_ours_over_1"] == 1
    ranges = spark.createDataFrame([("gemm", "tensor_all_cycle", 0.0, 1.0, 0.5, 0.25), ("gemm", "global_cycle", 0.0, 2.0, 1.0, 0.5)], "operator string, feature string, min double, max double, mean double, std double")
    rr = {r["feature"]: r for r in ext.range_report(full, ranges).collect()}
    assert set(rr) == {"tensor_all_cycle", "global_cycle"} and rr["tensor_all_cycle"]["frac_above_max"] == 1 and rr["global_cycle"]["median_z"] == 0
    assert ext.worst_ranges(ext.range_report(full, ranges), 1).first()["feature"] == "tensor_all_cycle"


def test_transfer_table_and_hybrid(spark):
    rows = [("L4", "gemm", 1.0, 2.0, 1.1, 1.5, 20.0 if i == 0 else 0.0) for i in range(12)] + [("H100", "gemm", 1.0, 1.5, 1.2, 1.0, 0.0) for _ in range(50)] + [("L4", "groupnorm", 1.0, 1.0, 1.0, 1.0, 0.0)] * 60
    df = ext.with_hybrid(spark.createDataFrame(rows, "gpu_key string, operator string, energy_true double, energy_zeroshot double, energy_finetuned double, energy_scratch double, eta_logit double"))
    t = {(r["gpu"], r["operator"]): r for r in ext.transfer_table(df, min_train=10).collect()}
    assert set(t) == {("L4", "gemm"), ("H100", "gemm"), ("POOLED", "-")}
    assert t[("L4", "gemm")]["hybrid"] == pytest.approx((11 * 10 + 50) / 12) and t[("L4", "gemm")]["ft_med"] == pytest.approx(10)
    assert t[("POOLED", "-")]["n_test"] == 62 and t[("POOLED", "-")]["finetuned"] == pytest.approx((12 * 10 + 50 * 20) / 62)
    assert {r["status"] for r in ext.transfer_cells(df).filter("operator = 'gemm' AND gpu_key = 'H100'").collect()} == {"too few rows"}


# --- files ---------------------------------------------------------------------------------


def test_measurement_files_with_different_headers(spark, tmp_path):
    (tmp_path / "L4__gemm__0of2.csv").write_text("kernel_sig,category,gpu_key,latency_s,contended,timestamp,p_m,p_kind\na,gemm,L4,1e-5,0,2024-01-01T00:00:00,64.0,\n")
    (tmp_path / "L4__norm.csv").write_text("kernel_sig,category,gpu_key,latency_s,p_rows,p_kind\nb,norm,L4,,8,rms\n")
    (tmp_path / "L4__conv.csv").write_text("")
    df = readers.read_measurements(spark, str(tmp_path))
    rows = {r["kernel_sig"]: r for r in df.collect()}
    assert rows["a"]["p_m"] == 64 and rows["a"]["p_rows"] is None and rows["a"]["file_name"] == "L4__gemm__0of2.csv" and rows["a"]["timestamp"].year == 2024
    assert rows["b"]["latency_s"] is None and rows["b"]["p_kind"] == "rms" and dict(df.dtypes)["p_m"] == "bigint"
    with pytest.raises(FileNotFoundError):
        readers.read_measurements(spark, str(tmp_path), "H100__*.csv")


def test_captures_to_catalogue_and_back(spark, tmp_path):
    (tmp_path / "capture__flux.csv").write_text("kernel_sig,category,dtype,source_model,source_module,op_name,p_m,p_n,p_k,p_bias,height,width\nx,gemm,bf16,flux,,linear,64,64,64,True,512,512\n")
    (tmp_path / "capture__sd.csv").write_text("kernel_sig,category,dtype,source_model,source_module,op_name,p_m,p_n,p_k,p_bias,height,width\nx,gemm,bf16,sd,,linear,64.0,64,64,True,512,512\n")
    cat = build_catalogue(readers.read_captures(spark, str(tmp_path)))
    assert cat.count() == 1 and cat.first()["source_model"] == "flux|sd"
    writers.write_catalogue(cat, str(tmp_path / "cat"), ["flux"])  # the other model is found
    back = readers.read_catalogue(spark, str(tmp_path / "cat"))
    assert back.first()["kernel_sig"] == cat.first()["kernel_sig"] and back.first()["calls"] == {"flux": 1, "sd": 1}


def test_e2e_pairs(spark, tmp_path):
    (tmp_path / "e2e__L4__m.csv").write_text("gpu_key,model,steps,height,width,latency_s,energy_counter_used\nL4,m,4,1024,1024,1.5,True\n")
    (tmp_path / "e2e__L4__lost.csv").write_text("gpu_key,model,steps,height,width,latency_s,energy_counter_used\nL4,lost,4,1024,1024,1.5,True\n")
    (tmp_path / "e2e_calls__L4__m.csv").write_text("kernel_sig,calls,gpu_key,model,steps,height,width\nk1,7,L4,m,4,1024,1024\n")
    runs, calls = readers.read_e2e(spark, str(tmp_path))
    assert [r["model"] for r in runs.collect()] == ["m"] and calls.first()["calls"] == 7


def test_moments_and_tile_reference(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"gemm": {"features": ["a"], "n": 3, "source": "s", "mean": [1.5], "precision": [[2.0]], "md_p50": 1, "md_p95": 2, "md_p99": 3.5, "md_max": 4}}))
    r = readers.read_training_moments(spark, str(tmp_path / "m.json")).first()
    assert (r["operator"], r["mean"], r["precision"], r["md_p99"]) == ("gemm", [1.5], [[2.0]], 3.5)
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("hardware,arch,num_sms,M,N,K,tile_M,tile_N,tile_K,cta_count,is_split_k\nA,ada,60,1,2,3,64,64,32,5,0\nB,ada,60,1,2,3,64,64,32,5,1\n")
    rows = readers.read_tile_reference(spark, str(tmp_path / "t.csv.gz")).collect()
    assert [(r["idx"], r["hardware"], r["is_split_k"]) for r in rows] == [(0, "A", False), (1, "B", True)]


ROWS = "kernel_sig string, category string, gpu_key string, latency_s double, p_m long"


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("k", "gemm", "L4", 1.0, 64), ("k", "gemm", "L4", 1.0, 64), ("n", "norm", "H100", 2.0, None)], ROWS)
    more = spark.createDataFrame([("c", "conv", "L4", 3.0)], "kernel_sig string, category string, gpu_key string, latency_s double")
    assert writers.append_measurements(df, path, "shard 0") and not writers.append_measurements(df, path, "shard 0")
    assert writers.append_measurements(more, path, "1") and writers.append_measurements(df, path, "shard 2")
    # Without a name the rows name themselves, however they are dealt.
    assert writers.append_measurements(df, path) and not writers.append_measurements(df.orderBy(F.desc("kernel_sig")).repartition(3), path)
    got = writers.read_appended(spark, path)
    assert got.count() == 10 and set(got.columns) == {"kernel_sig", "category", "gpu_key", "latency_s", "p_m"}
    assert {(r["name"], r["n_rows"]) for r in writers.commits(spark, path).collect()} >= {("shard 0", 3), ("1", 1), ("shard 2", 3)}
    assert writers.append_measurements(df.limit(0), path, "empty") and writers.read_appended(spark, path).count() == 10


def test_a_lost_attempt_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("k", "gemm", "L4", 1.0, 64)], ROWS)
    writers.append_measurements(df, path, "a")
    token = writers.commits(spark, path).first()["job"]
    # Rows without an entry in the manifest: of another job, and of a second attempt of the same.
    for place in (f"job=j0/attempt=a0", f"job={token}/attempt=azzz"):
        df.write.partitionBy("gpu_key", "category").parquet(f"{path}/rows/{place}")
    assert writers.read_appended(spark, path).count() == 1
    # Two attempts that both commit count once.
    spark.createDataFrame([("a", 1)], "name string, n_rows long").write.parquet(f"{path}/commits/job={token}/attempt=azzz")
    assert writers.read_appended(spark, path).count() == 1


def test_writers_side_by_side(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    frames = [spark.createDataFrame([(f"k{i}_{j}", "gemm", "L4", 1.0, j) for j in range(20)], ROWS) for i in range(4)]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: writers.append_measurements(frames[i % 4], path, f"job {i % 4}"), range(8)))  # each job twice at a time
    assert writers.read_appended(spark, path).count() == 80 and writers.commits(spark, path).count() == 4


def test_append_guard_and_prediction_partitions(spark, tmp_path):
    df = spark.createDataFrame([("k", "gemm", "L4", 1.0, 64)], ROWS)
    path = str(tmp_path / "t")
    writers.append_measurements(df, path)
    with pytest.raises(ValueError, match="p_new"):
        writers.append_measurements(df.withColumn("p_new", F.lit(1)), path)
    with pytest.raises(ValueError, match="surprise"):
        writers.append_measurements(df.withColumn("surprise", F.lit(1)), path)
    for fold in ("hardware", "category", "hardware"):
        writers.write_predictions(df, str(tmp_path / "p"), fold)
    assert {r["fold"]: r["count"] for r in spark.read.parquet(str(tmp_path / "p")).groupBy("fold").count().collect()} == {"hardware": 1, "category": 1}
    writers.write_dataset(df, str(tmp_path / "d"), "csv")
    df.write.parquet(str(tmp_path / "one"))
    assert readers.load_results(spark, str(tmp_path / "one")).count() == 1
    writers.write_report_tables({"hardware": df}, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "hardware")).count() == 1


def test_rows_of_a_transfer_table_are_not_dealt_by_cell(spark, monkeypatch):
    """A handful of cells must not gather the rows in as many tasks."""
    seen = []
    monkeypatch.setattr(ext, "group_quantiles", lambda df, *_: seen.append(df) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(400).selectExpr("concat('g', id % 4) AS gpu_key", "'gemm' AS operator", "1D + id AS energy_true", "1D AS energy_zeroshot", "2D AS energy_finetuned",
                                           "3D AS energy_scratch", "3D AS energy_hybrid", "false AS saturated")
        ext.transfer_table(rows)
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan and seen[0].count() == 800
