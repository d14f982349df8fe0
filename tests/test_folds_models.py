import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from jouleframe.operators import folds, models
from jouleframe.operators.dataset import build_dataset
from jouleframe.sources.synthetic import synthetic_configs, synthetic_measurements

FEW = ["log_theoretical_time", "log_flops", "sm_occupancy", "log_n_waves", "log_bytes_per_flop", "uses_tensor_core", "log_tdp"]


@pytest.fixture(scope="module")
def data(spark):
    ds = build_dataset(synthetic_measurements(spark, seed=0))
    return ds.checkpoint()


def test_synthetic_data_covers_the_fleet_and_ignores_partitioning(spark, data):
    assert synthetic_configs(spark).count() == 3 * (9 * 4 + 2)
    assert data.groupBy("gpu_key").count().count() == 8 and data.filter("eta > 1 OR pi > 1").count() == 0
    a = {(r[0], r[1], r[2]): r[3] for r in synthetic_measurements(spark, 3, ["L4"]).select("kernel_sig", "source_model", "source_module", "energy_j").collect()}
    b = {(r[0], r[1], r[2]): r[3] for r in synthetic_measurements(spark, 3, ["H100", "L4"]).filter("gpu_key = 'L4'").repartition(7).select("kernel_sig", "source_model", "source_module", "energy_j").collect()}
    assert a == b and len(a) > 100


def test_ridge_equals_the_closed_form_and_spark_ml(spark, data):
    held = "L4"
    pdf = data.select("gpu_key", "energy_j", *FEW).toPandas()
    tr, te = pdf[pdf.gpu_key != held], pdf[pdf.gpu_key == held]
    mu, sd = tr[FEW].mean().to_numpy(), tr[FEW].std(ddof=0).to_numpy()
    sd[sd < 1e-12] = 1.0
    x, y = (tr[FEW].to_numpy() - mu) / sd, np.log(tr.energy_j.to_numpy())
    coef = np.linalg.solve(x.T @ x + np.eye(len(FEW)), x.T @ (y - y.mean()))
    want = np.sort(np.exp((te[FEW].to_numpy() - mu) / sd @ coef + y.mean()))
    rows = folds.written_rows(data, "hardware", FEW)
    pred = folds.ridge_predictions(rows, "hardware", [held])
    got = np.sort([r[0] for r in rows.filter(F.col("gpu_key") == held).select(pred).collect()])
    assert np.allclose(got, want, rtol=1e-8)
    std = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], ["y", *FEW])
    fit = LinearRegression(labelCol="y", regParam=1.0 / len(y) * float(np.std(y)), elasticNetParam=0, standardization=False, solver="normal").fit(
        VectorAssembler(inputCols=FEW, outputCol="features").transform(std))
    assert np.allclose(fit.coefficients.toArray(), coef, rtol=1e-5, atol=1e-7)


def test_ridge_on_all_features_equals_the_closed_form(data):
    from jouleframe.functions.roofline import FEATURE_COLUMNS

    table = {r["group"]: r for r in folds.baseline_table(data, "hardware", FEATURE_COLUMNS, ridge=True).collect()}
    pdf = data.select("gpu_key", "energy_j", *FEATURE_COLUMNS).toPandas()
    errors = []
    for held in sorted(pdf.gpu_key.unique()):
        tr, te = pdf[pdf.gpu_key != held], pdf[pdf.gpu_key == held]
        mu, sd = tr[FEATURE_COLUMNS].mean().to_numpy(), tr[FEATURE_COLUMNS].std(ddof=0).to_numpy()
        sd[sd < 1e-9 * np.maximum(1.0, np.abs(mu))] = np.inf
        x, y = (tr[FEATURE_COLUMNS].to_numpy() - mu) / sd, np.log(tr.energy_j.to_numpy())
        coef = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ (y - y.mean()))
        want = np.exp((te[FEATURE_COLUMNS].to_numpy() - mu) / sd @ coef + y.mean())
        true = te.energy_j.to_numpy()
        own = np.abs(want - true) / np.maximum(np.abs(true), 1e-8) * 100
        assert table[held]["ridge"] == pytest.approx(own.mean(), rel=1e-6) and table[held]["n_test"] == len(te)
        errors.append(own)
    assert table["MEAN"]["ridge"] == pytest.approx(np.mean([e.mean() for e in errors]), rel=1e-6)
    assert table["POOLED"]["ridge"] == pytest.approx(np.concatenate(errors).mean(), rel=1e-6)


def test_a_feature_that_only_the_held_out_group_varies_gets_no_weight(spark):
    rows = [("a", float(i % 7), 0.1, float(i + 1)) for i in range(20)] + [("b", float(i % 5), 0.1, float(i + 2)) for i in range(20)] + [("c", float(i % 3), 5.0, 3.0) for i in range(20)]
    df = spark.createDataFrame(rows, "gpu_key string, f double, odd double, energy_j double").withColumns({c: F.lit(1.0) for c in ("eta", "pi", "latency_s", "theoretical_time_s", "tdp_w")})
    with_odd, without = (folds.written_rows(df, "hardware", f) for f in (["f", "odd"], ["f"]))
    pick = lambda r: [x[0] for x in r.filter("gpu_key = 'c'").select(folds.ridge_predictions(r, "hardware", ["c"])).collect()]
    assert sorted(pick(with_odd)) == pytest.approx(sorted(pick(without)))


def test_complement_medians(data):
    pdf = data.select("category", "eta", "pi").toPandas()
    cats = sorted(pdf.category.unique())
    for wanted in (cats, cats[:2]):
        for r in folds.complement_medians(data, "category", wanted).collect():
            rest = pdf[pdf.category != r["group"]]
            assert r["eta_const"] == pytest.approx(rest.eta.median()) and r["pi_const"] == pytest.approx(rest.pi.median())


def test_report_table_mean_and_pooled(spark):
    p = spark.createDataFrame([("a", 1.0, 1.1, 1.0), ("b", 1.0, 1.3, 1.0), ("b", 1.0, 1.3, 2.0), ("b", 2.0, 2.6, 2.0)], "group string, energy_true double, energy_pred double, ridge_pred double")
    t = {r["group"]: r for r in folds.report_table(p).collect()}
    assert t["a"]["energy"] == pytest.approx(10) and t["b"]["energy"] == pytest.approx(30)
    assert t["MEAN"]["energy"] == pytest.approx(20) and t["POOLED"]["energy"] == pytest.approx(25)
    assert t["MEAN"]["n_test"] == t["POOLED"]["n_test"] == 4 and t["POOLED"]["ridge"] == pytest.approx(25)


def test_model_beats_roofline_and_nothing_leaks(data):
    one = data.filter(F.col("gpu_key").isin("L4", "A100_PCIE", "H100"))
    cfg = models.TrainConfig(max_iter=8, max_depth=3)
    ev = models.evaluate(one, "hardware", FEW, cfg)
    t = {r["group"]: r for r in ev.table.collect()}
    assert set(t) == {"L4", "A100_PCIE", "H100", "MEAN", "POOLED"} and t["POOLED"]["energy"] < t["POOLED"]["roofline"]
    preds = ev.predictions
    assert preds.count() == one.count() and preds.filter("eta_pred <= 0 OR eta_pred > 1 OR pi_pred > 1").count() == 0
    # Changing the held-out card's targets must not change its predictions.
    bent = one.withColumns({c: F.when(F.col("gpu_key") == "L4", F.col(c) * 0.5).otherwise(F.col(c)) for c in ("eta", "pi", "energy_j")})
    again = models.evaluate(bent, "hardware", FEW, cfg, ridge=False).predictions
    pick = lambda p: sorted((r["kernel_sig"], r["source_model"], round(r["eta_pred"], 12)) for r in p.filter("gpu_key = 'L4'").collect())
    assert pick(preds) == pick(again)
    tidy = models.histories_frame(models.histories_source(data.sparkSession, ev.histories))
    assert {r["split"] for r in tidy.select("split").distinct().collect()} == {"train", "val", "test"}
    assert models.curve_summary(tidy).count() == 6 and models.best_epochs(tidy).count() == 6


def test_per_category_uses_a_generalist_for_thin_categories(data):
    two = data.filter(F.col("gpu_key").isin("L4", "H100") & F.col("category").isin("gemm", "norm"))
    ev = models.evaluate(two, "hardware", FEW, models.TrainConfig(2, 2), per_category=True, min_category_rows=20, ridge=False)
    assert {h[2] for h in ev.histories} == {"gemm", "all"} and ev.predictions.count() == two.count()


def test_one_scoring_pass_equals_each_fit_applied_to_its_rows(data):
    """Specialists, a planted thin category and the generalist, against Spark ML's own scoring."""
    thin = (F.col("category") != "attention") | (F.pmod(F.xxhash64("kernel_sig"), F.lit(3)) == 0)
    two = data.filter(F.col("gpu_key").isin("L4", "H100") & F.col("category").isin("gemm", "norm", "attention") & thin)
    prepared = models.prepare(two, "hardware", FEW, ridge=False)
    cfg = models.TrainConfig(4, 3)
    ev = models.evaluate_prepared(prepared, cfg, per_category=True, min_category_rows=20)
    fitted = {(h[1], h[2]) for h in ev.histories}
    assert ("L4", "gemm") in fitted and ("L4", "all") in fitted and ("L4", "attention") not in fitted
    rows = prepared.rows.withColumn("_val", models.validation_flag(cfg, ["kernel_sig", "gpu_key"]))
    for g, c in (("L4", "gemm"), ("L4", "attention")):
        own = F.col("category") == c if (g, c) in fitted else F.lit(True)
        test = rows.filter((F.col("gpu_key") == g) & (F.col("category") == c))
        for head in models.HEADS:
            model, _ = models._fit(rows.filter((F.col("gpu_key") != g) & own), test, head, cfg)
            want = sorted(r[0] for r in model.transform(test).select(F.least(F.exp("prediction"), F.lit(1.0))).collect())
            got = sorted(r[0] for r in ev.predictions.filter((F.col("group") == g) & (F.col("category") == c)).select(f"{head}_pred").collect())
            assert got == pytest.approx(want, rel=1e-12) and len(got) > 3


def test_curves_of_all_fits_come_from_one_pass(data, monkeypatch):
    """The curves equal Spark ML's own, which reads the rows once a round and side; no fit reads them that often."""
    two = data.filter(F.col("gpu_key").isin("L4", "H100") & F.col("category").isin("gemm", "norm", "attention"))
    prepared = models.prepare(two.filter("category != 'attention' OR pmod(xxhash64(kernel_sig), 3) = 0"), "hardware", FEW, ridge=False)
    cfg = models.TrainConfig(5, 3)
    rows = prepared.rows.withColumn("_val", models.validation_flag(cfg, ["kernel_sig", "gpu_key"]))
    special = models._specialists(prepared, 20)
    want = {}
    for g, name in [("L4", "gemm"), ("L4", "all")]:
        own = F.col("category") == name if name != "all" else F.lit(True)
        test = rows.filter((F.col("gpu_key") == g) & own)
        if name == "all":
            test = test.filter(~F.col("category").isin([c for h, c in special if h == g]))
        for head in models.HEADS:
            want[g, name, head] = models._fit(rows.filter((F.col("gpu_key") != g) & own), test, head, cfg)[1]

    def refuse(*_):
        raise AssertionError("reads the rows once a round")

    monkeypatch.setattr("pyspark.ml.regression.GBTRegressionModel.evaluateEachIteration", refuse)
    ev = models.evaluate_prepared(prepared, cfg, per_category=True, min_category_rows=20)
    got = {h[1:4]: h[4:7] for h in ev.histories}
    for key, sides in want.items():
        for a, b in zip(got[key], sides):
            assert a == pytest.approx(b, rel=1e-9) and a[0] > 0
    assert max(len(h[4]) for h in ev.histories) > 1


def test_seeds_equal_separate_evaluations(data):
    two = data.filter(F.col("gpu_key").isin("L4", "H100"))
    cfg = models.TrainConfig(2, 2)
    runs = {(r["seed"], r["group"]): r for r in models.run_seeds(two, seeds=2, base_seed=3, cfg=cfg, features=FEW).collect()}
    assert {g for _, g in runs} == {"L4", "H100", "MEAN", "POOLED"} and len(runs) == 8
    for seed in (3, 4):
        for r in models.evaluate(two, "hardware", FEW, models.replace(cfg, seed=seed)).table.collect():
            for c in ("energy", "latency", "eta", "pi", "roofline", "constant", "ridge"):
                assert runs[seed, r["group"]][c] == pytest.approx(r[c], rel=1e-9)


def test_seeds_and_refusals(data):
    two = data.filter(F.col("gpu_key").isin("L4", "H100"))
    runs = models.run_seeds(two, seeds=2, cfg=models.TrainConfig(1, 2), arm="x", fold="hardware", features=FEW, ridge=False)
    assert {(r["seed"], r["arm"]) for r in runs.collect()} == {(0, "x"), (1, "x")}
    with pytest.raises(ValueError, match="fold must be"):
        folds.fold_column("city")
    with pytest.raises(KeyError, match="add_targets"):
        folds.complete_rows(two.drop("pi"), "hardware", [])
    with pytest.raises(RuntimeError, match="at least"):
        folds.fold_groups(data.filter("gpu_key = 'L4'"), "hardware")
    with pytest.raises(Exception, match="positive"):
        models.evaluate(two.withColumn("eta", F.lit(0.0)), "hardware", FEW, models.TrainConfig(1, 2), ridge=False)


def test_history_shapes(spark):
    h = [("f", "g1", "all", "eta", [1.0] * 40, [2.0 - i / 40 for i in range(40)], [3.0] * 40, 37), ("f", "g2", "all", "eta", [1.0] * 25, [1.0] * 25, [1.0] * 25, 22)]
    tidy = models.histories_frame(models.histories_source(spark, h))
    assert tidy.count() == 195
    s = {r["group"]: r for r in models.curve_summary(tidy).collect()}
    assert s["g1"]["epochs"] == 40 and s["g1"]["val_at_best"] == pytest.approx(2 - 37 / 40) and s["g1"]["val_at_last"] == pytest.approx(2 - 39 / 40)
    assert {r["group"]: r["best_epoch"] for r in models.best_epochs(tidy).collect()} == {"g1": 39, "g2": 0}
    small = [("f", f"g{k}", "all", "eta", v, v, v, 0) for k, v in enumerate(([1.0, 1.0 - 9e-7, 1.0 - 1.8e-6, 1.0 - 2e-6], [2.0, 1.0, 1.0 - 5e-7, 3.0], [float("nan"), 1.0, 0.5]))]
    for r in models.best_epochs(models.histories_frame(models.histories_source(spark, small))).collect():
        losses = small[int(r["group"][1])][5]
        assert r["best_epoch"] == models.best_epoch(losses) and r["best_val"] == losses[r["best_epoch"]]
    assert models.best_epoch([3.0, 2.0, 2.0 - 1e-9, 1.0, 1.5]) == 3


def test_clock_comparison(data):
    a = folds.baseline_table(data, "category")
    out = folds.clock_comparison(a, a).collect()
    assert all(r["roofline_tensor"] == r["roofline_boost"] for r in out) and len(out) == 7


def test_baselines_that_are_not_asked_for_are_not_fitted(data, monkeypatch):
    whole = {r["group"]: r["roofline"] for r in folds.baseline_table(data, "hardware").collect()}

    def refuse(*_):
        raise AssertionError("medians of a baseline that nobody reads")

    monkeypatch.setattr(folds, "complement_medians", refuse)
    table = folds.baseline_table(data, "hardware", constant=False)
    assert "constant" not in table.columns and {r["group"]: r["roofline"] for r in table.collect()} == whole
