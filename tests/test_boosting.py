"""Many fits grown side by side: their work does not grow with their number, and their results not with how rows are dealt."""
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from jouleframe.operators import boosting, models
from jouleframe.operators.dataset import build_dataset
from jouleframe.sources.synthetic import synthetic_measurements

FEW = ["log_theoretical_time", "log_flops", "sm_occupancy", "log_n_waves", "log_bytes_per_flop", "uses_tensor_core", "log_tdp"]


@pytest.fixture(scope="module")
def data(spark):
    return build_dataset(synthetic_measurements(spark, seed=0)).checkpoint()


def jobs_of(spark, work):
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    work()
    spark.sparkContext.setJobGroup("none", "none")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_more_fits_take_no_more_jobs(spark, data):
    """The fits of a fold read the rows together: six cards hold three times the fits of two."""
    cards = sorted(r[0] for r in data.select("gpu_key").distinct().collect())
    cfg = models.TrainConfig(1, 2)
    few, many = (models.prepare(data.filter(F.col("gpu_key").isin(cards[:n])), "hardware", FEW, ridge=False) for n in (2, 6))
    assert len(few.groups) == 2 and len(many.groups) == 6
    run = lambda p: jobs_of(spark, lambda: models.evaluate_prepared(p, cfg).table.collect())
    assert run(many) <= run(few) + 2


def test_rows_with_the_same_bins_stand_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)  # read on the driver and sent along
    rows = spark.range(1_000).selectExpr("if(id % 2 = 0, 'a', 'b') AS g", "cast(null AS string) AS category", "if(id < 900, '01', '11') AS x",
                                         "id % 4 AS val", "cast(id % 7 AS double) AS u", "cast(-1 AS double) AS w").repartition(5)
    found = boosting.blocks(rows, ["u", "w"], 2).collect()
    sizes = [np.frombuffer(r["sizes"], np.int32) for r in found]
    assert sum(s.sum() for s in sizes) == 1_000 and all(r["category"] is None for r in found)
    cells = {(r["g"], bytes(r["x"][2 * i:2 * i + 2])) for r, s in zip(found, sizes) for i in range(len(s))}
    assert cells == {(g, x) for g in "ab" for x in (b"\0\1", b"\1\1")}
    assert sum(len(s) for s in sizes) < 40
    steps = [np.frombuffer(r["labels"], np.int32).reshape(2, -1) / boosting.LABEL for r in found]
    assert sum(s[0].sum() for s in steps) == sum(i % 7 for i in range(1_000)) and all((s[1] == -1).all() for s in steps)


def test_trees_do_not_depend_on_how_rows_are_dealt(spark, data):
    two = data.filter(F.col("gpu_key").isin("L4", "H100"))
    prepared = models.prepare(two, "hardware", FEW, ridge=False)
    cfg = models.TrainConfig(5, 3)

    def grown(p):
        found = models._grown(p, cfg, [0, 1], set(), False)
        return {f: [(t.feature, t.threshold, t.left, t.right, t.value) for t in trees] for f, trees in found.trees.items()}

    dealt = models.Prepared(prepared.rows.repartition(7, F.rand(1)), prepared.fold, prepared.groups, prepared.width)
    assert grown(prepared) == grown(dealt)


def test_predictions_of_all_fits_equal_spark_ml(data):
    """Eight rounds, five levels and twin features whose splits tie."""
    two = data.filter(F.col("gpu_key").isin("L4", "H100", "A100_PCIE")).withColumn("twin", -F.col("log_flops"))
    prepared = models.prepare(two, "hardware", ["twin", *FEW], ridge=False)
    cfg = models.TrainConfig(8, 5)
    found = models._grown(prepared, cfg, [0], set(), False)
    rows = prepared.rows.withColumn("_val", models.validation_flag(cfg, ["kernel_sig", "gpu_key"]))
    x = boosting.bins_of(prepared.rows.select("_x").toArrow().combine_chunks().column("_x").combine_chunks())
    for f, trees in found.trees.items():
        model = models._trained(rows.filter(F.col("gpu_key") != f.group), models.HEADS[f.head], cfg)
        assert len(model.trees) == len(trees)
        want = sorted(r[0] for r in model.transform(prepared.rows).select("prediction").collect())
        assert sorted(boosting.boosted(trees, x, cfg.max_depth, cfg.step)) == pytest.approx(want, rel=1e-13)


def test_a_fit_without_a_split_says_its_mean(spark):
    rows = [(c, f"k{i}", 1.0, 0.5 if i % 2 else 0.25, 0.5, 2.0, 1.0, 1.0, 100.0) for c in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "gpu_key string, kernel_sig string, f double, eta double, pi double, energy_j double, latency_s double, theoretical_time_s double, tdp_w double").withColumn("category", F.lit("gemm"))
    for features in (["f"], []):
        ev = models.evaluate(df, "hardware", features, models.TrainConfig(3, 2), ridge=False)
        preds = ev.predictions.collect()
        assert len(preds) == 80 and {round(r["pi_pred"], 6) for r in preds} == {0.5} and all(0.25 < r["eta_pred"] < 0.5 for r in preds)


def test_more_seeds_take_no_more_jobs(spark, data):
    two = data.filter(F.col("gpu_key").isin("L4", "H100"))
    run = lambda n: jobs_of(spark, lambda: models.run_seeds(two, seeds=n, cfg=models.TrainConfig(1, 2), features=FEW, ridge=False).collect())
    assert run(4) <= run(1) + 2


def test_more_specialists_take_no_more_jobs(spark, data):
    two = data.filter(F.col("gpu_key").isin("L4", "H100"))
    prepared = models.prepare(two, "hardware", FEW, ridge=False)
    run = lambda least: jobs_of(spark, lambda: models.evaluate_prepared(prepared, models.TrainConfig(1, 2), True, least).table.collect())
    assert run(5) <= run(10_000) + 2


def test_the_report_of_no_rows_keeps_its_mean(spark):
    from jouleframe.operators import folds

    none = spark.createDataFrame([], "group string, energy_true double, energy_pred double")
    assert [tuple(r) for r in folds.report_table(none).collect()] == [("MEAN", None, None)]
