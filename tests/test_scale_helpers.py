import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from jouleframe.operators import quantiles
from jouleframe.operators.ordering import with_running
from jouleframe.operators.quantiles import Quantile, group_quantiles, median


def skewed(spark, n=6000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        v = None if rng.random() < 0.05 else (7.5 if g == "hot" and rng.random() < 0.4 else rng.lognormvariate(0, 2))
        rows.append((g, v, rng.randrange(5), i))
    rows += [("one", 3.0, 1, n), ("none", None, 1, n + 1), (None, 2.0, 1, n + 2), (None, 4.0, 1, n + 3)]
    return spark.createDataFrame(rows, "g string, v double, w int, i long").repartition(7), rows


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_bracketed_quantiles_are_exact(spark, accuracy):
    df, rows = skewed(spark)
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    wanted = [Quantile(f"q{j}", F.col("v"), q) for j, q in enumerate(qs)] + [median("odd", F.when(F.col("w") > 2, F.col("v")))]
    got = {r["g"]: r for r in group_quantiles(df, ["g"], wanted, [F.count("*").alias("n")], accuracy=accuracy).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        vals = [v for k, v, _, _ in rows if k == g and v is not None]
        assert r["n"] == sum(1 for k, *_ in rows if k == g)
        for j, q in enumerate(qs):
            assert r[f"q{j}"] == (pytest.approx(float(np.quantile(vals, q)), rel=1e-12) if vals else None)
        odd = [v for k, v, w, _ in rows if k == g and v is not None and w > 2]
        assert r["odd"] == (pytest.approx(float(np.median(odd)), rel=1e-12) if odd else None)


def test_quantiles_without_keys(spark):
    df, rows = skewed(spark)
    for bounded in (True, False):
        r = group_quantiles(df, [], [median("m", F.col("v"))], [F.count("v").alias("n")], bounded_groups=bounded, accuracy=50).first()
        vals = [v for _, v, _, _ in rows if v is not None]
        assert r["m"] == pytest.approx(float(np.median(vals))) and r["n"] == len(vals)


@pytest.mark.parametrize("keys", [["g"], []])
def test_running_sums_agree_with_a_window(spark, keys):
    df, _ = skewed(spark, 900)
    order = [F.desc_nulls_last("v"), F.col("i")]
    w = Window.partitionBy(*keys).orderBy(*order)
    a = df.withColumns({"s": F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "r": F.row_number().over(w).cast("bigint")})
    b = with_running(df, keys, order, {"s": F.col("w")}, "r")
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_no_group_gathers_in_one_buffer(spark, monkeypatch):
    """Plans for unbounded groups never hold a group in an exact percentile buffer."""
    monkeypatch.setattr(quantiles, "written", lambda d: d)  # to see the whole plan
    df, _ = skewed(spark, 300)
    text = group_quantiles(df, ["g"], [median("m", F.col("v"))])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in text or "approx_percentile" in text
    assert " percentile(" not in text


def test_merge_keeps_one_row_per_key_before_the_shuffle(spark):
    from jouleframe.operators.merge import merge_measurements

    df, _ = skewed(spark, 300)
    out = merge_measurements(df.withColumns({"kernel_sig": F.col("g"), "gpu_key": F.lit("L4")}), ["i"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_only_rows_inside_a_bracket_are_taken_apart(spark, monkeypatch):
    """Rows below a bracket are counted by a plain aggregate: no slot of theirs is exploded."""
    monkeypatch.setattr(quantiles, "written", lambda d: d)  # to see the whole plan
    df, _ = skewed(spark, 300)
    plan = group_quantiles(df, ["g"], [median("m", F.col("v")), median("n", F.col("w"))])._jdf.queryExecution().optimizedPlan().toString()
    assert "count_if" in plan or "count(if" in plan
