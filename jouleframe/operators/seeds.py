"""Comparing experiment arms over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jouleframe.functions.labels import seed_verdict
from jouleframe.functions.metrics import sign_test_p
from jouleframe.operators.quantiles import group_quantiles, median

METRICS = ("zeroshot", "finetuned", "scratch", "hybrid", "ft_med", "pi_ft", "eta_ft")
CELL = ["gpu", "operator"]


def _half_range(c: str):
    return (F.max(c) - F.min(c)) / 2.0


def seed_summary(runs: DataFrame, metrics=METRICS) -> DataFrame:
    """Median and half the min-max range of each metric per cell, with the seeds behind it."""
    present = [m for m in metrics if m in runs.columns]
    aggs = [F.min("n_test").alias("n_test"), F.countDistinct("seed").alias("seeds")]
    aggs += [_half_range(m).alias(f"{m}_pm") for m in present]
    return group_quantiles(runs, CELL, [median(m, F.col(m)) for m in present], aggs, bounded_groups=True)  # the seeds of one cell


def pair_arms(a: DataFrame, b: DataFrame, metric: str = "hybrid") -> DataFrame:
    """The two arms side by side on (gpu, operator, seed)."""
    keys = [*CELL, "seed"]
    left = a.select(*keys, "n_test", F.col(metric).alias("a"))
    right = b.select(*keys, F.col(metric).alias("b"))
    return left.join(right, keys).withColumn("delta", F.col("b") - F.col("a"))


def require_shared_cells(pairs: DataFrame) -> DataFrame:
    if not pairs.take(1):
        raise ValueError("the two arms share no (gpu, operator, seed) cells")
    return pairs


def per_cell(pairs: DataFrame) -> DataFrame:
    """Medians, median difference, wins of b and the sign test per cell."""
    out = group_quantiles(
        pairs.filter(F.col("operator") != "-"), CELL,
        [median("a", F.col("a")), median("b", F.col("b")), median("delta", F.col("delta"))],
        [F.min("n_test").alias("n_test"), F.countDistinct("seed").alias("seeds"), F.count_if(F.col("delta") < 0).alias("b_wins")], bounded_groups=True)
    return out.withColumn("p_sign", sign_test_p(F.col("b_wins"), F.col("seeds")))


def pooled_verdict(pairs: DataFrame) -> DataFrame:
    """One row over the pooled cells (operator '-'): medians, ranges, wins, sign test, reading."""
    a, b, d = F.col("a"), F.col("b"), F.col("delta")
    out = group_quantiles(
        pairs.filter(F.col("operator") == "-"), [],
        [median("a_median", a), median("b_median", b), median("delta_median", d)],
        [F.count("*").alias("seeds"), F.min(a).alias("a_min"), F.max(a).alias("a_max"),
         F.min(b).alias("b_min"), F.max(b).alias("b_max"), F.count_if(d < 0).alias("b_wins")], bounded_groups=True)  # the seeds
    out = out.filter(F.col("seeds") > 0).withColumn("p_sign", sign_test_p(F.col("b_wins"), F.col("seeds")))
    return out.withColumn("reading", seed_verdict(F.col("b_wins"), F.col("seeds"), F.col("p_sign")))


def paired_compare(a: DataFrame, b: DataFrame, metric: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """(per-cell table, pooled verdict); negative delta means ``b`` scored lower, i.e. better."""
    pairs = require_shared_cells(pair_arms(a, b, metric))
    return per_cell(pairs), pooled_verdict(pairs)
