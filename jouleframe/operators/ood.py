"""Distance of kernels from an external model's training distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jouleframe.operators.external import OPERATOR_FEATURES, PREFIX
from jouleframe.operators.quantiles import Quantile, group_quantiles, median


def offset(x: Column, mean: Column) -> Column:
    return F.zip_with(x, mean, lambda a, b: F.log1p(a) - b)


def mahalanobis(d: Column, precision: Column) -> Column:
    """sqrt(max(d' P d, 0)) over an offset vector; pass ``d`` as a plain column, it is read often."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    along = F.zip_with(d, precision, lambda di, row: di * total(F.zip_with(row, d, lambda p, dj: p * dj)))
    return F.sqrt(F.greatest(total(along), F.lit(0.0)))


def with_distance(df: DataFrame, moments: DataFrame, features: dict[str, list[str]] | None = None,
                  out: str = "md") -> DataFrame:
    """Rows with a complete feature vector, with their distance and the moments' quantiles.

    ``moments``: operator, features, mean, precision, md_p99 (one row per operator). A group
    norm is measured against rmsnorm. A feature order other than ours is an error.
    """
    names = features or OPERATOR_FEATURES
    vector, order = None, None
    for op, cols in names.items():
        if not {PREFIX + c for c in cols} <= set(df.columns):
            continue
        test = F.col("pw_operator") == op
        arr = F.array(*[F.col(PREFIX + c).cast("double") for c in cols])
        lit = F.array(*[F.lit(c) for c in cols])
        vector = F.when(test, arr) if vector is None else vector.when(test, arr)
        order = F.when(test, lit) if order is None else order.when(test, lit)
    # The one-row explode computes the vector once, below every filter and lambda that reads it.
    once = df.withColumn("_x", F.explode(F.array(vector)))
    staged = once.withColumns({
        "_order": order, "_ref": F.when(F.col("pw_operator") == "groupnorm", "rmsnorm").otherwise(F.col("pw_operator"))})
    whole = staged.filter(F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))
    m = moments.select(F.col("operator").alias("_ref"), F.col("features").alias("_names"), F.col("mean").alias("_mean"),
                       F.col("precision").alias("_precision"), *[c for c in moments.columns if c.startswith("md_")])
    joined = whole.join(m, "_ref")
    ordered = F.when(F.col("_names") == F.col("_order"), F.col("_x")).otherwise(
        F.raise_error(F.concat(F.lit("moments have another feature order for "), F.col("_ref"))))
    moved = joined.withColumn("_d", F.explode(F.array(offset(ordered, F.col("_mean")))))
    return moved.withColumn(out, mahalanobis(F.col("_d"), F.col("_precision"))).drop(
        "_x", "_d", "_order", "_ref", "_names", "_mean", "_precision")


def ood_report(df: DataFrame, moments: DataFrame, quantile: str = "md_p99", features: dict[str, list[str]] | None = None) -> DataFrame:
    """Per (operator, card): median and p95 distance, and the share beyond the training quantile."""
    d = with_distance(df, moments, features, "_md")
    out = group_quantiles(
        d, ["pw_operator", "gpu_key"], [median("md_median", F.col("_md")), Quantile("md_p95", F.col("_md"), 0.95)],
        [F.count("*").alias("n"), F.max("md_p99").alias("train_p99"),
         F.avg((F.col("_md") > F.col(quantile)).cast("double")).alias("frac_beyond_train_p99")])
    return (out.select(F.col("pw_operator").alias("operator"), "gpu_key", "n", "md_median", "md_p95", "train_p99", "frac_beyond_train_p99")
            .orderBy(F.desc("frac_beyond_train_p99"), "operator", "gpu_key"))
