"""Error metrics and the sign test as aggregate or scalar Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def relative_error_pct(true: Column, pred: Column, floor: float) -> Column:
    return F.abs(pred - true) / F.greatest(F.abs(true), F.lit(floor)) * 100.0


def mape(true: Column, pred: Column) -> Column:
    """Mean absolute percentage error (aggregate)."""
    return F.avg(relative_error_pct(true, pred, 1e-8))


def ape(true: Column, pred: Column) -> Column:
    """Absolute percentage error of one row, for mean and median reports."""
    return relative_error_pct(true, pred, 1e-12)


def population_sd_rel(x: Column, floor: float) -> Column:
    """Population spread relative to the mean (aggregate)."""
    return F.stddev_pop(x) / F.greatest(F.avg(x), F.lit(floor))


def sign_test_p(wins: Column, n: Column) -> Column:
    """One-sided binomial tail P(X >= wins), X ~ Binomial(n, 1/2); NULL for n <= 0.

    The terms C(n,k)/2^n follow from the previous one by (n-k+1)/k, starting at 2^-n, in
    logs so that large n does not underflow before the tail is reached.
    """
    ln_choose = lambda k: F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0), lambda acc, i: acc + F.ln((n - i + 1) / i))
    first = F.greatest(wins, F.lit(0)).cast("int")
    start = F.exp(ln_choose(first) - n * F.ln(F.lit(2.0)))
    steps = F.when(n > first, F.sequence(first + 1, n.cast("int"))).otherwise(F.array().cast("array<int>"))
    state = F.struct(start.alias("term"), start.alias("total"))
    tail = F.aggregate(
        steps, state,
        lambda s, k: F.struct((s["term"] * (n - k + 1) / k).alias("term"),
                              (s["total"] + s["term"] * (n - k + 1) / k).alias("total")),
        lambda s: s["total"])
    return (F.when(n <= 0, F.lit(None).cast("double")).when(first == 0, 1.0)
            .when(first > n, 0.0).otherwise(tail))
