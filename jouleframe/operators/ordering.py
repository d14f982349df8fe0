"""Ranks and running sums over groups of any size.

A window over one hot group (or over no group at all) sorts it in a single task. Instead the
frame is range-sorted across tasks, written once so positions are fixed, and each task's run
is offset by the totals of the runs before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jouleframe.runtime import written


def with_running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None,
                 rank: str | None = None) -> DataFrame:
    """Add inclusive running sums and a 1-based row number; ``order`` must be total per group."""
    sums = sums or {}
    staged = df.withColumns({f"_x_{n}": v for n, v in sums.items()})
    placed = written(staged.orderBy(*[F.col(k) for k in keys], *order)
                         .withColumn("_pos", F.monotonically_increasing_id())
                         .withColumn("_run", F.shiftright("_pos", 33)))
    run_keys = [*keys, "_run"]
    totals = placed.groupBy(*run_keys).agg(
        F.count("*").alias("_n"), *[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums])
    # One row per (group, task), so the hottest group has at most as many as there are tasks.
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_run").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(run_keys)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s0_{n}") for n in sums])
    on = F.lit(True)
    for i, k in enumerate(run_keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*run_keys).orderBy("_pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {n: F.col(f"_s0_{n}") + F.sum(f"_x_{n}").over(upto) for n in sums}
    if rank:
        cols[rank] = (F.col("_n0") + F.row_number().over(w)).cast("bigint")
    return placed.join(offsets, on).withColumns(cols).select(*df.columns, *cols)
