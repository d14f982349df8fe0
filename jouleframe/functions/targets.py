"""Bounded targets derived from measured columns, and their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def add_targets(df: DataFrame, latency_col: str = "latency_s", energy_col: str = "energy_j",
                theory_col: str = "theoretical_time_s", tdp_col: str = "tdp_w",
                idle_col: str = "idle_power_w", limit_col: str = "power_limit_w") -> DataFrame:
    """eta, pi and their companions. Optional inputs degrade to neutral columns."""
    lat, en, theory, tdp = (F.col(c).cast("double") for c in (latency_col, energy_col, theory_col, tdp_col))
    power = en / lat
    null = F.lit(None).cast("double")
    out = {"eta": theory / lat, "power_avg_w": power, "pi": power / tdp, "pi_dynamic": null, "energy_dynamic_j": null}
    if idle_col in df.columns:
        idle = F.col(idle_col).cast("double")
        # Missing stays missing: GREATEST alone would skip the NULL and return the bound.
        head = F.greatest(tdp - idle, F.lit(1e-6))
        dyn = (power - idle) / head
        spent = en - idle * lat
        out["pi_dynamic"] = F.when(dyn.isNotNull() & (tdp - idle).isNotNull(), F.greatest(dyn, F.lit(1e-6)))
        out["energy_dynamic_j"] = F.when(spent.isNotNull(), F.greatest(spent, F.lit(0.0)))
    if limit_col in df.columns:
        given = F.col(limit_col).cast("double")
        limit = F.coalesce(F.when(given > 0, given), tdp)
        out |= {"pi_limit": power / limit, "power_cap_ratio": limit / tdp}
    else:
        out |= {"pi_limit": power / tdp, "power_cap_ratio": F.lit(1.0)}
    out["log_energy"] = F.when(en.isNotNull(), F.ln(F.greatest(en, F.lit(1e-12))))
    out["log_latency"] = F.when(lat.isNotNull(), F.ln(F.greatest(lat, F.lit(1e-12))))
    if "analytic_flops" in df.columns:
        flops = F.greatest(F.col("analytic_flops").cast("double"), F.lit(1.0))
        out |= {"energy_per_flop_j": en / flops, "pj_per_flop": en / flops * 1e12}
    if "analytic_bytes_global" in df.columns:
        out["pj_per_byte"] = en / F.greatest(F.col("analytic_bytes_global").cast("double"), F.lit(1.0)) * 1e12
    return df.withColumns(out)


def energy_from_heads(eta: Column, pi: Column, theory: Column, tdp: Column, eta_floor: Column | float = 1e-6) -> Column:
    """Energy implied by an efficiency and a power fraction; eta is held off zero."""
    floor = eta_floor if isinstance(eta_floor, Column) else F.lit(float(eta_floor))
    return pi * tdp * theory / F.greatest(eta, floor)


def latency_from_eta(eta: Column, theory: Column) -> Column:
    return theory / F.greatest(eta, F.lit(1e-6))


def training_eta_floor(min_train_eta: Column) -> Column:
    """Half the smallest efficiency seen in training, as a bound for the division."""
    return F.greatest(min_train_eta * 0.5, F.lit(1e-8))


def complement_eta_floors(df: DataFrame, fold: str) -> DataFrame:
    """Per held-out value of ``fold``, the floor that all rows of the other values give.

    Only the two smallest minima are needed: a value's complement has the smallest one,
    unless the value holds it itself.
    """
    lows = df.groupBy(fold).agg(F.min("eta").alias("lo"))
    # One row per held-out unit.
    all_ = Window.orderBy(F.asc_nulls_last("lo"), fold).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = lows.withColumns({"_rank": F.row_number().over(Window.orderBy(F.asc_nulls_last("lo"), fold)),
                               "_lowest": F.nth_value("lo", 1).over(all_), "_next": F.nth_value("lo", 2).over(all_)})
    return ranked.select(fold, training_eta_floor(F.when(F.col("_rank") == 1, F.col("_next")).otherwise(F.col("_lowest"))).alias("floor"))


def subtract_overhead(df: DataFrame, latency: str = "latency_s", energy: str = "energy_raw_j",
                      overhead_s: str = "overhead_s", overhead_j: str = "overhead_j") -> DataFrame:
    """Net latency, energy and power after removing the cost of an empty launch.

    Rows without a priced overhead keep their raw figures.
    """
    lat = F.when(F.col(overhead_s).isNotNull(), F.greatest(F.col(latency) - F.col(overhead_s), F.lit(1e-9))).otherwise(F.col(latency))
    en = F.when(F.col(overhead_j).isNotNull(), F.greatest(F.col(energy) - F.col(overhead_j), F.lit(1e-12))).otherwise(F.col(energy))
    staged = df.withColumns({"latency_s": lat, "energy_j": en})
    return staged.withColumn("power_avg_w", F.col("energy_j") / F.greatest(F.col("latency_s"), F.lit(1e-12)))
