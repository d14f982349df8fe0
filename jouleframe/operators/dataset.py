"""Measurements to a model-ready dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jouleframe.functions.categories import CategoryRegistry, analysis_failure
from jouleframe.functions.labels import operator_of
from jouleframe.functions.missing import optional
from jouleframe.functions.roofline import roofline_features
from jouleframe.functions.targets import add_targets
from jouleframe.operators.merge import filter_reliable
from jouleframe.sources.hardware import attach_hardware, normal_key


def attach_features(df: DataFrame, clock: str = "tensor", hardware: DataFrame | None = None,
                    on_error: str = "drop", registry: CategoryRegistry | None = None) -> DataFrame:
    """Append analytical columns to measured rows.

    Rows that cannot be analysed are dropped, or make the query fail with their reason when
    ``on_error`` is "raise". ``split_failures`` returns them instead.
    """
    marked = _marked(df, hardware, registry)
    if on_error == "raise":
        checked = F.when(F.col("_reason").isNotNull(), F.raise_error(F.col("_reason")).cast("boolean")).otherwise(True)
        good = marked.filter(checked)
    else:
        good = marked.filter(F.col("_reason").isNull())
    feats = roofline_features(good.drop("_reason"), clock=clock, registry=registry)
    return feats.drop(*[c for c in feats.columns if c.startswith("hw_") and c not in df.columns])


def _marked(df, hardware, registry):
    placed = attach_hardware(df, hardware)
    no_card = F.when(F.col("hw_gpu_key").isNull(),
                     F.concat(F.lit("unknown card "), F.coalesce(F.col("gpu_key"), F.lit("NULL"))))
    return placed.withColumn("_reason", F.coalesce(no_card, analysis_failure(df, registry)))


def split_failures(df: DataFrame, hardware: DataFrame | None = None,
                   registry: CategoryRegistry | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that can be analysed, failed rows with their ``reason``)."""
    marked = _marked(df, hardware, registry)
    ok = marked.filter(F.col("_reason").isNull()).select(*df.columns)
    failed = marked.filter(F.col("_reason").isNotNull()).select(*df.columns, F.col("_reason").alias("reason"))
    return ok, failed


def select_rows(df: DataFrame, cards: list[str] | None = None, categories: list[str] | None = None, operators: list[str] | None = None,
                limit: int | None = None) -> DataFrame:
    """Rows of the named cards, categories and operators (of the external family); ``limit`` takes so many of the first signatures."""
    if cards is not None:
        df = df.filter(normal_key(F.col("gpu_key")).isin([c.strip().upper().replace("-", "_").replace(" ", "_") for c in cards]))
    if categories is not None:
        df = df.filter(F.col("category").isin(categories))
    if operators is not None:
        df = df.filter(operator_of(F.col("category"), optional(df, "kind", "string")).isin(operators))
    return df if limit is None else df.orderBy("kernel_sig", *[c for c in ("gpu_key",) if c in df.columns]).limit(limit)


def failure_causes(failed: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent reasons with their row counts."""
    return (failed.groupBy("reason").agg(F.count("*").alias("n_rows"))
            .orderBy(F.desc("n_rows"), "reason").limit(top))


def build_dataset(measurements: DataFrame, clock: str = "tensor", hardware: DataFrame | None = None,
                  drop_unreliable: bool = True, max_energy_sd_rel: float = 0.05,
                  min_latency_s: float = 5e-6, registry: CategoryRegistry | None = None) -> DataFrame:
    """Filter, attach features and derive targets: one lazy plan without a shuffle."""
    rows = filter_reliable(measurements, max_energy_sd_rel, min_latency_s) if drop_unreliable else measurements
    return add_targets(attach_features(rows, clock, hardware, registry=registry))
