"""Two-head predictors of efficiency and power fraction, evaluated by fold.

Features are binned once and written with the baselines of the fold; every fold, head, category
and seed fits on that table. All fits grow side by side (``boosting``), which leaves their loss
curves too. One pass scores each held-out row, for all seeds, by the model that it is routed to:
its category's specialist in its fold, or the fold's generalist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from jouleframe.functions.roofline import FEATURE_COLUMNS
from jouleframe.functions.targets import energy_from_heads, latency_from_eta
from jouleframe.operators.boosting import BINS, FIRST_BIN, Boosted, Fit, Grower, bins_of, blocks, boosted, label
from jouleframe.operators.folds import VECTOR, fold_column, fold_groups, report_table, with_baselines, written_rows
from jouleframe.runtime import find_package, written

HEADS = ("eta", "pi")
HISTORY_SCHEMA = "fold string, `group` string, model string, head string, train array<double>, val array<double>, test array<double>, best_epoch int"


@dataclass(frozen=True)
class TrainConfig:
    max_iter: int = 30
    max_depth: int = 4
    step: float = 0.15
    val_fraction: float = 0.15
    seed: int = 0


@dataclass(frozen=True)
class Prepared:
    """What all fits of a fold share: rows with binned features and baselines, and the groups to hold out."""
    rows: DataFrame
    fold: str
    groups: list[str]
    width: int  # features


@dataclass
class Evaluation:
    table: DataFrame
    predictions: DataFrame
    histories: list[tuple] = field(default_factory=list)


def validation_flag(cfg: TrainConfig, keys: list[str]):
    """Deterministic split by row key, the same whatever the partitioning."""
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(cfg.seed)), F.lit(10_000))
    return bucket < int(cfg.val_fraction * 10_000)


def best_epoch(losses: list[float], threshold: float = 1e-6) -> int:
    """Epoch of the last validation loss that improved on the best by more than ``threshold``."""
    best, at = float("inf"), -1
    for i, v in enumerate(losses):
        if v < best - threshold:
            best, at = v, i
    return at


def binned(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with the bins of their features as a string ``_x`` in place of the features; bins are the quantiles of all rows."""
    columns = rows.select(*[F.col(VECTOR)[i].alias(f"f{i}") for i in range(width)])
    cuts = columns.approxQuantile(columns.columns, [k / BINS for k in range(1, BINS)], 1.0 / (8 * BINS)) if width else []
    cuts = [np.array(sorted(set(c))) for c in cuts]
    names = [c for c in rows.columns if c != VECTOR]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = batch.column(VECTOR).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            x = np.full((n, max(width, 1)), FIRST_BIN, np.uint8)
            for i, c in enumerate(cuts):
                x[:, i] += np.searchsorted(c, values[:, i]).astype(np.uint8)
            ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            text = pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(x.tobytes()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], text], [*names, "_x"])

    schema = StructType([rows.schema[c] for c in names]).add("_x", StringType())
    return rows.select(*names, VECTOR).mapInArrow(place, schema)


def prepare(df: DataFrame, fold: str = "hardware", features: list[str] | None = None, min_rows: int = 10, ridge: bool = True) -> Prepared:
    """Rows of ``df`` ready for any number of fits, seeds and arms."""
    features = [c for c in FEATURE_COLUMNS if c in df.columns] if features is None else features
    find_package(df.sparkSession)
    rows = written_rows(df, fold, features)
    groups = [g for g, _, _ in fold_groups(rows, fold, min_rows)]
    logs = {f"_log_{h}": F.when(F.col(h) > 0, label(F.col(h))).otherwise(F.raise_error(F.lit(f"{h} must be positive"))) for h in HEADS}
    ready = written(binned(with_baselines(rows, fold, groups, ridge).withColumns(logs), len(features)))
    # For Spark ML alone; a column that nobody reads costs nothing.
    bins = F.array(*[(F.ascii(F.substring("_x", i + 1, 1)) - FIRST_BIN).cast("double") for i in range(len(features))]).cast("array<double>")
    return Prepared(ready.withColumn("bins", array_to_vector(bins)), fold, groups, len(features))


def _trained(train: DataFrame, head: str, cfg: TrainConfig):
    """One head's trees. Early stopping reads the validation rows alone."""
    gbt = GBTRegressor(
        featuresCol="bins", labelCol=f"_log_{head}", lossType="absolute", maxIter=cfg.max_iter, maxDepth=cfg.max_depth, maxBins=BINS,
        stepSize=cfg.step, seed=cfg.seed, validationIndicatorCol="_val")
    return gbt.fit(train)


def _fit(train: DataFrame, test: DataFrame, head: str, cfg: TrainConfig):
    """One head's trees and its curves by Spark ML, which reads the rows again for every level, round and side: what ``boosting`` is held against."""
    model = _trained(train, head, cfg)
    sides = (train.filter(~F.col("_val")), train.filter("_val"), test)
    return model, [[float(x) for x in model.evaluateEachIteration(d, "absolute")] for d in sides]


def _specialists(prepared: Prepared, least: int) -> set[tuple[str, str]]:
    """(group, category) pairs present in the group, with enough rows of the category in its complement."""
    col = fold_column(prepared.fold)
    cells = prepared.rows.groupBy(F.col(col).alias("g"), "category").agg(F.count("*").alias("n")).collect()  # one row per cell of the report
    total: dict[str, int] = {}
    for r in cells:
        total[r["category"]] = total.get(r["category"], 0) + r["n"]
    return {(r["g"], r["category"]) for r in cells if r["g"] in prepared.groups and total[r["category"]] - r["n"] >= least}


def _grown(prepared: Prepared, cfg: TrainConfig, seeds: list[int], special: set[tuple[str, str]], per_category: bool) -> Boosted:
    """Both heads of every fold, category and seed."""
    key = F.col(fold_column(prepared.fold)).cast("string")
    present = set(map(str, prepared.groups))
    if per_category:
        cells = prepared.rows.select(key.alias("g"), "category").distinct().collect()
        present = {r["g"] for r in cells if (r["g"], r["category"]) not in special}
    wanted = [(str(g), "all") for g in prepared.groups if str(g) in present] + sorted(special)
    fits = [Fit(i, g, name, head) for i in range(len(seeds)) for g, name in wanted for head in range(len(HEADS))]
    ids = [c for c in ("kernel_sig", "gpu_key") if c in prepared.rows.columns]
    flags = reduce(lambda a, b: a.bitwiseOR(b), [F.when(validation_flag(replace(cfg, seed=s), ids), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, s in enumerate(seeds)])
    labels = [f"_log_{h}" for h in HEADS]
    slim = prepared.rows.select(key.alias("g"), F.col("category").cast("string").alias("category"), F.col("_x").alias("x"), flags.alias("val"), *labels)
    return Grower(blocks(slim, labels, len(seeds)), fits, special, len(seeds), prepared.width, cfg.max_iter, cfg.max_depth, cfg.step).run()


def _scored(prepared: Prepared, cfg: TrainConfig, found: Boosted, special: set[tuple[str, str]], seeds: int) -> DataFrame:
    """Held-out rows with the logarithms that their models say, ``_{head}_{place of the seed}``, in one pass."""
    trees, depth, step = found.trees, cfg.max_depth, cfg.step
    made = [f"_{h}_{i}" for i in range(seeds) for h in HEADS]
    rows = prepared.rows.filter("group IS NOT NULL").drop("bins", *[f"_log_{h}" for h in HEADS])
    names = [c for c in rows.columns if c != "_x"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, out = bins_of(batch.column("_x")), np.empty((len(made), batch.num_rows))
            held, category = (batch.column(c).cast(pa.string()).dictionary_encode("encode") for c in ("group", "category"))
            pair = held.indices.to_numpy() * len(category.dictionary) + category.indices.to_numpy()
            for p in np.unique(pair):
                mine = np.flatnonzero(pair == p)
                g, c = held.dictionary[p // len(category.dictionary)].as_py(), category.dictionary[p % len(category.dictionary)].as_py()
                model = c if (g, c) in special else "all"
                for k in range(len(made)):
                    out[k, mine] = boosted(trees[Fit(k // len(HEADS), g, model, k % len(HEADS))], x[mine], depth, step)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, out)], [*names, *made])

    schema = StructType([rows.schema[c] for c in names])
    for c in made:
        schema = schema.add(c, "double")
    return rows.select(*names, "_x").mapInArrow(score, schema)


def _predictions(scored: DataFrame, fold: str) -> DataFrame:
    """Energies, latencies and heads of rows with the logarithms ``_{head}``."""
    scored = scored.withColumns({f"{h}_pred": F.least(F.exp(f"_{h}"), F.lit(1.0)) for h in HEADS})
    theory, tdp = F.col("theoretical_time_s"), F.col("tdp_w")
    ids = list(dict.fromkeys(c for c in ("seed", "group", fold_column(fold), "category", "gpu_key", "source_model", "kernel_sig") if c in scored.columns))
    base = [c for c in ("roofline_pred", "constant_pred", "ridge_pred") if c in scored.columns]
    return scored.select(
        *ids, F.col("energy_j").alias("energy_true"),
        energy_from_heads(F.col("eta_pred"), F.col("pi_pred"), theory, tdp).alias("energy_pred"),
        F.col("latency_s").alias("latency_true"), latency_from_eta(F.col("eta_pred"), theory).alias("latency_pred"),
        F.col("eta").alias("eta_true"), "eta_pred", F.col("pi").alias("pi_true"), "pi_pred", *base)


def evaluate_prepared(prepared: Prepared, cfg: TrainConfig = TrainConfig(), per_category: bool = False, min_category_rows: int = 40) -> Evaluation:
    """Fit both heads of every fold side by side and score all held-out rows in one pass."""
    special = {(str(g), c) for g, c in _specialists(prepared, min_category_rows)} if per_category else set()
    found = _grown(prepared, cfg, [cfg.seed], special, per_category)
    histories = [(prepared.fold, f.group, f.model, HEADS[f.head], *curves, best_epoch(curves[1])) for f, curves in found.losses.items()]
    scored = _scored(prepared, cfg, found, special, 1)
    preds = _predictions(scored.withColumnsRenamed({f"_{h}_0": f"_{h}" for h in HEADS}), prepared.fold)
    return Evaluation(report_table(preds), preds, histories)


def evaluate(df: DataFrame, fold: str = "hardware", features: list[str] | None = None, cfg: TrainConfig = TrainConfig(),
             min_rows: int = 10, per_category: bool = False, min_category_rows: int = 40, ridge: bool = True) -> Evaluation:
    """Leave each group out, fit on the rest, and report errors against the baselines."""
    return evaluate_prepared(prepare(df, fold, features, min_rows, ridge), cfg, per_category, min_category_rows)


def run_seeds(df: DataFrame, seeds: int = 5, base_seed: int = 0, arm: str = "run", cfg: TrainConfig = TrainConfig(), fold: str = "hardware",
              features: list[str] | None = None, min_rows: int = 10, ridge: bool = True, per_category: bool = False, min_category_rows: int = 40) -> DataFrame:
    """``evaluate`` over consecutive seeds: every table row tagged with its seed and arm.

    Rows, bins, baselines and Gram sums are made once; the fits of all seeds grow side by side.
    """
    prepared = prepare(df, fold, features, min_rows, ridge)
    special = {(str(g), c) for g, c in _specialists(prepared, min_category_rows)} if per_category else set()
    numbers = list(range(base_seed, base_seed + seeds))
    scored = _scored(prepared, cfg, _grown(prepared, cfg, numbers, special, per_category), special, seeds)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), *[F.col(f"_{h}_{i}").alias(f"_{h}") for h in HEADS]) for i, s in enumerate(numbers)])).alias("s")
    preds = _predictions(scored.select(*[c for c in prepared.rows.columns if c in scored.columns], each).select("*", "s.*"), fold)
    return report_table(preds, "seed").withColumn("arm", F.lit(arm))


def histories_source(spark, histories: list[tuple]) -> DataFrame:
    return spark.createDataFrame(histories, HISTORY_SCHEMA)


def histories_frame(histories: DataFrame) -> DataFrame:
    """Loss arrays to tidy rows (fold, group, model, epoch, best_epoch, split, loss)."""
    ids = [c for c in ("fold", "group", "model", "head") if c in histories.columns]
    splits = [s for s in ("train", "val", "test") if s in histories.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("losses")) for s in splits])).alias("h")
    tall = histories.select(*ids, "best_epoch", pairs)
    return tall.select(*ids, "best_epoch", "h.split", F.posexplode("h.losses").alias("epoch", "loss"))


def curve_summary(tidy: DataFrame) -> DataFrame:
    """Epochs, best epoch, and each split's loss at the best and the last epoch."""
    ids = [c for c in ("fold", "group", "model", "head") if c in tidy.columns]
    aggs = [F.max("epoch").alias("_last"), F.max("best_epoch").alias("best_epoch")]
    for s in ("train", "val", "test"):
        mine = F.col("split") == s
        aggs += [F.max(F.when(mine & (F.col("epoch") == F.col("best_epoch")), F.col("loss"))).alias(f"{s}_at_best"),
                 F.max_by("loss", F.when(mine, F.col("epoch"))).alias(f"{s}_at_last")]
    out = tidy.groupBy(*ids).agg(*aggs)
    return out.withColumn("epochs", F.col("_last") + 1).drop("_last")


def best_epochs(tidy: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """Per fit, the epoch whose validation loss was the last to improve on the best before it by more than ``threshold``."""
    ids = [c for c in ("fold", "group", "model", "head") if c in tidy.columns]
    in_order = F.array_sort(F.collect_list(F.struct("epoch", "loss")))  # a loss per epoch of one fit
    start = F.struct(F.lit(-1).alias("epoch"), F.lit(float("inf")).alias("loss"))
    better = lambda best, x: F.when(x["loss"] < best["loss"] - threshold, F.struct(x["epoch"].cast("int").alias("epoch"), x["loss"].cast("double").alias("loss"))).otherwise(best)
    return (tidy.filter(F.col("split") == "val").groupBy(*ids).agg(F.aggregate(in_order, start, better).alias("b"))
            .select(*ids, F.col("b.epoch").alias("best_epoch"), F.when(F.col("b.epoch") >= 0, F.col("b.loss")).alias("best_val")))
