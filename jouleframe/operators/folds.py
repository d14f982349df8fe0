"""Leave-one-group-out evaluation: groups, baselines and report tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from jouleframe.functions.metrics import mape
from jouleframe.functions.missing import require_columns
from jouleframe.functions.targets import energy_from_heads
from jouleframe.operators.quantiles import group_quantiles, median
from jouleframe.runtime import written

FOLDS = {"hardware": "gpu_key", "architecture": "source_model", "category": "category"}
NEEDED = ["eta", "pi", "energy_j", "latency_s", "theoretical_time_s", "tdp_w"]
VECTOR = "features"  # the model features of a row, as one array


def fold_column(fold: str) -> str:
    if fold not in FOLDS:
        raise ValueError(f"fold must be one of {sorted(FOLDS)}, got {fold!r}")
    return FOLDS[fold]


def complete_rows(df: DataFrame, fold: str, features: list[str]) -> DataFrame:
    """Rows usable in a fold: no missing feature, target or energy."""
    col = fold_column(fold)
    require_columns(df, [col], f"needed for the {fold} fold")
    require_columns(df, NEEDED, "run add_targets first")
    require_columns(df, features)
    return df.dropna(subset=list(dict.fromkeys([*features, "eta", "pi", "energy_j", col])))


def written_rows(df: DataFrame, fold: str, features: list[str]) -> DataFrame:
    """The rows of ``complete_rows``, written once with their features as one array.

    Every fold, baseline and fit reads them again. Rows are written before the incomplete
    ones are left out, so that no filter carries the feature formulas a second time.
    """
    complete_rows(df, fold, features)  # for its refusals
    ids = [c for c in ("kernel_sig", "gpu_key", "category", "source_model", *NEEDED) if c in df.columns]
    packed = F.array(*[F.col(f).cast("double") for f in features]).cast("array<double>")
    whole = ~F.exists(VECTOR, lambda x: x.isNull() | F.isnan(x))
    # The explode of one array keeps the flag from repeating the formulas; passes that need no features then read none.
    packed = df.select(*dict.fromkeys([*ids, fold_column(fold)]), F.explode(F.array(packed)).alias(VECTOR))
    rows = written(packed.withColumn("_whole", whole))
    return rows.filter("_whole").drop("_whole").dropna(subset=["eta", "pi", "energy_j", fold_column(fold)])


def fold_groups(df: DataFrame, fold: str, min_rows: int = 10) -> list[tuple[str, int, int]]:
    """(group, training rows, test rows) of every group with enough rows on both sides.

    Groups are the held-out units of a fold: cards, combinations of models, categories. The
    list is as long as there are units, since each is fitted and reported by itself.
    """
    col = fold_column(fold)
    counts = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(col).collect()
    total = sum(r["n"] for r in counts)
    out = [(r[col], total - r["n"], r["n"]) for r in counts if r["n"] >= min_rows and total - r["n"] >= min_rows]
    if not out:
        raise RuntimeError(f"no {fold} fold had at least {min_rows} rows on both sides")
    return out


def _lookup(values: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def complement_medians(df: DataFrame, fold: str, groups: list[str]) -> DataFrame:
    """Per group, the median eta and pi of all other groups: one pass, no copies of the rows."""
    col = fold_column(fold)
    wanted = []
    for i, g in enumerate(groups):
        outside = F.col(col) != g
        wanted += [median(f"eta_{i}", F.when(outside, F.col("eta"))), median(f"pi_{i}", F.when(outside, F.col("pi")))]
    one = group_quantiles(df, [], wanted)
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"eta_{i}").alias("eta_const"), F.col(f"pi_{i}").alias("pi_const"))
                               for i, g in enumerate(groups)])).alias("r")
    return one.select(rows).select("r.*")


# --- ridge on log energy ------------------------------------------------------------------


def group_grams(rows: DataFrame, fold: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gram matrix [1, x, y]'[1, x, y] of every group, and the means and deviations of x and y = log energy.

    x and y are standardised over all rows first. A task multiplies batch by batch and hands on
    one matrix of (features + 2) squared per group, which are then summed.
    """
    col = F.col(fold_column(fold)).cast("string").alias("group")
    values = F.concat(VECTOR, F.array(F.ln("energy_j")))
    z = rows.select(col, values.alias("z"))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="z", outputCol="s").fit(z.select(array_to_vector("z").alias("z")))
    mean, sd = scaler.mean.toArray(), scaler.std.toArray()
    scale = np.where(sd > 0, sd, np.inf)
    width = len(mean) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.ones((batch.num_rows, width))
            x[:, 1:] = (batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1) - mean) / scale
            groups = batch.column("group").dictionary_encode()
            of = groups.indices.to_numpy()
            for i, group in enumerate(groups.dictionary.to_pylist()):
                part = x[of == i]
                sums[group] = sums.get(group, 0.0) + part.T @ part
        at = pa.array(np.arange(width * width, dtype=np.int32))
        for group, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(at), pa.string()), at, pa.array(m.ravel())], ["group", "at", "v"])

    sums = z.mapInArrow(products, "group string, at int, v double").groupBy("group", "at").agg(F.sum("v").alias("v"))
    grams: dict[str, np.ndarray] = {}
    for r in sums.collect():  # a matrix per held-out unit
        grams.setdefault(r["group"], np.zeros(width * width))[r["at"]] = r["v"]
    return {g: m.reshape(width, width) for g, m in grams.items()}, mean, sd


def ridge_from_gram(gram: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge on standardised features from a Gram matrix: (coefficients on x, intercept)."""
    n = gram[0, 0]
    mean, second = gram[0, 1:] / n, gram[1:, 1:] / n
    cov = second - np.outer(mean, mean)
    flat = np.diag(cov)[:-1] <= 1e-10 * np.diag(second)[:-1]  # one value but for rounding: no coefficient
    sd = np.sqrt(np.where(flat, 1.0, np.diag(cov)[:-1]))
    use = np.where(flat, 0.0, 1.0 / sd)
    a = n * cov[:-1, :-1] * np.outer(use, use) + alpha * np.eye(len(sd))
    coef = np.linalg.solve(a, n * cov[:-1, -1] * use) * use
    return coef, float(mean[-1] - coef @ mean[:-1])


def ridge_predictions(rows: DataFrame, fold: str, groups: list[str], alpha: float = 1.0) -> Column:
    """Energy predicted for each row by the ridge fitted on all other groups.

    The training Gram of a fold is the total minus the group's own, so one pass fits every fold.
    """
    grams, mean, sd = group_grams(rows, fold)
    total = sum(grams.values())
    scale = np.where(sd[:-1] > 0, sd[:-1], np.inf)
    coefs, shifts = {}, {}
    for g in groups:
        coef, intercept = ridge_from_gram(total - grams[str(g)], alpha)
        coefs[str(g)] = coef / scale * sd[-1]
        shifts[str(g)] = mean[-1] + sd[-1] * intercept - float(coefs[str(g)] @ mean[:-1])
    key = F.col(fold_column(fold)).cast("string")
    pairs = [x for g, c in coefs.items() for x in (F.lit(g), F.array(*[F.lit(float(v)) for v in c]))]
    weights = F.try_element_at(F.create_map(*pairs), key)
    dot = F.aggregate(F.zip_with(weights, VECTOR, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.exp(dot + _lookup(shifts, key))


# --- reports --------------------------------------------------------------------------------


def with_baselines(rows: DataFrame, fold: str, groups: list[str], ridge: bool = True, constant: bool = True) -> DataFrame:
    """``written_rows`` with the energy that each baseline predicts; NULL outside of ``groups``."""
    theory, tdp = F.col("theoretical_time_s"), F.col("tdp_w")
    one = F.lit(1.0)
    key = F.col(fold_column(fold))
    cols = {"group": F.when(key.isin(*groups), key.cast("string")), "roofline_pred": energy_from_heads(one, one, theory, tdp)}
    if constant:
        consts = {r["group"]: r for r in complement_medians(rows, fold, groups).collect()}
        cols["constant_pred"] = energy_from_heads(_lookup({g: consts[g]["eta_const"] for g in groups}, key),
                                                  _lookup({g: consts[g]["pi_const"] for g in groups}, key), theory, tdp)
    if ridge:
        cols["ridge_pred"] = ridge_predictions(rows, fold, groups)
    return rows.withColumns(cols)


REPORT_PAIRS = {
    "energy": ("energy_true", "energy_pred"), "latency": ("latency_true", "latency_pred"),
    "eta": ("eta_true", "eta_pred"), "pi": ("pi_true", "pi_pred"),
    "roofline": ("energy_true", "roofline_pred"), "constant": ("energy_true", "constant_pred"), "ridge": ("energy_true", "ridge_pred"),
}


def report_table(predictions: DataFrame, *by: str) -> DataFrame:
    """Errors per held-out group plus MEAN (groups weigh equally) and POOLED (rows weigh equally), each once per value of ``by``.

    A group's line counts for itself and for MEAN, so the predictions are made once.
    """
    present = {k: p for k, p in REPORT_PAIRS.items() if set(p) <= set(predictions.columns)}
    aggs = [F.count("*").alias("n_test")] + [mape(F.col(t), F.col(p)).alias(k) for k, (t, p) in present.items()]
    sets = [[*map(F.col, by), F.col("group")], [*map(F.col, by)]]
    rolled = predictions.groupingSets(sets, *by, "group").agg(F.grouping("group").alias("_all"), *aggs)
    line = lambda name, of: F.struct(name.alias("group"), F.lit(of).alias("of"))
    lines = F.when(F.col("_all") == 1, F.array(line(F.lit("POOLED"), "all"))).otherwise(F.array(line(F.col("group"), "one"), line(F.lit("MEAN"), "each")))
    told = rolled.select(*by, F.explode(lines).alias("_line"), "n_test", *present)
    if not by:  # MEAN stands in the table of no rows too
        none = [F.lit(None).cast("bigint").alias("n_test"), *[F.lit(None).cast("double").alias(k) for k in present]]
        told = told.unionByName(predictions.sparkSession.range(1).select(line(F.lit("MEAN"), "each").alias("_line"), *none))
    out = told.groupBy(*by, "_line").agg(F.sum("n_test").alias("n_test"), *[F.avg(k).alias(k) for k in present])
    return out.select("_line.group", "n_test", *present, *by)


def complement_overview(df: DataFrame, fold: str, min_rows: int = 10) -> DataFrame:
    """Training and test rows of every group, and whether the fold is evaluated."""
    col = fold_column(fold)
    counts = df.groupBy(F.col(col).alias("group")).agg(F.count("*").alias("n_test"))
    total = df.agg(F.count("*").alias("n")).scalar()
    staged = counts.withColumn("n_train", total - F.col("n_test"))
    return staged.withColumn("evaluated", (F.col("n_test") >= min_rows) & (F.col("n_train") >= min_rows))


def baseline_table(df: DataFrame, fold: str, features: list[str] | None = None, ridge: bool = False,
                   min_rows: int = 10, constant: bool = True) -> DataFrame:
    """Report table of the parameter-free and linear baselines alone; those not asked for are not fitted."""
    rows = written_rows(df, fold, features or [])
    groups = [g for g, _, _ in fold_groups(rows, fold, min_rows)]
    held_out = with_baselines(rows, fold, groups, ridge, constant).filter("group IS NOT NULL")
    return report_table(held_out.withColumn("energy_true", F.col("energy_j")))


def clock_comparison(tensor: DataFrame, boost: DataFrame) -> DataFrame:
    """Two report tables side by side, by group."""
    a = tensor.select("group", *[F.col(c).alias(f"{c}_tensor") for c in tensor.columns if c != "group"])
    b = boost.select("group", *[F.col(c).alias(f"{c}_boost") for c in boost.columns if c != "group"])
    return a.join(b, "group", "full_outer")
