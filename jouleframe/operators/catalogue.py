"""The kernel catalogue: captured operation calls deduplicated by signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jouleframe.functions.categories import CategoryRegistry, Params, with_kernel_totals
from jouleframe.functions.keys import param_columns, signature
from jouleframe.functions.missing import optional

# Elementwise work implied by each observed norm.
SYNTHETIC_KINDS = ("scale_shift", "gate_residual", "add")


def capture_counts(events: DataFrame) -> DataFrame:
    """Operation-call events to one row per distinct (model, category, dtype, params)."""
    model = ["source_model"] if "source_model" in events.columns else []
    op = [F.min("op_name").alias("op_name")] if "op_name" in events.columns else []
    return (events.groupBy(*model, "category", "dtype", *param_columns(events))
            .agg(F.count("*").alias("count"), *op))


def category_counts(captures: DataFrame) -> DataFrame:
    return captures.groupBy("category").agg(F.sum("count").alias("count"))


def _per_model(captures: DataFrame) -> DataFrame:
    """One row per (signature, model) with summed calls and a stable provenance."""
    params = param_columns(captures)
    calls = F.coalesce(optional(captures, "count", "bigint", 1).cast("bigint"), F.lit(1))
    text = lambda c: F.coalesce(optional(captures, c, "string"), F.lit("")).alias(c)
    # Sum first, with only a number in the buffer (a hash aggregate); sign the few rows left.
    summed = captures.groupBy("category", "dtype", *params, text("source_model"), text("source_module"), text("op_name")).agg(
        F.sum(calls).alias("calls"))
    keyed = summed.withColumns({
        "kernel_sig": signature(summed),
        "prov": F.struct(F.lit(0).alias("made"), F.col("source_model"), F.col("source_module"), F.col("op_name"))})
    return (keyed.groupBy("kernel_sig", "category", "dtype", *params, F.col("source_model").alias("model"))
            .agg(F.sum("calls").alias("calls"), F.min("prov").alias("prov")))


def _synthesised(per_model: DataFrame, kinds) -> DataFrame:
    """Modulation and residual kernels at the sizes of the observed (non-group) norms.

    Norms sharing an element count and dtype give one set, taken from the norm with the
    smallest signature, with that norm's calls doubled.
    """
    p = Params(per_model)
    norms = per_model.filter((F.col("category") == "norm") & F.expr(f"{p.word('kind', '')} != 'group'"))
    norms = norms.withColumn("_n", F.expr(f"CAST({p.num('rows')} * {p.num('dim')} AS BIGINT)"))
    chosen = norms.groupBy("_n", "dtype").agg(F.min("kernel_sig").alias("kernel_sig"))
    kept = norms.join(chosen, ["_n", "dtype", "kernel_sig"], "left_semi")
    made = kept.select(
        F.lit("elementwise").alias("category"), "dtype", F.col("_n").alias("p_n_elem"), "model",
        (F.col("calls") * 2).alias("calls"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("p_kind"))
    op = F.concat(F.lit("synth::"), F.col("p_kind"))
    made = made.withColumn("prov", F.struct(F.lit(1).alias("made"), F.lit("").alias("source_model"), F.lit("").alias("source_module"), op.alias("op_name")))
    return made.withColumn("kernel_sig", signature(made))


def build_catalogue(captures: DataFrame, add_elementwise: bool = True, max_working_set_gb: float | None = 40.0,
                    kinds=SYNTHETIC_KINDS, registry: CategoryRegistry | None = None) -> DataFrame:
    """Merge captures (any mix of models) into one row per distinct kernel.

    Calls are summed per (signature, model) before models are gathered, so a kernel called
    in a third of all rows still reduces map-side.
    """
    per_model = _per_model(captures)
    if add_elementwise and {"p_rows", "p_dim"} <= set(captures.columns):
        both = per_model.unionByName(_synthesised(per_model, kinds), allowMissingColumns=True)
        # A captured kernel may coincide with a synthesised one.
        per_model = both.groupBy("kernel_sig", "category", "dtype", *param_columns(both), "model").agg(
            F.sum("calls").alias("calls"), F.min("prov").alias("prov"))
    params = param_columns(per_model)
    grouped = per_model.groupBy("kernel_sig", "category", "dtype", *params).agg(
        F.array_sort(F.collect_list(F.struct("model", "calls"))).alias("_mc"),
        F.sum("calls").alias("calls_total"), F.count("*").alias("n_models"), F.min("prov").alias("_prov"))
    models = F.col("_mc.model")
    out = grouped.select(
        "kernel_sig", "category", "dtype", *params,
        F.array_join(models, "|").alias("source_model"), F.col("_prov.source_module").alias("source_module"),
        F.col("_prov.op_name").alias("op_name"), models.alias("models"),
        F.map_from_entries("_mc").alias("calls"), "n_models", "calls_total")
    return out if max_working_set_gb is None else filter_catalogue(out, max_working_set_gb=max_working_set_gb, registry=registry)


def filter_catalogue(catalogue: DataFrame, categories: list[str] | None = None, max_working_set_gb: float | None = None,
                     min_calls: int = 1, registry: CategoryRegistry | None = None) -> DataFrame:
    """Narrow by category, calls and resident size; a size limit drops unanalysable rows."""
    out = catalogue.filter(F.col("calls_total") >= min_calls)
    if categories:
        out = out.filter(F.col("category").isin(*categories))
    if max_working_set_gb is not None:
        sized = with_kernel_totals(out, registry)
        out = sized.filter(F.col("working_set_bytes") / 2.0**30 <= max_working_set_gb).select(*out.columns)
    return out


def ordered(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy(F.asc("category"), F.desc("calls_total"), F.asc("kernel_sig"))


def pivot_calls(catalogue: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Spread the calls map into ``calls_<model>`` columns, one for every model that occurs.

    ``models`` sets which columns come first (and are there even without calls). Models are
    found in one distinct pass; the header of a flat file has one column for each anyway.
    """
    found = catalogue.select(F.explode(F.map_keys("calls")).alias("m")).distinct().orderBy("m").collect()
    names = list(dict.fromkeys([*(models or []), *(r["m"] for r in found)]))
    return catalogue.withColumns({f"calls_{m}": F.col("calls").getItem(m) for m in names}).drop("calls", "models")


def summarise(catalogue: DataFrame) -> DataFrame:
    """Distinct configs, calls and share of configs per category, largest first."""
    per_sig = catalogue.groupBy("category", "kernel_sig").agg(F.sum("calls_total").alias("calls"))
    by_cat = per_sig.groupBy("category").agg(F.count("*").alias("n_configs"), F.sum("calls").alias("calls"))
    total = by_cat.agg(F.sum("n_configs").alias("n_all")).scalar()
    return by_cat.withColumn("share_of_configs", F.col("n_configs") / total).orderBy(F.desc("n_configs"), "category")


def split_calls(catalogue: DataFrame) -> DataFrame:
    """A reloaded catalogue file to (kernel, model) rows: total calls divided evenly, at least 1."""
    models = F.split(F.coalesce(F.col("source_model"), F.lit("")), r"\|")
    total = F.coalesce(optional(catalogue, "calls_total", "double").cast("double"), F.lit(1.0))
    each = F.greatest(F.floor(total / F.size(models)).cast("bigint"), F.lit(1).cast("bigint"))
    return catalogue.withColumn("count", each).withColumn("source_model", F.explode(models)).drop("calls_total", "n_models")
