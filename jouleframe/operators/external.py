"""Analytics over feature vectors of an external model family (``pw_*`` columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jouleframe.functions.categories import Params
from jouleframe.functions.labels import operator_of
from jouleframe.functions.metrics import ape
from jouleframe.operators.quantiles import Quantile, group_quantiles, median, sent_whole_if_few
from jouleframe.runtime import spread, written
from jouleframe.sources.hardware import external_hardware_frame, normal_key

PREFIX = "pw_"

# Feature names in the order the external models read them.
MEMORY = ["global_in_flight", "global_cycle", "local_cycle", "sm_max_in_flight", "sm_max_global_cycle",
          "sm_max_shared_cycle", "sm_max_local_cycle"]


def _pipe(name: str) -> list[str]:
    return [f"{name}_{x}" for x in ("all_ops", "all_cycle", "sm_max_ops", "sm_max_cycle")]


OPERATOR_FEATURES = {
    "gemm": _pipe("tensor") + MEMORY,
    "attn": _pipe("tensor") + _pipe("xu") + MEMORY,
    "rmsnorm": _pipe("fma") + _pipe("xu") + MEMORY,
    "siluandmul": _pipe("fma") + _pipe("xu") + MEMORY,
    "groupnorm": _pipe("fma") + _pipe("xu") + MEMORY,
}
# Cycle columns whose sum is each operator's theoretical time.
REFERENCE_CYCLES = {
    "gemm": ["tensor_all_cycle"], "attn": ["tensor_all_cycle"],
    "rmsnorm": ["fma_all_cycle", "xu_all_cycle"], "siluandmul": ["fma_all_cycle", "xu_all_cycle"],
    "groupnorm": ["fma_all_cycle", "xu_all_cycle"],
}
NO_COUNTERPART = ["groupnorm"]
SATURATED_LOGIT = 12.0
ALL_FEATURES = list(dict.fromkeys(f for fs in OPERATOR_FEATURES.values() for f in fs))


def attach_operator_features(df: DataFrame, features: DataFrame, keys: list[str] = ("kernel_sig", "gpu_key")) -> DataFrame:
    """External features back onto rows; rows without any keep NULL."""
    keep = [c for c in features.columns if c in keys or c.startswith(PREFIX)]
    return df.join(features.select(*keep), list(keys), "left")


def lowering(df: DataFrame) -> DataFrame:
    """Operator and its problem size: (m, n, k) for products, (seq, dim) for row-wise kernels."""
    p = Params(df)
    kh, kw, stride, groups = p.num("kh"), p.num("kw"), p.num("stride", "1D"), p.num("groups", "1D")
    pad = p.num("pad", f"floor({kh} / 2)")
    out = lambda side, k: f"(floor(({p.num(side)} + 2 * {pad} - {k}) / {stride}) + 1)"
    launch = f"{p.num('threads', '256D')} * {p.num('elems_per_thread', '4D')}"
    given = f"IF({p.num('dim', '0D')} > 0, {p.num('dim', '0D')}, {launch})"
    lane = f"greatest(8D, {given} - pmod({given}, 8D))"
    pick = lambda **cases: "CAST(CASE category " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in cases.items()) + " END AS BIGINT)"
    return df.withColumns({
        "pw_operator": operator_of(F.col("category"), F.expr(p.word("kind"))),
        "low_m": F.expr(pick(gemm=p.num("m"), conv=f"{p.num('n')} * {out('h', kh)} * {out('w', kw)}")),
        # The external family lowers a grouped convolution with all output channels.
        "low_n": F.expr(pick(gemm=p.num("n"), conv=p.num("c_out"))),
        "low_k": F.expr(pick(gemm=p.num("k"), conv=f"floor({p.num('c_in')} / {groups}) * {kh} * {kw}")),
        "low_seq": F.expr(pick(norm=p.num("rows"), elementwise=f"greatest(1D, ceil({p.num('n_elem')} / {lane}))")),
        "low_dim": F.expr(pick(norm=p.num("dim"), elementwise=lane)),
    })


def audit_notes(df: DataFrame) -> Column:
    """Why a row is outside the external family's own data, as one text ('' when it is not)."""
    p = Params(df)
    cat, kind = F.col("category"), F.expr(p.word("kind"))
    norm_kind = F.coalesce(kind, F.lit("layer"))
    causal, shared = F.expr(p.flag("causal", False)), F.expr(f"{p.num('h_kv', p.num('h'))} != {p.num('h')}")
    notes = F.array_compact(F.array(
        F.when(cat == "conv", "conv lowered to a matrix product; the external data has no convolutions"),
        F.when((cat == "attention") & ~causal, "non-causal; the external data is causal throughout"),
        F.when((cat == "attention") & ~shared, "one key head per query head; the external data mostly shares them"),
        F.when((cat == "norm") & (norm_kind != "rms"), F.concat(norm_kind, F.lit(" norm through an rms model; one reduction pass is not counted"))),
        F.when((cat == "norm") & (norm_kind == "group"), "group norm has no counterpart; features only"),
        F.when(cat == "elementwise", "element count factored by the launch shape"),
        F.when((cat == "elementwise") & ~F.coalesce(kind.isin("silu", "gelu", "gelu_tanh", "swiglu"), F.lit(False)),
               F.concat(F.coalesce(kind, F.lit("unknown")), F.lit(" is no gated activation; operation counts stand in"))),
    ))
    return F.array_join(notes, "; ")


# --- nearest launch ---------------------------------------------------------------------


def reference_hardware(reference: DataFrame, cards: DataFrame) -> DataFrame:
    """Which reference card each of our cards should be looked up under.

    The card itself when the reference has it, else the one of its architecture with the
    closest unit count (ties: first by ``hardware``).
    """
    known = reference.groupBy("hardware", "arch", "num_sms").agg(F.count("*").alias("_n"))
    exact = cards.select("gpu_key", F.col("name").alias("hardware")).join(known.select("hardware").distinct(), "hardware", "left_semi")
    near = (cards.join(known, cards["architecture"] == known["arch"])
            .groupBy("gpu_key").agg(F.min(F.struct(
                F.abs(known["num_sms"] - cards["num_sms"]).alias("d"), known["hardware"].alias("hardware"))).alias("best")))
    picked = cards.select("gpu_key").join(exact, "gpu_key", "left").join(near.select("gpu_key", "best"), "gpu_key", "left")
    return picked.select(
        "gpu_key", F.coalesce("hardware", "best.hardware").alias("hardware"),
        F.when(F.col("hardware").isNotNull(), "exact").otherwise(F.concat(F.lit("arch:"), F.col("best.hardware"))).alias("how"))


FINE = 4  # parts of an octave per dimension that a block spans at most


def _octave(c: Column) -> Column:
    return F.floor(F.log2(F.greatest(c, F.lit(1.0)))).cast("int")


def _cell(m: Column, n: Column, k: Column) -> Column:
    """One key for the octaves of M, N and K; doubles have fewer than 2048 of them."""
    return (m.cast("bigint") * 2048 + n) * 2048 + k


def _blocks(reference: DataFrame, size: int) -> DataFrame:
    """Reference rows in blocks of shapes that are near each other, with the box that holds them.

    A block lies in one cell of octaves of (M, N, K) and spans a part of an octave; where more than
    ``size`` rows share a part it is cut further by row order.
    """
    x = {c: F.col(c).cast("double") for c in "MNK"}
    fine = [F.floor(F.log2(F.greatest(x[c], F.lit(1.0))) * FINE).cast("int").alias(f"_f{c}") for c in "MNK"]
    celled = reference.select("*", _cell(*[_octave(x[c]) for c in "MNK"]).alias("_cell"), *fine)
    keys = ["hardware", "_cell", "_fM", "_fN", "_fK"]
    counted = celled.groupBy(*keys).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("idx"), F.ceil(F.col("_n") / size)).alias("_part")
    entry = F.struct("idx", "M", "N", "K", "tile_M", "tile_N", "tile_K", "cta_count", "is_split_k")
    boxes = [f(c).cast("double").alias(f"{n}_{c}") for c in "MNK" for n, f in (("lo", F.min), ("hi", F.max))]
    return celled.join(counted, keys).select("*", part).groupBy(*keys, "_part").agg(F.collect_list(entry).alias("entries"), *boxes).drop("_fM", "_fN", "_fK", "_part")


def _square(x: Column) -> Column:
    return x * x


def _search(placed: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """The nearest reference row of each shape, by equal cells.

    Blocks in a shape's own and neighbouring cells, or else the box of its whole card, bound how
    far the nearest row can be. A second join visits the cells that this reaches, and there the
    blocks whose boxes begin within it.
    """
    blocks = written(_blocks(reference, size))
    boxes = blocks.drop("entries")
    dims = ("M", "N", "K")
    q = {c: F.col(c.lower()).cast("double") for c in dims}
    near = sum((_square(F.greatest(F.lit(0.0), F.col(f"lo_{c}") - q[c], q[c] - F.col(f"hi_{c}"))) for c in dims), F.lit(0.0))
    far = sum((_square(F.greatest(F.abs(F.col(f"lo_{c}") - q[c]), F.abs(F.col(f"hi_{c}") - q[c]))) for c in dims), F.lit(0.0))
    whole = boxes.groupBy("hardware").agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))])
    shape = ["gpu_key", "m", "n", "k", "how", "hardware"]
    at = [_octave(q[c]) for c in dims]
    around = F.array(*[_cell(at[0] + i, at[1] + j, at[2] + l) for i in (-1, 0, 1) for j in (-1, 0, 1) for l in (-1, 0, 1)])
    close = (placed.select(*shape, F.explode(around).alias("_cell")).join(boxes, ["hardware", "_cell"])
             .groupBy(*shape).agg(F.min(far).alias("_close")))
    bound = placed.join(whole, "hardware").select(*shape, far.alias("_any")).join(close, shape, "left")
    # A little more than the bound, as the square root below rounds.
    reach = written(bound.select(*shape, (F.least("_any", F.coalesce("_close", "_any")) * (1 + 1e-12)).alias("_reach")))
    r = F.sqrt("_reach")
    gap = lambda a, c: F.greatest(F.lit(0.0), F.when(a > 0, F.pow(F.lit(2.0), a) - q[c]).otherwise(0.0), q[c] - F.pow(F.lit(2.0), a + 1))
    low, high = [_octave(q[c] - r) for c in dims], [_octave(q[c] + r) for c in dims]
    lists = [F.sequence(low[i], high[i]) for i in range(3)]
    cells = F.flatten(F.flatten(F.transform(lists[0], lambda a: F.transform(lists[1], lambda b: F.transform(
        F.filter(lists[2], lambda c: _square(gap(a, "M")) + _square(gap(b, "N")) + _square(gap(c, "K")) <= F.col("_reach")), lambda c: _cell(a, b, c))))))
    tried = reach.select(*shape, "_reach", F.explode(cells).alias("_cell"))
    best = F.array_min(F.transform("entries", lambda e: F.struct(
        F.sqrt(sum((_square(e[c] - q[c]) for c in ("N", "K")), _square(e["M"] - q["M"]))).alias("distance"), e["idx"].alias("idx"),
        e["tile_M"].alias("tile_m"), e["tile_N"].alias("tile_n"), e["tile_K"].alias("tile_k"),
        e["cta_count"].alias("cta_count"), e["is_split_k"].alias("is_split_k"))))
    met = tried.join(blocks, ["hardware", "_cell"]).where(near <= F.col("_reach"))
    return met.select("gpu_key", "m", "n", "k", "how", best.alias("b")).groupBy("gpu_key", "m", "n", "k", "how").agg(F.min("b").alias("b"))


def nearest_launch(shapes: DataFrame, reference: DataFrame, cards: DataFrame | None = None, mode: str = "structural",
                   block: int = 256, missing: str = "raise") -> DataFrame:
    """Launch geometry for matrix products: nearest reference shape in raw (M, N, K).

    ``shapes`` has gpu_key, m, n, k; ``reference`` has hardware, arch, num_sms, M, N, K,
    tile_M/N/K, cta_count, is_split_k and ``idx``, its row order (ties go to the lowest).

    Distinct shapes are looked up once, in blocks of near reference shapes that equal cells find
    and boxes rule in or out. A card that is unknown or has no reference of its architecture fails the query;
    with ``missing="keep"`` its shapes come back with NULL geometry and the reason as
    ``launch_source``.
    """
    if mode not in ("structural", "upstream"):
        raise ValueError(f"mode must be 'structural' or 'upstream', got {mode!r}")
    if missing not in ("raise", "keep"):
        raise ValueError(f"missing must be 'raise' or 'keep', got {missing!r}")
    cards = external_hardware_frame(shapes.sparkSession) if cards is None else cards
    wanted = written(spread(shapes.select("gpu_key", "m", "n", "k").distinct(), "gpu_key", "m", "n", "k")
                         .join(reference_hardware(reference, cards), "gpu_key", "left"))
    slim = reference.select("hardware", *[F.col(c).cast("bigint").alias(c) for c in ("idx", "M", "N", "K", "tile_M", "tile_N", "tile_K", "cta_count")],
                            F.col("is_split_k").cast("boolean").alias("is_split_k"))
    found = _search(wanted.where(F.col("hardware").isNotNull()), slim, block)
    spec = cards.select("gpu_key", F.col("architecture").alias("_arch"), F.col("num_sms").alias("_sms"))
    out = found.join(spec, "gpu_key")
    if mode == "upstream":
        count, split, source = F.col("b.cta_count"), F.col("b.is_split_k"), F.lit("upstream/")
    else:
        tiles = (F.ceil(F.col("m") / F.col("b.tile_m")) * F.ceil(F.col("n") / F.col("b.tile_n"))).cast("bigint")
        hopper = F.col("_arch") == "hopper"
        count = F.greatest(F.lit(1).cast("bigint"), F.when(hopper, F.least(tiles, F.col("_sms").cast("bigint"))).otherwise(tiles))
        split = ~hopper
        source = F.when(hopper, "structural/hopper/").otherwise("structural/tiled/")
    done = out.select(
        "gpu_key", "m", "n", "k", "b.tile_m", "b.tile_n", "b.tile_k", count.alias("cta_count"), split.alias("is_split_k"),
        F.concat(source, F.col("how")).alias("launch_source"), F.col("b.distance").alias("neighbour_distance"))
    lost = wanted.where(F.col("hardware").isNull()).withColumn("launch_source", F.concat(F.lit("no reference for "), F.coalesce("gpu_key", F.lit("NULL"))))
    if missing == "raise":
        first = lost.select("launch_source").take(1)
        if first:
            raise ValueError(first[0]["launch_source"])
        return done
    blank = lost.select("gpu_key", "m", "n", "k", *[F.lit(None).cast(t).alias(c) for c, t in done.dtypes[4:9]], "launch_source",
                        F.lit(None).cast("double").alias("neighbour_distance"))
    return done.unionByName(blank)


# --- floors, ranges, transfer tables ------------------------------------------------------


def prepare(df: DataFrame) -> DataFrame:
    """Add the external theoretical time and the efficiency against it."""
    missing = {"pw_operator", "latency_s", "gpu_key"} - set(df.columns)
    if missing:
        raise KeyError(f"missing {sorted(missing)}; attach external features first")
    cycles = None
    for op, cols in REFERENCE_CYCLES.items():
        if not {PREFIX + c for c in OPERATOR_FEATURES[op]} <= set(df.columns):
            continue
        total = sum((F.col(PREFIX + c) for c in cols[1:]), F.col(PREFIX + cols[0]))
        test = F.col("pw_operator") == op
        cycles = F.when(test, total) if cycles is None else cycles.when(test, total)
    cycles = F.lit(None).cast("double") if cycles is None else cycles
    freq = external_hardware_frame(df.sparkSession).select(normal_key(F.col("gpu_key")).alias("_card"), F.col("sm_freq").alias("_freq"))
    placed = df.join(F.broadcast(freq), normal_key(F.col("gpu_key")) == F.col("_card"), "left")
    staged = placed.withColumn("theory_pw_s", cycles / (F.col("_freq") * 1e6)).drop("_card", "_freq")
    return staged.withColumn("eta_pw", F.col("theory_pw_s") / F.col("latency_s"))


def compare_floors(df: DataFrame) -> DataFrame:
    """External over own floor per (card, category), and how often each exceeds the measured time."""
    gap = {"theoretical_time_s", "theory_pw_s"} - set(df.columns)
    if gap:
        raise KeyError(f"need both floors; missing {sorted(gap)}")
    d = df.filter(F.col("theoretical_time_s").isNotNull() & F.col("theory_pw_s").isNotNull())
    ratio = F.col("theory_pw_s") / F.col("theoretical_time_s")

    def over(c):
        if c not in df.columns:
            return F.lit(None).cast("double")
        return F.avg(F.coalesce(F.col(c) > 1, F.lit(False)).cast("double"))

    return group_quantiles(
        d, ["gpu_key", "category"],
        [median("ratio_median", ratio), Quantile("ratio_p10", ratio, 0.1), Quantile("ratio_p90", ratio, 0.9)],
        [F.count("*").alias("n"), over("eta").alias("eta_ours_over_1"), over("eta_pw").alias("eta_pw_over_1")])


def range_report(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per (operator, feature): share of rows below / above the training range, median in sds.

    ``ranges`` has operator, feature, min, max, mean, std. Features stay wide until they are
    aggregated, so rows are not multiplied by the number of features.
    """
    used = [f for f in ALL_FEATURES if PREFIX + f in df.columns]
    packed = ranges.groupBy("operator").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("feature"), F.struct("min", "max", "mean", "std")))).alias("_ranges"))
    rows = df.join(packed, F.col("pw_operator") == F.col("operator"))
    aggs, quantiles = [], []
    for f in used:
        v, r = F.col(PREFIX + f), F.col("_ranges").getItem(f)
        low, high = v < r["min"], v > r["max"]
        aggs.append(F.struct(F.count(v).alias("n"), F.avg(low.cast("double")).alias("below"), F.avg(high.cast("double")).alias("above"),
                             F.max(r["mean"]).alias("mean"), F.max(r["std"]).alias("std")).alias(f"s_{f}"))
        quantiles.append(median(f"q_{f}", v))
    wide = group_quantiles(rows, ["operator"], quantiles, aggs)
    tidy = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s_{f}").alias("s"), F.col(f"q_{f}").alias("q")) for f in used])).alias("r")
    member = F.lit(False)
    for op, names in OPERATOR_FEATURES.items():
        member = member | ((F.col("operator") == op) & F.col("r.feature").isin(*names))
    return (wide.select("operator", tidy).filter(member & (F.col("r.s.n") > 0) & F.col("r.s.mean").isNotNull())
            .select("operator", "r.feature", "r.s.n", F.col("r.s.below").alias("frac_below_min"), F.col("r.s.above").alias("frac_above_max"),
                    ((F.col("r.q") - F.col("r.s.mean")) / F.greatest(F.col("r.s.std"), F.lit(1e-30))).alias("median_z")))


def worst_ranges(report: DataFrame, top: int = 12) -> DataFrame:
    """The features furthest out of range."""
    out = F.col("frac_below_min") + F.col("frac_above_max")
    return report.withColumn("out_of_range", out).orderBy(F.desc("out_of_range"), "operator", "feature").limit(top)


def with_hybrid(df: DataFrame, logit: str = "eta_logit", threshold: float = SATURATED_LOGIT) -> DataFrame:
    """Fall back to the model fitted from scratch where the transferred head is saturated."""
    sat = F.abs(F.col(logit)) > threshold if "saturated" not in df.columns else F.col("saturated")
    staged = df.withColumn("saturated", sat)
    return staged.withColumn("energy_hybrid", F.when(F.col("saturated"), F.col("energy_scratch")).otherwise(F.col("energy_finetuned")))


def transfer_cells(df: DataFrame, min_train: int = 40, min_test: int = 10) -> DataFrame:
    """Rows per (operator, card) with the rows left to train on, and why a cell is skipped."""
    cells = df.groupBy("operator", "gpu_key").agg(F.count("*").alias("n_test"))
    ops = cells.groupBy("operator").agg(F.sum("n_test").alias("_all"))
    staged = cells.join(ops, "operator").withColumn("n_train", F.col("_all") - F.col("n_test")).drop("_all")
    return staged.withColumn("status", F.when(F.col("operator").isin(*NO_COUNTERPART), "no counterpart")
                             .when((F.col("n_train") < min_train) | (F.col("n_test") < min_test), "too few rows").otherwise("evaluated"))


def transfer_table(df: DataFrame, min_train: int = 40, min_test: int = 10) -> DataFrame:
    """Energy error of each variant per (card, operator), and a POOLED row over all rows.

    ``df`` is a predictions table: gpu_key, operator, energy_true, energy_zeroshot,
    energy_finetuned, energy_scratch, energy_hybrid, saturated; optional eta/pi columns add
    their medians and ``below_train`` its share.
    """
    ok = transfer_cells(df, min_train, min_test).filter(F.col("status") == "evaluated").select("operator", "gpu_key")
    # The cells go to the rows: dealt by cell, the rows would stand in as many tasks as there are cells.
    rows = df.join(sent_whole_if_few(written(ok)), ["operator", "gpu_key"], "left_semi")
    true = F.col("energy_true")
    err = {v: ape(true, F.col(f"energy_{v}")) for v in ("zeroshot", "finetuned", "scratch", "hybrid")}
    aggs = [F.count("*").alias("n_test")] + [F.avg(e).alias(v) for v, e in err.items()]
    aggs.append(F.avg(F.col("saturated").cast("double")).alias("sat"))
    medians = [median("ft_med", err["finetuned"])]
    for out, t, p in (("eta_zs", "eta_true", "eta_zeroshot"), ("eta_ft", "eta_true", "eta_finetuned"), ("pi_ft", "pi_true", "pi_finetuned")):
        if {t, p} <= set(df.columns):
            medians.append(median(out, ape(F.col(t), F.col(p))))
    if "below_train" in df.columns:
        aggs.append(F.avg(F.col("below_train").cast("double")).alias("oob"))
    # Each row counts for its cell and for the pool; the copies combine map-side, the scan happens once.
    twice = rows.withColumn("_cell", F.explode(F.array(
        F.struct(F.col("gpu_key").alias("gpu"), F.col("operator").alias("op")), F.struct(F.lit("POOLED").alias("gpu"), F.lit("-").alias("op")))))
    keyed = twice.withColumns({"gpu": F.col("_cell.gpu"), "operator": F.col("_cell.op")})
    return group_quantiles(keyed, ["gpu", "operator"], medians, aggs)
