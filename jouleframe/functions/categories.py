"""Kernel categories: what work one kernel asks of a card, as Spark expressions.

A category describes a homogeneous grid of tasks. ``totals`` gives whole-kernel figures
that do not depend on the card; ``demand`` gives the per-task demand on each pipeline and
the number of tasks. Both are SQL expressions, so a new category registered by a user runs
inside the same generated code as the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Bytes per element of the known dtypes.
DTYPE_BYTES = {"fp32": 4, "tf32": 4, "fp16": 2, "bf16": 2, "fp8_e4m3": 1, "fp8_e5m2": 1, "int8": 1}

# Output tiles in the order they are tried (rows, columns, depth).
TILE_LADDER = [(256, 128, 64), (128, 256, 64), (128, 128, 64), (128, 64, 64), (64, 128, 64), (64, 64, 32), (32, 32, 32)]
PERSISTENT_TILES_PER_SM = 4.0

# Per element (fma ops, special-function ops) and tensors touched.
ELEMENTWISE_COST = {
    "add": (1.0, 0.0, 2), "mul": (1.0, 0.0, 2), "gelu": (6.0, 1.0, 1), "gelu_tanh": (6.0, 1.0, 1),
    "silu": (2.0, 1.0, 1), "swiglu": (3.0, 1.0, 2), "geglu": (7.0, 1.0, 2), "scale_shift": (2.0, 0.0, 3),
    "gate_residual": (2.0, 0.0, 3), "copy": (0.0, 0.0, 1), "softmax": (3.0, 1.0, 1),
}

DEMAND_FIELDS = ["count", "mma", "fma", "xu", "hbm", "l2", "smem"]
TOTAL_FIELDS = ["flops", "bytes_global", "working_set"]


class Params:
    """SQL text for a frame's ``p_*`` parameters as numbers, flags and words.

    Expressions are written as SQL text: a whole demand formula reaches Spark in one call
    instead of one call per operator.
    """

    def __init__(self, df: DataFrame):
        self._types = {f.name[2:]: f.dataType for f in df.schema.fields if f.name.startswith("p_")}

    def has(self, name: str) -> str:
        return f"p_{name} IS NOT NULL" if name in self._types else "false"

    def num(self, name: str, default: str | None = None) -> str:
        if name not in self._types:
            return f"CAST({default or 'NULL'} AS DOUBLE)"
        cast = "try_cast" if isinstance(self._types[name], T.StringType) else "CAST"
        value = f"{cast}(p_{name} AS DOUBLE)"
        return value if default is None else f"coalesce({value}, {default})"

    def flag(self, name: str, default: bool) -> str:
        if name not in self._types:
            return str(default).lower()
        return f"coalesce(lower(CAST(p_{name} AS STRING)) NOT IN ('false', '0', '0.0', ''), {str(default).lower()})"

    def word(self, name: str, default: str | None = None) -> str:
        value = f"CAST(p_{name} AS STRING)" if name in self._types else "CAST(NULL AS STRING)"
        return value if default is None else f"coalesce({value}, '{default}')"


@dataclass(frozen=True)
class Category:
    """A kernel category; every formula is SQL text over ``p_*``, ``_width`` and ``dtype``.

    ``matmul`` gives the (m, n, k) of the underlying matrix product, when there is one; the
    tile chosen for it is then available to ``demand`` as ``_tile.m``, ``_tile.n``,
    ``_tile.k`` and ``_tile.tiles``. ``persistent_on`` lists architectures whose launches
    keep one resident block per unit. ``invalid`` gives a reason text or NULL.
    """

    name: str
    required: tuple[str, ...]
    totals: Callable[[Params], dict[str, str]]
    demand: Callable[[Params], dict[str, str]]
    matmul: Callable[[Params], tuple[str, str, str]] | None = None
    blocks_per_sm: int = 2
    persistent_on: tuple[str, ...] = ()
    invalid: Callable[[Params], str] | None = None


@dataclass
class CategoryRegistry:
    by_name: dict[str, Category] = field(default_factory=dict)

    def register(self, category: Category) -> Category:
        self.by_name[category.name] = category
        return category

    def names(self) -> list[str]:
        return list(self.by_name)

    def pick(self, build: Callable[[Category], str | None], otherwise: str = "NULL") -> str:
        """CASE over the category column; categories whose build gives None are skipped."""
        built = [(c.name, build(c)) for c in self.by_name.values()]
        whens = " ".join(f"WHEN '{name}' THEN {text}" for name, text in built if text is not None)
        return f"(CASE category {whens} ELSE {otherwise} END)" if whens else otherwise


REGISTRY = CategoryRegistry()


def register_category(name: str, required, demand_fn, totals_fn, **options) -> Category:
    """Add a category made of SQL expressions (no Python runs per row)."""
    return REGISTRY.register(Category(name, tuple(required), totals_fn, demand_fn, **options))


def struct_text(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in fields.items()) + ")"


def dtype_bytes(dtype: str = "dtype") -> str:
    """Element width; NULL for a dtype that is not known."""
    return f"CAST(CASE {dtype} " + " ".join(f"WHEN '{d}' THEN {b}" for d, b in DTYPE_BYTES.items()) + " END AS DOUBLE)"


def accumulator_bytes(wide_dtypes) -> str:
    return "CASE WHEN dtype IN (" + ", ".join(f"'{d}'" for d in wide_dtypes) + ") THEN 4D ELSE _width END"


def tile_count(m: str, n: str, tm, tn) -> str:
    return f"CAST(ceil({m} / {tm}) AS DOUBLE) * CAST(ceil({n} / {tn}) AS DOUBLE)"


def choose_tile(m: str, n: str, sms: str) -> str:
    """Largest tile of the ladder whose grid covers the units twice, else the smallest."""
    pick = [(struct_text({"m": a, "n": b, "k": c}), f"{tile_count(m, n, a, b)} >= 2 * {sms}") for a, b, c in TILE_LADDER]
    whens = " ".join(f"WHEN {fits} THEN {tile}" for tile, fits in pick[:-1])
    return f"CASE WHEN {m} IS NULL OR {n} IS NULL THEN NULL {whens} ELSE {pick[-1][0]} END"


# --- built-in categories ----------------------------------------------------------------

_NARROW = ("bf16", "fp16", "fp8_e4m3", "fp8_e5m2")
_NARROW_CONV = ("bf16", "fp16")


def _matmul_demand(k: str, acc: str, hbm_total: str) -> dict[str, str]:
    """One task per output tile: read an A and a B panel, write the tile once."""
    panels = f"(_tile.m * {k} + {k} * _tile.n) * _width"
    return {
        "count": "_tile.tiles",
        "mma": f"2D * _tile.m * _tile.n * {k}",
        "fma": "0D",
        "xu": "0D",
        "hbm": f"({hbm_total}) / greatest(_tile.tiles, 1D)",
        "l2": f"({panels} + _tile.m * _tile.n * {acc})",
        "smem": panels,
    }


def _gemm_totals(p):
    m, n, k, acc = p.num("m"), p.num("n"), p.num("k"), accumulator_bytes(_NARROW)
    bias = p.flag("bias", True)
    return {
        "flops": f"2D * {m} * {n} * {k} + IF({bias}, {m} * {n}, 0D)",
        "bytes_global": f"({m} * {k} + {k} * {n}) * _width + {m} * {n} * {acc} + IF({bias}, {n} * _width, 0D)",
        "working_set": f"({m} * {k} + {k} * {n}) * _width + {m} * {n} * _width",
    }


def _gemm_demand(p):
    m, n, k, acc = p.num("m"), p.num("n"), p.num("k"), accumulator_bytes(_NARROW)
    bias = p.flag("bias", True)
    out = _matmul_demand(k, acc, f"({m} * {k} + {k} * {n}) * _width + {m} * {n} * {acc}")
    out["fma"] = f"IF({bias}, _tile.m * _tile.n, 0D)"
    out["l2"] += f" + IF({bias}, _tile.n * _width, 0D)"
    return out


def _conv_shape(p) -> dict[str, str]:
    kh, kw, stride, groups = p.num("kh"), p.num("kw"), p.num("stride", "1D"), p.num("groups", "1D")
    pad = p.num("pad", f"floor({kh} / 2)")
    out = lambda side, k: f"(floor(({p.num(side)} + 2 * {pad} - {k}) / {stride}) + 1D)"
    return {"kh": kh, "kw": kw, "stride": stride, "groups": groups, "h_out": out("h", kh), "w_out": out("w", kw),
            "in": f"floor({p.num('c_in')} / {groups})", "out": f"floor({p.num('c_out')} / {groups})"}


def _conv_matmul(p):
    s = _conv_shape(p)
    return f"{p.num('n')} * {s['h_out']} * {s['w_out']}", s["out"], f"{s['in']} * {s['kh']} * {s['kw']}"


def _conv_tensors(p, out_width: str) -> str:
    s = _conv_shape(p)
    x = f"{p.num('n')} * {p.num('c_in')} * {p.num('h')} * {p.num('w')} * _width"
    y = f"{p.num('n')} * {p.num('c_out')} * {s['h_out']} * {s['w_out']} * {out_width}"
    return f"({x} + {y} + {p.num('c_out')} * {s['in']} * {s['kh']} * {s['kw']} * _width)"


def _conv_totals(p):
    m, n, k = _conv_matmul(p)
    s = _conv_shape(p)
    bias = f"IF({p.flag('bias', True)}, {p.num('n')} * {p.num('c_out')} * {s['h_out']} * {s['w_out']}, 0D)"
    return {"flops": f"2D * {m} * {n} * {k} * {s['groups']} + {bias}",
            "bytes_global": _conv_tensors(p, accumulator_bytes(_NARROW_CONV)), "working_set": _conv_tensors(p, "_width")}


def _conv_demand(p):
    s, acc = _conv_shape(p), accumulator_bytes(_NARROW_CONV)
    out = _matmul_demand("_mm.k", acc, _conv_tensors(p, acc))
    # Overlapping gathers hit cache, so they raise the L2 figure only.
    out["l2"] += f" * greatest({s['kh']} * {s['kw']} / ({s['stride']} * {s['stride']}), 1D)"
    out["fma"] = f"IF({p.flag('bias', True)}, _tile.m * _tile.n, 0D)"
    out["count"] += f" * greatest({s['groups']}, 1D)"
    return out


def _attention_tensors(p) -> tuple[str, str]:
    q = f"{p.num('b')} * {p.num('h')} * {p.num('s_q')} * {p.num('d')} * _width"
    kv = f"2D * {p.num('b')} * {p.num('h_kv', p.num('h'))} * {p.num('s_kv')} * {p.num('d')} * _width"
    return q, kv


def _attention_totals(p):
    q, kv = _attention_tensors(p)
    seen = f"IF({p.flag('causal', False)}, {p.num('s_kv')} / 2D, {p.num('s_kv')})"
    return {"flops": f"4D * {p.num('b')} * {p.num('h')} * {p.num('s_q')} * {seen} * {p.num('d')}",
            "bytes_global": f"2D * {q} + {kv}", "working_set": f"{q} + {kv} + {q}"}


def _attention_demand(p):
    s_kv, d, block = p.num("s_kv"), p.num("d"), p.num("block_q", "128D")
    blocks = f"CAST(ceil({p.num('s_q')} / {block}) AS DOUBLE)"
    # Causal: block i sees min(s_kv, (i+1)*block) keys; sum the arithmetic part, then the plateau.
    rising = f"least({blocks}, CAST(floor({s_kv} / {block}) AS DOUBLE))"
    mean = f"({block} * {rising} * ({rising} + 1) / 2D + ({blocks} - {rising}) * {s_kv}) / {blocks}"
    seen = f"IF({p.flag('causal', False)}, {mean}, {s_kv})"
    tasks = f"{p.num('b')} * {p.num('h')} * {blocks}"
    io, kv = f"2D * {block} * {d} * _width", f"2D * {seen} * {d} * _width"
    return {
        "count": tasks,
        "mma": f"4D * {block} * {seen} * {d}",
        "fma": f"3D * {block} * {seen} + 2D * {block} * {d}",
        "xu": f"{block} * {seen}",
        "hbm": f"{io} + {_attention_tensors(p)[1]} / greatest({tasks}, 1D)",
        "l2": f"{io} + {kv}",
        "smem": f"{kv} + {block} * {d} * _width",
    }


def _norm_passes(p) -> str:
    return f"(IF({p.word('kind', 'layer')} = 'rms', 1D, 2D) + 2D)"


def _norm_totals(p):
    rows, dim = p.num("rows"), p.num("dim")
    moved = f"2D * {rows} * {dim} * _width"
    affine = f"IF({p.flag('affine', True)}, 2D * {dim} * _width, 0D)"
    return {"flops": f"{rows} * {dim} * {_norm_passes(p)}", "bytes_global": f"{moved} + {affine}", "working_set": moved}


def _norm_demand(p):
    moved = f"2D * {p.num('dim')} * _width"
    return {"count": p.num("rows"), "mma": "0D", "fma": f"{_norm_passes(p)} * {p.num('dim')}", "xu": "1D", "hbm": moved,
            "l2": f"{moved} + IF({p.flag('affine', True)}, 2D * {p.num('dim')} * _width, 0D)", "smem": f"{p.num('dim')} * 4D"}


def _cost(p, position: int) -> str:
    return f"(CASE {p.word('kind')} " + " ".join(f"WHEN '{k}' THEN {float(c[position])}D" for k, c in ELEMENTWISE_COST.items()) + " END)"


def _elementwise_totals(p):
    n = p.num("n_elem")
    moved = f"{_cost(p, 2)} * {n} * _width"
    return {"flops": f"{n} * ({_cost(p, 0)} + {_cost(p, 1)})", "bytes_global": moved, "working_set": moved}


def _elementwise_demand(p):
    per_block = f"({p.num('threads', '256D')} * {p.num('elems_per_thread', '4D')})"
    elems = f"least({per_block}, {p.num('n_elem')})"
    moved = f"{_cost(p, 2)} * {elems} * _width"
    return {"count": f"greatest(CAST(ceil({p.num('n_elem')} / {per_block}) AS DOUBLE), 1D)", "mma": "0D",
            "fma": f"{_cost(p, 0)} * {elems}", "xu": f"{_cost(p, 1)} * {elems}", "hbm": moved, "l2": moved, "smem": "0D"}


def _elementwise_invalid(p):
    kind = p.word("kind")
    known = ", ".join(f"'{k}'" for k in ELEMENTWISE_COST)
    return f"CASE WHEN {kind} NOT IN ({known}) THEN concat('unknown elementwise kind ', {kind}) END"


register_category(
    "gemm", ("m", "n", "k"), _gemm_demand, _gemm_totals,
    matmul=lambda p: (p.num("m"), p.num("n"), p.num("k")), persistent_on=("Hopper",))
register_category(
    "attention", ("b", "h", "s_q", "s_kv", "d"), _attention_demand, _attention_totals, persistent_on=("Hopper",))
register_category(
    "conv", ("n", "c_in", "c_out", "h", "w", "kh", "kw"), _conv_demand, _conv_totals, matmul=_conv_matmul)
register_category("norm", ("rows", "dim"), _norm_demand, _norm_totals, blocks_per_sm=8)
register_category(
    "elementwise", ("n_elem", "kind"), _elementwise_demand, _elementwise_totals,
    blocks_per_sm=16, invalid=_elementwise_invalid)


# --- over frames ------------------------------------------------------------------------


def failure_text(df: DataFrame, registry: CategoryRegistry | None = None) -> str:
    reg = registry or REGISTRY
    p = Params(df)

    def missing(cat: Category) -> str:
        names = "array_compact(array(" + ", ".join(f"IF({p.has(r)}, NULL, '{r}')" for r in cat.required) + "))"
        lacks = f"IF(size({names}) > 0, concat('{cat.name}: missing ', array_join({names}, ', ')), NULL)"
        return lacks if cat.invalid is None else f"coalesce({lacks}, {cat.invalid(p)})"

    known = ", ".join(f"'{n}'" for n in reg.names())
    return (f"coalesce(CASE WHEN category IS NULL OR category NOT IN ({known}) THEN concat('unknown category ', coalesce(category, 'NULL')) END, "
            f"{reg.pick(missing)}, CASE WHEN {dtype_bytes()} IS NULL THEN concat('unknown dtype ', coalesce(dtype, 'NULL')) END)")


def analysis_failure(df: DataFrame, registry: CategoryRegistry | None = None) -> Column:
    """Why a row cannot be analysed, or NULL when it can."""
    return F.expr(failure_text(df, registry))


def with_kernel_totals(df: DataFrame, registry: CategoryRegistry | None = None) -> DataFrame:
    """Add flops, HBM bytes, intensity and resident bytes of each kernel (card-free)."""
    reg = registry or REGISTRY
    p = Params(df)
    totals = reg.pick(lambda c: struct_text({f: c.totals(p)[f] for f in TOTAL_FIELDS}))
    staged = df.withColumn("_width", F.expr(dtype_bytes()))
    # The one-row explode keeps filters on the results from carrying copies of the formulas.
    staged = staged.withColumn("_totals", F.explode(F.array(F.expr(f"IF({failure_text(df, reg)} IS NULL, {totals}, NULL)"))))
    flops, moved = F.col("_totals.flops"), F.col("_totals.bytes_global")
    return staged.withColumns({
        "kernel_flops": flops,
        "kernel_bytes_global": moved,
        "arithmetic_intensity": F.when(moved > 0, flops / moved).when(moved.isNotNull(), float("inf")),
        "working_set_bytes": F.col("_totals.working_set"),
    }).drop("_totals", "_width")
