"""Exact grouped quantiles that never hold a large group in one task.

Spark's exact percentile keeps every distinct value of a group in one aggregation buffer.
That fits groups whose size is bounded by what they are, such as the repeats of one
measurement or the seeds of one cell; operators over such keys say ``bounded_groups=True``.
For all other keys a mergeable sketch first brackets each wanted rank, and only the rows
inside the bracket (about 6/accuracy of the group, counted per distinct value) are ranked.
Both give the same linearly interpolated numbers; the operator states which, never the size
of the input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from jouleframe.runtime import written

ACCURACY = 10_000
FEW_GROUPS = 10_000  # most bracket rows that are broadcast, after counting them


@dataclass(frozen=True)
class Quantile:
    """Quantile ``q`` of ``value`` per group; rows where ``value`` is NULL do not count."""

    out: str
    value: Column
    q: float = 0.5


def median(out: str, value: Column) -> Quantile:
    return Quantile(out, value, 0.5)


def group_quantiles(df: DataFrame, keys: list[str], quantiles: list[Quantile], aggs: list[Column] = (),
                    bounded_groups: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with the asked quantiles and the plain aggregates ``aggs``.

    ``bounded_groups``: the keys bound their groups to what one aggregation buffer holds.
    """
    if not quantiles:
        return df.groupBy(*keys).agg(*aggs)
    if bounded_groups:
        exact = [F.percentile(z.value.cast("double"), F.lit(float(z.q))).alias(z.out) for z in quantiles]
        return df.groupBy(*keys).agg(*aggs, *exact)
    return _bracketed(df, keys, quantiles, list(aggs), accuracy)


def sent_whole_if_few(groups: DataFrame) -> DataFrame:
    """``groups`` (written before), counted: few go to every task; else rows would go to as many tasks as there are groups."""
    return F.broadcast(groups) if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else groups


def _used(df: DataFrame, keys: list[str], columns: list[Column]) -> list[str]:
    """The columns of ``df`` that the expressions name (or whose names cannot be told from their text)."""
    words = set(re.findall(r"\w+", " ".join(map(str, columns)))) | set(keys)
    return [c for c in df.columns if c in words or not re.fullmatch(r"\w+", c)]


def _bracketed(df: DataFrame, keys, quantiles, aggs, accuracy) -> DataFrame:
    # Read twice below: what is needed is written once, so that its source is planned and run once.
    df = written(df.select(*_used(df, keys, [*aggs, *[z.value for z in quantiles]])))
    slots = range(len(quantiles))
    vals = [z.value.cast("double") for z in quantiles]
    slack = 3.0 / accuracy

    # Pass 1: counts, bounds and a sketch per slot. Sketches merge map-side.
    stats = [F.struct(
        F.count(vals[j]).alias("n"), F.min(vals[j]).alias("lo"), F.max(vals[j]).alias("hi"),
        F.percentile_approx(vals[j], [max(quantiles[j].q - slack, 0.0), min(quantiles[j].q + slack, 1.0)], accuracy).alias("b"),
    ).alias(f"_s{j}") for j in slots]
    first = df.groupBy(*keys).agg(*aggs, *stats)

    # Up to ``accuracy`` rows the whole group is inside the bracket.
    bounds = []
    for j in slots:
        s, q = F.col(f"_s{j}"), quantiles[j].q
        few, pos = s["n"] < accuracy, (s["n"] - 1) * F.lit(q)
        bounds.append(F.struct(
            F.when(few | F.lit(q <= slack), s["lo"]).otherwise(s["b"][0]).alias("lo"),
            F.when(few | F.lit(q >= 1 - slack), s["hi"]).otherwise(s["b"][1]).alias("hi"),
            pos.alias("pos"),
        ).alias(f"_b{j}"))
    names = [f"_k{i}" for i in range(len(keys))]
    if keys:
        first = written(first)
    brackets = first.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *bounds)
    sent = sent_whole_if_few if keys else (lambda d: d)

    # Pass 2: below the bracket count only (NULL value); above it drop; inside keep the value.
    on = F.lit(True)
    for k, n in zip(keys, names):
        on = on & F.col(f"_d.{k}").eqNullSafe(F.col(f"_r.{n}"))
    slim = df.select(*keys, *[vals[j].alias(f"_v{j}") for j in slots])
    if keys:
        joined = slim.alias("_d").join(sent(brackets).alias("_r"), on)
    else:
        one = brackets.select(F.struct(*brackets.columns).alias("s")).scalar()
        joined = slim.withColumn("_r", one).select(*slim.columns, "_r.*")
    # Few rows stand inside a bracket; only those are taken apart by slot. The others are counted as they are.
    inside = [F.col(f"_v{j}").between(F.col(f"_b{j}.lo"), F.col(f"_b{j}.hi")) for j in slots]
    tagged = F.explode(F.filter(F.array(*[
        F.when(inside[j], F.struct(F.lit(j).alias("j"), F.col(f"_v{j}").alias("v"), F.col(f"_b{j}.pos").alias("pos"))) for j in slots
    ]), lambda e: e.isNotNull())).alias("e")
    counted = (joined.filter(reduce(Column.__or__, inside)).select(*names, tagged).select(*names, "e.j", "e.v", "e.pos")
               .groupBy(*names, "j", "v", "pos").agg(F.count("*").alias("c")))
    below = joined.groupBy(*names).agg(*[F.struct(
        F.lit(j).alias("j"), F.lit(None).cast("double").alias("v"), F.max(f"_b{j}.pos").alias("pos"),
        F.count_if(F.col(f"_v{j}") < F.col(f"_b{j}.lo")).alias("c")).alias(f"_n{j}") for j in slots])
    below = below.select(*names, F.explode(F.array(*[f"_n{j}" for j in slots])).alias("e")).select(*names, "e.*").filter("c > 0")
    counted = counted.unionByName(below)
    w = (Window.partitionBy(*names, "j").orderBy(F.col("v").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("upto", F.sum("c").over(w))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("v")))

    low, high = F.floor("pos"), F.ceil("pos")
    picked = ranked.groupBy(*names, "j").agg(F.max("pos").alias("pos"), at(low).alias("a"), at(high).alias("b"))
    frac = F.col("pos") - F.floor("pos")
    value = (F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("quantile rank fell outside its bracket")))
             .when(F.col("a") == F.col("b"), F.col("a"))
             .otherwise(F.col("a") * (1 - frac) + F.col("b") * frac))
    wide = (picked.select(*names, "j", value.alias("x")).groupBy(*names)
            .agg(*[F.max(F.when(F.col("j") == j, F.col("x"))).alias(f"_q{j}") for j in slots]))
    back = F.lit(True)
    for k, n in zip(keys, names):
        back = back & F.col(f"_f.{k}").eqNullSafe(F.col(f"_w.{n}"))
    kept = [c for c in first.columns if not c.startswith("_s")]
    if not keys:
        one = wide.select(F.struct(*wide.columns).alias("s")).scalar()
        return first.withColumn("_w", one).select(
            *kept, *[F.col(f"_w._q{j}").alias(quantiles[j].out) for j in slots])
    return first.alias("_f").join(wide.alias("_w"), back, "left").select(
        *[F.col(f"_f.{c}") for c in kept], *[F.col(f"_w._q{j}").alias(quantiles[j].out) for j in slots])
