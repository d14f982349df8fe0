"""Planning measurement work: what is left, in what order, on which shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from jouleframe.operators.ordering import with_running
from jouleframe.runtime import written

# Seconds of a default measurement protocol.
PROTOCOL = {"warmup_s": 2.0, "repeats": 3, "window_s": 3.0, "sleep_s": 0.25, "setup_s": 1.5, "n_buffers": 4}
SECONDS_PER_GIB = 0.4


def planned_pairs(catalogue: DataFrame, cards: list[str]) -> DataFrame:
    """Each config once per card; the cards are a short list, expanded inside the row."""
    return catalogue.withColumn("gpu_key", F.explode(F.array(*[F.lit(c) for c in cards])))


def remaining_work(catalogue: DataFrame, cards: list[str], done: DataFrame) -> DataFrame:
    """Planned pairs not recorded in any shard."""
    recorded = done.select("kernel_sig", "gpu_key").distinct()
    return planned_pairs(catalogue, cards).join(recorded, ["kernel_sig", "gpu_key"], "left_anti")


def estimate_cost_s(working_set: Column, protocol: dict = PROTOCOL) -> Column:
    """Seconds to measure one config: fixed protocol time plus filling its buffers."""
    fixed = (protocol["warmup_s"] + protocol["repeats"] * (protocol["window_s"] + protocol["sleep_s"])
             + protocol["setup_s"])
    gib = F.coalesce(working_set * protocol["n_buffers"] / 2.0**30, F.lit(0.5))
    return F.lit(fixed) + SECONDS_PER_GIB * gib


def _least_loaded(classes: Iterator[tuple[int, int]], n: int) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
    """For (cost, rows) of falling cost: the cost, and from which row on rows go round which shards.

    Every row goes to the shard with the least load, the smaller number on ties. Among equal
    costs, the shards that are level take turns in a fixed order, and each next shard joins
    them when they reach its load.
    """
    loads = [(0, k) for k in range(n)]  # a heap
    for cost, rows in classes:
        if rows <= 4 * n or cost == 0:
            turns = []
            for _ in range(rows if cost else min(rows, 1)):
                load, k = loads[0]
                heapq.heapreplace(loads, (load + cost, k))
                turns.append(k)
            yield cost, [(0, turns)]
            continue
        waiting = sorted(loads)
        level: list[list[int]] = []
        runs, at = [], 0
        while at < rows:
            level.append(list(waiting.pop(0)))
            level.sort()
            # Loads below the next shard's: those rows go round the level ones.
            ahead = [max(0, -(-(waiting[0][0] - l) // cost)) for l, _ in level] if waiting else None
            room = sum(ahead) if waiting else rows - at
            if not room:
                continue
            runs.append((at, [k for _, k in level]))
            take = min(room, rows - at)
            for i, x in enumerate(level):
                x[0] += cost * (ahead[i] if waiting and take == room else take // len(level) + (i < take % len(level)))
            at += take
        loads = [tuple(x) for x in level] + waiting
        heapq.heapify(loads)
        yield cost, runs


def balanced_shards(df: DataFrame, n: int, cost: str = "cost_s", key: str = "kernel_sig") -> DataFrame:
    """Assign each row to one of ``n`` shards: the costliest first, each to the shard with the least load.

    Ties in cost go by key, ties in load to the smaller shard; costs count in whole microseconds.
    The greatest load is within 4/3 of the best possible. Membership depends on costs and keys
    only, never on input order. Rows of equal cost are one class; the classes pass through one
    task as a stream of (cost, rows), and ranks within them place the rows.
    """
    if n < 1:
        raise ValueError("need at least one shard")
    micros = F.greatest(F.round(F.coalesce(F.col(cost), F.lit(0.0)) * 1e6), F.lit(0.0)).cast("bigint")
    ranked = with_running(df.withColumn("_micros", micros), ["_micros"], [F.col(key)], rank="_rank")

    def assign(batches):
        pairs = (p for b in batches for p in zip(b["_micros"].tolist(), b["rows"].tolist()))
        for c, runs in _least_loaded(pairs, n):
            yield pd.DataFrame({"_c": [c], "runs": [[{"start": a, "turns": t} for a, t in runs]]})

    classes = ranked.groupBy("_micros").agg(F.count("*").alias("rows")).coalesce(1).sortWithinPartitions(F.desc("_micros"))
    placed = written(classes.mapInPandas(assign, "_c bigint, runs array<struct<start: bigint, turns: array<int>>>"))
    row = F.col("_rank") - 1
    run = F.element_at(F.filter("runs", lambda r: r["start"] <= row), -1)
    turn = F.get(run["turns"], F.pmod(row - run["start"], F.size(run["turns"])).cast("int"))
    return ranked.join(placed, ranked["_micros"] == placed["_c"]).withColumn("shard", turn.cast("int")).select(*df.columns, "shard")


def within_budget(df: DataFrame, budget_s: float, order: list[Column], cost: str = "cost_s",
                  by: list[str] = ()) -> DataFrame:
    """Work that fits: stop before the first config whose cost would overrun the budget."""
    running = with_running(df, list(by), order, {"elapsed_s": F.col(cost)})
    return running.filter(F.col("elapsed_s") <= budget_s)
