"""Queries on copies of the small tables that differ where a finding says that results or work went wrong."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jouleframe.operators import folds
from jouleframe.plans.bindings import Tables
from oracle_check import differences, duck

DIR = "/root/testdata/sf0.001"


def copied(folder, **changed: str) -> str:
    """The tables of ``DIR`` in ``folder``, those named in ``changed`` as its SQL selects them from ``{t}``."""
    for f in os.listdir(DIR):
        name = f.removesuffix(".parquet")
        if name in changed:
            duckdb.execute(f"COPY ({changed[name].format(t=repr(f'{DIR}/{f}'))}) TO '{folder}/{f}' (FORMAT parquet)")
        else:
            os.symlink(f"{DIR}/{f}", f"{folder}/{f}")
    return str(folder)


def test_counter_ratio_passes_over_repeats_without_a_reading(spark, tmp_path):
    # The latest repeats of every card have no counter reading; prices end in halves.
    path = copied(tmp_path, lineitem="SELECT * REPLACE (CASE WHEN l_orderkey > 100 THEN 4 ELSE l_linenumber END AS l_linenumber, floor(l_extendedprice) + 0.5 AS l_extendedprice) FROM {t}")
    exact, _, text, n = differences(entry.queries()["counter_ratio"](spark, path), duck(path), entry.oracle_sql()["counter_ratio"])
    assert exact and n == 8, text


def test_read_e2e_deals_the_runs_of_a_card_over_pairs_of_files(spark, tmp_path, monkeypatch):
    from jouleframe.plans import files

    seen = {}
    read = files.readers.read_e2e
    monkeypatch.setattr(files.readers, "read_e2e", lambda s, folder: seen.setdefault("r", read(s, folder)))
    exact, _, text, _ = differences(entry.queries()["read_e2e"](spark, DIR), duck(DIR), entry.oracle_sql()["read_e2e"])
    assert exact, text
    runs, calls = seen["r"]
    pairs = {r["gpu_key"]: r["n"] for r in runs.groupBy("gpu_key").agg(F.countDistinct("tag").alias("n")).collect()}
    assert len(pairs) == 6 and min(pairs.values()) > 1
    # A run and its calls are in files of one tag.
    assert calls.select(F.col("model").alias("notes"), "tag").distinct().join(runs.select("notes", "tag"), ["notes", "tag"], "left_anti").isEmpty()


def rows_read(spark, name, tables) -> tuple[int, int]:
    """Rows of lineitem that a query of ``REGISTRY`` reads in all, and how many it has."""
    n = spark.sparkContext.accumulator(0)

    class Counted(tables):
        def raw(self, table):
            df = super().raw(table)
            if table != "lineitem":
                return df

            def count(batches):
                for b in batches:
                    n.add(len(b))
                    yield b

            return df.mapInPandas(count, df.schema)

    entry.REGISTRY[name].build(Counted(spark, DIR)).collect()
    return n.value, tables(spark, DIR).raw("lineitem").count()


@pytest.mark.parametrize("name", ["read_measurements", "read_captures"])
def test_files_of_all_categories_come_from_one_pass(spark, name):
    read, rows = rows_read(spark, name, Tables)
    assert read == rows


def test_passes_without_features_read_none(spark):
    rows = folds.written_rows(Tables(spark, DIR).dataset(), "hardware", ["log_flops", "log_tdp"])
    plan = rows.select("eta")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and folds.VECTOR not in plan.split("ReadSchema")[1].splitlines()[0]


def test_grams_sum_over_batches_and_tasks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = np.random.default_rng(1).normal(size=(100, 4)) * [1, 10, 0, 100] + 3
        df = spark.createDataFrame([(f"g{i % 3}", float(np.exp(r[0] / 10)), list(map(float, r[1:]))) for i, r in enumerate(data)], f"gpu_key string, energy_j double, {folds.VECTOR} array<double>").repartition(5)
        grams, mean, sd = folds.group_grams(df, "hardware")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = np.column_stack([data[:, 1:], data[:, 0] / 10])
    z = np.column_stack([np.ones(100), (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0, ddof=1), np.inf)])
    assert all(np.allclose(grams[f"g{g}"], z[g::3].T @ z[g::3]) for g in range(3)) and np.allclose(mean, x.mean(0))


def test_values_of_sessions_that_end_in_a_batch_never_enter_the_state():
    import pandas as pd
    from jouleframe.streaming.sessions import Sessions

    class State(dict):
        exists = lambda self: bool(self)
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)
        updateValue = dict.__setitem__
        getValue = dict.__getitem__
        containsKey = dict.__contains__
        iterator = lambda self: iter([(k, v) for k, v in self.items()])

    class Handle:
        getValueState = lambda self, *a: State()
        getMapState = lambda self, *a: State()
        listTimers = lambda self: []
        registerTimer = lambda self, t: None

    p = Sessions(["gpu_key", "ts", "power_w"], ["gpu_key"], gap=100, slice_=10)
    p.init(Handle())
    stored = []
    put = p.counts["power_w"].__class__.updateValue
    p.counts["power_w"].updateValue = lambda k, v: (stored.append(k[0]), put(p.counts["power_w"], k, v))
    row = lambda start, values: {"slice_start": start, **{c: 1.0 for c in p.combine}, "n_samples": len(values), "first_t": start, "last_t": start + 5, "first_p": 1.0, "last_p": 1.0, "power_w_values": values}
    # Out of order, over two chunks: a session of two slices, then one that stays open.
    chunks = [pd.DataFrame([row(1000, [7.0, 8.0])]), pd.DataFrame([row(10, [3.0, 4.0]), row(0, [1.0, 2.0, 2.0])])]
    out = pd.concat(p.handleInputRows(("L4",), iter(chunks), None))
    assert out["power_median_w"].tolist() == [2.0] and out["n_samples"].tolist() == [5] and stored == [7.0, 8.0]


def test_reconcile_merges_once_and_moves_the_calls_by_run(spark):
    """Values and cards come from merged rows that are written, and the calls are dealt by run for both of their steps."""
    from jouleframe.plans import queries

    t = Tables(spark, DIR)
    whole = queries._reconciled(t)
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = t.e2e_calls.join(t.e2e_runs.select("run_id", "gpu_key"), "run_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # one a side
    assert all(differences(entry.queries()[n](spark, DIR), duck(DIR), entry.oracle_sql()[n])[0] for n in ("reconcile", "step_model", "stream_ingest"))
