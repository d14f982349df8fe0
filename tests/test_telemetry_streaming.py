import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from jouleframe.operators import telemetry as tel
from jouleframe.streaming import ingest, rollup

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "gpu_key string, ts timestamp, power_w double, sm_clock double, temp double, throttle long, counter_mj long"


def samples(spark, n=400):
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.02, 0.5, 7.0, 95.0])
        rows.append(("hot" if i % 3 else "cool", T0 + dt.timedelta(seconds=t), 50 + 100 * rng.random(), 1000.0 + i, 40.0, i % 512, i * 10))
    return spark.createDataFrame(rows, SCHEMA), rows


def trapezoid(rows):
    rows = sorted(rows, key=lambda r: r[1])
    return sum(0.5 * (a[2] + b[2]) * (b[1] - a[1]).total_seconds() for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("slice_s", [1, 60, 100_000])
def test_sliced_integral_equals_the_plain_one(spark, slice_s):
    df, rows = samples(spark)
    got = {r["gpu_key"]: r["energy_integrated_j"] for r in tel.trapezoid_energy(df.repartition(5), ["gpu_key"], slice_s).collect()}
    for g in ("hot", "cool"):
        assert got[g] == pytest.approx(trapezoid([r for r in rows if r[0] == g]), rel=1e-9)


def test_summary_of_one_sample(spark):
    df = spark.createDataFrame([("L4", T0, 70.0, 1500.0, 50.0, 4, 100)], SCHEMA)
    r = tel.summarise_telemetry(df, ["gpu_key"]).first()
    assert r["power_sd_w"] == 0 and r["energy_integrated_j"] == 0 and r["energy_counter_j"] == 0 and r["frac_sw_power_cap"] == 1 and r["duration_s"] == 1e-9


def test_summary_by_hand(spark):
    df = spark.createDataFrame([("L4", T0 + dt.timedelta(seconds=s), p, 1000.0, 50.0, m, c) for s, p, m, c in ((0, 10.0, 4, 0), (1, 30.0, 0, 15_000), (3, 20.0, 8, 65_000))], SCHEMA)
    r = tel.summarise_telemetry(df, ["gpu_key"]).first()
    assert r["n_samples"] == 3 and r["duration_s"] == 3 and r["power_median_w"] == 20 and r["energy_integrated_j"] == 70 and r["energy_counter_j"] == 65
    assert r["power_sd_w"] == pytest.approx((200 / 3) ** 0.5) and r["frac_hw_slowdown"] == pytest.approx(1 / 3)


def test_idle_discards_settling(spark):
    df = spark.createDataFrame([("L4", T0 + dt.timedelta(seconds=s), p, 210.0, 30.0, 0, 0) for s, p in ((0, 300.0), (4, 200.0), (5, 20.0), (9, 22.0))], SCHEMA)
    r = tel.idle_baseline(df, ["gpu_key"]).first()
    assert r["power_w"] == 21 and r["samples"] == 2 and r["seconds"] == 4


def test_repeats(spark):
    rows = [("k", "L4", 0, 1.0, 10.0, 9.0, 10.0), ("k", "L4", 1, 3.0, 30.0, 9.0, 0.0), ("k", "L4", 2, 2.0, 20.0, 11.0, 10.0)]
    df = spark.createDataFrame(rows, "kernel_sig string, gpu_key string, repeat int, latency_s double, energy_j double, energy_counter_j double, energy_integrated_j double")
    r = tel.summarise_repeats(df).first()
    assert (r["latency_s"], r["energy_raw_j"], r["n_repeats"]) == (2, 20, 3) and r["energy_check_ratio"] == pytest.approx(1.1)
    assert r["latency_sd_rel"] == pytest.approx((2 / 3) ** 0.5 / 2)
    e = tel.summarise_e2e_repeats(df, ["gpu_key"]).first()
    assert e["power_avg_w"] == 10
    w = spark.createDataFrame([(None, 0.0, 5.0, 2.0), (7.0, 3.0, 5.0, 2.0), (None, 3.0, 5.0, 2.0)], "energy_counter_j double, energy_integrated_j double, power_mean_w double, duration_s double")
    assert [r[0] for r in w.select(tel.repeat_energy(w)).collect()] == [10, 7, 3]


def same_rows(got, want, key, columns):
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    for a, b in zip(got, want, strict=True):
        for c in columns:
            assert a[c] == (pytest.approx(b[c], rel=1e-9, abs=1e-7) if isinstance(b[c], float) else b[c]), c


@pytest.mark.parametrize("slide", [None, "4 minutes"])
def test_stream_equals_batch(spark, tmp_path, slide):
    df, rows = samples(spark)
    for i, part in enumerate((df.filter("counter_mj < 1500"), df.filter("counter_mj >= 1500"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rolled = rollup.windowed_rollup(stream, ["gpu_key"], "10 minutes", slide, delay="1 day")
    rollup.start_rollup(rolled, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    got = rollup.read_rollup(spark, str(tmp_path / "out"), ["gpu_key"], "10 minutes", slide)
    want = rollup.windowed_rollup(df, ["gpu_key"], "10 minutes", slide)
    assert sorted(got.columns) == sorted(want.columns)
    same_rows(got, want, lambda r: (r["gpu_key"], r["window_start"]), want.columns)


def steady(spark, folder, batches=8, per=300):
    """A device that never falls silent, watts in steps of 0.5, and one with pauses; one file per batch, in order of time."""
    rng = random.Random(3)
    out = []
    for b in range(batches):
        rows = []
        for i in range(b * per, (b + 1) * per):
            rows.append(("on", T0 + dt.timedelta(seconds=i), 100 + rng.randrange(40) / 2, 1000.0 + rng.randrange(5), 40.0 + i % 3, rng.randrange(512), i * 10))
            if i % 200 < 50:
                rows.append(("breaks", T0 + dt.timedelta(seconds=i, microseconds=7), 10.0 * (i % 7), 900.0, None, 0, None))
        out += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their time stamps
    return out


def state_rows(query):
    return [sum(x["numRowsTotal"] for x in p["stateOperators"]) for p in query.recentProgress]


def test_state_of_windows_is_flat(spark, tmp_path):
    steady(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rollup.start_rollup(rollup.windowed_rollup(stream, ["gpu_key"], "1 day", delay="30 seconds"), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    q.awaitTermination()
    held = state_rows(q)
    assert len(held) >= 8 and max(held[3:]) <= max(held[:3])  # the day never closes, yet nothing piles up
    got = rollup.read_rollup(spark, str(tmp_path / "out"), ["gpu_key"], "1 day")
    want = rollup.windowed_rollup(spark.read.parquet(str(tmp_path / "in")), ["gpu_key"], "1 day")
    same_rows(got, want, lambda r: r["gpu_key"], want.columns)


def test_state_of_sessions_is_flat(spark, tmp_path):
    steady(spark, str(tmp_path / "in"))
    # A last sample far ahead moves the watermark past all sessions.
    spark.createDataFrame([("end", T0 + dt.timedelta(days=1), 1.0, 1.0, 1.0, 0, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spans = rollup.run_rollup(stream, gap="90 seconds", delay="30 seconds", slice_="20 seconds")
    q = rollup.start_rollup(spans, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True, mode="append")
    q.awaitTermination()
    held = state_rows(q)
    assert len(held) >= 9 and max(held[4:]) <= 1.1 * max(held[:4])
    got = rollup.read_sessions(spark, str(tmp_path / "out"))
    want = rollup.run_rollup(spark.read.parquet(str(tmp_path / "in")).filter("gpu_key != 'end'"), gap="90 seconds")
    assert got.count() == 1 + 12
    same_rows(got, want, lambda r: (r["gpu_key"], r["n_samples"], r["power_mean_w"], r["energy_integrated_j"]), want.columns)
    assert {r["window_start"] for r in got.filter("gpu_key = 'on'").collect()} == {T0}


def test_runs_of_a_stream(spark, tmp_path):
    df, _ = samples(spark)
    tagged = df.withColumn("run_id", F.when(F.col("counter_mj") < 2000, "r1").otherwise("r2"))
    tagged.coalesce(1).write.parquet(str(tmp_path / "in"))
    tail = tagged.limit(1).withColumns({"run_id": F.lit("end"), "ts": F.col("ts") + F.expr("INTERVAL 9 DAYS")})
    time.sleep(1.1)
    tail.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tagged.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rollup.start_rollup(rollup.run_rollup(stream, delay="1 minute"), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True, mode="append")
    q.awaitTermination()
    want = rollup.run_rollup(tagged)
    got = rollup.read_sessions(spark, str(tmp_path / "out"))
    assert sorted(got.columns) == sorted(want.columns)
    same_rows(got, want, lambda r: (r["run_id"], r["gpu_key"]), want.columns)


def test_runs_and_sessions(spark):
    df, _ = samples(spark)
    assert rollup.run_rollup(df.withColumn("run_id", F.lit("r1"))).count() == 2
    assert rollup.run_rollup(df.filter("gpu_key = 'hot'"), gap="3 days").count() == 1
    native = df.groupBy(F.session_window("ts", "90 seconds"), "gpu_key").agg(F.count("*").alias("n"), F.avg("power_w").alias("p"))
    want = sorted((r["gpu_key"], r["n"], round(r["p"], 9)) for r in native.collect())
    for slice_s in (1, 60, 100_000):
        split = tel.with_sessions(df, ["gpu_key"], "90 seconds", slice_s).groupBy("gpu_key", "session").agg(F.count("*").alias("n"), F.avg("power_w").alias("p"))
        assert sorted((r["gpu_key"], r["n"], round(r["p"], 9)) for r in split.collect()) == want


INGEST = "kernel_sig string, gpu_key string, contended int, ts long, v int"


def ingest_once(spark, tmp_path, rows, checkpoint="c", on_batch=None):
    spark.createDataFrame(rows, INGEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(INGEST).parquet(str(tmp_path / "in"))
    q = ingest.start_ingest(stream, str(tmp_path / "t"), str(tmp_path / checkpoint), ["ts"], on_batch=on_batch, available_now=True)
    q.awaitTermination()
    return q


def ingested(spark, tmp_path):
    return {r["kernel_sig"]: r["v"] for r in ingest.read_ingested(spark, str(tmp_path / "t"), ["ts"]).collect()}


def test_ingest_resumes_without_duplicates(spark, tmp_path):
    seen = []
    note = lambda b, i: seen.append(b.count())
    ingest_once(spark, tmp_path, [("a", "L4", 1, 1, 1), ("a", "L4", 1, 2, 2), ("b", "L4", 0, 1, 3)], on_batch=note)
    ingest_once(spark, tmp_path, [("a", "L4", 0, 0, 4), ("b", "L4", 0, 9, 5), ("c", "L4", 1, 1, 6), ("c", "L4", None, 0, 7)], on_batch=note)
    assert ingested(spark, tmp_path) == {"a": 4, "b": 3, "c": 7} and sum(seen) == 4
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_a_new_query_adds_to_what_others_stored(spark, tmp_path):
    ingest_once(spark, tmp_path, [("a", "L4", 0, 1, 1), ("b", "L4", 1, 1, 2)])
    again = [("a", "L4", 0, 5, 10), ("b", "L4", 0, 0, 11), ("d", "L4", 1, 1, 12)]
    ingest_once(spark, tmp_path, again, checkpoint="c2")  # sees the first file again, too
    assert ingested(spark, tmp_path) == {"a": 1, "b": 11, "d": 12}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_a_batch_reads_nothing_of_the_history(spark, tmp_path):
    updated = []
    for b in range(5):
        rows = [(f"k{b}_{i}", "L4", i % 2, 1, i) for i in range(40)] + [("k0_1", "L4", 1, 99, -1)]
        q = ingest_once(spark, tmp_path, rows)
        with_rows = [p for p in q.recentProgress if p["numInputRows"]]
        updated.append((sum(p["numInputRows"] for p in with_rows), max(x["numRowsUpdated"] for p in with_rows for x in p["stateOperators"])))
        for old in (tmp_path / "t").glob("*/batch_id=*/*.parquet"):
            old.write_bytes(b"not parquet")  # nothing that a batch does could survive a look at earlier rows
    assert len(set(updated)) == 1 or max(u for _, u in updated[1:]) <= updated[0][1] + 1
    total = max(x["numRowsTotal"] for p in q.recentProgress for x in p["stateOperators"])
    assert total == 5 * 40


def test_a_retried_batch_writes_the_same_rows(spark, tmp_path):
    tries = []

    def fail_once(batch, batch_id):
        tries.append(sorted(r["v"] for r in batch.collect()))
        if len(tries) == 1:
            raise RuntimeError("lost")

    rows = [("a", "L4", 0, 1, 1), ("b", "L4", 1, 1, 2)]
    with pytest.raises(Exception, match="lost"):
        ingest_once(spark, tmp_path, rows, on_batch=fail_once)
    stream = spark.readStream.schema(INGEST).parquet(str(tmp_path / "in"))
    ingest.start_ingest(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["ts"], on_batch=fail_once, available_now=True).awaitTermination()
    assert tries[0] == tries[1] == [1, 2] and spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_ingest_moves_each_column_once(spark):
    """The rows of a batch are compared as one struct; columns that cannot be compared (maps) still come through."""
    rows = [("k", "L4", 1, 5, 0.1), ("k", "L4", 0, 3, 0.2), ("k", "L4", 0, 4, 0.3), ("j", "L4", 1, 2, 0.4), ("j", "H100", None, 1, 0.5)]
    df = spark.createDataFrame(rows, "kernel_sig string, gpu_key string, contended int, ts int, energy_j double")
    best = {("k", "L4", 0, 4, 0.3), ("j", "L4", 1, 2, 0.4), ("j", "H100", 0, 1, 0.5)}
    plain = ingest.new_rows(df, df.limit(0), ["ts"])
    assert {tuple(r) for r in plain.collect()} == best and plain.columns == df.columns
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "max(" in plan
    mapped = ingest.new_rows(df.withColumn("m", F.create_map(F.lit("a"), "ts")), df.limit(0).withColumn("m", F.create_map(F.lit("a"), "ts")), ["ts"])
    assert {(*tuple(r)[:5], r["m"]["a"]) for r in mapped.collect()} == {(*b, b[3]) for b in best}
