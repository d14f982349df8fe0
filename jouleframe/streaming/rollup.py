"""Structured Streaming roll-up of power telemetry.

Streams are cut into slices first. Windows are put together from the stored slices when they
are read, so that a window that is still open has its newest numbers; sessions and runs are
put together in the stream and written once, when they are over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from jouleframe.operators.telemetry import summarise_telemetry, with_sessions
from jouleframe.streaming.sessions import sessions
from jouleframe.streaming.slices import SLICE, assembled, micros, slice_for, sliced
from jouleframe.streaming.state import started


def windowed_rollup(samples: DataFrame, keys: list[str], size: str, slide: str | None = None, delay: str = "1 minute",
                    tie: list[str] = (), slice_: str = SLICE) -> DataFrame:
    """One summary per (event-time window, keys) of a table; the slices of these windows on a stream.

    On a stream, samples later than ``delay`` behind the newest one are dropped by the
    watermark, and a slice leaves the state when the watermark has passed it. Write the slices
    with ``start_rollup`` and read the windows with ``read_rollup``.
    """
    if samples.isStreaming:
        return sliced(samples, keys, slice_for(samples.sparkSession, slice_, size, slide), tie, delay).drop("slice_time")
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    placed = samples.withColumn("_w", window).withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")
    return summarise_telemetry(placed, ["window_start", "window_end", *keys], tie=list(tie))


def run_rollup(samples: DataFrame, run: str = "run_id", keys: list[str] = ("gpu_key",), gap: str | None = None,
               delay: str = "1 minute", tie: list[str] = (), silence: str = "10 minutes", slice_: str = SLICE) -> DataFrame:
    """One summary per measured run; with ``gap``, runs are sessions separated by silence instead.

    On a stream a run ends when no sample of it came for ``silence`` of event time, and a slice
    beyond that; its state is then dropped, and samples that still follow count as a further
    row of that run. Start these streams with ``mode="append"``: sessions have no intermediate results.
    """
    if not samples.isStreaming:
        if not gap:
            return summarise_telemetry(samples, [run, *keys], tie=list(tie))
        spans = summarise_telemetry(with_sessions(samples, list(keys), gap), ["session", *keys], tie=list(tie))
        return spans.drop("session")
    spark = samples.sparkSession
    by = [*([] if gap else [run]), *keys]
    silent = micros(spark, gap or silence)
    short = min(micros(spark, slice_), silent)  # no silence fits into a slice
    cut = sliced(samples, by, f"{short} microseconds", tie, delay)
    out = sessions(cut, samples.columns, by, silent, short)
    return out if gap else out.drop("window_start", "window_end")


def start_rollup(rollup: DataFrame, path: str, checkpoint: str, available_now: bool = False, mode: str = "update") -> StreamingQuery:
    """Write every refreshed slice per batch; a replayed batch overwrites its own files.

    ``mode="append"`` writes a row once, when it is final: for sessions and runs.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = rollup.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return started(rollup.sparkSession, writer, available_now)


def _newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    written = spark.read.parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return written.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "batch_id")


def read_rollup(spark: SparkSession, path: str, keys: list[str], size: str, slide: str | None = None) -> DataFrame:
    """Windows put together from the newest version of every slice written by ``start_rollup``."""
    window = F.window("slice_start", size, slide) if slide else F.window("slice_start", size)
    placed = _newest(spark, path, ["slice_start", *keys]).withColumn("_w", window)
    placed = placed.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")
    return assembled(placed, ["window_start", "window_end", *keys])


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions or runs written by ``start_rollup`` in append mode, each of them once."""
    return spark.read.parquet(path).drop("batch_id")
