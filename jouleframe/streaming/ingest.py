"""Resumable, duplicate-free ingestion of measurement rows.

The best row of each key is keyed state, so a batch looks up its own keys and reads nothing
of what was stored before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from jouleframe.operators.merge import KEY, merge_measurements
from jouleframe.runtime import path_exists
from jouleframe.streaming.state import started


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that the checkpoint gives its query; a new checkpoint is a new query."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def new_rows(stream: DataFrame, recorded: DataFrame, later: list[str], keys: list[str] = KEY) -> DataFrame:
    """Rows of each batch worth keeping: unrecorded pairs, and clean rows for pairs recorded only contended.

    ``recorded``, a stream too, is what was stored before the first batch. The state keeps a
    key's best row: a clean one before contended ones, then one of an earlier batch, then the
    latest of its batch. A batch gives out the keys whose best row is its own.
    """
    now = F.unix_micros(F.current_timestamp())  # the same for all rows of a batch, and when it is run again
    contended = F.coalesce(F.col("contended").cast("int"), F.lit(0))
    both = stream.withColumn("_at", now).unionByName(recorded.withColumn("_at", F.lit(0).cast("bigint")))
    flagged = both.withColumn("contended", contended)
    # One struct holds each column once, in sorts, shuffle and state: what orders the rows first, the rest after it.
    order = [(-F.col("contended")).alias("contended"), (-F.col("_at")).alias("_at"), *dict.fromkeys(later)]
    rest = [c for c in stream.columns if c not in keys and c not in later and c != "contended"]
    whole = F.struct(*order, *rest)
    unordered = any("map<" in t or t == "variant" for _, t in stream.dtypes)  # such rows cannot be compared whole
    best = flagged.groupBy(*keys).agg((F.max_by(whole, F.struct(*order)) if unordered else F.max(whole)).alias("_best"))
    own = {c: F.col(c) if c in keys else -F.col("_best.contended") if c == "contended" else F.col(f"_best.{c}") for c in stream.columns}
    return best.where(F.col("_best._at") == -now).select(*[v.alias(c) for c, v in own.items()])


def _recorded(stream: DataFrame, path: str, checkpoint: str, later: list[str], keys: list[str]) -> DataFrame:
    """What other queries stored before this one began, written beside its checkpoint once and read as a stream."""
    spark, seed = stream.sparkSession, f"{checkpoint.rstrip('/')}-recorded"
    if not path_exists(spark, f"{seed}/_SUCCESS"):
        rows = _read(spark, path)
        rows = stream.sparkSession.createDataFrame([], stream.schema) if rows is None else merge_measurements(rows, [*later, "batch_id"], keys)
        rows.select(*[F.col(c).cast(t) for c, t in stream.dtypes]).write.mode("overwrite").parquet(seed)
    return spark.readStream.schema(stream.schema).parquet(seed)


def start_ingest(stream: DataFrame, path: str, checkpoint: str, later: list[str], keys: list[str] = KEY,
                 on_batch: Callable[[DataFrame, int], None] | None = None, available_now: bool = False) -> StreamingQuery:
    """Append new rows per batch under ``path``; ``on_batch`` sees each batch's kept rows.

    A retried batch starts from the state before it and overwrites its own folder. Folders
    carry query and batch, so a query with a new checkpoint adds to what earlier ones stored.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/query_id={_query_id(spark, checkpoint)}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        if on_batch is not None:
            on_batch(spark.read.parquet(target), batch_id)

    kept = new_rows(stream, _recorded(stream, path, checkpoint, later, keys), later, keys)
    writer = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return started(stream.sparkSession, writer, available_now)


def read_ingested(spark: SparkSession, path: str, later: list[str], keys: list[str] = KEY) -> DataFrame:
    """The table as one row per pair, clean rows first."""
    return merge_measurements(spark.read.parquet(path), [*later, "batch_id"], keys).drop("batch_id", "query_id")


def drop_resends(stream: DataFrame, keys: list[str], ts: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    """Drop exact resends that arrive within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
