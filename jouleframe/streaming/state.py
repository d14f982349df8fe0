"""Starting queries whose state lives in RocksDB, on disk instead of in the executors' heaps."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(spark: SparkSession, writer: DataStreamWriter, available_now: bool) -> StreamingQuery:
    """Start ``writer``; the session's own setting is put back, as a query keeps those it was started with."""
    writer = writer.trigger(availableNow=True) if available_now else writer
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
