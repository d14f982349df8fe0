"""Exact deduplication with keyed streaming state (operator 10).

Each document becomes a narrow row: the SHA-256 of its text without white space, its code
points, its identifier and the locator of its content. A streaming query reads those rows
and keeps one state entry per digest - best row so far and number of rows - in RocksDB,
without expiry, so later batches meet every document ever seen. On hits (digests of more
than one row) the whole normalised bytes are compared with those of the row that stays;
digests under which texts differ are grouped again by the bytes themselves.

Defined results: a null text is an empty one, and all empty texts form one group. Of equal
texts the one with most code points stays, then the smallest ``doc_id`` (null last), then
the first locator, so of identical rows exactly one stays. Columns other than ``doc_id``
and ``text`` are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jouleframe.llm.common import LOCATOR, forget, keep, located, new_folder, text_of

WHITE = " \t\n\x0b\x0c\r"
STORE_MB = "64"  # of an executor's memory for all its state stores
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(name: str = "text") -> Column:
    return F.translate(text_of(name), WHITE, "")


def digests(docs: DataFrame, digest=None) -> DataFrame:
    """One narrow row per document; ``docs`` carries the locator."""
    digest = digest or (lambda text: F.sha2(text.cast("binary"), 256))
    return docs.select("doc_id", LOCATOR, digest(normalised()).alias("text_sha256"), F.length(text_of()).cast("bigint").alias("n"))


def rank() -> Column:
    """Smallest for the row that stays."""
    return F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(LOCATOR).alias(LOCATOR))


def group_state(rows: DataFrame) -> DataFrame:
    """The state per digest, for a streaming or a static frame of ``digests`` rows."""
    return rows.groupBy("text_sha256").agg(F.min(rank()).alias("best"), F.count("*").alias("group_size"))


@contextmanager
def _conf(spark: SparkSession, **pairs):
    old = {k: spark.conf.get(k, None) for k in pairs}
    for k, v in pairs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_groups(spark: SparkSession, folder: str, schema, state: str, out: str) -> DataFrame:
    """Run what is new in ``folder`` through the keyed state in ``state``; returns all groups so far.

    A later call with the same ``state`` and ``out`` continues where this one ended. Each
    batch writes the groups that it changed into its own folder, which a retry replaces.
    """
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # RocksDB state keeps changes, not whole snapshots, in the checkpoint folder, and sets no
    # disk space aside, which would cost megabytes a partition. All stores of an executor
    # share one bounded memory, however many partitions there are.
    with _conf(spark, **{"spark.sql.streaming.stateStore.providerClass": PROVIDER,
                         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
                         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
                         "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": STORE_MB,
                         "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
                         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}):
        query = (group_state(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode("update")
                 .option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start())
        query.awaitTermination()
    groups = group_state(spark.createDataFrame([], schema)).schema
    changed = spark.read.schema(groups.add("batch", "long")).option("basePath", out).parquet(f"{out}/batch=*") if _any(spark, out) else spark.createDataFrame([], groups.add("batch", "long"))
    last = changed.groupBy("text_sha256").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("g"))
    return last.select("text_sha256", "g.best", "g.group_size")


def _any(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def exact_duplicates(docs: DataFrame, digest=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and the locator."""
    return _duplicates(located(docs, "doc_id", "text"), digest)


def _duplicates(content: DataFrame, digest=None) -> DataFrame:
    spark = content.sparkSession
    base = new_folder(spark, "dedup")
    rows = digests(content, digest)
    rows.write.parquet(f"{base}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{base}/rows")
    groups = stream_groups(spark, f"{base}/rows", rows.schema, f"{base}/state", f"{base}/groups")
    found = written.join(groups, "text_sha256").withColumn("kept", F.col(LOCATOR) == F.col(f"best.{LOCATOR}"))

    # Full bytes on hits only: texts are normalised after the join that picks them.
    hits = found.where(F.col("group_size") > 1).select(LOCATOR, "text_sha256", "kept", F.col("n").alias("n_hit"))
    texts = keep(content.join(hits, LOCATOR).select("doc_id", LOCATOR, "text_sha256", "kept", F.col("n_hit").alias("n"), normalised().alias("bytes")), "hits")
    stays = texts.where("kept").select("text_sha256", F.col("bytes").alias("kept_bytes"))
    differ = keep(texts.where(~F.col("kept")).join(stays, "text_sha256").where(F.col("bytes") != F.col("kept_bytes"))
                  .select("text_sha256").distinct(), "collisions")
    plain = found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256", LOCATOR)
    if differ.isEmpty():
        forget(texts)
        return plain
    split = texts.join(differ, "text_sha256", "left_semi")
    again = split.groupBy("text_sha256", "bytes").agg(F.min(rank()).alias("best"), F.count("*").alias("group_size"))
    apart = split.join(again, ["text_sha256", "bytes"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col(LOCATOR) == F.col(f"best.{LOCATOR}")).alias("kept"), "text_sha256", LOCATOR)
    return plain.join(differ, "text_sha256", "left_anti").select(apart.columns).unionByName(apart)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = docs.columns
    whole = located(docs, *names)
    gone = _duplicates(whole.select("doc_id", "text", LOCATOR)).where(~F.col("kept")).select(LOCATOR)
    return whole.join(gone, LOCATOR, "left_anti").select(*names)
