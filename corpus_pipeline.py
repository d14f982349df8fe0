"""A training corpus from raw documents: toxic ones go, copies go, near copies go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept;
all but the last return the columns of ``documents``. ``run`` writes each stage's rows as
parquet in the folder that the cluster shares and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jouleframe.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from jouleframe.llm.common import keep, table
from jouleframe.llm.queries import production_weights

BATCH_BYTES = 4 << 20  # of texts that go to a Python worker at once; the stages share the executors' memory
MIXED_SHARE = 0.9  # of the tokens that the stages before it kept
MIXED_SEED = 7


def _in_small_batches(spark: SparkSession) -> None:
    """A setting of the session, as a stage's rows are computed when they are written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch at most, so no document occurs twice; the budget is a share of what is there."""
    return mixing.take_mixed(docs, F.floor(F.sum("tokens") * MIXED_SHARE), production_weights(), MIXED_SEED)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return packing.pack(docs)


STAGES = [("toxicity", remove_toxic), ("exact dedup", remove_copies), ("near dedup", remove_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

# Boosted trees and packing cannot be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
