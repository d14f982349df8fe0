"""Session settings and lineage cutting shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_recommended_conf(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def find_package(spark: SparkSession) -> None:
    """Local Python workers find this package where the driver found it; a cluster ships it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal few rows over all cores ahead of work that is heavy per row.

    The explicit count keeps adaptive execution from folding a small table into one task.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a scratch one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = os.path.join(tempfile.gettempdir(), f"spark-ckpt-{spark.sparkContext.applicationId}")
    os.makedirs(path, exist_ok=True)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable checkpoint storage; the copy keeps its partitions and their order."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path in the folder all executors reach that nothing has used before."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet in the folder all executors reach and go on from the written copy."""
    spark = df.sparkSession
    path = fresh_folder(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``written`` wrote; nothing that reads it may run afterwards."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
