"""Tables kept in the shared folder, row locators and small text expressions."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jouleframe.runtime import shared_dir

LOCATOR = "__row_locator__"


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Local Python workers find this package where the driver found it; a cluster ships it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the folder all executors reach that nothing has used before."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and go on from the written copy."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``keep`` wrote; nothing that reads it may run afterwards."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` and ``LOCATOR``: the file and row that hold the content.

    A frame that does not come straight from files is first written to the shared folder.
    Repeated rows have different locators, so a locator names one row for ever.
    """
    place = F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias(LOCATOR)
    picked = docs.select(*columns)
    try:
        return docs.select(*columns, place)
    except AnalysisException:
        return keep(picked, "located").select(*columns, place)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
