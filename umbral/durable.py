"""Cutting lineage, and tables made row by row, in the folder that executors share."""

import tempfile
import uuid
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

#: Rows that the driver holds at once.
CHUNK = 200_000


def work_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of our own only where it is unset, as in tests."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        kept = context.getCheckpointDir()
        folder = kept.get() if kept.isDefined() else tempfile.mkdtemp(prefix="umbral-work-")
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the work folder."""
    work_folder(df.sparkSession)
    return df.checkpoint()


def streamed(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A DataFrame of rows that come one by one, of which the driver holds CHUNK at most."""
    source = iter(rows)
    chunk = list(islice(source, CHUNK))
    if len(chunk) < CHUNK:
        return spark.createDataFrame(chunk, schema)
    folder = f"{work_folder(spark)}/rows-{uuid.uuid4().hex}"
    while chunk:
        spark.createDataFrame(chunk, schema).write.mode("append").parquet(folder)
        chunk = list(islice(source, CHUNK))
    return spark.read.schema(schema).parquet(folder)
