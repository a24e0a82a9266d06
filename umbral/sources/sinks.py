"""Writers and readers of padded bins and of bin catalogs. Bins are directories, so a range reads only those it touches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Neighbouring bins that share a directory, so that directories stay few.
BINS_PER_FOLDER = 64


def write_bins(padded: DataFrame, path: str) -> None:
    folder = F.floor(F.col("bin_id") / BINS_PER_FOLDER)
    padded.withColumn("bin_folder", folder).repartition("bin_folder").sortWithinPartitions("bin_id").write.mode("overwrite").partitionBy("bin_folder").parquet(path)


def read_bins(spark: SparkSession, path: str, bin_ids: list[int] | None = None) -> DataFrame:
    """The bins asked for, or all: folders are pruned, then row groups by bin_id."""
    df = spark.read.parquet(path)
    if bin_ids is not None:
        df = df.where(F.col("bin_folder").isin(sorted({b // BINS_PER_FOLDER for b in bin_ids})) & F.col("bin_id").isin(list(bin_ids)))
    return df.drop("bin_folder")


def write_index(bins: DataFrame, path: str) -> None:
    bins.sort("lo").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_output(rows: DataFrame, path: str) -> None:
    """Result rows, appended to what earlier queries wrote there."""
    rows.write.mode("append").parquet(path)
