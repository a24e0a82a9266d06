"""Range selections: a workload of closed integer ranges on one attribute.

Modes: exact gives the rows that qualify; bins the bins that a range touches; padded their whole padded
contents, which is what a storage server would send; sizes only how many rows that is.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import whole
from .padding import padded, placed


def exact(df: DataFrame, key: str, qs: int, qe: int) -> DataFrame:
    return df.where(F.col(key).between(qs, qe))


def exact_workload(df: DataFrame, key: str, workload: DataFrame) -> DataFrame:
    """query_id and the rows of each range of workload (query_id, qs, qe)."""
    # The stated workload is the small side by contract; the planner sees its size.
    return workload.join(df, whole(key).between(workload["qs"], workload["qe"])).drop("qs", "qe")


def touched(bins: DataFrame, workload: DataFrame) -> DataFrame:
    """query_id, bin_id, padded of every bin that a range overlaps; empty ranges touch none."""
    meets = (bins["lo"] <= workload["qe"]) & (bins["hi"] >= workload["qs"]) & (workload["qs"] <= workload["qe"])
    return workload.join(bins, meets).select("query_id", "bin_id", "padded")


def response(df: DataFrame, key: str, bins: DataFrame, workload: DataFrame) -> DataFrame:
    """query_id, bin_id, is_dummy and the columns of df: all padded rows of the touched bins."""
    table = padded(placed(df, key, bins), bins, F.col("padded") - F.col("real"))
    return touched(bins, workload).select("query_id", "bin_id").join(table, "bin_id")


def refined(answer: DataFrame, key: str, workload: DataFrame) -> DataFrame:
    """The rows of a response that qualify."""
    return answer.where("NOT is_dummy").join(workload, "query_id").where(whole(key).between(F.col("qs"), F.col("qe"))).drop("qs", "qe", "is_dummy", "bin_id")


def blow_up(df: DataFrame, key: str, bins: DataFrame, workload: DataFrame) -> DataFrame:
    """query_id, padded_rows, exact_rows, blow_up; queries without an answer are skipped."""
    values = df.where(F.col(key).isNotNull()).groupBy(whole(key).alias("key")).agg(F.count("*").alias("n"))
    right = workload.join(values, values["key"].between(workload["qs"], workload["qe"])).groupBy("query_id").agg(F.sum("n").alias("exact_rows"))
    sent = touched(bins, workload).groupBy("query_id").agg(F.sum("padded").alias("padded_rows"))
    return sent.join(right, "query_id").select("query_id", "padded_rows", "exact_rows", (F.col("padded_rows") / F.col("exact_rows")).alias("blow_up"))
