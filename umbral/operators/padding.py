"""Placing rows in bins and padding bins with dummy rows.

A padded table has bin_id, is_dummy and the original columns, which are null in dummies. Rows of null key
are in no bin.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that bins may cover to be listed one by one; and bins that a worker holds to look wider ranges up.
LISTED, LOOKED_UP = 50_000_000, 2_000_000


def by_value(bins: DataFrame) -> DataFrame:
    """key, bin_id for every value that a bin covers."""
    return bins.select(F.explode(F.sequence("lo", "hi")).alias("__key"), "bin_id")


def placed(df: DataFrame, key: str, bins: DataFrame) -> DataFrame:
    """df with the bin_id of its key: an equi-join on the value, so that the planner may pick either side.

    Bins that cover more than LISTED values are looked up in the sorted list of their bounds instead, in Arrow batches.
    """
    width, n = bins.agg(F.sum(F.col("hi").cast("double") - F.col("lo") + 1), F.count("*")).first()
    if (width or 0) > LISTED:
        if n > LOOKED_UP:
            raise ValueError(f"{n} bins over {width:.0f} values; at most {LOOKED_UP} bins can be looked up")
        return looked_up(df, key, bins)
    values = by_value(bins)
    return df.join(values, F.col(key).cast("long") == values["__key"]).drop("__key")


def looked_up(df: DataFrame, key: str, bins: DataFrame) -> DataFrame:
    rows = bins.select("lo", "hi", "bin_id").orderBy("lo").collect()  # at most LOOKED_UP
    lo, hi, names = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], [])))
    kept = df.withColumn("__key", F.col(key).cast("long")).where("__key IS NOT NULL")
    out = df.schema.names + ["bin_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.columns[-1].to_numpy()
            at = np.searchsorted(lo, keys, "right") - 1
            inside = (at >= 0) & (keys <= hi[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names[at], pa.int64())], names=out).filter(pa.array(inside))

    schema = df.withColumn("bin_id", F.lit(0).cast("long")).schema
    return kept.mapInArrow(run, schema) if len(names) else kept.drop("__key").withColumn("bin_id", F.lit(0).cast("long")).limit(0)


def placed_by_key(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """df with the bin_id of its key, from rows (key, bin_id)."""
    m = members.select(F.col("key").alias("__key"), "bin_id")
    return df.join(m, F.col(key).cast("long") == m["__key"]).drop("__key")


def dummies(sizes: DataFrame, count: str | Column, like: DataFrame) -> DataFrame:
    """`count` rows for each bin of sizes, with null in the columns of `like`."""
    n = F.col(count) if isinstance(count, str) else count
    rows = sizes.select("bin_id", n.alias("__n")).where("__n > 0").select("bin_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i"))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name != "bin_id"]
    return rows.select("bin_id", F.lit(True).alias("is_dummy"), *nulls)


def padded(in_bins: DataFrame, sizes: DataFrame, count: str | Column) -> DataFrame:
    """Rows that carry bin_id, with as many dummies for each bin as `count` says."""
    real = in_bins.select("bin_id", F.lit(False).alias("is_dummy"), *[F.col(f"`{c}`") for c in in_bins.columns if c != "bin_id"])
    return real.unionByName(dummies(sizes, count, in_bins))


def compacted(matches: DataFrame, slots: int, noise: int) -> DataFrame:
    """Matches followed by dummies up to the noisy size, but no more rows than there are slots."""
    out = matches.withColumn("is_dummy", F.lit(False))
    n = matches.count()
    more = max(0, min(n + noise, slots) - n)
    fill = matches.sparkSession.range(more).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in matches.schema], F.lit(True).alias("is_dummy"))
    return out.unionByName(fill)


def expanded(df: DataFrame, count: str) -> DataFrame:
    """Each row `count` times: run-length decoding."""
    return df.where(F.col(count) > 0).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long")))).drop("__i")


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition and all others (nulls among these)."""
    yes = F.coalesce(condition, F.lit(False))
    return df.where(yes), df.where(~yes)
