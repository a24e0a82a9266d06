"""Buckets of about equal mass over the noisy hierarchical histogram.

A walk over the domain closes a bucket once its noisy mass exceeds the target. It depends on all
values before it, so it cannot be divided; it reads the histogram (one row per domain value, never
the data) as a stream and holds one bucket at a time.
"""

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable, streamed
from ..functions.budget import HistogramPlan
from .catalog import dense_histogram, inferred, multiplicities

#: Domain values up to which the histogram is walked.
MAX_DOMAIN = 50_000_000

Row = tuple[int, int, int, int, int]


def joint_histogram(left: DataFrame, left_key: str, right: DataFrame, right_key: str, plan: HistogramPlan) -> DataFrame:
    """node, r1, e1, r2, e2: both tables' leaves after inference."""
    sides = []
    for df, key, tag, n in ((left, left_key, "h1_", 1), (right, right_key, "h2_", 2)):
        leaves = inferred(dense_histogram(df, key, plan, tag), plan, tag).where("level = 0")
        sides.append(leaves.select("node", F.col("real").alias(f"r{n}"), F.col("noise").alias(f"e{n}")))
    return sides[0].join(sides[1], "node")


def walk(rows: Iterable[Row], target: int, use: tuple[bool, bool] = (True, True)) -> Iterator[Row]:
    """(first node, last node, real 1, real 2) of each bucket, from rows (node, r1, e1, r2, e2) in order."""
    start, mass, real1, real2, node = 0, 0, 0, 0, -1
    for node, r1, e1, r2, e2 in rows:
        mass += (r1 + e1) * use[0] + (r2 + e2) * use[1]
        real1, real2 = real1 + r1, real2 + r2
        if mass > target:
            yield start, node, real1, real2
            start, mass, real1, real2 = node + 1, 0, 0, 0
    if start <= node:
        yield start, node, real1, real2


def _walked(histogram: DataFrame, plan: HistogramPlan, constant: float, sides: list[tuple[bool, bool]]) -> list[Iterator[Row]]:
    if plan.domain > MAX_DOMAIN:
        raise ValueError(f"a domain of {plan.domain} values is too wide for the histogram; coarsen the key to at most {MAX_DOMAIN}")
    histogram = durable(histogram)
    t1, t2 = histogram.agg(F.coalesce(F.sum(F.col("r1") + F.col("e1")), F.lit(0)), F.coalesce(F.sum(F.col("r2") + F.col("e2")), F.lit(0))).first()
    parts = plan.parts(t1 + t2, constant)
    ordered = histogram.select("node", "r1", "e1", "r2", "e2").orderBy("node")
    return [walk(ordered.toLocalIterator(), math.ceil((t1 * use[0] + t2 * use[1]) / parts), use) for use in sides]


def shared_buckets(left: DataFrame, left_key: str, right: DataFrame, right_key: str, plan: HistogramPlan, constant: float = 1.0) -> DataFrame:
    """bin_id, lo, hi, real1, padded1, real2, padded2: one list of boundaries for both tables."""
    (found,) = _walked(joint_histogram(left, left_key, right, right_key, plan), plan, constant, [(True, True)])
    rows = ((i, plan.lo + a, plan.lo + b, x, y) for i, (a, b, x, y) in enumerate(found))
    buckets = streamed(left.sparkSession, rows, "bin_id long, lo long, hi long, real1 long, real2 long")
    noise = plan.bucket_noise
    return buckets.select("bin_id", "lo", "hi", "real1", (F.col("real1") + noise.shifted("b1", F.col("bin_id"))).alias("padded1"), "real2", (F.col("real2") + noise.shifted("b2", F.col("bin_id"))).alias("padded2"))


def own_buckets(left: DataFrame, left_key: str, right: DataFrame, right_key: str, plan: HistogramPlan, constant: float = 1.0) -> DataFrame:
    """table_id, bin_id, lo, hi, real, padded: boundaries of each table's own."""
    found = _walked(joint_histogram(left, left_key, right, right_key, plan), plan, constant, [(True, False), (False, True)])
    rows = ((t + 1, i, plan.lo + b[0], plan.lo + b[1], b[2 + t]) for t in (0, 1) for i, b in enumerate(found[t]))
    buckets = streamed(left.sparkSession, rows, "table_id long, bin_id long, lo long, hi long, real long")
    return buckets.withColumn("padded", F.col("real") + plan.bucket_noise.shifted("o", F.col("table_id"), F.col("bin_id")))


def single_buckets(df: DataFrame, key: str, plan: HistogramPlan, constant: float = 1.0) -> DataFrame:
    """bin_id, lo, hi, real, padded of one table, for selections."""
    leaves = inferred(dense_histogram(df, key, plan, "h1_"), plan, "h1_").where("level = 0")
    histogram = leaves.select("node", F.col("real").alias("r1"), F.col("noise").alias("e1"), F.lit(0).cast("long").alias("r2"), F.lit(0).cast("long").alias("e2"))
    (found,) = _walked(histogram, plan, constant, [(True, False)])
    rows = ((i, plan.lo + a, plan.lo + b, x) for i, (a, b, x, _) in enumerate(found))
    buckets = streamed(df.sparkSession, rows, "bin_id long, lo long, hi long, real long")
    return buckets.withColumn("padded", F.col("real") + plan.bucket_noise.shifted("b1", F.col("bin_id")))


def refreshed(buckets: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The real sizes of buckets, counted anew from the data; for checks."""
    keys = multiplicities(df, key)
    return buckets.join(keys, keys["key"].between(buckets["lo"], buckets["hi"]), "left").groupBy("bin_id").agg(F.coalesce(F.sum(keys["real"]), F.lit(0)).alias("real"))
