"""Grouping keys by multiplicity: dense keys have bins of their own, sparse ones share bins of fixed capacity.

Sparse keys are packed in the order of their noisy counts, each into the current bin or, where it would
overflow, into the next: an order-dependent walk over the key list. It reads one row per sparse
key as a stream.
"""

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable, streamed
from ..functions.budget import Budget
from ..functions.noise import TGeom
from .catalog import key_list


@dataclass(frozen=True)
class GroupingPlan:
    rows: int
    pk_fk: bool = False
    budget: Budget = Budget()

    @property
    def delta_r(self) -> float:
        return Budget.delta(self.rows)

    @property
    def delta(self) -> float:
        return self.delta_r * 2

    @property
    def unit(self) -> int:
        return int(2 * (1 / self.budget.total * math.log(2 / self.delta)))

    @property
    def capacity(self) -> int:
        return 4 * self.unit

    @property
    def key_noise(self) -> TGeom:
        return TGeom(self.budget.eps_d + self.budget.eps_r, self.delta if self.pk_fk else self.delta - self.delta_r)

    @property
    def empty_noise(self) -> TGeom:
        return TGeom(self.key_noise.eps / 3, self.key_noise.delta / 3)


def next_fit(rows: Iterable[tuple[int, int, int]], capacity: int) -> Iterator[tuple[int, int]]:
    """(key, bin from 0) for rows (key, count 1, count 2) in order."""
    bin_id, sum1, sum2 = 0, 0, 0
    for key, c1, c2 in rows:
        if sum1 + c1 > capacity or sum2 + c2 > capacity:
            bin_id, sum1, sum2 = bin_id + 1, 0, 0
        sum1, sum2 = sum1 + c1, sum2 + c2
        yield key, bin_id


def members(left: DataFrame, left_key: str, right: DataFrame, right_key: str, plan: GroupingPlan) -> DataFrame:
    """key, bin_id, kind (dense or sparse), count1, noise1, count2, noise2. Dense bins are numbered first."""
    keys = key_list(left, left_key, right, right_key, plan.key_noise)
    total1, total2 = F.col("count1") + F.col("noise1"), F.col("count2") + F.col("noise2")
    keys = keys.withColumn("kind", F.when((total1 > 2 * plan.unit) | (total2 > 2 * plan.unit), "dense").otherwise("sparse"))
    keys = durable(keys)  # read three times below
    order = [total1.desc(), total2.desc(), F.col("key")]

    # The walk reads the keys in order, dense ones first, and writes their bins as it goes.
    def walk(kind: str) -> Iterator[tuple]:
        return map(tuple, keys.where(F.col("kind") == kind).orderBy(*order).select("key", "count1", "count2").toLocalIterator())

    def numbered() -> Iterator[tuple[int, int]]:
        first = 0
        for key, *_ in walk("dense"):
            yield key, first
            first += 1
        for key, b in next_fit(walk("sparse"), plan.capacity):
            yield key, first + b

    return keys.join(streamed(left.sparkSession, numbered(), "key long, bin_id long"), "key")


def bins(members: DataFrame, plan: GroupingPlan, tag: str = "e") -> DataFrame:
    """bin_id, kind, real1, padded1, real2, padded2, with the empty sparse bins that hide how many there are."""
    spark = members.sparkSession
    sums = members.groupBy("bin_id", "kind").agg(*[F.sum(c).alias(c) for c in ("count1", "noise1", "count2", "noise2")])
    size = lambda n: F.when(F.col("kind") == "dense", F.col(f"count{n}") + F.col(f"noise{n}")).otherwise(F.lit(plan.capacity)).cast("long").alias(f"padded{n}")
    used = sums.select("bin_id", "kind", F.col("count1").alias("real1"), size(1), F.col("count2").alias("real2"), size(2))
    n_empty = spark.range(1).select(plan.empty_noise.shifted(tag, F.lit(0)).alias("n"))
    first = members.agg(F.coalesce(F.max("bin_id") + 1, F.lit(0)).alias("first"))
    zero, full = F.lit(0).cast("long"), F.lit(plan.capacity).cast("long")
    empty = n_empty.where("n > 0").crossJoin(first).select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("bin_id"), F.lit("empty").alias("kind"), zero.alias("real1"), full.alias("padded1"), zero.alias("real2"), full.alias("padded2"))  # one row each
    return used.unionByName(empty)


def output_size(bins: DataFrame) -> DataFrame:
    """Slots of the padded join: what each bin's two sides multiply to."""
    return bins.agg(F.coalesce(F.sum(F.col("padded1") * F.col("padded2")), F.lit(0)).cast("long").alias("slots"))
