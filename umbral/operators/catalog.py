"""Small frames that describe a key's values: domain, histogram, hierarchy, multiplicities.

Null keys belong to no bin and are left out everywhere.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.budget import FAN_OUT, Budget, HistogramPlan
from ..functions.noise import TGeom


def whole(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).cast("long")


def key_domain(*sides: tuple[DataFrame, str]) -> DataFrame:
    """lo, hi over the keys of all sides; nulls if there are none."""
    parts = [df.agg(F.min(whole(k)).alias("lo"), F.max(whole(k)).alias("hi")) for df, k in sides]
    return reduce(DataFrame.unionByName, parts).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def plan_for(*sides: tuple[DataFrame, str], pk_fk: bool = False, budget: Budget = Budget()) -> HistogramPlan:
    """Domain and row count of the sides, in one pass over each."""
    parts = [df.agg(F.min(whole(k)).alias("lo"), F.max(whole(k)).alias("hi"), F.count(k).alias("n")) for df, k in sides]
    lo, hi, n = reduce(DataFrame.unionByName, parts).agg(F.min("lo"), F.max("hi"), F.sum("n")).first()
    if lo is None:
        lo = hi = 0
    return HistogramPlan(lo, hi, n or 0, pk_fk, budget)


def multiplicities(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(whole(key).alias("key")).agg(F.count("*").alias("real"))


def dense_histogram(df: DataFrame, key: str, plan: HistogramPlan, tag: str) -> DataFrame:
    """node, real, noise for every value of the domain; node counts from the domain's low end."""
    dense = df.sparkSession.range(plan.lo, plan.hi + 1).select(F.col("id").alias("key"))
    counted = dense.join(multiplicities(df, key), "key", "left")
    noise = plan.histogram_noise.plain(f"{tag}0", F.col("key") - plan.lo)
    return counted.select((F.col("key") - plan.lo).alias("node"), F.coalesce("real", F.lit(0)).alias("real"), noise.alias("noise"))


def _parents(level: DataFrame) -> DataFrame:
    return level.groupBy(F.floor(F.col("node") / FAN_OUT).cast("long").alias("node")).agg(F.sum("real").alias("real"), F.sum("noise").alias("below"), F.count("*").alias("children"))


def hierarchy(leaves: DataFrame, plan: HistogramPlan, tag: str) -> DataFrame:
    """level, node, real, noise: sums of FAN_OUT children each, every node with noise of its own."""
    out, level = [leaves.select(F.lit(0).cast("long").alias("level"), "node", "real", "noise")], leaves
    for n in range(1, plan.height):
        level = _parents(level).select("node", "real", plan.histogram_noise.plain(f"{tag}{n}", F.col("node")).alias("noise"))
        out.append(level.select(F.lit(n).cast("long").alias("level"), "node", "real", "noise"))
    return reduce(DataFrame.unionByName, out)


def _toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def inferred(leaves: DataFrame, plan: HistogramPlan, tag: str) -> DataFrame:
    """The hierarchy made consistent: weighted averages upward, then differences spread downward."""
    levels = [leaves.select("node", "real", "noise")]
    for n in range(1, plan.height):
        top, low = FAN_OUT ** (n + 1), FAN_OUT**n
        fresh = plan.histogram_noise.plain(f"{tag}{n}", F.col("node"))
        z = F.lit((top - low) / (top - 1.0)) * (fresh + F.col("real")) + F.lit((low - 1.0) / (top - 1.0)) * (F.col("below") + F.col("real"))
        levels.append(_parents(levels[-1]).select("node", "real", (_toward_zero(z) - F.col("real")).alias("noise")))
    for n in range(plan.height - 1, 0, -1):
        below = _parents(levels[n - 1]).select("node", "below", "children")
        step = levels[n].join(below, "node").select(F.col("node").alias("parent"), ((F.col("noise") - F.col("below")) / F.col("children")).alias("step"))
        child = levels[n - 1].withColumn("parent", F.floor(F.col("node") / FAN_OUT).cast("long"))
        levels[n - 1] = child.join(step, "parent").select("node", "real", _toward_zero(F.col("noise") + F.col("step")).alias("noise"))
    return reduce(DataFrame.unionByName, [x.select(F.lit(i).cast("long").alias("level"), "node", "real", "noise") for i, x in enumerate(levels)])


def range_cover(lo: int, hi: int, size: int, height: int) -> list[tuple[int, int]]:
    """(level, node): the fewest nodes of the hierarchy over `size` leaves that cover [lo, hi]."""
    out, lo, hi = [], max(0, lo), min(size - 1, hi)
    for level in range(height):
        if lo > hi:
            break
        last = -(-size // FAN_OUT**level) - 1
        if level == height - 1:
            out += [(level, n) for n in range(lo, hi + 1)]
            break
        while lo <= hi and lo % FAN_OUT:
            out.append((level, lo))
            lo += 1
        while lo <= hi and (hi + 1) % FAN_OUT and hi != last:
            out.append((level, hi))
            hi -= 1
        lo, hi = lo // FAN_OUT, hi // FAN_OUT if lo <= hi else -1
    return out


def noisy_range_count(nodes: DataFrame, plan: HistogramPlan, qs: int, qe: int) -> DataFrame:
    """real and noisy count of keys in [qs, qe], from the hierarchy's cover of the range."""
    cover = range_cover(qs - plan.lo, qe - plan.lo, plan.domain, plan.height)
    chosen = nodes.sparkSession.createDataFrame(cover, "level long, node long")
    both = nodes.join(F.broadcast(chosen), ["level", "node"])  # at most 2 * FAN_OUT rows a level
    return both.agg(F.coalesce(F.sum("real"), F.lit(0)).alias("real"), F.coalesce(F.sum(F.col("real") + F.col("noise")), F.lit(0)).alias("noisy"))


def key_list(left: DataFrame, left_key: str, right: DataFrame, right_key: str, noise: TGeom, tag: str = "k") -> DataFrame:
    """key, count1, noise1, count2, noise2 for every key of either side."""
    l, r = (multiplicities(df, k).withColumnRenamed("real", name) for df, k, name in ((left, left_key, "count1"), (right, right_key, "count2")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return l.join(r, "key", "full").select("key", zero("count1"), noise.shifted(f"{tag}1", F.col("key")).alias("noise1"), zero("count2"), noise.shifted(f"{tag}2", F.col("key")).alias("noise2"))


def overlapping(bins: DataFrame, qs: int | Column, qe: int | Column, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Bins that the closed range [qs, qe] touches; none if qs > qe."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (qs, qe))
    return bins.where((F.col(lo) <= last) & (F.col(hi) >= first) & (first <= last))


def difference(all_: DataFrame, some: DataFrame) -> DataFrame:
    """Rows of one that are not in the other, repeats kept as often as they are in excess."""
    return all_.exceptAll(some)
