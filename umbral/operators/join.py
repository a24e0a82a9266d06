"""Inner equi-joins on one integer key, many-to-many or from a primary to a foreign key, with an optional range.

exact forms are plain joins, left to the planner and adaptive execution. padded forms return a slot for
each pair of rows (or each foreign-key row) of bins that meet, flagged is_match.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import TGeom


def equi_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    return left.join(right, F.col(left_key) == F.col(right_key))


def pk_fk_join(pk: DataFrame, pk_key: str, fk: DataFrame, fk_key: str) -> DataFrame:
    return fk.join(pk, F.col(fk_key) == F.col(pk_key))


def select_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, attribute: str, qs: int, qe: int) -> DataFrame:
    """The equi-join restricted to qs <= attribute <= qe; the optimizer carries a range on the key to both sides."""
    return equi_join(left, left_key, right, right_key).where(F.col(attribute).between(qs, qe))


def join_size(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """join_size, without making the join."""
    count = lambda df, k, n: df.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("long").alias("key")).agg(F.count("*").alias(n))
    return count(left, left_key, "c1").join(count(right, right_key, "c2"), "key").agg(F.coalesce(F.sum(F.col("c1") * F.col("c2")), F.lit(0)).cast("long").alias("join_size"))


def bin_pairs(bins1: DataFrame, bins2: DataFrame, qs: int | None = None, qe: int | None = None) -> DataFrame:
    """bin_id1, bin_id2, padded1, padded2 of bins with overlapping ranges (and that overlap the range on the key)."""
    a = bins1.select(F.col("bin_id").alias("bin_id1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("padded").alias("padded1"))
    b = bins2.select(F.col("bin_id").alias("bin_id2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("padded").alias("padded2"))
    if qs is not None:
        a, b = a.where((F.col("lo1") <= qe) & (F.col("hi1") >= qs)), b.where((F.col("lo2") <= qe) & (F.col("hi2") >= qs))
    return a.join(b, (F.col("lo1") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi1"))).select("bin_id1", "bin_id2", "padded1", "padded2")


def padded_size(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.sum(F.col("padded1") * F.col("padded2")), F.lit(0)).cast("long").alias("slots"))


def _sided(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{c}{name}" if c in ("bin_id", "is_dummy") else c) for c in df.columns])


def padded_slots(left: DataFrame, left_key: str, right: DataFrame, right_key: str, pairs: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """A slot for each pair of padded rows of bins that meet: equal bin_id, or the pairs given.

    A slot is a match where both rows are real, the keys are equal and `where` holds.
    """
    a, b = _sided(left, "1"), _sided(right, "2")
    if pairs is None:
        slots = a.join(b, F.col("bin_id1") == F.col("bin_id2"))
    else:
        slots = a.join(pairs.select("bin_id1", "bin_id2"), "bin_id1").join(b, "bin_id2")
    match = ~F.col("is_dummy1") & ~F.col("is_dummy2") & (F.col(left_key) == F.col(right_key))
    return slots.withColumn("is_match", F.coalesce(match & where if where is not None else match, F.lit(False)))


def padded_pk_fk(pk: DataFrame, pk_key: str, fk_padded: DataFrame, fk_key: str, where: Column | None = None) -> DataFrame:
    """A slot for each padded foreign-key row; a match where the row is real, its key exists and `where` holds."""
    out = fk_padded.join(pk.withColumn("__found", F.lit(True)), F.col(fk_key) == F.col(pk_key), "left")
    match = ~F.col("is_dummy") & F.col("__found")
    return out.withColumn("is_match", F.coalesce(match & where if where is not None else match, F.lit(False))).drop("__found")


def matches(slots: DataFrame) -> DataFrame:
    return slots.where("is_match")


def compaction_noise(eps_c: float, delta_c: float, largest_bin: int) -> TGeom:
    """Noise of a compacted join's size: one row changes it by up to the largest bin."""
    return TGeom(eps_c, delta_c, max(1, largest_bin))
