"""Readers. Every reader hands out plain DataFrames; rid, where there is one, numbers rows from 0 in file order."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the delimited tables.
TBL = {
    "customer": "c_custkey LONG, c_name STRING, c_address STRING, c_nationkey INT, c_phone STRING, c_acctbal DOUBLE, c_mktsegment STRING, c_comment STRING",
    "supplier": "s_suppkey LONG, s_name STRING, s_address STRING, s_nationkey INT, s_phone STRING, s_acctbal DOUBLE, s_comment STRING",
}


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tbl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A |-delimited table; the | that ends a line is no column."""
    return spark.read.csv(path, sep="|", schema=TBL[name], mode="PERMISSIVE")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text column as one file, in the order of the rows: what has a header has to be one file."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def _numbers(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """Lines of numbers with their place, and the header's numbers."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    header = lines.orderBy("at").first()
    rows = lines.where(F.col("at") > header["at"]).select("at", F.split(F.trim("value"), r"\s+").alias("v"))
    return rows, [int(x) for x in header["value"].split()]


def synthetic(spark: SparkSession, path: str) -> DataFrame:
    """`n d`, a blank line, and n lines of d numbers: key, a1, ... (integers, cut off towards zero), rid.

    Places within one file grow line by line, and rid is their rank: a sum of earlier
    partitions' counts and the place within the partition, so no row is moved.
    """
    rows, (_, width) = _numbers(spark, path)
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()  # one row a partition
    before, starts = 0, []
    for r in sorted(counts):
        starts.append((r["part"], before, r["first"]))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "part long, before long, first long")
    names = ["key", *(f"a{i}" for i in range(1, width))]
    placed = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.select(*[F.element_at("v", i + 1).cast("double").cast("int").alias(n) for i, n in enumerate(names)], (F.col("before") + F.col("at") - F.col("first")).alias("rid"))


def workload(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(query_id, qs, qe) and the index of the attribute asked for, from `n attribute` and n lines of ranges."""
    rows, (_, attribute) = _numbers(spark, path)
    first = rows.agg(F.min("at")).first()[0]
    place = F.col("at") - F.lit(first)
    return rows.select(place.cast("int").alias("query_id"), F.element_at("v", 1).cast("long").alias("qs"), F.element_at("v", 2).cast("long").alias("qe")), attribute


def ranges(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    """A stated workload of closed ranges."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "query_id int, qs long, qe long")


def generated(spark: SparkSession, kind: int, n1: int, n2: int, domain: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Synthetic pairs of tables (key, value). 1: one hot key against one row; 2: the mirror; 3: uniform keys; 4: Zipf keys."""
    u = lambda s: F.rand(seed + s)
    one = lambda n: spark.range(n).select(F.lit(0).alias("key"))
    rest = lambda n: spark.range(n).select((F.col("id") > 0).cast("int").alias("key"))
    flat = lambda n, s: spark.range(n).select((F.floor(u(s) * domain) + 1).cast("int").alias("key"))
    zipf = lambda n, s: spark.range(n).select(F.least(F.floor(F.pow(u(s), F.lit(-2.0))), F.lit(domain)).cast("int").alias("key"))
    left, right = {1: (one(n1), rest(n2)), 2: (rest(n1), one(n2)), 3: (flat(n1, 1), flat(n2, 2)), 4: (zipf(n1, 1), zipf(n2, 2))}[kind]
    return left.withColumn("value", F.col("key")), right.withColumn("value", F.col("key"))
