"""A noisy tree that halves a box of integer dimensions where it holds many rows.

The rows are read once: their distinct coordinates are counted and placed in the cells of the finest grid that the tree can
reach; each level is then one aggregate. Only nodes above the threshold are split, so the driver
holds what the tree holds.
"""

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.budget import Budget
from ..functions.noise import SEED, TGeom, laplace
from .catalog import overlapping, whole
from .padding import placed as in_bins

#: Dimensions that a node may split at once.
MAX_DIMENSIONS = 10


@dataclass(frozen=True)
class TreePlan:
    dimensions: int
    rows1: int
    rows2: int = 0
    kind: str = "join"  # join, pk_fk or select
    budget: Budget = Budget()

    @property
    def delta(self) -> float:
        d = Budget.delta(self.rows1 + self.rows2)
        return 2 * d if self.kind == "pk_fk" else d

    @property
    def fan_out(self) -> int:
        return 2**self.dimensions

    @property
    def threshold(self) -> float:
        if self.kind == "select":
            return 0.0
        return math.sqrt(self.rows1 + self.rows2) if self.kind == "pk_fk" else 2 / self.budget.total * math.log(2 / self.delta)

    @property
    def scale(self) -> float:
        return (2 * self.fan_out - 1) / ((self.fan_out - 1) * self.budget.eps_d)

    @property
    def decay(self) -> float:
        return self.scale * math.log(self.fan_out)

    @property
    def leaf_noise(self) -> TGeom:
        return TGeom(self.budget.eps_r, self.delta)


Box = tuple[tuple[int, int], ...]


def halves(box: Box) -> list[Box]:
    """The box with every dimension wider than one value cut in the middle."""
    out: list[list] = [[]]
    for lo, hi in box:
        mid = (lo + hi) // 2
        parts = [(lo, mid), (mid + 1, hi)] if hi > lo else [(lo, hi)]
        out = [[*b, p] for b in out for p in parts]
    return [tuple(b) for b in out]


def in_box(df: DataFrame, columns: list[str], box: Box) -> DataFrame:
    """The rows inside a closed box."""
    return df.where(reduce(lambda a, b: a & b, [whole(c).between(lo, hi) for c, (lo, hi) in zip(columns, box, strict=True)]))


def touched(leaves: DataFrame, dimension: int, qs: int, qe: int) -> DataFrame:
    """Leaves that a closed range of one dimension overlaps; none if qs > qe."""
    return overlapping(leaves, qs, qe, f"lo_{dimension}", f"hi_{dimension}")


def leaves(tables: list[tuple[DataFrame, list[str]]], plan: TreePlan, seed: int = SEED) -> DataFrame:
    """bin_id, lo_0, hi_0, ..., real1, padded1, real2, padded2 of each leaf, in order of the boxes."""
    if plan.dimensions > MAX_DIMENSIONS:
        raise ValueError(f"at most {MAX_DIMENSIONS} dimensions can be split at once")
    spark, dims = tables[0][0].sparkSession, [f"d{i}" for i in range(plan.dimensions)]
    cells = reduce(DataFrame.unionByName, [df.select(*[whole(c).alias(d) for c, d in zip(cols, dims, strict=True)], F.lit(int(t == 0)).alias("c1"), F.lit(int(t == 1)).alias("c2")) for t, (df, cols) in enumerate(tables)])
    cells = durable(cells.dropna(subset=dims).groupBy(*dims).agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2")))
    bounds = cells.agg(*[f(d) for d in dims for f in (F.min, F.max)]).first()
    done: list[tuple[Box, int, int]] = []
    level: list[Box] = [tuple((bounds[2 * i] or 0, bounds[2 * i + 1] or 0) for i in range(plan.dimensions))]
    depth = 0
    # Cells carry the number of their node, so each level is one pass and one aggregate.
    rows = cells.withColumn("node", F.lit(0))
    while level:
        counts = {r[0]: (r[1], r[2]) for r in rows.groupBy("node").agg(F.sum("c1"), F.sum("c2")).collect()}
        names = [",".join(f"{a}:{b}" for a, b in box) for box in level]
        noise = {r[0]: r[1] for r in spark.createDataFrame(list(enumerate(names)), "node int, name string").select("node", laplace(plan.scale, "p", F.col("name"), seed=seed)).collect()}
        split: dict[int, list[Box]] = {}
        for i, box in enumerate(level):
            c1, c2 = counts.get(i, (0, 0))
            biased = max(c1 + c2 - depth * plan.decay, plan.threshold - plan.decay)
            if biased + noise[i] > plan.threshold and any(hi > lo for lo, hi in box):
                split[i] = halves(box)
            else:
                done.append((box, c1, c2))
        below = [(i, b) for i, boxes in split.items() for b in boxes]
        if below:
            # A child's place among its siblings is given by the halves that the coordinates lie in.
            schema = "node int, child int, " + ", ".join(f"lo{i} long, hi{i} long" for i in range(plan.dimensions))
            table = spark.createDataFrame([(i, n, *(x for pair in b for x in pair)) for n, (i, b) in enumerate(below)], schema)
            within = reduce(lambda a, b: a & b, [F.col(d).between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i, d in enumerate(dims)])
            rows = rows.join(table, "node").where(within).select(*dims, "c1", "c2", F.col("child").alias("node"))
            if depth % 4 == 3:
                rows = durable(rows)
        level, depth = [b for _, b in below], depth + 1
    done.sort()
    schema = "bin_id long, " + ", ".join(f"lo_{i} long, hi_{i} long" for i in range(plan.dimensions)) + ", real1 long, real2 long"
    out = spark.createDataFrame([(n, *(x for pair in box for x in pair), c1, c2) for n, (box, c1, c2) in enumerate(done)], schema)
    pad = lambda n: (F.col(f"real{n}") + plan.leaf_noise.shifted(f"l{n}", F.col("bin_id"), seed=seed)).alias(f"padded{n}")
    second = [F.col("real2"), pad(2)] if len(tables) > 1 else []
    return out.select("bin_id", *[f"{e}_{i}" for i in range(plan.dimensions) for e in ("lo", "hi")], "real1", pad(1), *second)


def placed(df: DataFrame, columns: list[str], leaves: DataFrame) -> DataFrame:
    """df with the bin_id of the leaf that its coordinates lie in.

    One coordinate is placed like a key in bins. Of more, the join is on the first one's values, then filtered on the others.
    """
    if len(columns) == 1:
        return in_bins(df, columns[0], leaves.select("bin_id", F.col("lo_0").alias("lo"), F.col("hi_0").alias("hi")))
    edges = [c for c in leaves.columns if c.startswith(("lo_", "hi_"))]
    table = leaves.select("bin_id", *edges, F.explode(F.sequence("lo_0", "hi_0")).alias("__d0"))
    other = [whole(c).between(F.col(f"lo_{i}"), F.col(f"hi_{i}")) for i, c in enumerate(columns) if i]
    out = df.join(table, whole(columns[0]) == table["__d0"])
    for condition in other:
        out = out.where(condition)
    return out.drop("__d0", *edges)
