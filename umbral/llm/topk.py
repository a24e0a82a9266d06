"""Exact top-k by integer inner product: a KD-tree per shard, best-first traversal.

Vectors are dealt into shards by the median splits of a coarse tree over a bounded pilot set, so that a
shard's box is small. Queries, in blocks of bounded size, first visit the one shard whose box promises most;
the kth score found there (or in the pilot, if better) is a floor under the kth best of all. The second pass
sends a block to those shards only whose box bound reaches the floor of one of its queries; in every
shard a tree is walked best first, with the floor rising as it goes. Full shards are divided by row, so
each (shard, part, block) group of the cogrouped shuffles holds a bounded number of vectors and queries.

Rows with a null id, a null vector, or a null or non-finite component take no part. A pair of
vectors of different lengths has no score. Every row is a candidate, repeated rows as often as they occur; a
row is no candidate for a query of the same id. Equal query rows ask once, and rows of one id and different
vectors each have ranks of their own. Ties go to the smaller id. Empty tables give an empty result.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

LEAF = 256
#: Vectors of a shard, queries of a block, and vectors of the pilot set; the pilot also shapes the shards.
SHARD_ROWS, BLOCK_ROWS, PILOT_ROWS = 8_192, 2_048, 4_096
#: Shards that the pilot's tree tells apart at most; more rows than these hold divide shards by row.
MAX_SHARDS = 1_024


class KDTree:
    """Median splits along the widest dimension; every node has the tight box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.span)
            part = points[order[a:b]]
            lo, hi = part.min(0), part.max(0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.span.append((a, b))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            axis = int(np.argmax(hi - lo))
            if b - a > leaf and hi[axis] > lo[axis]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a, a + mid, node), (a + mid, b, node)]
        self.order, self.points = order, points[order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[query, node]: no point of the node's box has a larger inner product."""
        return box_bounds(queries, self.lo, self.hi)


def box_bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T


class Splits:
    """Which of `leaves` cells a vector lies in, by median splits of a pilot set."""

    def __init__(self, pilot: np.ndarray, leaves: int):
        self.axis, self.cut, self.kids, self.name = [], [], [], []
        self.leaves, todo = 0, [(pilot, leaves, -1)]
        while todo:
            points, n, parent = todo.pop()
            node = len(self.axis)
            if parent >= 0:
                self.kids[parent].append(node)
            self.kids.append([])
            spread = points.max(0) - points.min(0) if len(points) else np.zeros(1)
            axis = int(np.argmax(spread))
            if n > 1 and spread[axis] > 0:
                cut = np.partition(points[:, axis], len(points) // 2)[len(points) // 2]
                if cut == points[:, axis].min():
                    cut = points[:, axis][points[:, axis] > cut].min()
                above = points[:, axis] >= cut
                self.axis.append(axis), self.cut.append(cut), self.name.append(-1)
                todo += [(points[above], n // 2, node), (points[~above], n - n // 2, node)]  # popped last to first: below, then above
            else:
                self.axis.append(0), self.cut.append(0), self.name.append(self.leaves)
                self.leaves += 1

    def of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.name[node] >= 0:
                out[rows] = self.name[node]
                continue
            above = points[rows, self.axis[node]] >= self.cut[node]
            below_kid, above_kid = self.kids[node]
            todo += [(below_kid, rows[~above]), (above_kid, rows[above])]
        return out


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """float64 where all partial sums are exact in it, else int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return np.float64
    if most < 2.0**62:
        return np.int64
    return object


def walk(tree: KDTree, ids: np.ndarray, query: np.ndarray, own: int, bound: np.ndarray, floor: float, k: int):
    """Up to k candidates of at least `floor`, best first; ids are in the tree's order."""
    best_s, best_i = np.empty(0, tree.points.dtype), np.empty(0, np.int64)
    heap = [(-bound[0], 0)]
    while heap:
        top, node = heapq.heappop(heap)
        if -top < floor:
            break
        if tree.kids[node]:
            for kid in tree.kids[node]:
                if bound[kid] >= floor:
                    heapq.heappush(heap, (-bound[kid], kid))
            continue
        a, b = tree.span[node]
        score = tree.points[a:b] @ query
        take = np.flatnonzero((score >= floor) & (ids[a:b] != own))
        if len(take):
            best_s, best_i = np.concatenate([best_s, score[take]]), np.concatenate([best_i, ids[a:b][take]])
            if len(best_s) > k:
                keep = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[keep], best_i[keep]
            if len(best_s) == k:
                floor = max(floor, best_s.min())
    return best_i, best_s


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad)


def fixed_point(vec: Column, scale: int) -> Column:
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


FOUND = "query_id long, asked long, vec_id long, score long"


def found_in(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best of one group's points for each of its queries, none below the query's floor; all are of one length."""
    out: list[list] = [[], [], [], []]
    if points.num_rows and queries.num_rows:
        pv, qv, p_id, q_id = matrix(points.column("vec")), matrix(queries.column("vec")), points.column("id").to_numpy(), queries.column("id").to_numpy()
        kind = exact_kind(pv, qv)
        tree, qv = KDTree(pv.astype(kind)), qv.astype(kind)
        ids, asked = p_id[tree.order], queries.column("asked").to_numpy()
        for j, floor in enumerate(queries.column("floor").to_pylist()):
            got_i, got_s = walk(tree, ids, qv[j], q_id[j], tree.bounds(qv[j : j + 1])[0], -np.inf if floor is None else floor, k)
            for column, values in zip(out, (np.full(len(got_i), q_id[j]), np.full(len(got_i), asked[j]), got_i, got_s), strict=True):
                column.append(values)
    cat = [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in out]
    return pa.Table.from_arrays(cat, names=["query_id", "asked", "vec_id", "score"])


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shards_of(rows: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    """rows with the shard of each vector; lengths that the pilot lacks have one shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, shard = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int32)
            for d in np.unique(dims):
                if int(d) in splits:
                    mine = np.flatnonzero(dims == d)
                    shard[mine] = splits[int(d)].of(matrix(b.column("vec").take(pa.array(mine))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=["id", "vec", "dim", "shard"])

    return rows.mapInArrow(deal, "id long, vec array<long>, dim int, shard int")


BOX = "dim int, shard int, n long, lo array<long>, hi array<long>"


def boxes_of(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """dim -> shards, rows, lo and hi: one row for each shard reaches the driver."""
    longs = pa.list_(pa.int64())

    def packed(held: dict[tuple[int, int], tuple]) -> list[pa.Array]:
        return [pa.array([d for d, _ in held], pa.int32()), pa.array([s for _, s in held], pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], longs), pa.array([x[2] for x in held.values()], longs)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        for b in batches:
            dims, shards = b.column("dim").to_numpy(), b.column("shard").to_numpy()
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                vecs, names = matrix(b.column("vec").take(pa.array(mine))), shards[mine]
                for name in np.unique(names):
                    some, key = vecs[names == name], (int(d), int(name))
                    box = len(some), some.min(0), some.max(0)
                    was = held.get(key)
                    held[key] = (box[0] + was[0], np.minimum(box[1], was[1]), np.maximum(box[2], was[2])) if was else box
        yield pa.RecordBatch.from_arrays(packed(held), names=["dim", "shard", "n", "lo", "hi"])

    def whole(t: pa.Table) -> pa.Table:
        key = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        box = sum(t.column("n").to_pylist()), matrix(t.column("lo")).min(0), matrix(t.column("hi")).max(0)
        return pa.Table.from_arrays(packed({key: box}), names=["dim", "shard", "n", "lo", "hi"])

    out: dict[int, list] = {}
    for r in points.mapInArrow(part, BOX).groupBy("dim", "shard").applyInArrow(whole, BOX).collect():
        out.setdefault(r["dim"], []).append((r["shard"], r["n"], r["lo"], r["hi"]))
    return {d: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for d, v in out.items()}


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, pilot_rows: int = PILOT_ROWS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query.

    `is_query` is a condition on a column named `id`.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec"))).select("id", fixed_point(F.col("vec"), scale).alias("vec")).withColumn("dim", F.size("vec"))
    n = rows.count()

    # At most pilot_rows vectors, so their size is bounded by that parameter.
    share = min(1.0, 1.2 * pilot_rows / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    by_dim: dict[int, list] = {}
    for r in drawn.select("id", "vec").limit(pilot_rows).collect():
        by_dim.setdefault(len(r[1]), []).append((r[0], r[1]))
    pilot = {d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64)) for d, x in by_dim.items()}
    leaves = min(max_shards, max(1, -(-n // shard_rows)))
    points = durable(shards_of(rows, {d: Splits(v, leaves) for d, (_, v) in pilot.items()}))
    boxes = boxes_of(points)

    def bounds(d: int, vecs: np.ndarray) -> np.ndarray:
        _, _, lo, hi = boxes[d]
        kind = exact_kind(np.concatenate([lo, hi]), vecs)
        return box_bounds(vecs.astype(kind), lo.astype(kind), hi.astype(kind))

    def arrived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the shard that promises most and, from the pilot, a floor under the kth score."""
        for b in batches:
            floor, home = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                q = np.array(v, np.int64)
                home.append(int(boxes[len(v)][0][bounds(len(v), q[None])[0].argmax()]))
                ids, vecs = pilot.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)), np.int64)))
                score = (vecs.astype(exact_kind(vecs, q[None])) @ q)[ids != i]
                floor.append(int(np.partition(score, -k)[-k]) if len(score) >= k else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(floor, pa.int64())], names=["id", "vec", "dim", "asked", "home", "floor"])

    asked = points.where(is_query).select("id", "vec", "dim", F.xxhash64("vec").alias("asked")).dropDuplicates(["id", "vec"])
    asked = durable(asked.mapInArrow(arrived, "id long, vec array<long>, dim int, asked long, home int, floor long"))
    # Queries of one home share blocks, as their next shards are much the same. One row for each shard reaches the driver.
    table = [(r["dim"], r["home"], -(-r["count"] // block_rows)) for r in asked.groupBy("dim", "home").count().collect()]
    spark = vectors.sparkSession
    blocks = spark.createDataFrame(table, "dim int, home int, blocks int")
    asked = asked.join(blocks, ["dim", "home"]).withColumn("block", F.pmod(F.xxhash64("id", "asked"), "blocks").cast("int")).drop("blocks")
    sizes = [(d, int(s), -(-int(c) // shard_rows)) for d, (names, counts, _, _) in boxes.items() for s, c in zip(names, counts, strict=True)]
    parts = spark.createDataFrame(sizes, "dim int, shard int, parts int")
    # By place, so that repeated rows spread too; points are checkpointed, so places stay.
    held = points.withColumn("at", F.monotonically_increasing_id()).join(parts, ["dim", "shard"]).withColumn("part", F.pmod("at", "parts").cast("int")).drop("at", "parts")

    def visited(queries: DataFrame) -> DataFrame:
        """What queries (with a column shard) find there; a shard's part goes to the blocks that ask for it."""
        keys = ["dim", "shard", "part", "home", "block"]
        calls = queries.select("dim", "shard", "home", "block").distinct()
        left = held.join(calls.toDF(*calls.columns), ["dim", "shard"])
        right = queries.toDF(*queries.columns).join(parts, ["dim", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda p, q: found_in(p, q, k), FOUND)

    first = durable(best_of(visited(asked.withColumn("shard", F.col("home"))), k).select("query_id", "asked", "vec_id", "score"))
    kth = first.groupBy("query_id", "asked").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    again = asked.join(kth.withColumnRenamed("query_id", "id"), ["id", "asked"], "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth")

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the other shards whose box reaches its floor."""
        for b in batches:
            shards = []
            for v, home, floor in zip(b.column("vec").to_pylist(), b.column("home").to_pylist(), b.column("floor").to_pylist(), strict=True):
                names, top = boxes[len(v)][0], bounds(len(v), np.array([v], np.int64))[0]
                shards.append(names[(names != home) & ((top >= floor) if floor is not None else True)].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.list_(pa.int32()))], names=[*b.schema.names, "shards"])

    columns = "id long, asked long, dim int, home int, vec array<long>, floor long, block int"
    onward = again.select("id", "asked", "dim", "home", "vec", "floor", "block").mapInArrow(promising, columns + ", shards array<int>")
    second = visited(onward.withColumn("shard", F.explode("shards")).drop("shards"))
    return best_of(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")
