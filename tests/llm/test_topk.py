import numpy as np
import pytest
from pyspark.sql import functions as F

from umbral.llm import topk


def brute(rows, k=10):
    """query id -> [(rank, id, score)] by comparing with every row, repeated ones as often as they occur."""
    fixed = [(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in sorted(set(fixed)):
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fixed if i != q and len(a) == len(b))[:k]
            out.setdefault(q, []).extend((n + 1, i, -s) for n, (s, i) in enumerate(scores))
    return {q: sorted(v) for q, v in out.items() if v}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 70, "block_rows": 2, "pilot_rows": 15}, {"shard_rows": 20, "block_rows": 3, "max_shards": 8}])
def test_against_brute_force_with_ties_and_odd_rows(spark, sizes):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(500)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0]), (600, [float("nan"), 0.0, 0.0, 0.0]), (700, [float("inf")] * 4), (None, [1.0] * 4), (800, []), (900, [1.0, 2.0]), (901, [3.0, 1.0])]
    rows += [rows[3], rows[200], (1, rows[1][1]), (200, rows[7][1]), *[rows[9]] * 90]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, floor string")
    assert answers(topk.search(df, F.col("id") % 100 == 0, **sizes)) == brute(rows)


def test_boxes_bound_their_points():
    rng = np.random.default_rng(0)
    points, queries = rng.integers(-50, 50, (1000, 6)), rng.integers(-50, 50, (20, 6))
    tree = topk.KDTree(points, 16)
    bounds = tree.bounds(queries)
    for node, (a, b) in enumerate(tree.span):
        assert (tree.points[a:b] @ queries.T <= bounds[:, node]).all()
    assert sorted(map(tuple, tree.points)) == sorted(map(tuple, points))
    assert all(b - a <= 16 or (tree.lo[n] == tree.hi[n]).all() for n, (a, b) in enumerate(tree.span) if not tree.kids[n])


def test_repeated_rows_are_candidates_each(spark, duck):
    from umbral.llm.oracles import TOPK

    df = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 1.0])], "vec_id long, embedding array<double>")
    found = [tuple(r) for r in topk.search(df, F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert found == [(100, 1, 1, 524288), (100, 2, 1, 524288), (100, 3, 2, 262144)]
    con = duck.cursor()
    con.register("embeddings", df.toPandas())
    assert sorted(con.execute(TOPK).fetchall(), key=lambda r: r[1]) == found


def test_splits_deal_every_point_to_one_shard():
    points = np.random.default_rng(2).integers(-9, 9, (700, 3))
    splits = topk.Splits(points, 13)
    shard = splits.of(points)
    assert splits.leaves == 13 and set(shard) == set(range(13)) and np.bincount(shard).max() < 150
    assert topk.Splits(np.zeros((50, 3), np.int64), 4).leaves == 1


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 2.0]), (2, [1e6, 3.0]), (3, [-1e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(topk.search(df, F.col("id") % 100 == 0)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(one, F.col("id") % 100 == 0).count() == 0


def test_query_matches_sql(spark, sf, same_rows):
    from umbral.llm.queries import QUERIES, oracle_sql

    same_rows(QUERIES["op10_topk"](spark, sf), oracle_sql()["op10_topk"])
