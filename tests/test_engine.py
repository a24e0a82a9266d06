"""Invariants of bins, padding and joins, over generated tables and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from umbral import durable
from umbral.functions.noise import TGeom, laplace
from umbral.functions.sealing import seal, unseal
from umbral.operators import catalog, grouping, htree, join, padding, privtree, select
from umbral.plans.engine import EquiJoin, RangeSelect, TreeSelectJoin
from umbral.sources import sinks, tables
from umbral.streaming.replay import answered


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module", params=[1, 2, 3, 4])
def pair(spark, request):
    left, right = tables.generated(spark, request.param, 60, 90, domain=40)
    # rand() draws anew in each plan; fix the rows.
    fixed = [spark.createDataFrame(df.collect(), df.schema) for df in (left, right)]
    return fixed[0].toDF("k1", "v1"), fixed[1].toDF("k2", "v2")


@pytest.mark.parametrize("partitioner", ["histogram", "tree", "grouping"])
def test_padded_join_holds_the_exact_join(pair, partitioner):
    left, right = pair
    engine = EquiJoin(left, "k1", right, "k2", partitioner)
    slots = engine.slots()
    assert rows(join.matches(slots).select("k1", "v1", "k2", "v2")) == rows(engine.exact().select("k1", "v1", "k2", "v2"))
    assert slots.count() == engine.sizes().first()[0]


def test_bins_are_disjoint_cover_the_domain_and_conserve_rows(pair):
    left, right = pair
    plan = catalog.plan_for((left, "k1"), (right, "k2"))
    found = htree.shared_buckets(left, "k1", right, "k2", plan).orderBy("bin_id").collect()
    assert found[0].lo == plan.lo and found[-1].hi == plan.hi
    assert all(a.hi + 1 == b.lo for a, b in zip(found, found[1:]))
    assert sum(r.real1 for r in found) == left.count() and sum(r.real2 for r in found) == right.count()
    assert all(r.padded1 >= r.real1 and r.padded2 >= r.real2 for r in found)


def test_tree_leaves_are_disjoint_and_conserve_rows(spark):
    df = spark.createDataFrame([(i % 13, i % 7) for i in range(500)], "a int, b int")
    plan = privtree.TreePlan(2, 500, kind="select")
    leaves = privtree.leaves([(df, ["a", "b"])], plan)
    assert sum(r.real1 for r in leaves.collect()) == 500
    assert privtree.placed(df, ["a", "b"], leaves).count() == 500


@pytest.mark.parametrize("partitioner", ["histogram", "tree"])
def test_selection_modes_agree(spark, partitioner):
    df = spark.createDataFrame([(i, (i * i) % 50 - 10) for i in range(300)] + [(300, None)], "id int, x int")
    workload = tables.ranges(spark, [(-10, -10), (-10, 5), (-50, -20), (30, 10), (0, 2_000_000_000)])
    engine = RangeSelect.build(df, "x", partitioner)
    exact = engine.run(workload)
    refined = select.refined(engine.run(workload, "padded"), "x", workload)
    assert rows(refined.select("query_id", "id", "x")) == rows(exact.select("query_id", "id", "x"))
    sent = {r[0]: r[1] for r in engine.run(workload, "bins").groupBy("query_id").agg(F.sum("padded")).collect()}
    sizes = {r.query_id: r for r in engine.run(workload, "sizes").collect()}
    assert set(sizes) == {0, 1, 4} and all(sizes[q].padded_rows == sent[q] for q in sizes)
    assert 3 not in sent
    with pytest.raises(ValueError):
        engine.run(workload, "other")


def test_primary_to_foreign_key_join_drops_orphans_and_nulls(spark):
    pk = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pk int, name string")
    fk = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, 9), (14, None)], "id int, fk int")
    assert rows(join.pk_fk_join(pk, "pk", fk, "fk").select("id", "name")) == [(10, "a"), (11, "a"), (12, "c")]
    for partitioner in ("histogram", "tree", "grouping"):
        engine = EquiJoin(pk, "pk", fk, "fk", partitioner, "pk_fk")
        slots = engine.slots()
        assert rows(join.matches(slots).select("id", "name")) == [(10, "a"), (11, "a"), (12, "c")]
        assert slots.count() == engine.sizes().first()[0]


def test_select_join_on_either_attribute(pair):
    left, right = pair
    engine = EquiJoin(left, "k1", right, "k2")
    for attribute in ("k1", "k2", "v2"):
        match = join.matches(engine.slots(attribute, 1, 12)).select("k1", "v1", "k2", "v2")
        assert rows(match) == rows(engine.exact(attribute, 1, 12).select("k1", "v1", "k2", "v2"))


def test_select_join_over_trees(pair):
    left, right = pair
    engine = TreeSelectJoin(left, "k1", right, "k2", "v2")
    exact = join.select_join(left, "k1", right, "k2", "v2", 1, 12)
    slots = engine.slots(1, 12)
    assert rows(join.matches(slots).select("k1", "v1", "k2", "v2")) == rows(exact.select("k1", "v1", "k2", "v2"))
    assert slots.count() == join.padded_size(engine.pairs(1, 12)).first()[0]
    assert engine.slots(12, 1).count() == 0


def test_box(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (7, 1), (None, 1)], "a int, b int")
    assert rows(privtree.in_box(df, ["a", "b"], ((0, 3), (1, 2)))) == [(1, 1)]


def test_compacted_join(pair):
    left, right = pair
    engine = EquiJoin(left, "k1", right, "k2")
    n, out = engine.exact().count(), engine.compacted()
    assert out.where("NOT is_dummy").count() == n
    assert n <= out.count() <= engine.sizes().first()[0]


def test_empty_tables_and_single_values(spark):
    none = spark.createDataFrame([], "k1 int, v1 int")
    some = spark.createDataFrame([(5, 1), (5, 2)], "k2 int, v2 int")
    for partitioner in ("histogram", "tree", "grouping"):
        engine = EquiJoin(none, "k1", some, "k2", partitioner)
        assert engine.exact().count() == 0 and join.matches(engine.slots()).count() == 0
        engine = EquiJoin(some.toDF("k1", "v1"), "k1", some, "k2", partitioner)
        assert join.matches(engine.slots()).count() == 4
    both = EquiJoin(none, "k1", none.toDF("k2", "v2"), "k2")
    assert both.exact().count() == 0


def test_noise_stays_in_its_support_and_repeats(spark):
    noise = TGeom(0.3, 1e-5, 2)
    df = spark.range(5000).select(noise.shifted("t", F.col("id")).alias("s"), noise.plain("t", F.col("id")).alias("p"), laplace(3.0, "l", F.col("id")).alias("l"))
    lo, hi, mean, p_lo, p_hi, l = df.agg(F.min("s"), F.max("s"), F.avg("s"), F.min("p"), F.max("p"), F.avg("l")).first()
    assert 0 <= lo and hi <= 2 * noise.mean and abs(mean - noise.mean) < 0.5
    assert -noise.mean <= p_lo and p_hi <= noise.mean and abs(l) < 0.3
    assert rows(df) == rows(df)
    assert noise.mean == int(2 / 0.3 * math.log(2e5)) + 1


def test_range_cover_is_exact_for_all_ranges():
    size, height = 300, 4
    for lo in range(0, 300, 7):
        for hi in range(lo, 300, 11):
            covered = [x for level, n in catalog.range_cover(lo, hi, size, height) for x in range(n * 16**level, min(size, (n + 1) * 16**level))]
            assert sorted(covered) == list(range(lo, hi + 1))


def test_next_fit_respects_capacity():
    bins = {}
    for key, b in grouping.next_fit([(i, i % 5, (i * 3) % 7) for i in range(100)], 10):
        c = bins.setdefault(b, [0, 0])
        c[0] += key % 5
        c[1] += (key * 3) % 7
    assert all(max(c) <= 10 for c in bins.values())


def test_rows_that_come_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(durable, "CHUNK", 3)
    for n in (0, 2, 3, 7):
        assert rows(durable.streamed(spark, ((i, str(i)) for i in range(n)), "a long, b string")) == [(i, str(i)) for i in range(n)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("3 2\n\n5 1\n7 2.9\n-4 3\n")
    assert rows(tables.synthetic(spark, str(tmp_path / "t.txt"))) == [(-4, 3, 2), (5, 1, 0), (7, 2, 1)]
    (tmp_path / "q.txt").write_text("2 0\n1 5\n-3 9\n")
    queries, attribute = tables.workload(spark, str(tmp_path / "q.txt"))
    assert attribute == 0 and rows(queries) == [(0, 1, 5), (1, -3, 9)]
    (tmp_path / "supplier.tbl").write_text("1|S1|street|4|555|1.5|fine|\n2|S2|road|7|556|-2.25|also|\n")
    assert rows(tables.tbl(spark, str(tmp_path / "supplier.tbl"), "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")) == [(1, 4, 1.5), (2, 7, -2.25)]
    df = spark.createDataFrame([(i, i % 200) for i in range(400)], "id int, x int")
    engine = RangeSelect.build(df, "x")
    table = padding.padded(padding.placed(df, "x", engine.bins), engine.bins, F.col("padded") - F.col("real"))
    sinks.write_bins(table, str(tmp_path / "bins"))
    sinks.write_index(engine.bins, str(tmp_path / "index"))
    assert rows(sinks.read_index(spark, str(tmp_path / "index"))) == rows(engine.bins)
    one = sinks.read_bins(spark, str(tmp_path / "bins"), [0])
    assert one.count() == engine.bins.where("bin_id = 0").first().padded
    assert sinks.read_bins(spark, str(tmp_path / "bins")).count() == table.count()


def test_sealing_round_trip_and_tampering(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "id int, s string, x double")
    key = F.lit("0123456789abcdef")
    sealed = seal(df, key, ["id"])
    assert rows(unseal(sealed, key, df.drop("id").schema).orderBy("id")) == rows(df)
    with pytest.raises(Exception):
        unseal(sealed.withColumn("payload", F.concat("payload", F.lit(b"x"))), key, df.drop("id").schema).collect()


def test_expansion_and_split(spark):
    df = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "x string, n int")
    assert rows(padding.expanded(df, "n").select("x")) == [("a",), ("a",), ("c",)]
    yes, no = padding.split(df, F.col("n") > 0)
    assert yes.count() == 2 and no.count() == 1


def test_streamed_workload(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 30) for i in range(90)], "id int, x int")
    engine = RangeSelect.build(df, "x")
    tables.ranges(spark, [(0, 3), (10, 12)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id int, qs long, qe long").parquet(str(tmp_path / "in"))
    seen = []
    query = answered(stream, df, "x", engine.bins, lambda out, n: seen.extend(out.where("NOT is_dummy").select("query_id", "id").collect()), str(tmp_path / "cp"))
    query.awaitTermination()
    wanted = rows(engine.run(tables.ranges(spark, [(0, 3), (10, 12)])).select("query_id", "id"))
    assert set(wanted) <= set(map(tuple, seen))


def test_primary_to_foreign_key_slots_keep_to_the_range(spark):
    pk = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pk int, name string")
    fk = spark.createDataFrame([(10, 1), (11, 1), (12, 3)], "id int, fk int")
    for partitioner in ("histogram", "tree", "grouping"):
        engine = EquiJoin(pk, "pk", fk, "fk", partitioner, "pk_fk")
        for attribute, qs, qe in (("fk", 1, 1), ("pk", 2, 3), ("id", 11, 12), ("fk", 3, 1)):
            assert rows(join.matches(engine.slots(attribute, qs, qe)).select("id", "name")) == rows(engine.exact(attribute, qs, qe).select("id", "name"))


def test_sealing_keeps_microseconds(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-02 03:04:05.123456' AS t, TIMESTAMP_NTZ '2024-01-02 03:04:05.000001' AS n, DATE '2024-02-29' AS d, 1.25D AS x, CAST(NULL AS TIMESTAMP) AS e")
    key = F.lit("0123456789abcdef")
    assert rows(unseal(seal(df, key, ["id"]), key, df.drop("id").schema)) == rows(df)


def test_wide_keys_are_placed_without_listing_values(spark):
    keys = [0, 5, 10**11, 10**11 - 3, 7 * 10**10, None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k long")
    leaves = privtree.leaves([(df, ["k"])], privtree.TreePlan(1, 5, kind="select"))
    placed = privtree.placed(df, ["k"], leaves).join(leaves, "bin_id")
    assert sorted(r.id for r in placed.collect()) == [0, 1, 2, 3, 4] and placed.where("k NOT BETWEEN lo_0 AND hi_0").count() == 0
    gaps = spark.createDataFrame([(0, 0, 3), (1, 10, 10**9)], "bin_id long, lo long, hi long")
    assert [(r.id, r.bin_id) for r in padding.placed(df, "k", gaps).orderBy("id").collect()] == [(0, 0)]
