"""Registered queries: every operator on the tables of a scale factor, with explicit column names."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.budget import Budget, HistogramPlan
from ..durable import work_folder
from ..functions.noise import TGeom, laplace
from ..functions.sealing import seal, unseal
from ..operators import catalog, grouping, htree, join, padding, privtree, select
from ..sources import sinks, tables
from ..sources.tables import parquet, ranges
from ..streaming.replay import answered

#: The workload of range queries on o_custkey: inside, at and outside the domain, and empty.
WORKLOAD = [(0, 9), (10, 30), (-5, 3), (140, 160), (25, 25), (60, 20), (-20, -1), (100, 2_000_000_000)]
NATION_RANGE, CUSTOMER_RANGE = (5, 9), (100, 700)


def _supplier(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")


def _customer(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")


def _nations(spark: SparkSession, d: str) -> tuple[DataFrame, str, DataFrame, str]:
    return _supplier(spark, d), "s_nationkey", _customer(spark, d), "c_nationkey"


def _nation_plan(spark: SparkSession, d: str) -> HistogramPlan:
    a, ak, b, bk = _nations(spark, d)
    return catalog.plan_for((a, ak), (b, bk))


def _shared(spark: SparkSession, d: str) -> DataFrame:
    return htree.shared_buckets(*_nations(spark, d), _nation_plan(spark, d))


def _quantities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """lineitem by whole quantity, and its buckets."""
    df = parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"))
    return df, htree.single_buckets(df, "quantity", catalog.plan_for((df, "quantity")))


QUANTITY_RANGES = [(10, 20), (0, 0), (1, 50), (49, 90), (30, 10)]


def equi_join_supplier_customer(spark, d):
    return join.equi_join(*_nations(spark, d)).select("s_suppkey", "c_custkey", "s_nationkey")


def self_join_supplier(spark, d):
    a = _supplier(spark, d).select(F.col("s_suppkey").alias("suppkey1"), F.col("s_nationkey").alias("nation1"))
    b = _supplier(spark, d).select(F.col("s_suppkey").alias("suppkey2"), F.col("s_nationkey").alias("nation2"))
    return join.equi_join(a, "nation1", b, "nation2").select("suppkey1", "suppkey2", F.col("nation1").alias("nationkey"))


def self_join_customer_sizes(spark, d):
    return join.join_size(_customer(spark, d), "c_nationkey", _customer(spark, d), "c_nationkey")


def join_size_exact(spark, d):
    return join.join_size(*_nations(spark, d))


def pk_fk_join_customer_orders(spark, d):
    orders = parquet(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return join.pk_fk_join(_customer(spark, d), "c_custkey", orders, "o_custkey").select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


def pk_fk_join_orders_lineitem(spark, d):
    orders = parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    lines = parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return join.pk_fk_join(orders, "o_orderkey", lines, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "o_orderstatus")


def pk_fk_join_nation_supplier(spark, d):
    nation = parquet(spark, d, "nation").select("n_nationkey", "n_name")
    return join.pk_fk_join(nation, "n_nationkey", _supplier(spark, d), "s_nationkey").select("s_suppkey", "n_name")


def range_select_lineitem_quantity(spark, d):
    lines = parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return select.exact(lines, "l_quantity", 10, 20)


def range_select_workload(spark, d):
    orders = parquet(spark, d, "orders").select("o_orderkey", "o_custkey")
    return select.exact_workload(orders, "o_custkey", ranges(spark, WORKLOAD)).select("query_id", "o_orderkey", "o_custkey")


def select_join_on_key(spark, d):
    return join.select_join(*_nations(spark, d), "s_nationkey", *NATION_RANGE).select("s_suppkey", "c_custkey", "s_nationkey")


def select_join_on_attr(spark, d):
    return join.select_join(*_nations(spark, d), "c_custkey", *CUSTOMER_RANGE).select("s_suppkey", "c_custkey", "s_nationkey")


def key_domain(spark, d):
    a, ak, b, bk = _nations(spark, d)
    return catalog.key_domain((a, ak), (b, bk))


def dense_histogram(spark, d):
    return catalog.dense_histogram(_supplier(spark, d), "s_nationkey", _nation_plan(spark, d), "h1_")


def hierarchy_levels(spark, d):
    plan = _nation_plan(spark, d)
    return catalog.hierarchy(catalog.dense_histogram(_supplier(spark, d), "s_nationkey", plan, "h1_"), plan, "h1_")


def constrained_inference(spark, d):
    plan = _nation_plan(spark, d)
    return catalog.inferred(catalog.dense_histogram(_supplier(spark, d), "s_nationkey", plan, "h1_"), plan, "h1_")


def best_range_cover(spark, d):
    plan = _nation_plan(spark, d)
    nodes = catalog.hierarchy(catalog.dense_histogram(_supplier(spark, d), "s_nationkey", plan, "h1_"), plan, "h1_")
    return catalog.noisy_range_count(nodes, plan, 3, 20)


def key_multiplicity_list(spark, d):
    plan = grouping.GroupingPlan(_nation_plan(spark, d).rows)
    return catalog.key_list(*_nations(spark, d), plan.key_noise)


def htree_buckets_shared(spark, d):
    return _shared(spark, d)


def htree_buckets_per_table(spark, d):
    return htree.own_buckets(*_nations(spark, d), _nation_plan(spark, d))


def bins_overlapping_query(spark, d):
    return catalog.overlapping(_shared(spark, d), *NATION_RANGE).select("bin_id", "lo", "hi")


def bins_missed_by_query(spark, d):
    every = _shared(spark, d).select("bin_id")
    return catalog.difference(every, catalog.overlapping(_shared(spark, d), *NATION_RANGE).select("bin_id"))


def response_blowup(spark, d):
    df, bins = _quantities(spark, d)
    return select.blow_up(df, "quantity", bins, ranges(spark, QUANTITY_RANGES))


def padded_bucket_sizes(spark, d):
    """Rows and dummies of each padded bin, counted from the padded table itself."""
    df, bins = _quantities(spark, d)
    table = padding.padded(padding.placed(df, "quantity", bins), bins, F.col("padded") - F.col("real"))
    return table.groupBy("bin_id").agg(F.sum((~F.col("is_dummy")).cast("long")).alias("rows"), F.sum(F.col("is_dummy").cast("long")).alias("dummies"))


def padded_range_select(spark, d):
    """What the touched bins hold for each query, and how much of it answers the query."""
    df, bins = _quantities(spark, d)
    workload = ranges(spark, QUANTITY_RANGES)
    answer = select.response(df, "quantity", bins, workload).join(workload, "query_id")
    fits = ~F.col("is_dummy") & F.col("quantity").between(F.col("qs"), F.col("qe"))
    return answer.groupBy("query_id").agg(F.count("*").alias("sent"), F.sum(F.when(fits, 1).otherwise(0)).alias("answers"))


def _own(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = htree_buckets_per_table(spark, d)
    return own.where("table_id = 1"), own.where("table_id = 2")


def bucket_pair_overlap(spark, d):
    return join.bin_pairs(*_own(spark, d), *NATION_RANGE)


def padded_join_sizes(spark, d):
    return join.padded_size(join.bin_pairs(*_own(spark, d)))


def padded_join_slots(spark, d):
    """Slots and matches of the padded join in each shared bin."""
    a, ak, b, bk = _nations(spark, d)
    bins = _shared(spark, d)
    left, right = (padding.padded(padding.placed(df.select(k), k, bins), bins, F.col(f"padded{n}") - F.col(f"real{n}")) for n, df, k in ((1, a, ak), (2, b, bk)))
    slots = join.padded_slots(left, ak, right, bk)
    return slots.groupBy(F.col("bin_id1").alias("bin_id")).agg(F.count("*").alias("slots"), F.sum(F.col("is_match").cast("long")).alias("matches"))


def padded_pk_fk_join(spark, d):
    """Slots and matches of nation to padded customers in each bin."""
    _, _, b, bk = _nations(spark, d)
    bins = _shared(spark, d)
    nation = parquet(spark, d, "nation").select("n_nationkey")
    right = padding.padded(padding.placed(b.select(bk), bk, bins), bins, F.col("padded2") - F.col("real2"))
    slots = join.padded_pk_fk(nation, "n_nationkey", right, bk)
    return slots.groupBy("bin_id").agg(F.count("*").alias("slots"), F.sum(F.col("is_match").cast("long")).alias("matches"))


def join_compaction_size(spark, d):
    """Matches, and the noisy number of rows that the compacted join has."""
    bins = _shared(spark, d)
    largest = bins.agg(F.max(F.greatest("padded1", "padded2"))).first()[0]
    noise = join.compaction_noise(Budget().eps_c, Budget.delta(_nation_plan(spark, d).rows), largest)
    return join_size_exact(spark, d).select(F.col("join_size").alias("matches"), (F.col("join_size") + noise.shifted("c", F.lit(0))).alias("noisy_size"))


def compacted_join(spark, d):
    """Rows and dummies of the compacted join."""
    from .engine import EquiJoin

    a, ak, b, bk = _nations(spark, d)
    out = EquiJoin(a.select("s_suppkey", ak), ak, b.select("c_custkey", bk), bk).compacted()
    return out.groupBy("is_dummy").agg(F.count("*").alias("n"))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, grouping.GroupingPlan]:
    plan = grouping.GroupingPlan(_order_plan(spark, d))
    return grouping.members(*_orders(spark, d), plan), plan


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, str, DataFrame, str]:
    return parquet(spark, d, "customer").select("c_custkey"), "c_custkey", parquet(spark, d, "orders").select("o_custkey"), "o_custkey"


def _order_plan(spark: SparkSession, d: str) -> int:
    a, ak, b, bk = _orders(spark, d)
    return catalog.plan_for((a, ak), (b, bk)).rows


def dense_sparse_grouping(spark, d):
    return _groups(spark, d)[0].select("key", "bin_id", "kind")


def dense_sparse_bins(spark, d):
    members, plan = _groups(spark, d)
    return grouping.bins(members, plan)


def grouped_join_size(spark, d):
    members, plan = _groups(spark, d)
    return grouping.output_size(grouping.bins(members, plan))


def privtree_leaves(spark, d):
    a, ak, b, bk = _nations(spark, d)
    return privtree.leaves([(a, [ak]), (b, [bk])], privtree.TreePlan(1, a.count(), b.count()))


def privtree_leaves_2d(spark, d):
    df = parquet(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("quantity"), "l_suppkey")
    return privtree.leaves([(df, ["quantity", "l_suppkey"])], privtree.TreePlan(2, df.count(), kind="select"))


def tree_select_join(spark, d):
    """Slots of the select-join over trees, and the matches among them."""
    from .engine import TreeSelectJoin

    a, ak, b, bk = _nations(spark, d)
    slots = TreeSelectJoin(a.select(ak), ak, b.select(bk, "c_custkey"), bk, "c_custkey").slots(*CUSTOMER_RANGE)
    return slots.agg(F.count("*").alias("slots"), F.sum(F.col("is_match").cast("long")).alias("matches"))


def sealed_roundtrip(spark, d):
    df = parquet(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    key = F.lit("0123456789abcdef")  # for the query only; callers pass their own
    return unseal(seal(df, key, ["c_custkey"]), key, df.drop("c_custkey").schema)


def noise_tgeom(spark, d):
    noise = TGeom(0.26, 1e-6)
    return parquet(spark, d, "customer").select("c_custkey", noise.shifted("t", F.col("c_custkey")).alias("shifted"), noise.plain("t", F.col("c_custkey")).alias("plain"))


def sealed_roundtrip_orders(spark, d):
    """Timestamps keep all their digits."""
    df = parquet(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, 0, 0, 0.123456)")).alias("stamp"), "o_totalprice")
    key = F.lit("0123456789abcdef")
    return unseal(seal(df, key, ["o_orderkey"]), key, df.drop("o_orderkey").schema)


def noise_laplace(spark, d):
    return parquet(spark, d, "customer").select("c_custkey", F.round(laplace(150.0, "l", F.col("c_custkey")), 6).alias("noise"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _as_tbl(df: DataFrame, name: str) -> str:
    """The table as a |-delimited file; columns that df lacks are empty."""
    path = _folder(df.sparkSession, name)
    names = [c.split()[0] for c in tables.TBL[name].split(", ")]
    line = F.concat_ws("|", *[F.col(c).cast("string") if c in df.columns else F.lit("") for c in names], F.lit(""))
    df.select(line.alias("value")).write.text(path)
    return path


def scan_supplier_tbl(spark, d):
    path = _as_tbl(parquet(spark, d, "supplier"), "supplier")
    return tables.tbl(spark, path, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def scan_customer_tbl(spark, d):
    path = _as_tbl(parquet(spark, d, "customer"), "customer")
    return tables.tbl(spark, path, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def scan_synthetic_text(spark, d):
    """Customers as a file of numbers under a header, read again with row numbers."""
    rows, path = _customer(spark, d), _folder(spark, "synthetic")
    head = spark.createDataFrame([(-2, f"{rows.count()} 2"), (-1, "")], "at long, value string")
    lines = head.unionByName(rows.select(F.col("c_custkey").alias("at"), F.concat_ws(" ", "c_nationkey", "c_custkey").alias("value")))
    tables.write_lines(lines.orderBy("at").select("value"), path)
    return tables.synthetic(spark, path)


def scan_workload(spark, d):
    path = _folder(spark, "workload")
    lines = [f"{len(WORKLOAD)} 1", *(f"{a} {b}" for a, b in WORKLOAD)]
    tables.write_lines(spark.createDataFrame(list(enumerate(lines)), "at int, value string").orderBy("at").select("value"), path)
    queries, attribute = tables.workload(spark, path)
    return queries.withColumn("attribute", F.lit(attribute))


def saved_bins(spark, d):
    """Rows and dummies of three bins that were written and read again."""
    df, bins = _quantities(spark, d)
    path = _folder(spark, "bins")
    sinks.write_bins(padding.padded(padding.placed(df, "quantity", bins), bins, F.col("padded") - F.col("real")), path)
    return sinks.read_bins(spark, path, [0, 1, 2]).groupBy("bin_id").agg(F.sum((~F.col("is_dummy")).cast("long")).alias("rows"), F.sum(F.col("is_dummy").cast("long")).alias("dummies"))


def saved_index(spark, d):
    path = _folder(spark, "index")
    sinks.write_index(_shared(spark, d), path)
    return sinks.read_index(spark, path)


def saved_join_output(spark, d):
    path = _folder(spark, "output")
    sinks.write_output(equi_join_supplier_customer(spark, d), path)
    return spark.read.parquet(path)


def box_membership(spark, d):
    df = parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"), "l_suppkey")
    return privtree.in_box(df, ["quantity", "l_suppkey"], ((5, 9), (3, 40)))


def rows_expanded(spark, d):
    return padding.expanded(parquet(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey")


def rows_split(spark, d):
    yes, no = padding.split(parquet(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") > 0)
    return yes.withColumn("side", F.lit(True)).unionByName(no.withColumn("side", F.lit(False)))


def _matches(spark: SparkSession, d: str, partitioner: str) -> DataFrame:
    from .engine import EquiJoin

    a, ak, b, bk = _nations(spark, d)
    return join.matches(EquiJoin(a.select("s_suppkey", ak), ak, b.select("c_custkey", bk), bk, partitioner).slots()).select("s_suppkey", "c_custkey", "s_nationkey")


def tree_join_matches(spark, d):
    return _matches(spark, d, "tree")


def grouped_join_matches(spark, d):
    return _matches(spark, d, "grouping")


def _pk_fk_matches(spark: SparkSession, d: str, partitioner: str, *within) -> DataFrame:
    from .engine import EquiJoin

    nation, customer = parquet(spark, d, "nation").select("n_nationkey", "n_name"), parquet(spark, d, "customer").select("c_custkey", "c_nationkey")
    engine = EquiJoin(nation, "n_nationkey", customer, "c_nationkey", partitioner, "pk_fk")
    return join.matches(engine.slots(*within)).select("c_custkey", "c_nationkey", "n_name")


def tree_pk_fk_matches(spark, d):
    return _pk_fk_matches(spark, d, "tree")


def grouped_pk_fk_matches(spark, d):
    return _pk_fk_matches(spark, d, "grouping")


def padded_pk_fk_select_join(spark, d):
    return _pk_fk_matches(spark, d, "histogram", "c_nationkey", *NATION_RANGE)


def tree_select_join_matches(spark, d):
    from .engine import TreeSelectJoin

    a, ak, b, bk = _nations(spark, d)
    slots = TreeSelectJoin(a.select("s_suppkey", ak), ak, b.select(bk, "c_custkey"), bk, "c_custkey").slots(*CUSTOMER_RANGE)
    return join.matches(slots).select("s_suppkey", "c_custkey", "s_nationkey")


def tree_routed_rows(spark, d):
    """Rows of each key after routing to leaves, and whether all lie within their leaf."""
    a, ak, b, bk = _nations(spark, d)
    leaves = privtree.leaves([(a, [ak]), (b, [bk])], privtree.TreePlan(1, a.count(), b.count()))
    rows = privtree.placed(b.select(bk), [bk], leaves).join(leaves, "bin_id")
    return rows.groupBy(F.col(bk).alias("key")).agg(F.count("*").alias("n"), F.min(F.col(bk).between(F.col("lo_0"), F.col("hi_0"))).alias("inside"))


def streamed_range_select(spark, d):
    """The workload as a stream, answered with padded bins, of which the rows that qualify are kept."""
    df, bins = _quantities(spark, d)
    path = _folder(spark, "stream")
    workload = ranges(spark, QUANTITY_RANGES)
    workload.write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(workload.schema).parquet(f"{path}/in")
    answered(arriving, df, "quantity", bins, lambda out, n: out.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/checkpoint").awaitTermination()
    return select.refined(spark.read.parquet(f"{path}/out"), "quantity", workload).select("query_id", "l_orderkey", "l_linenumber", "quantity")


QUERIES = {
    f.__name__: f
    for f in (
        equi_join_supplier_customer, self_join_supplier, self_join_customer_sizes, join_size_exact, pk_fk_join_customer_orders, pk_fk_join_orders_lineitem, pk_fk_join_nation_supplier,
        range_select_lineitem_quantity, range_select_workload, select_join_on_key, select_join_on_attr, key_domain, dense_histogram, hierarchy_levels, constrained_inference, best_range_cover,
        key_multiplicity_list, htree_buckets_shared, htree_buckets_per_table, bins_overlapping_query, bins_missed_by_query, response_blowup, padded_bucket_sizes, padded_range_select,
        bucket_pair_overlap, padded_join_sizes, padded_join_slots, padded_pk_fk_join, join_compaction_size, compacted_join, dense_sparse_grouping, dense_sparse_bins, grouped_join_size,
        privtree_leaves, privtree_leaves_2d, tree_select_join, sealed_roundtrip, noise_tgeom,
        sealed_roundtrip_orders, noise_laplace, scan_supplier_tbl, scan_customer_tbl, scan_synthetic_text, scan_workload, saved_bins, saved_index, saved_join_output, box_membership, rows_expanded, rows_split,
        tree_join_matches, grouped_join_matches, tree_pk_fk_matches, grouped_pk_fk_matches, padded_pk_fk_select_join, tree_select_join_matches, tree_routed_rows, streamed_range_select,
    )
}
