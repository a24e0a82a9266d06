"""The registered queries as DuckDB SQL. Noise is drawn from the same md5 bits."""

from .queries import CUSTOMER_RANGE, NATION_RANGE, QUANTITY_RANGES, WORKLOAD

SEED = 7


def _geometric(rate: str, tag: str, key: str) -> str:
    return f"floor(ln((('0x' || substr(md5('{SEED}|{tag}|' || {key}), 1, 8))::BIGINT + 0.5) / CAST(4294967296 AS DOUBLE)) / CAST(-({rate}) AS DOUBLE))"


def _mean(eps: str, delta: str, sensitivity: str = "1") -> str:
    return f"(CAST(floor(({sensitivity}) / CAST({eps} AS DOUBLE) * ln(2 / ({delta}))) AS BIGINT) + ({sensitivity}) - 1)"


def shifted(eps: str, delta: str, tag: str, key: str, sensitivity: str = "1") -> str:
    rate, mean = f"CAST({eps} AS DOUBLE) / ({sensitivity})", _mean(eps, delta, sensitivity)
    return f"CAST(least(greatest({_geometric(rate, tag + 'a', key)} - {_geometric(rate, tag + 'b', key)} + {mean}, 0), 2 * {mean}) AS BIGINT)"


def plain(eps: str, delta: str, tag: str, key: str, sensitivity: str = "1") -> str:
    rate, mean = f"CAST({eps} AS DOUBLE) / ({sensitivity})", _mean(eps, delta, sensitivity)
    return f"CAST(least(greatest({_geometric(rate, tag + 'a', key)} - {_geometric(rate, tag + 'b', key)}, -{mean}), {mean}) AS BIGINT)"


#: Shares of the histogram's budget: 0.2 * 0.28 and the rest.
EPS_H, EPS_B = repr(0.2 * (0.02 + 0.26)), repr((0.02 + 0.26) - 0.2 * (0.02 + 0.26))
DELTA_H, DELTA_B = "0.2 * (SELECT delta FROM plan)", "((SELECT delta FROM plan) - 0.2 * (SELECT delta FROM plan))"
HEIGHT = "(SELECT height FROM plan)"


def _plan(sides: list[tuple[str, str]]) -> str:
    """CTEs: keys of both sides (t, key), and plan (lo, hi, n, delta, height, unit)."""
    keys = " UNION ALL ".join(f"SELECT {i + 1} AS t, CAST({k} AS BIGINT) AS key FROM {t} WHERE {k} IS NOT NULL" for i, (t, k) in enumerate(sides))
    return f"""keys AS ({keys}),
ends AS (SELECT min(key) AS lo, max(key) AS hi, count(*) AS n FROM keys),
plan AS (SELECT lo, hi, n, pow(n, -1.3) AS delta,
  1 + (SELECT count(*) FROM range(0, 12) AS p(i) WHERE pow(16, p.i) < hi - lo + 1) AS height,
  CAST(floor(2 / 0.30000000000000004 * ln(1 / pow(n, -1.3))) AS BIGINT) AS unit FROM ends)"""


def _histogram(t: int) -> str:
    """CTEs of one side, for domains of 17 to 256 values: leaves a{t}, inferred levels z0 to z2."""
    noise = lambda level, key: plain(EPS_H, DELTA_H, f"h{t}_{level}", f"({key})::VARCHAR", HEIGHT)
    up = lambda below: f"SELECT node // 16 AS node, sum(real)::BIGINT AS real, sum(noise)::BIGINT AS below, count(*) AS children FROM {below} GROUP BY node // 16"
    top, low = (lambda n: 16 ** (n + 1)), (lambda n: 16**n)
    z = lambda n: f"CAST(trunc({repr((top(n) - low(n)) / (top(n) - 1.0))} * ({noise(n, 'node')} + real) + {repr((low(n) - 1.0) / (top(n) - 1.0))} * (below + real)) AS BIGINT) - real"
    down = lambda child, parent: f"""SELECT c.node, c.real, CAST(trunc(c.noise + (p.noise - s.below) / CAST(s.children AS DOUBLE)) AS BIGINT) AS noise
  FROM {child} AS c JOIN {parent} AS p ON c.node // 16 = p.node JOIN ({up(child)}) AS s ON s.node = p.node"""  # noqa: E731
    return f"""a{t} AS (SELECT v - lo AS node, coalesce(real, 0) AS real, {noise(0, 'v - lo')} AS noise
  FROM (SELECT lo, unnest(range(lo, hi + 1)) AS v FROM plan) LEFT JOIN (SELECT key, count(*) AS real FROM keys WHERE t = {t} GROUP BY key) ON key = v),
b{t} AS (SELECT node, real, {z(1)} AS noise FROM ({up(f'a{t}')})),
z2_{t} AS (SELECT node, real, {z(2)} AS noise FROM ({up(f'b{t}')})),
z1_{t} AS ({down(f'b{t}', f'z2_{t}')}),
z0_{t} AS ({down(f'a{t}', f'z1_{t}')})"""


NATIONS = _plan([("supplier", "s_nationkey"), ("customer", "c_nationkey")])


def _joint(both: bool = True) -> str:
    if both:
        return f"{_histogram(1)},\n{_histogram(2)},\njoint AS (SELECT x.node, x.real AS r1, x.noise AS e1, y.real AS r2, y.noise AS e2 FROM z0_1 AS x JOIN z0_2 AS y USING (node))"
    return f"{_histogram(1)},\njoint AS (SELECT node, real AS r1, noise AS e1, 0 AS r2, 0 AS e2 FROM z0_1)"


def _walk(name: str, mass: str) -> str:
    """CTEs of a greedy walk: {name} (bin, lo, hi, r1, r2), bins numbered from 0."""
    return f"""{name}_target AS (SELECT ceil((SELECT sum({mass}) FROM joint) / CAST(greatest(1, ceil(CAST(((SELECT sum(r1 + e1 + r2 + e2) FROM joint) // greatest(unit, 1)) * height AS DOUBLE))) AS DOUBLE)) AS target FROM plan),
{name}_walk AS (
  SELECT CAST(-1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS bin, CAST(0 AS BIGINT) AS mass, FALSE AS full_
  UNION ALL
  SELECT j.node, w.bin + CASE WHEN w.full_ THEN 1 ELSE 0 END, CASE WHEN w.full_ THEN 0 ELSE w.mass END + CAST({mass} AS BIGINT),
    CASE WHEN w.full_ THEN 0 ELSE w.mass END + {mass} > (SELECT target FROM {name}_target)
  FROM {name}_walk AS w JOIN joint AS j ON j.node = w.node + 1),
{name} AS (SELECT bin, min(w.node) + any_value(lo) AS lo, max(w.node) + any_value(lo) AS hi, sum(r1)::BIGINT AS r1, sum(r2)::BIGINT AS r2
  FROM {name}_walk AS w JOIN joint USING (node), plan WHERE w.node >= 0 GROUP BY bin)"""


def _noise_b(tag: str, key: str) -> str:
    return shifted(EPS_B, DELTA_B, tag, key)


SHARED = f"""WITH RECURSIVE {NATIONS},
{_joint()},
{_walk('s', 'r1 + e1 + r2 + e2')},
shared AS (SELECT bin AS bin_id, lo, hi, r1 AS real1, r1 + {_noise_b('b1', 'bin::VARCHAR')} AS padded1, r2 AS real2, r2 + {_noise_b('b2', 'bin::VARCHAR')} AS padded2 FROM s)"""

OWN = f"""WITH RECURSIVE {NATIONS},
{_joint()},
{_walk('o1', 'r1 + e1')},
{_walk('o2', 'r2 + e2')},
own AS (
  SELECT CAST(1 AS BIGINT) AS table_id, bin AS bin_id, lo, hi, r1 AS real, r1 + {_noise_b('o', "'1|' || bin")} AS padded FROM o1
  UNION ALL
  SELECT CAST(2 AS BIGINT), bin, lo, hi, r2, r2 + {_noise_b('o', "'2|' || bin")} FROM o2)"""

QUANTITY = f"""WITH RECURSIVE items AS (SELECT CAST(l_quantity AS BIGINT) AS quantity FROM lineitem),
{_plan([("items", "quantity")])},
{_joint(False)},
{_walk('q', 'r1 + e1')},
bins AS (SELECT bin AS bin_id, lo, hi, r1 AS real, r1 + {_noise_b('b1', 'bin::VARCHAR')} AS padded FROM q),
workload AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(QUANTITY_RANGES))}) AS w(query_id, qs, qe)),
touched AS (SELECT query_id, qs, qe, bins.* FROM workload JOIN bins ON lo <= qe AND hi >= qs AND qs <= qe)"""

#: Grouping of customers and orders by customer.
GROUPS = f"""WITH RECURSIVE {_plan([("customer", "c_custkey"), ("orders", "o_custkey")])},
unit AS (SELECT CAST(floor(2 * (1 / 0.30000000000000004 * ln(2 / (2 * delta)))) AS BIGINT) AS u, delta FROM plan),
counted AS (SELECT key, count(*) FILTER (t = 1) AS c1, count(*) FILTER (t = 2) AS c2 FROM keys GROUP BY key),
noisy AS (SELECT key, c1, c2, {shifted('0.28', '(SELECT delta FROM unit)', 'k1', 'key::VARCHAR')} AS n1, {shifted('0.28', '(SELECT delta FROM unit)', 'k2', 'key::VARCHAR')} AS n2 FROM counted),
sorted AS (SELECT *, c1 + n1 > 2 * u OR c2 + n2 > 2 * u AS dense, row_number() OVER (PARTITION BY c1 + n1 > 2 * u OR c2 + n2 > 2 * u ORDER BY c1 + n1 DESC, c2 + n2 DESC, key) AS i FROM noisy, unit),
packed AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS bin, CAST(0 AS BIGINT) AS s1, CAST(0 AS BIGINT) AS s2
  UNION ALL
  SELECT s.i, CASE WHEN s1 + c1 > 4 * u OR s2 + c2 > 4 * u THEN bin + 1 ELSE bin END,
    CASE WHEN s1 + c1 > 4 * u OR s2 + c2 > 4 * u THEN c1 ELSE s1 + c1 END, CASE WHEN s1 + c1 > 4 * u OR s2 + c2 > 4 * u THEN c2 ELSE s2 + c2 END
  FROM packed AS p JOIN (SELECT * FROM sorted WHERE NOT dense) AS s ON s.i = p.i + 1),
members AS (
  SELECT key, i - 1 AS bin_id, 'dense' AS kind, c1, n1, c2, n2 FROM sorted WHERE dense
  UNION ALL
  SELECT key, bin + (SELECT count(*) FROM sorted WHERE dense), 'sparse', c1, n1, c2, n2 FROM sorted JOIN packed USING (i) WHERE NOT dense),
used AS (
  SELECT bin_id, kind, sum(c1)::BIGINT AS real1, CASE WHEN kind = 'dense' THEN sum(c1 + n1)::BIGINT ELSE 4 * (SELECT u FROM unit) END AS padded1,
    sum(c2)::BIGINT AS real2, CASE WHEN kind = 'dense' THEN sum(c2 + n2)::BIGINT ELSE 4 * (SELECT u FROM unit) END AS padded2
  FROM members GROUP BY bin_id, kind),
group_bins AS (
  SELECT * FROM used
  UNION ALL
  SELECT CAST((SELECT max(bin_id) FROM used) + unnest(range(1, 1 + {shifted(repr(0.28 / 3), '(SELECT delta / 3 FROM unit)', 'e', "'0'")})) AS BIGINT), 'empty', 0, 4 * u, 0, 4 * u FROM unit)"""

def _laplace(scale: str, tag: str, key: str) -> str:
    u = f"((('0x' || substr(md5('{SEED}|{tag}|' || {key}), 1, 8))::BIGINT + 0.5) / CAST(4294967296 AS DOUBLE) - 0.5)"
    return f"(CAST(-({scale}) AS DOUBLE) * sign({u}) * ln(CAST(1 AS DOUBLE) - 2 * abs({u})))"


#: The adaptive tree over one dimension: halves of what is above the threshold, and its leaves in order.
TREE = f"""WITH RECURSIVE {NATIONS.replace('ends AS', 'span AS').replace('FROM ends', 'FROM span')},
sums AS (SELECT v, count(*) FILTER (t = 1) AS c1, count(*) FILTER (t = 2) AS c2 FROM (SELECT lo, unnest(range(lo - 1, hi + 1)) AS v FROM plan) LEFT JOIN keys ON key <= v GROUP BY v),
bar AS (SELECT 2 / 0.30000000000000004 * ln(2 / delta) AS threshold, 150.0 * ln(2) AS decay FROM plan),
grown AS (
  SELECT CAST(0 AS BIGINT) AS depth, lo, hi, TRUE AS open FROM plan
  UNION ALL
  SELECT depth + 1, CASE WHEN side = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN side = 0 THEN (lo + hi) // 2 ELSE hi END, TRUE
  FROM (SELECT g.*, b.c1 + b.c2 - a.c1 - a.c2 AS n FROM grown AS g JOIN sums AS a ON a.v = g.lo - 1 JOIN sums AS b ON b.v = g.hi) AS g, bar, (VALUES (0), (1)) AS s(side)
  WHERE hi > lo AND greatest(n - depth * decay, threshold - decay) + {_laplace('150.0', 'p', "lo || ':' || hi")} > threshold),
ends AS (SELECT g.lo, g.hi, b.c1 - a.c1 AS real1, b.c2 - a.c2 AS real2 FROM grown AS g JOIN sums AS a ON a.v = g.lo - 1 JOIN sums AS b ON b.v = g.hi
  WHERE NOT EXISTS (SELECT 1 FROM grown AS k WHERE k.depth = g.depth + 1 AND k.lo = g.lo)),
tree AS (SELECT row_number() OVER (ORDER BY lo) - 1 AS bin_id, * FROM ends)"""

_workload = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(WORKLOAD))
_nations = "supplier JOIN customer ON s_nationkey = c_nationkey"
_lo, _hi = NATION_RANGE

ORACLES = {
    "equi_join_supplier_customer": f"SELECT s_suppkey, c_custkey, s_nationkey FROM {_nations}",
    "self_join_supplier": "SELECT a.s_suppkey AS suppkey1, b.s_suppkey AS suppkey2, a.s_nationkey AS nationkey FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey",
    "self_join_customer_sizes": "SELECT count(*) AS join_size FROM customer AS a JOIN customer AS b ON a.c_nationkey = b.c_nationkey",
    "join_size_exact": f"SELECT count(*) AS join_size FROM {_nations}",
    "pk_fk_join_customer_orders": "SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey",
    "pk_fk_join_orders_lineitem": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "pk_fk_join_nation_supplier": "SELECT s_suppkey, n_name FROM nation JOIN supplier ON n_nationkey = s_nationkey",
    "range_select_lineitem_quantity": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "range_select_workload": f"SELECT query_id, o_orderkey, o_custkey FROM orders JOIN (VALUES {_workload}) AS w(query_id, qs, qe) ON o_custkey BETWEEN qs AND qe",
    "select_join_on_key": f"SELECT s_suppkey, c_custkey, s_nationkey FROM {_nations} WHERE s_nationkey BETWEEN {_lo} AND {_hi}",
    "select_join_on_attr": f"SELECT s_suppkey, c_custkey, s_nationkey FROM {_nations} WHERE c_custkey BETWEEN {CUSTOMER_RANGE[0]} AND {CUSTOMER_RANGE[1]}",
    "key_domain": f"WITH {NATIONS} SELECT lo, hi FROM plan",
    "dense_histogram": f"WITH {NATIONS}, {_histogram(1)} SELECT node, real, noise FROM a1",
    "hierarchy_levels": f"""WITH {NATIONS}, {_histogram(1)}
SELECT CAST(0 AS BIGINT) AS level, node, real, noise FROM a1
UNION ALL SELECT 1, node // 16, sum(real)::BIGINT, {plain(EPS_H, DELTA_H, 'h1_1', '(node // 16)::VARCHAR', HEIGHT)} FROM a1 GROUP BY node // 16
UNION ALL SELECT 2, node // 256, sum(real)::BIGINT, {plain(EPS_H, DELTA_H, 'h1_2', '(node // 256)::VARCHAR', HEIGHT)} FROM a1 GROUP BY node // 256""",
    "constrained_inference": f"""WITH {NATIONS}, {_histogram(1)}
SELECT CAST(0 AS BIGINT) AS level, * FROM z0_1 UNION ALL SELECT 1, * FROM z1_1 UNION ALL SELECT 2, * FROM z2_1""",
    "best_range_cover": f"""WITH {NATIONS}, {_histogram(1)}
SELECT sum(real)::BIGINT AS real, sum(real + noise)::BIGINT AS noisy FROM a1, plan WHERE node + lo BETWEEN 3 AND 20""",
    "key_multiplicity_list": f"""WITH {NATIONS}, counted AS (SELECT key, count(*) FILTER (t = 1) AS count1, count(*) FILTER (t = 2) AS count2 FROM keys GROUP BY key)
SELECT key, count1, {shifted('0.28', '(SELECT delta FROM plan)', 'k1', 'key::VARCHAR')} AS noise1, count2, {shifted('0.28', '(SELECT delta FROM plan)', 'k2', 'key::VARCHAR')} AS noise2 FROM counted""",
    "htree_buckets_shared": f"{SHARED} SELECT * FROM shared",
    "htree_buckets_per_table": f"{OWN} SELECT * FROM own",
    "bins_overlapping_query": f"{SHARED} SELECT bin_id, lo, hi FROM shared WHERE lo <= {_hi} AND hi >= {_lo}",
    "bins_missed_by_query": f"{SHARED} SELECT bin_id FROM shared WHERE lo > {_hi} OR hi < {_lo}",
    "response_blowup": f"""{QUANTITY}, sent AS (SELECT query_id, sum(padded)::BIGINT AS padded_rows FROM touched GROUP BY query_id),
answers AS (SELECT query_id, count(*) AS exact_rows FROM workload JOIN items ON quantity BETWEEN qs AND qe GROUP BY query_id)
SELECT query_id, padded_rows, exact_rows, padded_rows / CAST(exact_rows AS DOUBLE) AS blow_up FROM sent JOIN answers USING (query_id)""",
    "padded_bucket_sizes": f"{QUANTITY} SELECT bin_id, real AS rows, padded - real AS dummies FROM bins WHERE padded > 0",
    "padded_range_select": f"""{QUANTITY}, answers AS (SELECT query_id, count(*) AS n FROM workload JOIN items ON quantity BETWEEN qs AND qe GROUP BY query_id)
SELECT query_id, sum(padded)::BIGINT AS sent, CAST(coalesce(any_value(n), 0) AS BIGINT) AS answers FROM touched LEFT JOIN answers USING (query_id) GROUP BY query_id HAVING sum(padded) > 0""",
    "bucket_pair_overlap": f"""{OWN} SELECT a.bin_id AS bin_id1, b.bin_id AS bin_id2, a.padded AS padded1, b.padded AS padded2 FROM own AS a JOIN own AS b ON a.table_id = 1 AND b.table_id = 2
AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.lo <= {_hi} AND a.hi >= {_lo} AND b.lo <= {_hi} AND b.hi >= {_lo}""",
    "padded_join_sizes": f"{OWN} SELECT sum(a.padded * b.padded)::BIGINT AS slots FROM own AS a JOIN own AS b ON a.table_id = 1 AND b.table_id = 2 AND a.lo <= b.hi AND b.lo <= a.hi",
    "padded_join_slots": f"""{SHARED}, found AS (SELECT s_nationkey AS key, count(*) AS n FROM {_nations} GROUP BY s_nationkey)
SELECT bin_id, padded1 * padded2 AS slots, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches FROM shared LEFT JOIN found ON key BETWEEN lo AND hi WHERE padded1 * padded2 > 0 GROUP BY bin_id, padded1, padded2""",
    "padded_pk_fk_join": f"""{SHARED}, found AS (SELECT c_nationkey AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey)
SELECT bin_id, padded2 AS slots, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches FROM shared LEFT JOIN found ON key BETWEEN lo AND hi WHERE padded2 > 0 GROUP BY bin_id, padded2""",
    "join_compaction_size": f"""{SHARED}, size AS (SELECT count(*) AS matches FROM {_nations}), largest AS (SELECT max(greatest(padded1, padded2)) AS s FROM shared)
SELECT matches, matches + {shifted('0.02', '(SELECT delta FROM plan)', 'c', "'0'", '(SELECT s FROM largest)')} AS noisy_size FROM size""",
    "compacted_join": f"""{SHARED}, size AS (SELECT count(*) AS matches FROM {_nations}), largest AS (SELECT max(greatest(padded1, padded2)) AS s FROM shared),
noisy AS (SELECT matches, least({shifted('0.02', '(SELECT delta FROM plan)', 'c', "'0'", '(SELECT s FROM largest)')}, (SELECT sum(padded1 * padded2)::BIGINT FROM shared) - matches) AS more FROM size)
SELECT FALSE AS is_dummy, matches AS n FROM noisy WHERE matches > 0 UNION ALL SELECT TRUE, more FROM noisy WHERE more > 0""",
    "dense_sparse_grouping": f"{GROUPS} SELECT key, bin_id, kind FROM members",
    "dense_sparse_bins": f"{GROUPS} SELECT * FROM group_bins",
    "grouped_join_size": f"{GROUPS} SELECT sum(padded1 * padded2)::BIGINT AS slots FROM group_bins",
    "sealed_roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer",
    "noise_tgeom": f"SELECT c_custkey, {shifted('0.26', '1e-6', 't', 'c_custkey::VARCHAR')} AS shifted, {plain('0.26', '1e-6', 't', 'c_custkey::VARCHAR')} AS plain FROM customer",
    "privtree_leaves": f"""{TREE} SELECT bin_id, lo AS lo_0, hi AS hi_0, real1, real1 + {shifted('0.26', '(SELECT delta FROM plan)', 'l1', 'bin_id::VARCHAR')} AS padded1,
  real2, real2 + {shifted('0.26', '(SELECT delta FROM plan)', 'l2', 'bin_id::VARCHAR')} AS padded2 FROM tree""",
    "sealed_roundtrip_orders": "SELECT o_orderkey, o_orderdate + INTERVAL 123456 MICROSECONDS AS stamp, o_totalprice FROM orders",
    "noise_laplace": f"SELECT c_custkey, round({_laplace('150.0', 'l', 'c_custkey::VARCHAR')}, 6) AS noise FROM customer",
    "scan_supplier_tbl": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "scan_customer_tbl": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "scan_synthetic_text": "SELECT c_nationkey AS key, CAST(c_custkey AS INTEGER) AS a1, row_number() OVER (ORDER BY c_custkey) - 1 AS rid FROM customer",
    "scan_workload": f"SELECT CAST(query_id AS INTEGER) AS query_id, CAST(qs AS BIGINT) AS qs, CAST(qe AS BIGINT) AS qe, 1 AS attribute FROM (VALUES {_workload}) AS w(query_id, qs, qe)",
    "saved_bins": f"{QUANTITY} SELECT bin_id, real AS rows, padded - real AS dummies FROM bins WHERE padded > 0 AND bin_id < 3",
    "saved_index": f"{SHARED} SELECT * FROM shared",
    "saved_join_output": f"SELECT s_suppkey, c_custkey, s_nationkey FROM {_nations}",
    "box_membership": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, l_suppkey FROM lineitem WHERE CAST(l_quantity AS BIGINT) BETWEEN 5 AND 9 AND l_suppkey BETWEEN 3 AND 40",
    "rows_expanded": "SELECT n_nationkey, n_regionkey FROM nation, LATERAL (SELECT unnest(range(n_regionkey)))",
    "rows_split": "SELECT s_suppkey, s_acctbal, s_acctbal > 0 AS side FROM supplier",
    "tree_join_matches": f"SELECT s_suppkey, c_custkey, s_nationkey FROM {_nations}",
    "grouped_join_matches": f"SELECT s_suppkey, c_custkey, s_nationkey FROM {_nations}",
    "tree_pk_fk_matches": "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "grouped_pk_fk_matches": "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "padded_pk_fk_select_join": f"SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey BETWEEN {_lo} AND {_hi}",
    "tree_select_join_matches": f"SELECT s_suppkey, c_custkey, s_nationkey FROM {_nations} WHERE c_custkey BETWEEN {CUSTOMER_RANGE[0]} AND {CUSTOMER_RANGE[1]}",
    "tree_routed_rows": "SELECT c_nationkey AS key, count(*) AS n, TRUE AS inside FROM customer GROUP BY c_nationkey",
    "streamed_range_select": f"""SELECT query_id, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem
JOIN (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(QUANTITY_RANGES))}) AS w(query_id, qs, qe) ON CAST(l_quantity AS BIGINT) BETWEEN qs AND qe""",
}
