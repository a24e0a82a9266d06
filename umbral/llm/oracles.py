"""DuckDB SQL for the rows of those opN_ queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
gram AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM doc, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT doc_id, item, i, gram.n FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS asked, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql() -> str:
    from . import secrets as s

    parts = []
    for order, (kind, (pattern, group)) in enumerate(s.KINDS.items()):
        p = quoted(pattern)
        parts.append(f"""SELECT rid, doc_id, source, {order} AS ord, '{kind}' AS kind, unnest(range(1, len(w) + 1)) AS i, w, v, g FROM (
  SELECT rid, doc_id, source, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {group}) AS v, regexp_split_to_array(t, {p}) AS g FROM d WHERE regexp_matches(t, {p}))""")
    kinds = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in s.BASE)
    base = ", ".join(f"'{k}'" for k in s.BASE)
    joined = lambda more: f"coalesce(string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, ord){more}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
placed AS (
  SELECT rid, doc_id, source, ord, kind, v[i] AS value, length(w[i]) AS size,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM m WHERE kind <> 'assign' OR length(v[i]) >= {s.ASSIGN_VALUE}),
owners AS (SELECT value, count(DISTINCT coalesce('x' || source, '')) AS n_owners, count(DISTINCT coalesce('x' || doc_id, '')) AS n_repos FROM placed GROUP BY value),
shown AS (
  SELECT *, start + size AS fin FROM placed JOIN owners USING (value)
  WHERE kind IN ({base}) OR (n_owners <= {s.MAX_OWNERS} AND n_repos <= {s.MAX_REPOS} AND len(list_distinct(string_split(value, ''))) >= {s.DISTINCT_CHARS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]'))),
per_row AS (
  SELECT rid, {kinds}, {joined(f" FILTER (kind IN ({base}))")} AS base, {joined('')} AS spans FROM shown GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in s.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_row USING (rid)
"""


def urls_sql(rules: list[tuple[str, str]]) -> str:
    from . import urls as u

    fits, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        when = f"(host = {quoted(host)} OR ends_with(host, {quoted('.' + host)})) AND starts_with(path, {quoted(slash + path)})"
        fits.append(f"WHEN {when} THEN {quoted(rule)}")
        verdicts.append(f"WHEN {when} THEN {quoted(verdict)}")
    two = ", ".join(map(quoted, u.TWO_LABEL))

    def names(host: str) -> str:
        last = lambda n: f"array_to_string(list_slice(string_split({host}, '.'), greatest(len(string_split({host}, '.')) - {n - 1}, 1), len(string_split({host}, '.'))), '.')"
        return f"CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix"

    def level(name: str, groups: str, above: str) -> str:
        """CTEs: groups with their parent's mean, the prior strength, and the posterior."""
        within, expected = "sum(mean * (1 - mean))", "sum(mean * (1 - mean) * (n - 1))"
        rho = f"CASE WHEN {expected} <> 0 THEN (sum(n * (x / n - mean) * (x / n - mean)) - {within}) / {expected} ELSE {u.MOST_RHO} END"
        return f"""{name}_rows AS (SELECT g.*, p.mean FROM ({groups}) AS g JOIN {above}),
{name}_k AS (SELECT 1 / least(greatest({rho}, {u.LEAST_RHO}), {u.MOST_RHO}) - 1 AS k FROM {name}_rows WHERE n > 0),
{name}_post AS (SELECT {name} AS name, mean * k + x AS a, (1 - mean) * k + n - x AS b FROM {name}_rows, {name}_k)"""

    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1.0 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0.0 END AS bad FROM labels),
outcomes AS (
  SELECT host, bad FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM p) JOIN judged USING (doc_id)
  UNION ALL SELECT host, NULL FROM p),
hosts AS (SELECT host, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS x, CAST(count(bad) AS DOUBLE) AS n, {names('host')} FROM outcomes GROUP BY host),
{level('suffix', 'SELECT suffix, sum(x) AS x, sum(n) AS n FROM hosts GROUP BY suffix', '(SELECT (sum(x) + 1) / (sum(n) + 2) AS mean FROM hosts) AS p ON TRUE')},
{level('domain', 'SELECT suffix, domain, sum(x) AS x, sum(n) AS n FROM hosts GROUP BY suffix, domain', '(SELECT name, a / (a + b) AS mean FROM suffix_post) AS p ON p.name = g.suffix')},
{level('host', 'SELECT * FROM hosts', '(SELECT name, a / (a + b) AS mean FROM domain_post) AS p ON p.name = g.domain')}
SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule,
  coalesce(CASE {' '.join(verdicts)} END, CASE WHEN a / (a + b) - {u.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {u.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN host_post ON name = host
"""


def licenses_sql() -> str:
    from . import licenses as c

    weights, bias = c.trained()
    rows = ", ".join(f"({quoted(f)}, {w})" for f, w in weights.items())
    shingles = ", ".join(f"({quoted(f)}, {i}, {len(s)}, {quoted(x)})" for f in c.FAMILIES for i, s in enumerate(map(c.shingles, map(c.words, c.SENTENCES[f]))) for x in s)
    anchor, blank = quoted(c.ANCHOR), quoted(r"\n[ \t\r]*\n")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT rid, CASE WHEN regexp_matches(t, {blank}) THEN regexp_split_to_array(t, {blank}) ELSE string_split(t, chr(10)) END AS p FROM d WHERE regexp_matches(t, {anchor})),
para AS (SELECT rid, i, p[i] AS t FROM cut, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) WHERE regexp_matches(p[i], {anchor})),
word AS (SELECT rid, i, list_filter(regexp_split_to_array(regexp_replace(lower(t), '[0-9]+', '0', 'g'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM para),
feature AS (
  SELECT DISTINCT rid, i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) AS f FROM word),
weight(f, w) AS (VALUES {rows}),
class AS (SELECT unnest(range(1, {len(bias) + 1})) AS c, unnest({bias}) AS b),
total AS (
  SELECT rid, i, c, any_value(b) + coalesce(sum(x.w[c]), 0) AS z
  FROM word CROSS JOIN class LEFT JOIN (SELECT rid, i, w FROM feature JOIN weight USING (f)) AS x USING (rid, i) GROUP BY rid, i, c),
best AS (SELECT rid, i, arg_min(c, (-z, CASE WHEN c = {c.UNKNOWN + 1} THEN 0 ELSE c END)) AS c FROM total GROUP BY rid, i),
family AS (SELECT rid, i, {c.FAMILIES}[c] AS family FROM best WHERE c <= {c.UNKNOWN}),
template(family, s, size, g) AS (VALUES {shingles}),
own AS (
  SELECT DISTINCT rid, i, unnest(list_transform(range(1, len(w) - least({c.SHINGLE}, len(w)) + 2), lambda j: array_to_string(w[j:j + least({c.SHINGLE}, len(w)) - 1], ' '))) AS g FROM word WHERE len(w) > 0),
sure AS (
  SELECT DISTINCT rid, i FROM (SELECT rid, i, family, s, count(*) AS n, any_value(size) AS size FROM family JOIN own USING (rid, i) JOIN template USING (family, g) GROUP BY rid, i, family, s) WHERE n >= size * {c.SIMILARITY}),
per_row AS (
  SELECT f.rid, count(*) AS n_predicted, count(s.rid) AS n_confirmed, string_agg(DISTINCT CASE WHEN s.rid IS NOT NULL THEN family END, ',' ORDER BY CASE WHEN s.rid IS NOT NULL THEN family END) AS names
  FROM family AS f LEFT JOIN (SELECT rid AS r, i AS j, rid FROM sure) AS s ON s.r = f.rid AND s.j = f.i GROUP BY f.rid)
SELECT doc_id, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(names, '') AS licenses FROM d LEFT JOIN per_row USING (rid)
"""
