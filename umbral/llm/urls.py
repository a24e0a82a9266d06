"""URL filtering: explicit rules, and empirical-Bayes host reputation for the rest.

Labelled page outcomes are summed by host, registered domain and suffix. Each level is shrunk
towards the one above through a beta-binomial prior: its mean is the parent's posterior mean, and its
strength is estimated from the overdispersion between the level's groups. A host is blocked when
the lower posterior bound of its rate of bad pages exceeds the threshold; a host without labels has the
prior that its domain gives it.

A null url, or one without `://`, has an empty host and path; it fits no rule and gets the verdict of
an unlabelled host. Repeated pages each count and each get a row. With no labels at all every page has
the uniform prior, whose lower bound blocks nothing. Only sums per host are joined with the pages, on the
host; a host that holds most pages is split by the adaptive skew join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered; all others have one label.
TWO_LABEL = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: Posterior standard deviations below the mean, and the rate that bound may not exceed.
Z, THRESHOLD = 1.0, 0.4
#: Bounds of the intraclass correlation, so that strengths stay between 1 and 999.
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Longer rule lists are joined instead of inlined.
INLINE_RULES = 64
#: Hosts that one task takes when levels are summed.
HOSTS = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    host, path = host_path(F.col("__url"))
    return pages.select(F.col(id_col), F.col(url_col).alias("__url")).withColumns({"host": host, "path": path})


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*TWO_LABEL)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def fitting(rule_host: Column, rule_path: Column) -> Column:
    host, path = F.col("host"), F.col("path")
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def with_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict of the longest fitting (verdict, host/path) rule; of equally long ones the first by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    if len(rules) <= INLINE_RULES:
        rule = verdict = None
        for v, r in ordered:
            host, slash, path = r.partition("/")
            fits = fitting(F.lit(host), F.lit(slash + path))
            rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
            verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
        none = F.lit(None).cast("string")
        return pages.withColumns({"rule": none if rule is None else rule, "rule_verdict": none if verdict is None else verdict})
    spark = pages.sparkSession
    table = spark.createDataFrame([(v, r, r.partition("/")[0], "/" + r.partition("/")[2], -len(r)) for v, r in ordered], "verdict string, rule string, rule_host string, rule_path string, rank int")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    found = places.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = found.groupBy("host", "path").agg(F.min(F.struct("rank", "rule", "verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.verdict")}).drop("best")


def strength(groups: DataFrame) -> float:
    """Prior strength from groups of x bad of n pages, each with its parent's mean: one row comes back."""
    p, n, m = F.col("x") / F.col("n"), F.col("n"), F.col("mean")
    within, expected, spread = groups.where("n > 0").agg(F.sum(m * (1 - m)), F.sum(m * (1 - m) * (n - 1)), F.sum(n * (p - m) * (p - m))).first()
    rho = (spread - within) / expected if expected else MOST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, x, n, a, b for every host of outcomes (host, bad 0, 1 or null): bad and labelled pages, and the posterior beta distribution."""
    domain, suffix = domain_of(F.col("host"))
    x, n = F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("x"), F.count("bad").cast("double").alias("n")
    hosts = durable(outcomes.groupBy("host").agg(x, n))
    # Few hosts need few tasks: what follows is then done in one, without a shuffle.
    hosts = hosts.coalesce(max(1, -(-hosts.count() // HOSTS))).withColumns({"domain": domain, "suffix": suffix})
    add = (F.sum("x").alias("x"), F.sum("n").alias("n"))
    bad, seen = hosts.agg(*add).first()
    # The uniform prior above all.
    mean = ((bad or 0.0) + 1) / ((seen or 0.0) + 2)
    rows = hosts.groupBy("suffix").agg(*add).withColumn("mean", F.lit(mean))
    for level, groups in (("suffix", hosts.groupBy("suffix", "domain").agg(*add)), ("domain", hosts)):
        k = F.lit(strength(rows))
        above = rows.select(level, ((F.col("mean") * k + F.col("x")) / (k + F.col("n"))).alias("mean"))
        rows = groups.join(above, level)
    k = F.lit(strength(rows))
    return rows.select("host", "x", "n", (F.col("mean") * k + F.col("x")).alias("a"), ((1 - F.col("mean")) * k + F.col("n") - F.col("x")).alias("b"))


def lower_bound(a: Column, b: Column, z: float) -> Column:
    return a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, host, path, rule, verdict (allow or block)."""
    seen = parsed(pages, id_col, url_col)
    known = reputations(outcomes.select("host", "bad").unionByName(seen.select("host", F.lit(None).cast("int").alias("bad"))))
    method = F.when(lower_bound(F.col("a"), F.col("b"), z) > threshold, "block").otherwise("allow")
    ruled = with_rules(seen, rules)
    return ruled.join(known.select("host", method.alias("method")), "host").select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", "method").alias("verdict"))
