import pytest
from pyspark.sql import functions as F

from umbral.llm import urls
from umbral.llm.queries import QUERIES, URL_RULES


def test_host_and_path(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x"), "https://b.com?x/y": ("b.com", ""), "c.com/x": ("", ""), None: ("", ""), "": ("", ""),
        "ftp://h.net#a/b": ("h.net", ""), "://x/y": ("x", "/y"), "http://É.org/a\nb": ("É.org", "/a\nb"), "a://b://c/d": ("b:", "//c/d"), "http://": ("", ""),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id int, url string")
    got = {r.page_id: (r.host, r.path) for r in urls.parsed(df, "page_id", "url").collect()}
    assert list(got[i] for i in range(len(cases))) == list(cases.values())


RULE_CASES = {
    "http://example.org/es/1": "example.org/es/", "http://www.example.org/en/12": "example.org/en/1", "http://www.example.org/en/2": "org/", "http://x.com/fr/": "com/fr/",
    "http://x.com/de/1": "com/de/", "http://x.com/de": None, "http://notorg/": None, "http://org/": "org/", "http://org": None, "http://x.net/fr/": None,
}


@pytest.mark.parametrize("inline", [64, 0])
def test_longest_rule_wins(spark, monkeypatch, inline):
    monkeypatch.setattr(urls, "INLINE_RULES", inline)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(RULE_CASES)], "page_id int, url string")
    found = urls.with_rules(urls.parsed(df, "page_id", "url"), URL_RULES)
    got = {r.page_id: r.rule for r in found.collect()}
    assert [got[i] for i in range(len(RULE_CASES))] == list(RULE_CASES.values())


def outcomes(spark, hosts):
    return spark.createDataFrame([(h, b) for h, bad, good in hosts for b in [1] * bad + [0] * good], "host string, bad int")


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    hosts = [(f"h{i}.site.net", 0, 40) for i in range(20)] + [(f"g{i}.spam.com", 38, 2) for i in range(10)] + [("once.site.net", 1, 0)]
    known = outcomes(spark, hosts)
    pages = spark.createDataFrame([(1, "http://h1.site.net/a"), (2, "http://g1.spam.com/a"), (3, "http://new.spam.com/a"), (4, "http://once.site.net/"), (5, "http://new.site.net/"), (6, None), (2, "http://g1.spam.com/a")], "page_id int, url string")
    got = sorted((r.page_id, r.verdict) for r in urls.judge(pages, known, []).collect())
    assert got == [(1, "allow"), (2, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow")]
    rate = {r.host: r.a / (r.a + r.b) for r in urls.reputations(known.unionByName(spark.createDataFrame([("new.site.net", None)], "host string, bad int"))).collect()}
    assert rate["once.site.net"] < 0.5 and rate["g1.spam.com"] > 0.9
    assert rate["h1.site.net"] < rate["new.site.net"] < rate["once.site.net"]


def test_no_labels_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, bad int")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string")
    assert [r.verdict for r in urls.judge(pages, none, []).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), none, URL_RULES).count() == 0
    (row,) = urls.reputations(spark.createDataFrame([("a.com", None)], "host string, bad int")).collect()
    assert (row.n, row.a) == (0, row.b)


def test_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com",), ("",)], "host string").select(*urls.domain_of(F.col("host")))
    assert [tuple(r) for r in df.collect()] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]


def test_query(spark, sf):
    rows = QUERIES["op5_urls"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    by_rule = {r: v for v, r in URL_RULES}
    assert all(r.verdict == by_rule[r.rule] for r in rows if r.rule)


def test_query_matches_sql(spark, sf, same_rows):
    from umbral.llm.queries import QUERIES, oracle_sql

    same_rows(QUERIES["op5_urls"](spark, sf), oracle_sql()["op5_urls"])
