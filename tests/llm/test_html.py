import html as entities
import re

import numpy as np
import pytest

from umbral.llm import html


def text_of(page):
    return html.joined([t for k, t in html.blocks(page) if k == html.CONTENT])


CASES = {
    "<article><h1>T &amp; U</h1><p>a <b>b<br>c<p>d</article><footer>f</footer>": "T & U\n\na b c\n\nd",
    "<nav>n</nav><article>x<aside>s</aside> y<form>f</form><script>var t='</p>';</script>z</article>": "x\n\ny\n\nz",
    "<article><p>one</p><div class='ad-box'>buy</div><p>two</p><section id=comments><p>me too</p></section></article>": "one\n\ntwo",
    "<article><p>cut &am": "cut &am",
    "<article><p>cut off <a hre": "cut off",
    "<article><p>a<!-- <p>no</p> -->b</p><style>p{}</style></article>": "ab",
    "<main><p>in main</p></main><p>out</p>": "in main",
    "<div role='main'><p>m</p></div><div>o</div>": "m",
    "<article><p title=\"a>b\">q &#8212; &nbsp; r\t\n s</p></article>": "q — r s",
    "<article><p>un<b>closed <div class=newsletter>sub<p>scribe</article>after": "unclosed",
    "<article><ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table></article>": "1\n\n2\n\na b\n\nc",
    "<ARTICLE><P>Caps</P></ARTICLE>": "Caps",
    "<article><p>x</p></article><article class='comment'><p>reader</p></article><article><p>y</p></article>": "x\n\ny",
    "<article><header><h2>site</h2></header><p>b</p><p hidden>h</p></article>": "b",
    "<article>5 < 6 and 7 > 2</article>": "5 < 6 and 7 > 2",
    "<article><script>never ends": "",
    "": "",
    None: "",
}


@pytest.mark.parametrize("page", CASES)
def test_structure(page):
    assert text_of(page) == CASES[page]


@pytest.mark.parametrize("part", ["<a ", "<! ", "</script ", '<a =">"', "<span>", "</div>", "<p>", "<b><div>", "&amp;", '="'])
@pytest.mark.parametrize("before", ["", "<script>", "<span>" * 20000, "<b><div>"])
def test_long_pages_are_read_in_linear_time(part, before):
    import time

    began = time.perf_counter()
    html.blocks(before + part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 2 * 3


def brute_windows(streams, run):
    where = {}
    for i, w in enumerate(streams):
        for s in range(len(w) - run + 1):
            where.setdefault(tuple(w[s : s + run]), set()).add(i)
    return [[s for s in range(len(w) - run + 1) if len(where[tuple(w[s : s + run])]) > 1] for w in streams]


def test_suffix_ranks_against_brute_force():
    rng = np.random.default_rng(0)
    for run in (1, 2, 3, 5, 8):
        streams = [rng.integers(0, 3, rng.integers(0, 40)) for _ in range(6)]
        page = np.concatenate([np.full(len(s), i) for i, s in enumerate(streams)])
        at = np.cumsum([0, *map(len, streams)])
        first = np.concatenate([np.arange(a, a + max(0, len(s) - run + 1)) for a, s in zip(at, streams)]).astype(np.int64)
        hit = html.windows_repeated(np.concatenate(streams), page, first, run)
        assert [sorted(h - at[i] for h in hit if page[h] == i) for i in range(6)] == brute_windows([s.tolist() for s in streams], run)


def pages():
    menu = "<div>Home About Contact Us Log In Register Now Today</div>"
    body = "<div>unique words number {0} {1} here and there for page {0}</div><p>copyright this and that all rights reserved by us</p>"
    rows = [(i, f"http://h.com/{i}", "<body>" + menu + body.format(i, i * 7) + "</body>") for i in range(5)]
    rows += [(0, "http://h.com/0", rows[0][2]), (20, "http://alone.com/", menu), (21, None, menu), (22, "no scheme", ""), (None, "http://h.com/n", None), (23, "http://h.com/23", f"<article><p>kept</p></article>{menu}")]
    return rows


def test_a_menu_on_all_pages_of_a_divided_host(spark):
    menu = "<div>Home About Contact Us Log In Register Now Today</div>"
    df = spark.createDataFrame([(i, "http://h.com/", f"{menu}<p>text {i} of this page</p>") for i in range(300)], "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html.extract(df, part_words=40).collect()}
    assert got == {i: f"text {i} of this page" for i in range(300)}


@pytest.mark.parametrize("part_words", [html.PART_WORDS, 12])
def test_repeated_runs_leave_pages_without_article(spark, part_words):
    df = spark.createDataFrame([(*r, 1, "x") for r in pages()], "page_id long, url string, html string, tag int, host string")
    got = sorted((str(r.page_id), r.text) for r in html.extract(df, part_words=part_words).collect())
    want = [(str(i), f"unique words number {i} {i * 7} here and there for page {i}") for i in (0, 0, 1, 2, 3, 4)]
    want += [("20", "Home About Contact Us Log In Register Now Today"), ("21", "Home About Contact Us Log In Register Now Today"), ("22", ""), ("None", ""), ("23", "kept")]
    assert got == sorted(want)
    assert html.extract(df.limit(0)).count() == 0


def test_query_against_a_plain_reading(spark, sf):
    from umbral.llm.queries import QUERIES

    page = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_html"](spark, sf).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page[r.page_id], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>|<[a-z/][^>]*\Z", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(filter(None, parts)) and r.n_chars == len(r.text)


@pytest.mark.parametrize("part_words", [html.PART_WORDS, 12])
def test_the_array_reads_pages_with_articles_too(spark, part_words):
    """All pages have an article: an unmarked notice in most of them goes; copies, prose, and what few pages share stay."""
    notice = "<div>sign up now for the letter of this fine house</div>"
    prose = "<p>one passage of many words that all pages quote from others</p>"
    few = "<div>a list of many words that only two of the pages share</div>"
    menu = "<div>Home About Contact Us Log In Register Now Today</div>"
    rows = [(i, "http://h.com/", f"{menu}<article><p>text {i}</p>{notice if i < 4 else ''}{prose}{few if i < 2 else ''}</article>") for i in range(6)]
    rows += [(10 + i, "http://copies.com/", f"<article>{notice}</article>") for i in range(4)]
    rows += [(20 + i, "http://two.com/", f"<article><p>x</p>{notice}</article>") for i in range(2)]
    bare = lambda x: re.sub("<[^>]*>", "", x)
    got = {r.page_id: (r.text, r.n_repeated) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), part_words=part_words).collect()}
    want = {i: (html.joined([f"text {i}", bare(prose), *[bare(few)] * (i < 2)]), 9 + 10 * (i < 4) + 12 * (i < 2)) for i in range(6)}
    want |= {10 + i: (bare(notice), 10) for i in range(4)} | {20 + i: (html.joined(["x", bare(notice)]), 10) for i in range(2)}
    assert got == want
