"""Main-text extraction: a host-wide suffix array over all pages, and a check of what it finds by page structure.

A page is read into blocks of text. The words of all pages of a host, but for the prose of articles, are
concatenated, their suffixes sorted (by prefix doubling), and runs of MIN_RUN words or more that occur
on distinct pages are boilerplate. Every page, of every host, is joined with its runs, and they are
checked against its structure:

* Pages without an article (or main) element: runs are cut, and what is unique stays, but for what lies in
  elements, roles or classes of page furniture.
* Pages with one: the furniture, and all else outside the article, is left out, whether it is repeated or
  unique. In the article, a block in an element of its own that is no prose (a div or list; not a
  paragraph, heading, quotation, table or figure, nor the article's own text) is an unmarked notice or menu,
  and goes, if runs cover all of it, the same block stands in articles of COMMON pages or more and of more
  than half of the host's pages, and other text of the article stays. All other text inside an
  article is never cut, however often it is repeated: copies and quotations are content too.

A host of many words is divided: a suffix goes to the part that the hash of its first MIN_RUN words
names. Repeated runs of that length or more are just the unions of repeated windows of that length, so
the parts together find what one array would. Before that, an array over each batch of pages finds the windows
that repeat there; one occurrence of each stands for all, so that a menu on all pages of a large host
reaches its part once for each batch, not once for each page.

Null and empty pages have the empty text; tags cut off by the end of a page are dropped, like markup.
Rows alike in id, url and html are one page, each with its row. A null url, or one without `://`, has
the empty host, which is a host like any other.
"""

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Words of a run that is boilerplate when distinct pages of a host share it.
MIN_RUN = 8
#: Pages of a host, at least, that a notice inside articles stands on.
COMMON = 3
#: Words of a host that one task sorts.
PART_WORDS = 1_000_000

# What no > ends reaches to the end of the page, so that every attempt at a tag succeeds and a page is read once.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Fixed lists: elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
FURNITURE = frozenset("aside button canvas dialog footer form head header menu nav object select svg template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACE = frozenset("br td th wbr".split()) - {"wbr"}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of classes and ids that name furniture.
NAMES = frozenset("ad ads adbox advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())

#: Elements whose text in an article is prose.
PROSE = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 p pre table".split())

CONTENT, CHROME, UNDECIDED, LOOSE = 0, 1, 2, 3


def furniture(name: str, attributes: str) -> bool:
    if name in FURNITURE:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and (not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)) or value in ("header", "site-header", "page-header")):
            return True
    return False


def blocks(page: str | None, apart: bool = False) -> list[tuple[int, str]]:
    """(CONTENT, CHROME or UNDECIDED, text) of each block of a page, in its order; with `apart`, content that is no prose is LOOSE."""
    out: list[tuple[int, bool, str]] = []
    if not page:
        return []
    # An open element: name, whether furniture, whether article or main. Where elements of each name, and blocks, are in the stack.
    stack: list[tuple[str, bool, int]] = []
    where: dict[str, list[int]] = {}
    open_blocks: list[int] = []
    text: list[str] = []
    chrome = article = main = prose = 0
    any_article = any_main = False

    def flush() -> None:
        words = "".join(text).split()
        text.clear()
        if words:
            loose = apart and not prose and bool(open_blocks) and not stack[open_blocks[-1]][2]
            out.append((-1 if chrome else 2 if article else 1 if main else 0, loose, " ".join(words)))

    def close(i: int) -> None:
        """Closes the elements from the i-th on."""
        nonlocal chrome, article, main, prose
        for name, f, kind in stack[i:]:
            chrome -= f
            article -= kind == 2
            main -= kind == 1
            prose -= name in PROSE
            where[name].pop()
            if name in BLOCK:
                open_blocks.pop()
        del stack[i:]

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            text.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name in SPACE:
            text.append(" ")
        if not m[4]:  # cut off by the end of the page
            break
        if m[1]:
            # The end of a phrase or paragraph ends no element around it.
            inner = name == "p" or name not in BLOCK and name not in FURNITURE
            if where.get(name) and not (inner and open_blocks and open_blocks[-1] > where[name][-1]):
                close(where[name][-1])
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in FURNITURE:
            continue
        f = furniture(name, m[3])
        kind = 2 if name == "article" and not f else 1 if (name == "main" or "main" in m[3] and re.search(r"""\brole\s*=\s*["']?main\b""", m[3], re.I)) and not f else 0
        if name == "p" and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        where.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            open_blocks.append(len(stack))
        stack.append((name, f, kind))
        chrome += f
        article += kind == 2
        main += kind == 1
        prose += name in PROSE
        any_article |= kind == 2 and not chrome
        any_main |= kind == 1 and not chrome
    flush()
    wanted = 2 if any_article else 1 if any_main else 0
    return [(CHROME if where < max(0, wanted) else UNDECIDED if not wanted else LOOSE if loose else CONTENT, t) for where, loose, t in out]


def windows_repeated(ids: np.ndarray, page: np.ndarray, first: np.ndarray, run: int) -> np.ndarray:
    """The places in `first` whose run of words also occurs on another page.

    ids: the words of all streams, one after another; page: the page of each. The suffix array's ranks
    come from prefix doubling, which ends at runs of `run` words: nothing needs the order beyond.
    """
    n = len(ids)
    rank, width = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while width < run:
        step = min(width, run - width)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:] if step < n else []
        rank = np.unique(rank * (n + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    if not len(first):
        return first
    # Suffixes in order: those of one rank share a run and stand together.
    order = first[np.lexsort((page[first], rank[first]))]
    r, p = rank[order], page[order]
    head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    group = np.cumsum(np.concatenate([[0], r[1:] != r[:-1]]))
    several = np.minimum.reduceat(p, head) != np.maximum.reduceat(p, head)
    return np.sort(order[several[group]])


def word_ids(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)).astype(np.int32)


def outside(found: list[tuple[int, str]]) -> list[str]:
    return [w for kind, t in found if kind != CONTENT for w in t.split(" ")]


def block_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def streams(named: DataFrame) -> DataFrame:
    """id, tag, host, n, words, own of each page: what the array reads, and hashes of the blocks of the article that are no prose."""
    kind = named.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(x, True) for x in b.columns[-1].to_pylist()]
            ids = [word_ids(outside(x)) for x in found]
            own = [sorted({block_hash(t) for k, t in x if k == LOOSE}) for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.int64()))], names=["id", "tag", "host", "n", "words", "own"])

    return durable(named.select("id", "tag", "host", "html").mapInArrow(read, f"id {kind}, tag long, host string, n int, words array<int>, own array<long>").dropDuplicates(["id", "tag"]))


def common_blocks(rows: DataFrame) -> DataFrame:
    """host, common: hashes of the blocks in articles that stand on COMMON pages or more, and on more than half of the host's."""
    pages = rows.groupBy("host").agg(F.count("*").alias("pages"))
    found = rows.select("host", F.explode("own").alias("block")).groupBy("host", "block").agg(F.count("*").alias("n"))
    # Fewer than twice as many as a page has on average.
    return found.join(pages, "host").where((F.col("n") >= COMMON) & (2 * F.col("n") > F.col("pages"))).groupBy("host").agg(F.collect_list("block").alias("common"))


def repeated(rows: DataFrame, run: int, part_words: int) -> DataFrame:
    """id, tag, starts: where in the streams of pages repeated runs begin, from what streams() gives."""
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.where(F.col("n") >= run).drop("own")
    hosts = rows.groupBy("host").agg(F.ceil(F.sum(F.col("n").cast("long")) / part_words).cast("int").alias("parts"))
    rows = rows.join(hosts, "host")

    def windows_of(w: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(w, run)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stream as it is to an undivided host; else its windows, each to the part of its hash. Part -1: places that are known to repeat."""
        for b in batches:
            parts, hosts = b.column("parts").to_pylist(), b.column("host").to_pylist()
            words = [np.array(x, np.int32) for x in b.column("words").to_pylist()]
            row, part, starts, sent = [], [], [], []
            send = lambda i, p, s, w: (row.append(i), part.append(int(p)), starts.append(s.astype(np.int32)), sent.append(w))
            divided: dict[str, list[int]] = {}
            for i, (p, host, w) in enumerate(zip(parts, hosts, words, strict=True)):
                if p == 1:
                    send(i, 0, np.arange(len(w) - run + 1), w)
                else:
                    divided.setdefault(host, []).append(i)
            for rows in divided.values():
                lengths = np.array([len(words[i]) for i in rows])
                ids, page, offset = np.concatenate([words[i] for i in rows]), np.repeat(np.arange(len(rows)), lengths), np.cumsum(lengths) - lengths
                first = np.concatenate([o + np.arange(n - run + 1) for o, n in zip(offset, lengths, strict=True)])
                here = np.isin(first, windows_repeated(ids, page, first, run))
                view = windows_of(ids)[first]
                h = (view.astype(np.uint32).astype(np.uint64) * (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, run + 1, dtype=np.uint64))).sum(1)
                once = ~here
                if here.any():  # one of each stands for all
                    at = np.flatnonzero(here)
                    once[at[np.unique(view[at], axis=0, return_index=True)[1]]] = True
                to = ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts[rows[0]])
                for k, i in enumerate(rows):
                    mine = page[first] == k
                    if (known := mine & here).any():
                        send(i, -1, first[known] - offset[k], np.zeros(0, np.int32))
                    for p in np.unique(to[mine & once]):
                        some = mine & once & (to == p)
                        send(i, p, first[some] - offset[k], view[some].ravel())
            take = pa.array(row, pa.int64())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("host").take(take), pa.array(part, pa.int32()), b.column("id").take(take), b.column("tag").take(take), b.column("parts").take(take), pa.array(starts, ints), pa.array(sent, ints)], names=["host", "part", "id", "tag", "parts", "starts", "words"])

    dealt = durable(rows.select("host", "id", "tag", "parts", "words").mapInArrow(deal, f"host string, part int, id {kind}, tag long, parts int, starts array<int>, words array<int>"))

    def sort(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        whole = t.column("parts")[0].as_py() == 1
        starts, words = ([np.array(x, np.int64) for x in t.column(c).to_pylist()] for c in ("starts", "words"))
        ids, page, first, local, at = [], [], [], [], 0
        for i, (s, w) in enumerate(zip(starts, words, strict=True)):
            ids.append(w)
            page.append(np.full(len(w), i))
            first.append(at + (s if whole else np.arange(len(s)) * run))
            local.append(s)
            at += len(w)
        ids, page, first, local = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, page, first, local))
        hit = windows_repeated(ids, page, first, run)
        # Ascending, so the places of one page stand together.
        pages, head = np.unique(page[hit], return_index=True)
        found = np.split(local[np.searchsorted(first, hit)], head[1:]) if len(pages) else []
        take = pa.array(pages, pa.int64())
        return pa.Table.from_arrays([t.column("id").take(take), t.column("tag").take(take), pa.array(found, pa.list_(pa.int32()))], names=["id", "tag", "starts"])

    found = dealt.where("part >= 0").groupBy("host", "part").applyInArrow(sort, f"id {kind}, tag long, starts array<int>")
    found = found.unionByName(dealt.where("part < 0").select("id", "tag", "starts"))
    return found.groupBy("id", "tag").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def joined(texts: list[str]) -> str:
    return "\n\n".join(texts)


def main_text(page: str | None, starts: list[int] | None, common: list[int] | None, run: int) -> tuple[str, int]:
    """The text of a page, and how many words of its stream repeated runs cover."""
    found = blocks(page, True)
    covered = np.zeros(len(outside(found)) + 1, np.int32)
    if starts:
        np.add.at(covered, starts, 1)
        np.add.at(covered, np.array(starts) + run, -1)
    covered = np.cumsum(covered) > 0
    out, at, notices = [], 0, set(common or ())
    for kind, t in found:
        if kind == CONTENT:
            out.append((True, t))
            continue
        words = t.split(" ")
        mine = covered[at : at + len(words)]
        if kind == UNDECIDED:
            hit = np.concatenate([[0], mine, [0]])
            keep = np.ones(len(words), bool)
            for a, b in np.flatnonzero(np.diff(hit)).reshape(-1, 2):
                # What a run has of a block only because it reaches over from the next one stays.
                keep[a:b] = b - a < min(run, len(words))
            out.append((True, " ".join(w for w, k in zip(words, keep, strict=True) if k)))
        elif kind == LOOSE:
            out.append((not (mine.all() and block_hash(t) in notices), t))
        at += len(words)
    kept = [t for stays, t in out if stays and t]
    # An article that would be left empty is a copy.
    return joined(kept or [t for _, t in out if t]), int(covered.sum())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = MIN_RUN, part_words: int = PART_WORDS) -> DataFrame:
    """id_col, url_col, text, n_repeated of each row of pages; n_repeated: words outside the article's prose that runs cover."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.when(F.instr(url, "://") > 0, F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))).otherwise("")
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(url_col, html_col, F.length(html_col)).alias("tag"), host.alias("host"), F.col(html_col).alias("html"))
    kind = named.schema["id"].dataType.simpleString()
    rows = streams(named)
    runs = repeated(rows, run, part_words).select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), "starts")
    both = named.join(runs, named["id"].eqNullSafe(runs["__id"]) & (named["tag"] == runs["__tag"]), "left").join(common_blocks(rows), "host", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(p, s, c, run) for p, s, c in zip(*(b.column(x).to_pylist() for x in ("html", "starts", "common")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["id", "url", "text", "n_repeated"])

    done = both.select("id", "url", "html", "starts", "common").mapInArrow(cut, f"id {kind}, url string, text string, n_repeated long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_repeated")
