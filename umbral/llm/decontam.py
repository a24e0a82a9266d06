"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

A-Z are lower-cased and words are runs of ASCII letters and digits and all non-ASCII characters.
The words of every document stream through the automaton, which keeps the length of the
longest suffix read so far that occurs in an item. A window is `window` consecutive words of an
item, or the whole of a shorter item; each place where the match reaches a window marks its words.

The items are read in blocks of bounded size, one automaton each, so what is sent to the executors
is bounded however large the benchmark is; documents pass over each block in turn. Longer items are divided
among blocks, with every window whole in one of them.

Null texts and texts without words have no words and are never hit. Items without words have no
window. Rows that share an item id count as one item; items with a null id are ignored. Repeated
documents are judged each for itself. Empty tables are allowed.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, rebuilt

#: Words of the items that one automaton holds.
BLOCK_WORDS = 400_000

#: Every byte that is no part of a word becomes a space; A-Z become a-z.
FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items each state's windows belong to."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state, item, length of the short item or 0
        self.names: list = []
        number: dict = {}
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            if name not in number:
                number[name] = len(self.names)
                self.names.append(name)
            self.shortest = min(self.shortest, len(words))
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.append((last, number[name], 0))
            if len(words) < window:
                ends[-1] = (last, number[name], len(words))
        self._windows(ends)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _windows(self, ends: list[tuple[int, int, int]]) -> None:
        """at[state]: the ancestor whose strings include the suffix of `window` words; full[state]: the
        (length, item) of short items that end here; items[state]: those in which its strings occur."""
        n, w = len(self.length), self.window
        items: list[set[int]] = [set() for _ in range(n)]
        short: list[tuple] = [()] * n
        for state, item, whole in ends:
            if whole:
                short[state] = (*short[state], (whole, item))
            else:
                items[state].add(item)
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in reversed(order):
            if self.link[v] > 0 and self.length[self.link[v]] >= w:  # shorter strings are no windows
                items[self.link[v]] |= items[v]
        self.at, self.full = [0] * n, [()] * n
        for v in order:
            up = self.link[v]
            if self.length[v] >= w:
                self.at[v] = v if self.length[up] < w else self.at[up]
            self.full[v] = (*self.full[up], *short[v])
        self.items = [frozenset(x) for x in items]

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit spans [start, end) of words, merged and in order, and the items with windows there."""
        ids = np.fromiter(map(self.vocabulary.get, words, _minus), np.int64, len(words))
        # A word that no item has sends the automaton back to its start; only runs of other words
        # as long as the shortest window can hold one.
        known = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]])))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in known.reshape(-1, 2):
            if b - a >= self.shortest:
                self._run(ids[a:b].tolist(), int(a), spans, found)
        return spans, found

    def _run(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        nxt, link, length, w = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, c in enumerate(ids, at + 1):
            while c not in nxt[state] and state:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state, matched = nxt[state][c], matched + 1
            if matched >= w:
                found |= self.items[self.at[state]]
                _mark(spans, i - w, i)
            for whole, item in self.full[state]:
                if whole <= matched:
                    found.add(item)
                    _mark(spans, i - whole, i)


class _Minus:
    """An endless supply of -1, for words that the vocabulary lacks."""

    def __iter__(self):
        return self

    def __next__(self):
        return -1


_minus = _Minus()


def _mark(spans: list[tuple[int, int]], a: int, b: int) -> None:
    while spans and spans[-1][1] >= a:
        a, b = min(a, spans[-1][0]), max(b, spans[-1][1])
        spans.pop()
    spans.append((a, b))


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of items; the driver holds one block at a time."""
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for r in benchmark.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).cast("binary")).toLocalIterator():
        words = words_of(r[1])
        # An item longer than a block is divided; its parts overlap so that each window lies in one of them.
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + step + window - 1]
            if block and size + len(part) > block_words:
                yield SuffixAutomaton(block, window)
                block, size = [], 0
            block.append((str(r[0]), part))
            size += len(part)
    yield SuffixAutomaton(block, window)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs: id_col, n_words, hit_spans (start and end words), n_hit, items (ids as strings, sorted)."""
    kind = docs.select(id_col).schema[0].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("__tag", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hit_spans", span), T.StructField("items", T.ArrayType(T.StringType()))])
    tag = F.xxhash64(F.col(text_col), F.length(text_col))
    spans_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def over(automaton: SuffixAutomaton) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(plain(automaton))  # bounded by block_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam = rebuilt(shared.value, SuffixAutomaton)
            for b in batches:
                n, spans, items = [], [], []
                for text in b.column(2):
                    words = words_of(text.as_py())
                    s, found = sam.stream(words)
                    n.append(len(words))
                    spans.append([{"start": x, "end": y} for x, y in s])
                    items.append(sorted(sam.names[i] for i in found))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(spans, spans_of), pa.array(items, pa.list_(pa.string()))], names=schema.names)

        return docs.select(F.col(id_col), tag.alias("__tag"), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)

    parts = [over(a) for a in automata(benchmark, item_id, item_text, window, block_words)]
    found = parts[0]
    if len(parts) > 1:
        # Rows of one id and text differ in nothing that is returned: they meet, and part again.
        for p in parts[1:]:
            found = found.unionByName(p)
        times = (F.count("*") / len(parts)).cast("long")
        found = found.groupBy(id_col, "__tag", "n_words").agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), times.alias("__times"))
        found = found.withColumn("hit_spans", merged(F.col("hit_spans"))).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    found = found.select(id_col, "n_words", "hit_spans", "items")
    total = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumn("n_hit", total)


def merged(spans):
    """Spans sorted, with those that touch or overlap made one."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def digest(items) -> object:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and what stands between words of one span)."""
    folded = text.translate(FOLD)
    at, offsets = 0, []
    for w in words_of(text):
        at = folded.index(w, at)
        offsets.append((at, at + len(w)))
        at += len(w)
    out, begin = [], 0
    for a, b in spans:
        out.append(text[begin : offsets[a][0]])
        begin = offsets[b - 1][1]
    out.append(text[begin:])
    return b"".join(out)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the spans that benchmark items share with them; a document of which the hits of all items cover more than max_coverage goes as a whole.

    Every block streams over the original text. What it hits is merged with what blocks before it hit; after the last one,
    coverage is judged and the spans are cut out. All columns stay. Untouched texts stay as they are, byte for byte.
    """
    order = docs.columns
    rest = [F.col(f"`{c}`") for c in order if c != text_col]
    spans_of = pa.list_(pa.int64())
    # Start, end, start, end, ... of the hit spans so far, in the last column.
    docs = docs.select(*rest, F.col(text_col).cast("binary").alias(text_col), F.array().cast("array<long>").alias("__spans"))
    raw, text_at = docs.schema, len(order) - 1
    done = T.StructType([*raw.fields[:text_at], T.StructField(text_col, T.StringType())])

    def finished(b: pa.RecordBatch, hits: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts, keep = [], []
        for x, spans in zip(b.columns[text_at], hits, strict=True):
            text = x.as_py()
            keep.append(not spans or sum(e - a for a, e in spans) <= max_coverage * len(words_of(text)))
            texts.append(cut(text, spans) if spans and keep[-1] else text)
        return pa.RecordBatch.from_arrays([*b.columns[:text_at], pa.array(texts, pa.binary()).cast(pa.string())], names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    def passed(automaton: SuffixAutomaton, last: bool):
        shared = docs.sparkSession.sparkContext.broadcast(plain(automaton))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam = rebuilt(shared.value, SuffixAutomaton)
            for b in batches:
                hits = []
                for x, before in zip(b.columns[text_at], b.columns[text_at + 1].to_pylist(), strict=True):
                    spans: list[tuple[int, int]] = []
                    for s in sorted([*zip(before[::2], before[1::2], strict=True), *sam.stream(words_of(x.as_py()))[0]]):
                        _mark(spans, *s)
                    hits.append(spans)
                if last:
                    yield finished(b, hits)
                else:
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([[end for s in spans for end in s] for spans in hits], spans_of)], names=b.schema.names)

        return run

    # The pass of the last block also judges and cuts, so that one block is one pass.
    blocks = automata(benchmark, item_id, item_text, window, block_words)
    now, after = next(blocks), next(blocks, None)
    while after is not None:
        docs = docs.mapInArrow(passed(now, False), raw)
        now, after = after, next(blocks, None)
    return docs.mapInArrow(passed(now, True), done).select(*[f"`{c}`" for c in order])


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], window: int = 10) -> dict:
    """The same by trying every window at every place; for tests."""
    split = lambda t: words_of(t.encode() if t is not None else None)
    windows = []
    for name, text in items:
        w = split(text)
        windows += [(str(name), w[i : i + min(window, len(w))]) for i in range(max(1, len(w) - window + 1)) if w]
    out = {}
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for name, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(name)
        ids = ",".join(sorted(found))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest())
    return out
