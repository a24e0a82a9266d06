import random

import numpy as np
import pytest

from umbral.llm import simhash


def found(df):
    return {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in df.collect()}


def reference_bits(text, seed=42):
    from xxhash import xxh64

    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64(p, seed=seed).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", ["", "one", "One two", "a b c", "a b c a b c a b", "é b \x0bc D", "x " * 500])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text.encode()) == reference_bits(text)
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert simhash.fingerprint(text.encode()) == reference_bits(text)


def test_spark_agrees_on_hashes(spark):
    from pyspark.sql import functions as F

    (h,) = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()
    assert h & (2**64 - 1) == simhash.fingerprint(b"a b c")


def components_of(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {v: min(w for k, w in enumerate(values) if find(k) == find(i)) for i, v in enumerate(values)}


@pytest.mark.parametrize("cell_size", [simhash.CELL, 3000])
def test_links_and_components_of_random_balls(spark, cell_size):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(rng.randrange(12)):
            flipped = centre
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                flipped ^= 1 << b
            values.add(flipped)
            if rng.random() < 0.3:
                centre = flipped
    signed = [v - 2**64 if v >> 63 else v for v in values]
    unique = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(unique, cell_size)).collect()}
    want = components_of([v & (2**64 - 1) for v in sorted(signed)])
    groups = lambda label: sorted(sorted(v for v in signed if label(v) == g) for g in {label(v) for v in signed})
    assert groups(lambda v: root.get(v, v)) == groups(lambda v: want[v & (2**64 - 1)])


def test_every_distance_to_three_is_linked():
    rng = random.Random(1)
    for d in (1, 2, 3, 4):
        for _ in range(60):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), d):
                b ^= 1 << bit
            moved, _ = simhash.meet(np.array(sorted([a, b]), np.uint64), 0, 0, 0, 1)
            assert len(moved) == (d <= 3)


def test_long_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(300)]
    star = [(2000 + i, 1000) for i in range(500)]
    links = spark.createDataFrame(chain + star, "a long, b long")
    root = {r.node: r.root for r in simhash.components(links).collect()}
    assert root == {**{i: 0 for i in range(1, 301)}, **{2000 + i: 1000 for i in range(500)}}


def test_edges(edge_docs, no_docs):
    rows = simhash.clusters(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    zero = [r for r in rows if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {0}
    assert {r.component_id for r in rows if r.doc_id in (100, 101)} == {100}
    assert simhash.clusters(no_docs).count() == 0
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 6, 7, 8, 100]
    assert [r.text for r in kept.where("doc_id IS NULL").collect()] == ["lost"]  # the other is one of the empty texts


def test_rows_of_one_id_and_different_texts_are_told_apart(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, one), (1, two), (1, two), (2, one), (None, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(1, one), (1, two)]


def test_components_that_do_not_settle_are_an_error(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.components(links, max_rounds=2)


def test_query_against_brute_force(spark, sf, documents):
    from umbral.llm.queries import QUERIES

    want = simhash.brute_force(documents)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, sf).collect()} == want
