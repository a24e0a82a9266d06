import random

import pytest

import corpus_pipeline
from umbral.llm import similar


def near_copies(seed=5, groups=12, words=60):
    """Groups of texts of which one to six words differ, a passage that many share, and edge texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, out = [word() for _ in range(40)], [None, "", "one two", "one two three four five"]
    for g in range(groups):
        base = [word() for _ in range(words)] + passage * (g % 2)
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text + [word() for _ in range(rng.randrange(4))]))
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("seed", [5, 6])
def test_every_link_of_four_fifths_is_kept_as_one(spark, seed):
    texts = near_copies(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, r in similar.brute_force(texts).items() if i == r}
    assert len(want) < len(texts)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_stage_against_brute_force(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {i for i, r in similar.brute_force(documents).items() if i == r}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == want


def test_edges(edge_docs, no_docs):
    assert similar.keep_one(edge_docs).columns == edge_docs.columns
    assert similar.keep_one(no_docs).count() == 0


def test_rows_of_one_id_and_rows_without_an_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (1, two), (2, two), (None, one), (None, three), (None, three), (3, None), (None, None)]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, three), (1, one), (1, two), (3, "")]


def test_hashes_in_common(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, 9, sorted(set(rng.integers(-400, 400, 6).tolist()) | ({7} if i % 3 else set()))) for i in range(150)]
    one = spark.createDataFrame(rows, "sid long, n int, prefix array<long>").repartition(5)
    holders = {}
    for i, _, p in rows:
        for h in p:
            holders.setdefault(h, []).append(i)
    want = sorted((h, i, 9, p.index(h)) for i, _, p in rows for h in p if len(holders[h]) > 1)
    for cell in (similar.CELL, 50):
        assert sorted(map(tuple, similar.in_common(one, cell).collect())) == want


def shifted(count=70, words=60):
    """Texts around one base, each with a run of new words: most pairs are near the limit, few are linked."""
    rng = random.Random(3)
    base, out = [f"b{i}" for i in range(words)], []
    for _ in range(count):
        text, at, n = list(base), rng.randrange(words - 6), rng.randrange(1, 7)
        text[at : at + n] = [f"x{rng.randrange(9999)}" for _ in range(n)]
        out.append(" ".join(text))
    return dict(enumerate([*out, None, "", base[0]]))


@pytest.mark.parametrize("block", [similar.BLOCK, 500])
def test_families_in_blocks_give_what_brute_force_gives(spark, block):
    texts = shifted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = similar.durable(similar.sets(docs, "doc_id", "text"))
    root = {r.node: r.root for r in similar.linked(rows, docs, "text", block).collect()}
    found = {r.doc_id: root.get(r.sid, r.sid) for r in rows.collect()}
    want = similar.brute_force(texts)
    assert 1 < len(set(want.values())) < len(texts)
    together = lambda of: {frozenset(i for i in of if of[i] == r) for r in of.values()}
    assert together(found) == together(want)


def test_blocks_and_pairs_give_the_same_links(spark, monkeypatch):
    docs = spark.createDataFrame(list(shifted().items()), "doc_id long, text string")
    kept = {r.doc_id for r in similar.keep_one(docs).collect()}
    real = similar.families
    monkeypatch.setattr(similar, "families", lambda open_, block: real(open_, block).withColumn("dense", similar.F.lit(False)))
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == kept


def test_among_has_every_similar_pair():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = {i - 20: np.unique(np.concatenate([base[rng.random(40) < 0.93], rng.integers(0, 1 << 60, rng.integers(0, 5)).astype(np.uint64)])) for i in range(40)}
    alike = lambda a, b: len(np.intersect1d(a, b)) * 5 >= len(np.union1d(a, b)) * 4
    x, y = ({i: s for i, s in sets.items() if (i % 2 == 0) is even} for even in (True, False))
    for left, right in ((sets, sets), (x, y), (x, {}), ({}, y)):
        want = {(min(i, j), max(i, j)) for i in left for j in right if i != j and alike(sets[i], sets[j])}
        assert set(map(tuple, similar.among(left, right).tolist())) == want


def test_sketches_meet_in_blocks_of_buckets(spark):
    rng = random.Random(8)
    sets = {i - 30: similar.shingle_set(" ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(12, 30))).encode(), 2) for i in range(60)}
    rows = [(h, i, len(s), 0, i % 4) for i, s in sets.items() for h in (1, 2 + i % 3)]
    open_ = spark.createDataFrame(rows, "h long, sid long, n int, at int, root long")
    one = spark.createDataFrame([(i, similar.sketch(s)) for i, s in sets.items()], "sid long, sketch binary")
    may = lambda a, b: min(len(a), len(b)) * 9 >= (len(a) + len(b)) * 4
    bytes_of = lambda s: similar.np.frombuffer(similar.sketch(s), "u1").astype(int)
    close = lambda a, b: similar.np.minimum(bytes_of(a), bytes_of(b)).sum() * 9 >= (len(a) + len(b)) * 4
    want = sorted((i, j) for i in sets for j in sets if i < j and i % 4 != j % 4 and may(sets[i], sets[j]) and close(sets[i], sets[j]))
    assert want
    for block in (similar.BUCKET, 7):
        assert sorted(map(tuple, similar.in_buckets(open_, one, block).distinct().collect())) == want


def test_a_wide_family_of_one_bucket_is_not_copied_to_blocks(spark):
    """The pipeline's disk: 40 sets of 50 hashes in blocks of 100 would travel 20 times each, for 780 pairs."""
    rows = lambda at, count, n, hashes: [(h, at + i, n, 0, at + i, at) for h in range(at, at + hashes) for i in range(count)]
    open_ = spark.createDataFrame([*rows(0, 40, 50, 1), *rows(1000, 40, 2, 1), *rows(2000, 40, 50, 10)], "h long, sid long, n int, at int, root long, main long")
    dense = {r.family: r.dense for r in similar.families(open_, 100).collect()}
    assert dense == {0: False, 1000: True, 2000: True}


@pytest.mark.parametrize("hot", [2, 20, 10**6])
def test_any_split_of_buckets_gives_what_brute_force_gives(spark, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT", hot)
    texts = shifted()
    want = similar.brute_force(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == set(want.values())
