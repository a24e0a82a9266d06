import random

from umbral.llm import decontam


def answers(found):
    return {r.doc_id: (r.n_words, r.n_hit, len(r.items), r.items) for r in found.collect()}


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def random_texts(seed, n, words, alphabet="abc"):
    rng = random.Random(seed)
    return [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(words))) for _ in range(n)]


def test_against_brute_force_over_a_tiny_alphabet():
    for window in (1, 3, 4):
        items = list(enumerate(random_texts(window, 8, 9)))
        docs = list(enumerate(random_texts(50 + window, 60, 30)))
        want = decontam.brute_force(docs, items, window)
        sam = decontam.SuffixAutomaton([(str(i), decontam.words_of(t.encode())) for i, t in items], window)
        for i, t in docs:
            w = decontam.words_of(t.encode())
            spans, found = sam.stream(w)
            assert (len(w), sum(b - a for a, b in spans), len(found)) == want[i][:3], (window, t)


def test_blocks_of_items_give_what_one_automaton_gives(spark):
    items = frame(spark, list(enumerate(random_texts(1, 12, 9))), "item_id long, text string")
    docs = frame(spark, [*enumerate(random_texts(2, 40, 30)), (3, "a b c a b c a b c"), (3, "a b c a b c a b c")])
    key = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items), tuple(map(tuple, r.hit_spans))) for r in df.collect())
    one = key(decontam.hits(docs, items, window=3))
    assert key(decontam.hits(docs, items, window=3, block_words=20)) == one
    assert len(one) == 42


def test_whole_items_where_shorter_than_the_window(spark):
    items = frame(spark, [(1, "Red, green"), (2, None), (3, "..."), (None, "blue"), (4, "red GREEN blue")], "item_id long, text string")
    docs = frame(spark, [(1, "red-green!"), (2, "green red"), (3, "red green blue"), (4, None)])
    assert answers(decontam.hits(docs, items)) == {1: (2, 2, 1, ["1"]), 2: (2, 0, 0, []), 3: (3, 3, 2, ["1", "4"]), 4: (0, 0, 0, [])}


def test_edges(spark, edge_docs, no_docs):
    items = frame(spark, [(1, "the same text here as there")], "item_id long, text string")
    assert decontam.hits(edge_docs, items).count() == edge_docs.count()
    assert decontam.hits(no_docs, items).count() == 0
    assert decontam.hits(edge_docs, items.limit(0)).where("n_hit > 0").count() == 0
    left = decontam.remove(edge_docs, items)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count() - 2


def test_removal_leaves_the_rest_byte_for_byte(spark):
    words = " ".join(f"w{i}" for i in range(12))
    items = frame(spark, [(1, words)], "item_id long, text string")
    text = f"Kéep this — and\n {words.upper()}!, then more of it, " + "x " * 30
    (row,) = decontam.remove(frame(spark, [(1, text)]), items).collect()
    assert row.text == f"Kéep this — and\n !, then more of it, " + "x " * 30


def test_removal_in_blocks_gives_what_one_automaton_gives(spark):
    one, two = ([f"{c}{i}" for i in range(12)] for c in "ab")
    rest = [f"r{i}" for i in range(16)]
    overlapping = [*one, *two[:6]]
    items = frame(spark, [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(overlapping[6:])), (4, "r0 r2 " * 6)], "item_id long, text string")
    texts = [" ".join(t) for t in ([*rest, *one, "between", *two], [*one, *rest], [*rest, *rest, *overlapping], ["r2", "r0", *one, "r2", *["r0", "r2"] * 3, *rest, *rest])]
    docs = frame(spark, [*enumerate([*texts, *random_texts(4, 30, 30), None, ""])])
    key = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    want = key(decontam.remove(docs, items))
    assert 0 not in dict(want) and dict(want)[2].split() == [*rest, *rest] and dict(want)[3].split()[:4] == ["r2", "r0", "r2", "r0"]
    assert key(decontam.remove(docs, items, block_words=12)) == want
    small = frame(spark, list(enumerate(random_texts(1, 12, 9))), "item_id long, text string")
    assert key(decontam.remove(docs, small, window=3, block_words=20)) == key(decontam.remove(docs, small, window=3))


def test_query_matches_sql(spark, sf, same_rows):
    from umbral.llm.queries import QUERIES, oracle_sql

    same_rows(QUERIES["op1_decontaminate"](spark, sf), oracle_sql()["op1_decontaminate"])
