import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from umbral.llm import bpe


@pytest.fixture(scope="module")
def plain(ranks):
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=ranks[1], mergeable_ranks=bpe.rank_table(ranks[0]), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab'st 09\n\t .é漢 　\x1c\x85٣"), max_size=60), size=st.integers(1, 9))
def test_pieces_do_not_change_ids(plain, text, size):
    assert "".join(bpe.pieces(text, size)) == text
    assert bpe.encode_text(plain, text, size) == plain.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(runs=st.lists(st.tuples(st.sampled_from(["a", "b1", ".", "  ", "漢", "\x1c", "٣"]), st.text(alphabet=st.sampled_from(" \n\t\x85　"), min_size=0, max_size=30)), max_size=6), size=st.integers(2, 9))
def test_long_white_space_is_one_match(plain, runs, size):
    text = "".join(a + b for a, b in runs)
    assert "".join(p for _, p in bpe.parts(text, size)) == text
    assert bpe.encode_text(plain, text, size) == plain.encode_ordinary(text)


@pytest.mark.parametrize("space", [" ", "\n", "　", " \n"])
@pytest.mark.parametrize("after", ["", "x"])
def test_a_million_spaces(plain, space, after):
    import time

    text, began = "word" + space * 1_000_000 + after, time.perf_counter()
    ids = bpe.encode_text(plain, text)
    assert time.perf_counter() - began < 2 * 3
    assert plain.decode_bytes(ids) == text.encode()


def test_round_trip_of_edges(spark, edge_docs, no_docs, ranks, plain):
    both = bpe.round_trip(edge_docs, "text", *ranks)
    rows = both.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.ids == plain.encode_ordinary(r.text or "")
    assert bpe.round_trip(no_docs, "text", *ranks).count() == 0
    apart = bpe.decode(bpe.encode(edge_docs, "text", *ranks), "ids", *ranks)
    assert sorted(bytes(r[0]) for r in apart.select("decoded").collect()) == sorted(bytes(r.decoded) for r in rows)


def test_decoding_ids_that_are_no_text(spark, ranks, plain):
    part = plain.encode_ordinary("漢")[:1]
    df = spark.createDataFrame([(1, part), (2, None), (3, [])], "i int, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, "ids", *ranks).orderBy("i").collect()] == [plain.decode_bytes(part), b"", b""]


def test_query_against_the_library(spark, sf, documents, plain):
    from umbral.llm.queries import QUERIES

    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in QUERIES["op2_bpe"](spark, sf).collect():
        ids = plain.encode_ordinary(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(documents[r.doc_id].encode()))
