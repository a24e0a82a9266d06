import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="session")
def documents(spark, sf):
    """doc_id -> text of the smallest documents table."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


#: Texts that any operator must take: null, empty, white space, no letters, long, wide characters.
EDGE = [None, "", "  \n\t ", "12345 !!!", "a" * 3000, "word " * 2000, "été ÀÉ 漢字 \U0001f600 x", "\x1c\x85\xa0", "one two"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts, rows repeated, null ids, and extra columns whose names operators might use themselves."""
    rows = [(i, t) for i, t in enumerate(EDGE)]
    rows += [(4, "a" * 3000), (None, "lost"), (None, None), (100, "the same text here as there"), (101, "the same text here as there")]
    full = [(i, t, None if i is None else "en", f"s{(i or 0) % 2}", len(t or ""), 1, "k", 0.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars int, id int, key string, score double")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
