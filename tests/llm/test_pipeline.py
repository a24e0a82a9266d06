import pytest

import corpus_pipeline
from umbral.llm import bpe, decontam, similar


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """What each stage of the pipeline returned."""
    docs, out, folder = spark.read.parquet(f"{sf}/documents.parquet"), {}, tmp_path_factory.mktemp("stages")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(kept[n].dtypes == kept["documents"].dtypes for n in names[:-1])


def test_language_id_keeps_clean_documents(kept):
    before, after = texts(kept["documents"]), texts(kept["language_id"])
    assert set(after) <= set(before) and len(after) > 0.98 * len(before)


def test_one_of_each_group_stays(kept):
    before = texts(kept["language_id"])
    want = {i for i, c in similar.brute_force(before).items() if i == c}  # five words, a similarity of 0.8 or more
    assert set(texts(kept["near_dedup"])) == want


def test_benchmark_passages_are_gone(spark, sf, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = texts(kept["near_dedup"]), texts(kept["decontaminate"])
    hit = {i: v for i, v in decontam.brute_force(list(before.items()), items).items() if v[1]}
    assert hit
    assert all(before[i] == after[i] for i in before if i not in hit)
    assert all(i not in after or after[i] != before[i] for i in hit)
    assert not any(v[1] for v in decontam.brute_force([(i, after[i]) for i in hit if i in after], items).values())


def test_secrets_are_masked_and_ids_are_those_of_the_text(kept, ranks):
    import tiktoken

    before, after = texts(kept["decontaminate"]), texts(kept["scan_secrets"])
    assert set(before) == set(after)
    changed = {i for i in before if before[i] != after[i]}
    assert all("[SECRET]" in after[i] for i in changed)
    plain = tiktoken.Encoding("plain", pat_str=ranks[1], mergeable_ranks=bpe.rank_table(ranks[0]), special_tokens={})
    rows = kept["tokenize"].collect()
    assert len(rows) == len(after)
    assert all(r.ids == plain.encode_ordinary(after[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_run_returns_the_last_stage(spark, sf, kept):
    rows = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, rows.collect())) == sorted(map(str, kept["tokenize"].collect()))


def test_stages_take_empty_tables(spark, sf, kept):
    none = kept["documents"].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_stages_take_null_and_repeated_ids_and_more_columns(spark, sf, edge_docs):
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokenize":
            assert out.columns == edge_docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept <= {(r.doc_id, r.text) for r in edge_docs.collect()} and (8, "one two") in kept and (101, "the same text here as there") not in kept
    assert out.count() == docs.count()
