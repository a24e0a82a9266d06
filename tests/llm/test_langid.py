import zlib

import numpy as np
from pyspark.sql import functions as F

from umbral.llm import langid


def test_probabilities_of_each_context_sum_to_at_most_one():
    texts = {"xx": ["abab abba baab"], "yy": ["cdcd dccd"]}
    m = langid.Models(list(texts), texts)
    for context in ("abab", "    ", "zzzz", " dcc"):
        before = [ord(c) for c in context]
        codes = [np.array([*before, c], np.uint64) for c in (32, *range(97, 123))]
        total = sum(np.exp(m.log_p(row)[-1].astype(float)) for row in codes)
        assert (total < 1.0001).all() and (total > 0).all()


def test_seen_text_is_likelier_and_splitting_does_not_matter(monkeypatch):
    texts = {"xx": ["abab abba baab " * 5], "yy": ["cdcd dccd cdd " * 5]}
    m = langid.Models(list(texts), texts)
    mixed = ["abba ab", "cd dc", "ab" * 50, "x", "cdc ab dcd " * 9]
    whole = m.score(mixed)[0]
    assert [m.names[i] for i in whole[:3].argmax(1)] == ["xx", "yy", "xx"]
    assert np.allclose(whole, [m.score([t])[0][0] for t in mixed], atol=1e-4)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.allclose(whole, m.score(mixed)[0], atol=1e-4)


def test_sorted_hash_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    table = langid.Hashed(keys, np.arange(len(keys))[:, None])
    found = table.find(keys)
    assert (table.values[found, 0] == np.arange(len(keys))).all()
    assert (table.find(rng.integers(2**63, 2**64 - 1, 1000, dtype=np.uint64)) == -1).all()


def test_edges(edge_docs, no_docs):
    models = langid.fit(edge_docs, F.lit(True))
    rows = langid.predictions(edge_docs, models, ["doc_id"]).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (0, 1, 2, 3, 7):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert by[8].lang_pred == "en" and 0 <= by[8].score <= 1
    none = langid.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in langid.predictions(edge_docs, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predictions(no_docs, models, ["doc_id"]).count() == 0


def test_held_out_accuracy_and_nothing_clean_rejected(spark, sf):
    from umbral.llm.queries import QUERIES

    label = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op3_language"](spark, sf).collect()
    assert len(rows) == len(label)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == label[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_foreign_symbols_are_rejected(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and then it ran away again " * 3, "en") for i in range(30)], "doc_id long, text string, lang string")
    models = langid.fit(docs, F.lit(True))
    probe = spark.createDataFrame([(1, "qzx xqj zzkq wvx " * 10), (2, "and then the cat sat on the mat again")], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in langid.predictions(probe, models, ["doc_id"]).collect()} == {1: True, 2: False}


def plain_kneser_ney(texts):
    """log p of a character after those before it, by dictionaries and recursion."""
    from collections import Counter, defaultdict

    n_max, seen = langid.ORDER, {n: Counter() for n in range(1, langid.ORDER + 1)}
    for t in texts:
        c = langid.codes_of(t).tolist()
        for i in range(n_max - 1, len(c)):
            for n in seen:
                seen[n][tuple(c[i - n + 1 : i + 1])] += 1
    counts = {n_max: seen[n_max]} | {n: Counter(g[1:] for g in seen[n + 1]) for n in range(1, n_max)}
    total, kinds, discount = defaultdict(int), defaultdict(int), {}
    for n, grams in counts.items():
        once, twice = (sum(v == k for v in grams.values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5
        for g, v in grams.items():
            total[n, g[:-1]] += v
            kinds[n, g[:-1]] += 1

    def p(gram):
        n, context = len(gram), gram[:-1]
        below = p(gram[1:]) if n > 1 else 1 / langid.ALPHABET
        if not total[n, context]:
            return below
        return max(0, counts[n][gram] - discount[n]) / total[n, context] + discount[n] * kinds[n, context] / total[n, context] * below

    return lambda codes, i: np.log(p(tuple(codes[i - n_max + 1 : i + 1])))


def test_models_against_plain_kneser_ney():
    texts = {"aa": ["the cat sat on the mat", "a cat, a mat!", "the the"], "bb": ["das ist ein haus", "das das"]}
    model = langid.Models(list(texts), texts)
    for t in ("the cat is ein mat", "zzz ist", "a"):
        codes = langid.codes_of(t)
        got = model.log_p(codes)
        for k, name in enumerate(model.names):
            plain = plain_kneser_ney(texts[name])
            want = [plain(codes.tolist(), i) for i in range(langid.ORDER - 1, len(codes))]
            assert np.allclose(got[langid.ORDER - 1 :, k], want, atol=1e-5)


def test_ties_and_long_labelled_texts(spark):
    # Two languages of the same texts tie: the first name wins. A language of long texts only is learned too.
    rows = [(i, "one two three four", lang) for i, lang in enumerate(["y", "x"] * 10)] + [(100 + i, "langer text " * 3000, "z") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.names == ["x", "y", "z"]
    assert [r[0] for r in model.predict(["one two", "langer text"])] == ["x", "z"]
    assert len(langid.fit(docs.unionByName(docs).unionByName(docs), F.lit(True)).names) == 3


def test_rejection_of_what_no_language_has_and_of_mixtures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    texts = [r.text for r in docs.where("lang IS NOT NULL AND length(text) > 200").limit(40).collect()]
    mixed = [a[:150] + " " + b[:150] for a, b in zip(texts, texts[1:])]
    assert not any(r[3] for r in model.predict(texts + mixed))
    assert all(r[3] for r in model.predict(["ж" * 50, "xq zvkj wpfx " * 20, "漢字かな" * 30]))
