import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbral.llm import lm
from umbral.llm.bpe import rank_table


def test_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    net = lm.Attention(7)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    net.seen = net.seen.astype(np.float64)
    ids, targets = rng.integers(0, 7, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW))
    real = (rng.random((3, lm.WINDOW)) > 0.3).astype(float)

    def loss():
        z = net.forward(ids)[-1]
        p = z - np.log(np.exp(z).sum(2, keepdims=True))
        return -(np.take_along_axis(p, targets[..., None], 2)[..., 0] * real).sum() / real.sum()

    g = net.gradients(ids, targets, real)
    for name, w in net.w.items():
        for at in rng.integers(0, w.size, 4):
            old, step = w.flat[at], 1e-5
            w.flat[at] = old + step
            up = loss()
            w.flat[at] = old - step
            down = loss()
            w.flat[at] = old
            assert abs((up - down) / (2 * step) - g[name].flat[at]) < 1e-4


def test_exp_needs_no_care_only_where_it_cannot_overflow():
    net = lm.Attention(9)
    ids, classes = np.arange(2 * lm.WINDOW).reshape(2, -1) % 9, np.zeros((2, lm.WINDOW), np.int64)
    careful = net.log_p(ids, classes)
    net.bounded()
    assert net.safe and np.allclose(net.log_p(ids, classes), careful, atol=1e-5)
    net.w["qkv"] *= 300
    net.bounded()
    assert not net.safe and np.isfinite(net.log_p(ids, classes)).all()


def test_later_ids_do_not_matter():
    net = lm.Attention(9)
    ids = np.arange(2 * lm.WINDOW).reshape(2, -1) % 9
    other = ids.copy()
    other[:, 10:] = 3
    assert np.allclose(net.forward(ids)[-1][:, :10], net.forward(other)[-1][:, :10], atol=1e-5)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 55, 56, 57, 200])
def test_each_id_is_scored_once(n):
    starts, seq, first = lm.windows(np.array([n, 5]))
    scored = [s + k for s, q, f in zip(starts, seq, first) for k in range(f, lm.WINDOW) if q == 0 and s + k < n]
    assert sorted(scored) == list(range(n))


def test_probabilities_sum_to_one():
    m = lm.Model(20, 19)
    m.fit([[int(x) for x in np.random.default_rng(i).integers(0, 12, 40)] for i in range(20)])
    m.counted(np.arange(20))
    for before in ([], [3], [1, 2, 3] * 20):
        of = lambda seq: m.scores(np.array(seq), np.array([len(seq)]))[0]
        base = of([*before, 5])
        one = [of([*before, i]) for i in range(20)]
        rest = of(before) if before else 0.0
        assert abs(sum(10 ** (x - rest) for x in one) - 1) < 1e-3 and np.isfinite(base)


def learns():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


def run(df, ranks, **more):
    return lm.score(df, learns(), *ranks, size=50_257, end=50_256, **more)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 2])
def test_counts_against_brute_force(spark, ranks, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "ROWS", 5)
    texts = ["the cat THE dog", "a b c a", None, "", "the the the", "new words only here", "x\x00y id 5 words ends", "漢 字 the"]
    df = spark.createDataFrame([(i, t, "k", 1, True) for i, t in enumerate(texts)], "doc_id long, text string, key string, id int, learn boolean")
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in enumerate(texts)]
    want, n, _ = lm.brute_force(rows)
    got = {r.doc_id: r for r in run(df, ranks).collect()}
    for i, (tokens, known, score) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, n)
        assert abs(got[i].base_score - score) < 1e-9 and got[i].score < 0


def test_edges(spark, edge_docs, no_docs, ranks):
    rows = run(edge_docs, ranks).collect()
    assert len(rows) == edge_docs.count()
    same = [r for r in rows if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]
    assert run(no_docs, ranks).count() == 0
    untaught = lm.score(edge_docs, F.lit(False), *ranks, size=50_257, end=50_256).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untaught} == {(0, 0, 0.0)}


def test_query_beats_subword_frequencies_on_held_out_text(spark, sf, documents, ranks):
    from umbral.llm.queries import QUERIES

    rows = QUERIES["op7_lm"](spark, sf).collect()
    want, n, _ = lm.brute_force([(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in documents.items()])
    for r in rows:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and abs(r.base_score - want[r.doc_id][2]) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    v = lm.Vocabulary([b"the"], 50_256, *ranks)
    seq = {i: v.ids(w, v.places(w))[0].tolist() for i, w in ((i, [*lm.words_of(t.encode()), None]) for i, t in documents.items())}
    counts = np.bincount([x for r in rows if not r.held_out for x in seq[r.doc_id]], minlength=50_257) + 1.0
    p = np.log10(counts / counts.sum())
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(p[seq[r.doc_id]].sum() for r in held)
    assert len(rank_table(ranks[0])) == 50_256


def test_windows_at_once_have_no_effect_and_stay_small(monkeypatch):
    m = lm.Model(20, 19)
    m.fit([[int(x) for x in np.random.default_rng(i).integers(0, 12, 40)] for i in range(20)])
    follow, lengths = np.random.default_rng(1).integers(0, 19, 5000), np.array([4000, 1, 999])
    assert lm.CHUNK * lm.WINDOW * lm.CLASSES * 4 < 1 << 18
    want = m.scores(follow, lengths)
    monkeypatch.setattr(lm, "CHUNK", 512)
    assert np.allclose(m.scores(follow, lengths), want, rtol=1e-6)


def test_long_documents_teach_the_weights_and_partitions_do_not_matter(spark, ranks):
    """No sample held texts of over 20 000 characters; their order of words, with all counts alike, changes what is learned."""
    words = [f"{a}{b}" for a in ("red", "blue", "old", "new") for b in ("cat", "dog", "house", "tree")]
    short = [(i, " ".join(words[(i * k) % 16] for k in range(30))) for i in range(12)]
    long = " ".join(words * 400)
    assert len(long) > lm.SAMPLE_CHARS

    def scores(text, parts):
        df = spark.createDataFrame([*short, (99, text)], "doc_id long, text string").repartition(parts)
        rows = lm.score(df, F.col("doc_id") != 3, *ranks, size=50_257, end=50_256).collect()
        return {r.doc_id: r.score for r in rows}, {r.doc_id: r.base_score for r in rows}

    one, base = scores(long, 1)
    other, same = scores(" ".join(sorted(long.split())), 1)
    assert abs(base[3] - same[3]) < 1e-9 and abs(one[3] - other[3]) > 1e-3
    again = scores(long, 4)[0]
    assert all(abs(again[i] - one[i]) < 1e-3 for i in one)


def test_neighbours_do_not_reach_over_an_end():
    a, b = np.array([1, 2, 9]), np.array([3, 9])
    seen, count, f = lm.neighbours(np.concatenate([a, b]), np.array([3, 2]), 9)
    assert seen.tolist() == [1, 2, 3, 9] and count.tolist() == [1, 1, 1, 2]
    parts = [lm.neighbours(x, np.array([len(x)]), 9) for x in (a, b)]
    assert all((f[seen == i][0] == sum((p[2][p[0] == i].sum(0) for p in parts))).all() for i in seen)


def test_a_step_learns_as_the_mean_gradient_says():
    """fit() sums by places and chunks what gradients() gives of a whole batch; the first step of Adam goes by signs."""
    rng = np.random.default_rng(3)
    ids, targets = rng.integers(0, 9, (70, lm.WINDOW)), rng.integers(0, lm.CLASSES, (70, lm.WINDOW))
    real = (rng.random(ids.shape) > 0.3).astype(np.float32)
    net, other = lm.Attention(9), lm.Attention(9)
    g = other.gradients(ids, targets, real)
    net.fit(ids, targets, real, epochs=1)
    for n, w in net.w.items():
        sure = np.abs(g[n]) > 1e-5
        assert np.allclose((w - other.w[n])[sure], -lm.RATE * np.sign(g[n])[sure], rtol=0.05)


def test_sums_by_row_against_add_at():
    rng = np.random.default_rng(4)
    for size in (5, 70_000):
        rows, values = rng.integers(0, size, 900), rng.random((900, 3))
        got, want = np.ones((size, 3)), np.ones((size, 3))
        lm.summed(got, rows, values)
        np.add.at(want, rows, values)
        assert np.allclose(got, want)


def test_words_that_are_encoded_together(ranks, documents):
    encode = lm.encoding(*ranks).encode_ordinary
    of_texts = sorted({w for t in documents.values() for w in lm.words_of((t or "").encode())})
    odd = ["'s", "it's", "'", "a\xa0", "\xa0b", "\xa0 ".strip(" "), "\x85", "x\x1c", "\u3000y", "1a2", "...", "漢字", "\U0001f600", "a" * 300, "\x00", "it", "'ll"]
    for words in (of_texts, [w.encode() for w in odd], [w.encode() for w in odd if w.isprintable()], [b"\xff\xfe", b"ab"], []):
        flat, length = lm.Vocabulary([], 50_256, *ranks).encoded(words)
        assert [x.tolist() for x in np.split(flat, np.cumsum(length))][:-1] == [encode(" " + w.decode("utf-8", "replace")) for w in words]


@pytest.mark.parametrize("far", [0.0, -300.0, 300.0])
def test_gradients_are_finite_where_logits_are_far(far):
    net = lm.Attention(9)
    net.w["b"] += np.float32(far)
    ids = np.arange(2 * lm.WINDOW).reshape(2, -1) % 9
    found = [net.gradients(ids, ids % lm.CLASSES, np.ones(ids.shape, np.float32)), {"p": net.log_p(ids, ids)}]
    plain_net = lm.Attention(9)
    want = [plain_net.gradients(ids, ids % lm.CLASSES, np.ones(ids.shape, np.float32)), {"p": plain_net.log_p(ids, ids)}]
    for f, w in zip(found, want):
        assert all(np.allclose(f[n], w[n], atol=1e-4) for n in w)


def test_texts_are_read_three_times_only(spark, ranks):
    """Once to count, once for the sample, once for all else: words, ids, neighbours, gradients and scores."""
    df = spark.createDataFrame([(i, f"some text number {i}") for i in range(20)], "doc_id long, text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    assert run(df.mapInArrow(counted, df.schema), ranks).count() == 20
    assert read.value <= 3 * 20


def test_reader_gives_words_and_ids_of_texts(ranks, documents, monkeypatch):
    odd = [b"", b" ", b"  a B\tb ", b"\xff\xfe X\x1cy\x0bz\x85", "\u00c9t\u00e9 \u3000x \xa0".encode(), b"a a a", b"new new old"]
    texts = [*((t or "").encode() for t in documents.values()), *odd]
    v = lm.Vocabulary([b"the", b"a", b"of"], 50_256, *ranks)
    monkeypatch.setattr(lm, "MET", 50)
    monkeypatch.setattr(lm, "READ", 10_000)
    whole, reader = pa.array([b"before", *texts], pa.binary()).slice(1), lm.Reader(v)
    at = 0
    for start, m in lm.slices(whole):
        assert start == at
        at += m
        ids, n_ids, places, n, rare, which = reader.read(whole.slice(start, m))
        words = [lm.words_of(t) for t in texts[start : start + m]]
        flat = [w for x in words for w in x]
        assert n.tolist() == [len(x) for x in words] and places.tolist() == v.places(flat).tolist()
        assert [rare[i] for i in which] == [w for w in flat if w not in v.number]
        want = [v.ids(x, v.places(x))[0].tolist() for x in ([*x, None] for x in words)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n_ids))][:-1] == want
    assert at == len(texts)


def test_places_before_the_first_need_no_scores():
    net = lm.Attention(9)
    ids, classes = np.arange(3 * lm.WINDOW).reshape(3, -1) % 9, np.arange(3 * lm.WINDOW).reshape(3, -1) % 40
    for safe in (False, True):
        net.safe = safe
        assert np.allclose(net.log_p(ids, classes)[:, 8:], net.log_p(ids, classes[:, 8:], 8), atol=1e-6)


@pytest.mark.parametrize(("most", "size"), [(0, 2), (32_767, 2), (32_768, 4), (2_000_000_000, 4)])
def test_words_of_documents_are_packed_small(most, size):
    x = np.array([[0, most], [1, 2], [-most, 3]])
    assert len(lm.packed_small(x)) == 1 + size * x.size and (lm.unpacked(lm.packed_small(x)) == x).all()
