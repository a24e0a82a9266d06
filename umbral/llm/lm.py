"""Language-model scoring: word counts of the whole corpus, and causal self-attention on subword ids.

Tokens are the words of a text, A-Z lower-cased, and one end. The base score is add-one smoothed: the
sum of log10((c + 1) / (N + V + 1)).

The model reads each word as the subword ids that a public rank file gives it after a space, and then
the end. One layer of causal self-attention, trained in numpy, predicts the next id's class from the
ids before it in a window of WINDOW; p(id) = p(class | window) * p(id | class). Windows overlap by
OVERLAP ids and every id is scored once. Everything is learned from all learning documents: the counts of the
base score and behind p(id | class), the neighbours that the classes come from, and the attention weights. A sample (at
most SAMPLE_ROWS learning documents of at most SAMPLE_CHARS characters, the first FIT_IDS ids of them) only gives
the weights a start. From there all learning documents, dealt by hash into shards of about SHARD, are learned from
in whole, shard by shard; each id's embedding becomes the mean of those of the shards, weighted by how often
they have it, and each other weight the mean weighted by ids. Shards and their order do not depend on partitions.

Texts are read as words and ids once; what is kept of a document is its ids and the numbers of its frequent words. Words
that are frequent in the sample (at most FREQUENT of them, so their table has a bounded size) are summed inside tasks.
All others go, packed with the places of their documents, to the part of their hash, where each is counted and from
where sums go back to the documents. Which words count as frequent has no effect on results.

A null text is the empty one: just an end. Repeated rows count, and are scored, each for itself. With no
learning documents all counts are 0 and the model is uniform. Empty tables are allowed.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoding
from .common import durable, give_back, plain, rebuilt

WINDOW, OVERLAP = 32, 8
WIDTH, CLASSES = 16, 48
SAMPLE_ROWS, SAMPLE_CHARS, FIT_IDS = 3_000, 20_000, 400_000
FREQUENT = 100_000
#: Learning documents of a shard, and ids that are averaged by one task.
SHARD, IDS = 2048, 1024
#: Bins of neighbours that classes are told apart by, on each side.
BINS = 64
EPOCHS, BATCH, RATE = 4, 256, 6e-3
#: Windows and documents that are scored at once; so few windows that what they need stays in a core's cache. No effect on results.
CHUNK, DOCUMENTS = 32, 128
#: Windows whose gradients are found at once. No effect on results but by rounding.
LEARNED = 128
#: Bytes of text that are read at once, and words a task remembers the ids of beside the frequent ones. No effect on results.
READ, MET = 4 << 20, 200_000
#: Rows of words that a task holds before it sends them, and bytes of text for each part that words are dealt to.
ROWS, PART = 50_000, 16 << 20
#: Scores and logits up to this need no maximum taken off before exp in 32 bits.
SAFE = 40.0
#: Words that are encoded as one text. No effect on results.
JOINED = 1_000

DOCUMENT, RARE, WORD, NEAR = 0, 1, 2, 3


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class Vocabulary:
    """Frequent words, numbered, with the subword ids of each in one array; the end is the last. Other words are encoded as they come."""

    def __init__(self, words: list[bytes], end: int, path: str, pattern: str):
        self.words, self.path, self.pattern = words, path, pattern
        self.opens: np.ndarray | None = None
        self.number: dict[bytes | None, int] = {w: i for i, w in enumerate(words)}
        self.number[None] = len(words)
        flat, self.length = self.encoded(words)
        self.opens = None
        self.flat, self.length = np.append(flat, end).astype(np.int32), np.append(self.length, 1)
        self.offset = np.cumsum(self.length) - self.length

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        encoder = encoding(self.path, self.pattern)
        encode = encoder.encode_ordinary
        if self.opens is None:  # ids that begin with a space
            found = encoder.token_byte_values()
            self.opens = np.zeros(1 + max(map(encoder.encode_single_token, found)), bool)
            self.opens[[encoder.encode_single_token(t) for t in found if t[:1] == b" "]] = True
        flat, length = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), JOINED):
            some = [" " + w.decode("utf-8", "replace") for w in words[at : at + JOINED]]
            text = "".join(some)
            # With no white space but the one before each word, no match reaches from word to word, and a space opens each.
            ids = np.array(encode(text), np.int32) if text.isprintable() else flat[0]
            head = np.flatnonzero(self.opens[ids])
            if len(head) == len(some) and not head[0]:
                n = np.diff(np.append(head, len(ids)))
            else:
                found = list(map(encode, some))
                ids, n = np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))
            flat.append(ids)
            length.append(n)
        return np.concatenate(flat), np.concatenate(length)

    def places(self, words: list[bytes | None]) -> np.ndarray:
        """Numbers of words; -1 for those that are not frequent."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, words: list[bytes | None], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rare = np.flatnonzero(places < 0)
        flat, length = self.encoded([words[i] for i in rare])
        offset, n = self.offset[places], self.length[places]
        offset[rare], n[rare] = len(self.flat) + np.cumsum(length) - length, length
        at = np.repeat(offset - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.concatenate([self.flat, flat])[at], n


class Reader:
    """Reads texts; remembers the ids of words that were met and are not frequent."""

    def __init__(self, v: Vocabulary):
        self.v, self.frequent = v, pa.array(v.words, pa.binary())
        self.forget()

    def forget(self) -> None:
        self.met: dict[bytes, int] = {}
        self.flat, self.length, self.offset = self.v.flat, self.v.length, self.v.offset

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, as words_of() gives them, and how many each has."""
        # As strings, without a look at their encoding: only A-Z and white space matter.
        texts = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        n, flat = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()
        flat = pa.Array.from_buffers(pa.binary(), len(flat), flat.buffers(), offset=flat.offset)
        empty = pc.binary_length(flat).to_numpy() == 0  # before leading white space and after trailing
        if empty.any():
            n -= np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
            flat = flat.filter(pa.array(~empty))
        return flat, n

    def read(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Of all texts: ids with ends, how many each has; numbers of words (-1: not frequent), how many each has; the other words, and which of them stands at each -1."""
        words, n = self.words(texts)
        places = pc.fill_null(pc.index_in(words, value_set=self.frequent), -1).to_numpy().astype(np.int32)
        rare = np.flatnonzero(places < 0)
        coded = words.take(pa.array(rare)).dictionary_encode()
        others, which = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if len(self.met) > MET:
            self.forget()
        new = [w for w in others if w not in self.met]
        if new:
            flat, length = self.v.encoded(new)
            self.met.update(zip(new, range(len(self.length), len(self.length) + len(new)), strict=True))
            self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(length) - length])
            self.flat, self.length = np.concatenate([self.flat, flat]).astype(np.int32), np.concatenate([self.length, length])
        number = np.full(len(words) + len(n), len(self.v.words))
        ends = np.cumsum(n + 1) - 1
        inner = np.ones(len(number), bool)
        inner[ends] = False
        own = places.astype(np.int64)
        own[rare] = np.fromiter(map(self.met.get, others), np.int64, len(others))[which]
        number[inner] = own
        length = self.length[number]
        total = np.cumsum(length)
        at = np.repeat((self.offset[number] - total + length).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], np.add.reduceat(length, ends - n), places, n, others, which


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of texts of about READ bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + READ, "right")))
        yield at, end - at
        at = end


def neighbours(follow: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of sequences, ascending, how often they occur, and how often hashed ids stand before and after them."""
    count = np.bincount(follow, minlength=1)
    seen = np.flatnonzero(count)
    place, count = (np.cumsum(count > 0) - 1)[follow], count[seen]
    near = (np.append(follow, end).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)
    near, of_end = near[:-1], near[-1]
    last = np.cumsum(lengths) - 1
    before, inner = np.roll(near, 1), np.ones(len(follow), bool)
    before[last + 1 - lengths] = of_end
    inner[last] = False
    f = np.bincount(place * 2 * BINS + before, minlength=len(seen) * 2 * BINS)
    f += np.bincount(place[inner] * 2 * BINS + BINS + near[np.flatnonzero(inner) + 1], minlength=len(f))
    return seen, count, f.reshape(len(seen), 2 * BINS)


def classes_of(seen: np.ndarray, count: np.ndarray, f: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A class for each id: k-means over what neighbours() found; ids that are not seen share the last."""
    f, bins = f.astype(np.float32), BINS
    f = np.sqrt((f + 0.1) / (f.sum(1, keepdims=True) + 0.2 * bins))
    rng = np.random.default_rng(seed)
    k = min(CLASSES - 1, len(seen))
    centre = f[np.argsort(-count, kind="stable")[:k]] if len(seen) else f
    label = np.zeros(len(seen), np.int64)
    weight = np.sqrt(count)
    for _ in range(8):
        label = (f @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1) if k else label
        total = np.bincount(label, weight, k)
        for j in np.flatnonzero(total == 0):
            centre[j] = f[rng.integers(len(f))]
        for j in np.flatnonzero(total):
            mine = label == j
            centre[j] = np.average(f[mine], axis=0, weights=weight[mine])
    out = np.full(size, CLASSES - 1)
    out[seen] = label
    return out


def windows(lengths: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in the concatenation of sequences), the sequence, and the first position that a window scores."""
    step = WINDOW - overlap
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    seq = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.cumsum(lengths) - lengths, n) + k * step
    return starts, seq, np.where(k > 0, overlap, 0)


def summed(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each of values to the row of out that rows names."""
    if len(rows):
        order = np.argsort(rows.astype(np.uint16) if len(out) <= 1 << 16 else rows, kind="stable")
        rows = rows[order]
        head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[head]] += np.add.reduceat(np.take(values, order, axis=0), head)


class Attention:
    """One causal self-attention layer over ids; predicts classes."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.w = {"e": draw(size, WIDTH), "p": draw(WINDOW, WIDTH), "qkv": draw(WIDTH, 3 * WIDTH), "out": draw(WIDTH, CLASSES), "b": np.zeros(CLASSES, np.float32)}
        self.seen = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.safe = False

    def scaled(self) -> np.ndarray:
        """The weights of q, k and v, with the scale of scores in those of q."""
        out = self.w["qkv"].copy()
        out[:, :WIDTH] *= np.asarray(WIDTH**-0.5, out.dtype)
        return out

    def forward(self, ids: np.ndarray, first: int = 0) -> tuple:
        """x, q, k, v, attention before it is divided by its sums, these, y, logits of windows of ids; q and what comes of it from place `first` on."""
        found = self.attended(ids, first)
        z = (found[-1].reshape(-1, WIDTH) @ self.w["out"]).reshape(len(ids), -1, CLASSES)
        z += self.w["b"]
        return *found, z

    def attended(self, ids: np.ndarray, first: int) -> tuple:
        w = self.w
        x = np.take(w["e"], ids, axis=0)
        x += w["p"]
        qkv = (x.reshape(-1, WIDTH) @ self.scaled()).reshape(*ids.shape, -1)
        q, k, v = qkv[:, first:, :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
        a = np.matmul(q, k.transpose(0, 2, 1))
        if not self.safe and not (a.max() < SAFE and a.min() > -SAFE):
            a -= np.where(self.seen[first:] > 0, a, -np.inf).max(2, keepdims=True)
            np.minimum(a, 0, out=a)  # what is masked may lie above; it must not overflow
        np.exp(a, out=a)
        a *= self.seen[first:]
        sums = np.matmul(a, np.ones((WINDOW, 1), a.dtype))
        y = np.matmul(a, v)
        y /= sums
        y += x[:, first:]
        return x, q, k, v, a, sums, y

    def bounded(self) -> None:
        """Finds whether no scores or logits of any ids can be so large that exp needs care."""
        norm = lambda t: float(np.linalg.norm(t, axis=1).max(initial=0))
        x = norm(self.w["e"]) + norm(self.w["p"])
        q, k, v = (float(np.linalg.norm(t, 2)) for t in np.split(self.w["qkv"], 3, axis=1))
        score = x * x * q * k * WIDTH**-0.5
        real = self.w["b"] > -1e8
        logit = (x + x * v) * float(np.linalg.norm(self.w["out"], axis=0).max(initial=0)) + float(np.abs(self.w["b"][real]).max(initial=0))
        self.safe = score < SAFE and logit < SAFE

    def powers(self, z: np.ndarray) -> tuple[np.ndarray | float, np.ndarray]:
        """Turns logits into e to the power of each, less what is returned first; then the sums over classes."""
        top = 0.0
        # Where the first class that has ids is not far below 0, no sum is too small.
        if not self.safe and not (z.max() < SAFE and z[..., int(np.argmax(self.w["b"] > -1e8))].min() > -SAFE):
            top = z.max(2)
            z -= top[..., None]
        np.exp(z, out=z)
        return top, z @ np.ones(CLASSES, z.dtype)

    def log_p(self, ids: np.ndarray, classes: np.ndarray, first: int = 0) -> np.ndarray:
        """log10 p(class) at each place from `first` on."""
        own_at = np.arange(classes.size) * CLASSES + classes.ravel()
        if self.safe:  # e to the power of a logit is that of its bias times that of the rest
            z = self.attended(ids, first)[-1].reshape(-1, WIDTH) @ self.w["out"]
            own = z.ravel()[own_at] + self.w["b"][classes.ravel()]
            np.exp(z, out=z)
            total = z @ np.exp(self.w["b"])
        else:
            z = self.forward(ids, first)[-1]
            own = z.reshape(-1)[own_at]
            top, total = self.powers(z)
            own -= np.ravel(top)
        own -= np.log(total.ravel())
        own *= np.float32(1 / np.log(10))
        return own.reshape(classes.shape)

    def backward(self, ids: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The gradients for the embedding at each place, and for the other weights; `real`: the weight of each place in the loss."""
        x, q, k, v, a, sums, y, z = self.forward(ids)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        total = self.powers(z)[1]
        z *= (real / total)[..., None].astype(z.dtype)
        z.reshape(-1)[np.arange(targets.size) * CLASSES + targets.ravel()] -= real.ravel()
        dy = (flat(z) @ self.w["out"].T).reshape(x.shape)
        part = dy / sums
        ds = np.matmul(part, v.transpose(0, 2, 1))
        # The sum of da * a over a row, by y less its residual.
        ds -= np.einsum("ijk,ijk->ij", part, y - x)[..., None]
        ds *= a
        dqkv = np.empty((*ids.shape, 3 * WIDTH), z.dtype)
        dqkv[..., :WIDTH] = np.matmul(ds, k)
        dqkv[..., WIDTH : 2 * WIDTH] = np.matmul(ds.transpose(0, 2, 1), q)
        dqkv[..., 2 * WIDTH :] = np.matmul(a.transpose(0, 2, 1), part)
        of_qkv = flat(x).T @ flat(dqkv)
        of_qkv[:, :WIDTH] *= np.asarray(WIDTH**-0.5, z.dtype)
        dx = (flat(dqkv) @ self.scaled().T).reshape(x.shape)
        dx += dy
        return flat(dx), {"p": dx.sum(0), "qkv": of_qkv, "out": flat(y).T @ flat(z), "b": np.ones(targets.size, z.dtype) @ flat(z)}

    def gradients(self, ids: np.ndarray, targets: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Those of the mean loss over the places where `real` is 1."""
        at, found = self.backward(ids, targets, real / real.dtype.type(max(1, real.sum())))
        de = np.zeros_like(self.w["e"])
        summed(de, ids.ravel(), at)
        return {"e": de, **found}

    def fit(self, ids: np.ndarray, targets: np.ndarray, real: np.ndarray, seed: int = 2, epochs: int = EPOCHS) -> None:
        """Adam on windows of ids, the classes that follow, and which of these count."""
        rng = np.random.default_rng(seed)
        # Embeddings of other ids have no gradient.
        whole, seen = self.w["e"], np.flatnonzero(np.bincount(ids.ravel(), minlength=1))
        places = np.zeros(len(whole), np.int64)
        places[seen] = np.arange(len(seen))
        self.w["e"], ids = whole[seen], places[ids]
        m, s = ({n: np.zeros_like(x) for n, x in self.w.items()} for _ in range(2))
        steps = epochs * -(-len(ids) // BATCH)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                t += 1
                rate = RATE * (1 - (t - 1) / steps) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
                total, weight = {n: np.zeros_like(x) for n, x in self.w.items()}, np.float32(1 / max(1, real[some].sum()))
                rows = []
                for part in np.split(some, range(LEARNED, len(some), LEARNED)):
                    dx, found = self.backward(ids[part], targets[part], real[part] * weight)
                    rows.append(dx)
                    for n, g in found.items():
                        total[n] += g
                summed(total["e"], ids[some].ravel(), np.concatenate(rows))
                for n, g in total.items():
                    self.move(rate, self.w[n], m[n], s[n], g)
                if t % 8 == 0:
                    self.bounded()
        whole[seen] = self.w["e"]
        self.w["e"] = whole

    @staticmethod
    def move(rate: float, w: np.ndarray, m: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
        """One step of Adam, in place; g is used up."""
        m *= 0.9
        m += g * np.float32(0.1)
        s *= 0.999
        np.square(g, out=g)
        g *= np.float32(0.001)
        s += g
        np.sqrt(s, out=g)
        g += np.float32(1e-8)
        np.divide(m, g, out=g)
        g *= np.float32(rate)
        w -= g


class Model:
    """Attention, classes and the log10 of p(id | class)."""

    def __init__(self, size: int, end: int):
        self.size, self.end = size, end
        self.net = Attention(size)
        self.classes = np.full(size, CLASSES - 1)
        self.counted(np.zeros(size))

    def fit(self, texts: list[list[int]], classes: np.ndarray | None = None) -> None:
        """Fits the weights on texts, and finds the classes in them where none are given."""
        if texts:
            follow, lengths = np.concatenate([[*x, self.end] for x in texts]).astype(np.int64), np.array([len(x) + 1 for x in texts])
            self.classes = classes_of(*neighbours(follow, lengths, self.end), self.size) if classes is None else classes
            ids, targets, real = self.laid_out(follow, lengths)[:3]
            self.net.fit(ids, self.classes[targets], real.astype(np.float32))
        elif classes is not None:
            self.classes = classes
        else:
            self.net.w = {n: np.zeros_like(x) for n, x in self.net.w.items()}
        # A class without ids is never the one that follows.
        self.net.w["b"][np.bincount(self.classes, minlength=CLASSES) == 0] = -1e9
        self.net.bounded()

    def counted(self, counts: np.ndarray) -> None:
        """Counts of all ids in the whole corpus; with one added, every id has a probability."""
        total = np.bincount(self.classes, counts + 1.0, CLASSES)
        self.within = np.log10((counts + 1.0) / total[self.classes])

    def more(self, follow: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Goes on fitting the weights, once over all the sequences, each id of which counts once; the ids before, and how often."""
        ids, targets, real, _ = self.laid_out(follow, lengths, 0)
        self.net.fit(ids, self.classes[targets], real.astype(np.float32), epochs=1)
        count = np.bincount(ids[real], minlength=1)
        return np.flatnonzero(count), count[count > 0]

    def laid_out(self, follow: np.ndarray, lengths: np.ndarray, overlap: int = OVERLAP) -> tuple:
        """Windows of the ids before, of the ids that follow, which of these are scored, and the sequence of each window.

        follow: the ids of all sequences, one after another, each with its end.
        """
        before = np.roll(follow, 1)
        last = np.cumsum(lengths)
        before[last - lengths] = self.end
        starts, seq, first = windows(lengths, overlap)
        at = starts[:, None] + np.arange(WINDOW)
        real = (at < last[seq][:, None]) & (np.arange(WINDOW) >= first[:, None])
        at = np.minimum(at, len(follow) - 1)
        return before[at], follow[at], real, seq

    def scores(self, follow: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence of ids."""
        starts = np.cumsum(lengths) - lengths
        ids, after, real, seq = self.laid_out(follow, lengths)
        found = np.zeros(len(ids))
        # Windows but the first of a sequence score nothing before place OVERLAP.
        for first, some in ((0, np.flatnonzero(real[:, 0])), (OVERLAP, np.flatnonzero(~real[:, 0]))):
            for part in (some[at : at + CHUNK] for at in range(0, len(some), CHUNK)):
                p = self.net.log_p(ids[part], self.classes[after[part, first:]], first)
                found[part] = np.einsum("ij,ij->i", p, real[part, first:])
        return np.bincount(seq, found, len(lengths)) + np.add.reduceat(self.within[follow], starts)


def summed_up(t: pa.Table) -> pa.Table:
    """One row for those of a part: positions, ascending, and the sums of the rows of integers that go with them."""
    a, c = ([np.frombuffer(x.as_py(), np.int64) for x in t.column(n)] for n in "ac")
    at = np.unique(np.concatenate(a))
    out = np.zeros((len(at), len(c[0]) // len(a[0])), np.int64)
    for x, y in zip(a, c, strict=True):
        out[np.searchsorted(at, x)] += y.reshape(len(x), -1)
    return pa.Table.from_arrays([pa.array([t.column("kind")[0].as_py()], pa.int8()), pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["kind", "part", "a", "c"])


def learn_all(taught: DataFrame, n_taught: int, model: Model, kind: type) -> None:
    """Sets the model's weights to the means of those that the shards of all rows of `taught`, key and a (ids), lead to."""
    start, shards = taught.sparkSession.sparkContext.broadcast(plain(model)), -(-n_taught // SHARD)
    others = [n for n in model.net.w if n != "e"]

    def fit(t: pa.Table) -> pa.Table:
        model = rebuilt(start.value, Model, Attention)
        model.net.w = {n: x.copy() for n, x in model.net.w.items()}
        texts = [np.frombuffer(t.column("a")[int(i)].as_py(), kind) for i in np.argsort(t.column("key").to_numpy(), kind="stable")]
        ids, count = model.more(np.concatenate(texts).astype(np.int64), np.array([len(x) for x in texts]))
        block = ids // IDS
        rows = [(int(b), ids[block == b], count[block == b], model.net.w["e"][ids[block == b]]) for b in np.unique(block)]
        rows.append((-1, np.zeros(1, np.int64), count.sum(keepdims=True), np.concatenate([model.net.w[n].ravel() for n in others])))
        shard = t.column("shard")[0].as_py()
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([shard] * len(rows), pa.int64()), *(pa.array([r[i].astype(k).tobytes() for r in rows], pa.binary()) for i, k in ((1, np.int64), (2, np.int64), (3, np.float32)))], names=["block", "shard", "ids", "count", "value"])

    def mean(t: pa.Table) -> pa.Table:
        rows = [[np.frombuffer(t.column(c)[int(i)].as_py(), k) for c, k in (("ids", np.int64), ("count", np.int64), ("value", np.float32))] for i in np.argsort(t.column("shard").to_numpy(), kind="stable")]
        at = np.unique(np.concatenate([r[0] for r in rows]))
        whole, weight = np.zeros((len(at), len(rows[0][2]) // len(rows[0][0]))), np.zeros(len(at), np.int64)
        for ids, count, value in rows:
            i = np.searchsorted(at, ids)
            whole[i] += count[:, None] * value.reshape(len(ids), -1).astype(np.float64)
            weight[i] += count
        out = (whole / weight[:, None]).astype(np.float32)
        return pa.Table.from_arrays([pa.array([t.column("block")[0].as_py()] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], names=["block", "id", "value"])

    dealt = taught.select("a", "key", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInArrow(fit, "block int, shard long, ids binary, count binary, value binary")
    for block, id_, value in found.groupBy("block").applyInArrow(mean, "block int, id int, value binary").toLocalIterator():  # as many floats as the model has
        x = np.frombuffer(bytes(value), np.float32)
        if block >= 0:
            model.net.w["e"][id_] = x
        else:
            for n, part in zip(others, np.split(x, np.cumsum([model.net.w[n].size for n in others])[:-1]), strict=True):
                model.net.w[n] = part.reshape(model.net.w[n].shape).copy()
    model.net.bounded()


def packed_small(x: np.ndarray) -> bytes:
    """Integers in three rows, of two bytes each where these do, else of four; the first byte tells."""
    kind = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32
    return bytes([kind().itemsize]) + x.astype(kind).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int16 if x[0] == 2 else np.int32, offset=1).reshape(3, -1).astype(np.int64)


def judged(t: pa.Table) -> pa.Table:
    """For each block of documents, of the words of one part: documents, their sums of log10(c + 1) and of known words; and, in block -1, how many words were learned."""
    some, pairs, n = [], [], 0
    for a, b, c in zip(t.column("a"), t.column("b"), t.column("c"), strict=True):
        length = np.frombuffer(b.as_py(), np.int32)
        offset = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        some.append(pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offset.astype(np.int64)), a.as_buffer()]))
        pairs.append(unpacked(c.as_py()))
        pairs[-1][0] += n
        n += len(length)
    coded = pa.concat_arrays(some).dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    word, tf = (np.concatenate([x[i] for x in pairs]) for i in (0, 2))
    c = np.bincount(which[word], np.maximum(tf, 0), len(coded.dictionary))
    log_c = np.log10(c + 1.0)
    rows = [(-1, np.array([(c > 0).sum()]), np.zeros(0), np.zeros(0))]
    for block, (word, doc, tf) in zip(t.column("block").to_pylist(), pairs, strict=True):
        own, tf = which[word], np.abs(tf)
        docs = np.flatnonzero(np.bincount(doc))
        rows.append((block, docs, np.bincount(doc, tf * log_c[own])[docs], np.bincount(doc, tf * (c[own] > 0))[docs]))
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i].astype(k).tobytes() for r in rows], pa.binary()) for i, k in ((1, np.int64), (2, np.float64), (3, np.int64)))], names=["block", "a", "b", "c"])


def gathered(t: pa.Table) -> pa.Table:
    """Sums of what all parts say of the documents of one block."""
    a, b, c = (np.concatenate([np.frombuffer(x.as_py(), k) for x in t.column(n)]) for n, k in (("a", np.int64), ("b", np.float64), ("c", np.int64)))
    docs = np.flatnonzero(np.bincount(a))
    return pa.Table.from_arrays([pa.array(t.column("block")[0].as_py() + docs), pa.array(np.bincount(a, b)[docs]), pa.array(np.bincount(a, c)[docs].astype(np.int64))], names=["row", "rare_log", "rare_known"])


def score(docs: DataFrame, learn: Column, path: str, pattern: str, size: int, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_tokens, n_known, train_tokens, base_score, score.

    `learn` is a condition on docs' columns: the rows that counts and the model are taken from.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.xxhash64(F.col(id_col), text, F.length(text)).alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"))

    short = F.length("text") <= SAMPLE_CHARS
    n_taught, n_fitting, n_bytes = named.agg(F.count_if("learn"), F.count_if(F.col("learn") & short), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    draw = F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(1 << 40))
    some = named.where("learn").where(short).where(draw < F.lit(int(min(1.0, 1.2 * SAMPLE_ROWS / max(1, n_fitting)) * (1 << 40)))).select(draw.alias("draw"), "text").collect()
    sample = [words_of(r[1]) for r in sorted(some)[:SAMPLE_ROWS]]
    words = Vocabulary([w for w, _ in Counter(chain.from_iterable(sample)).most_common(FREQUENT)], end, path, pattern)
    vocabulary = spark.sparkContext.broadcast(plain(words))  # FREQUENT words at most
    texts, left = [], FIT_IDS
    for text in sample:
        if left > 0:
            texts.append(words.ids(text, words.places(text))[0].tolist())
            left -= len(texts[-1]) + 1
    ids_kind, parts, rows_held = np.uint16 if size <= 1 << 16 else np.int32, 1 + n_bytes // PART, ROWS
    names = ["kind", "id", "row", "key", "learn", "n_tokens", "part", "block", "a", "b", "c"]
    kinds = [pa.int8(), None, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their ids and frequent words; other words by part; and the task's sums of frequent words, of all words and of neighbours."""
        v = rebuilt(vocabulary.value, Vocabulary)
        reader, row = Reader(v), TaskContext.get().partitionId() << 40
        known, place, near = np.zeros(len(v.words) + 1, np.int64), np.full(size, -1), np.zeros((0, 1 + 2 * BINS), np.int64)
        others: dict[bytes, int] = {}
        pairs, block, id_type = [], row, None

        def packed(n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, k or id_type)) for c, k in zip(names, kinds, strict=True)], names=names)

        def flushed():
            word, doc, tf = np.concatenate(pairs, axis=1)
            listed = list(others)
            part = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % parts
            order = np.argsort(part, kind="stable")
            first = np.searchsorted(part[order], np.arange(parts + 1))
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            word = new[word]
            by_word = np.argsort(word, kind="stable")
            word, doc, tf = word[by_word], doc[by_word], tf[by_word]
            cuts, out = np.searchsorted(word, first), []
            for p in np.flatnonzero(np.diff(first)):
                own, at = [listed[i] for i in order[first[p] : first[p + 1]]], slice(cuts[p], cuts[p + 1])
                out.append((p, b"".join(own), np.fromiter(map(len, own), np.int32, len(own)).tobytes(), packed_small(np.stack([word[at] - first[p], doc[at], tf[at]]))))
            p, a, b, c = zip(*out, strict=True)
            return packed(len(out), kind=[RARE] * len(out), part=p, block=[block] * len(out), a=a, b=b, c=c)

        for batch in batches:
            id_type = batch.column(0).type
            whole = batch.column(1).cast(pa.binary())
            for at, m in slices(whole):
                ids, n_ids, places, n, rare, which = reader.read(whole.slice(at, m))
                learns = batch.column(3).slice(at, m).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(m), n)
                frequent = places >= 0
                known += np.bincount(places[frequent & learns[doc]], minlength=len(known))
                known[-1] += n[learns].sum()
                if learns.any():
                    seen, count, f = neighbours(ids[np.repeat(learns, n_ids)].astype(np.int64), n_ids[learns], end)
                    new = seen[place[seen] < 0]
                    place[new] = len(near) + np.arange(len(new))
                    near = np.concatenate([near, np.zeros((len(new), near.shape[1]), np.int64)])
                    near[place[seen], 0] += count
                    near[place[seen], 1:] += f
                if len(rare):
                    number = np.fromiter((others.setdefault(w, len(others)) for w in rare), np.int64, len(rare))
                    one, tf = np.unique(doc[~frequent] * len(rare) + which, return_counts=True)
                    of = one // len(rare)
                    pairs.append(np.stack([number[one % len(rare)], of + (row - block), np.where(learns[of], tf, -tf)]))
                few, many = frequent & (places < 1 << 16), places >= 1 << 16
                cut = lambda x, n: [y.tobytes() for y in np.split(x, np.cumsum(n)[:-1])]
                per_doc = lambda x, doc=doc, m=m: np.bincount(doc[x], minlength=m)
                columns = {"a": cut(ids.astype(ids_kind), n_ids), "b": cut(places[few].astype(np.uint16), per_doc(few)), "c": cut(places[many], per_doc(many))}
                yield packed(m, kind=[DOCUMENT] * m, id=batch.column(0).slice(at, m), row=row + np.arange(m), key=batch.column(2).slice(at, m), learn=batch.column(3).slice(at, m), n_tokens=n + 1, **columns)
                row += m
                if sum(x.shape[1] for x in pairs) >= rows_held:
                    yield flushed()
                if not pairs or sum(x.shape[1] for x in pairs) >= rows_held:
                    others, pairs, block = {}, [], row
        if id_type is None:
            return
        if pairs:
            yield flushed()
        seen = np.flatnonzero(place >= 0)
        for kind, at, values in ((WORD, np.flatnonzero(known), known[known > 0][:, None]), (NEAR, seen, near[place[seen]])):
            for p in np.unique(at // IDS):
                mine = at // IDS == p
                yield packed(1, kind=[kind], part=[p], a=[at[mine].astype(np.int64).tobytes()], c=[values[mine].tobytes()])

    id_kind = named.schema["id"].dataType.simpleString()
    found = durable(named.select("id", "text", "key", "learn").mapInArrow(read, f"kind byte, id {id_kind}, row long, key long, learn boolean, n_tokens long, part int, block long, a binary, b binary, c binary"))
    documents = found.where(F.col("kind") == DOCUMENT)

    counts, by_id, near = np.zeros(len(words.words) + 1, np.int64), np.zeros(size), []
    # At most FREQUENT words and `size` ids.
    for kind, part, at, values in found.where(F.col("kind") > RARE).select("kind", "part", "a", "c").groupBy("kind", "part").applyInArrow(summed_up, "kind byte, part int, a binary, c binary").toLocalIterator():
        at = np.frombuffer(bytes(at), np.int64)
        values = np.frombuffer(bytes(values), np.int64).reshape(len(at), -1)
        if kind == WORD:
            counts[at] = values[:, 0]
        else:
            by_id[at] = values[:, 0]
            near.append((part, at, values))
    model = Model(size, end)
    if n_taught:
        near = [x[1:] for x in sorted(near, key=lambda x: x[0])]
        seen, values = (np.concatenate([x[i] for x in near]) for i in (0, 1))
        model.fit(texts, classes_of(seen, values[:, 0], values[:, 1:], size))
        learn_all(documents.where("learn"), n_taught, model, ids_kind)
        give_back(spark)  # with it go the shuffle files of ids
    else:
        model.fit(texts)

    replies = durable(found.where(F.col("kind") == RARE).select("part", "block", "a", "b", "c").groupBy("part").applyInArrow(judged, "block long, a binary, b binary, c binary"))
    rare_kinds = sum(int(np.frombuffer(bytes(r[0]), np.int64)[0]) for r in replies.where("block < 0").select("a").toLocalIterator())
    rare = replies.where("block >= 0").groupBy("block").applyInArrow(gathered, "row long, rare_log double, rare_known long")
    n = int(counts[-1]) + n_taught
    v = int((counts[:-1] > 0).sum()) + rare_kinds + (n_taught > 0)
    model.counted(by_id)
    shared = spark.sparkContext.broadcast(plain((model, np.log10(counts[:-1] + 1.0), counts[:-1] > 0)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_c, is_known = rebuilt(shared.value, Model, Attention)
        for b in batches:
            for at in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(at, DOCUMENTS)
                texts = [np.frombuffer(x.as_py(), ids_kind) for x in part.column(3)]
                places = [np.concatenate([np.frombuffer(x.as_py(), np.uint16), np.frombuffer(y.as_py(), np.int32)]) for x, y in zip(part.column(4), part.column(5), strict=True)]
                flat, doc = np.concatenate(places).astype(np.int64), np.repeat(np.arange(len(places)), [len(x) for x in places])
                scores = model.scores(np.concatenate(texts).astype(np.int64), np.array([len(x) for x in texts]))
                found = (np.bincount(doc, is_known[flat], len(texts)).astype(np.int64) + (n_taught > 0), np.bincount(doc, log_c[flat], len(texts)) + np.log10(n_taught + 1.0), scores)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, found)], names=["id", "row", "n_tokens", "n_known", "log_c", "score"])

    scored = documents.select("id", "row", "n_tokens", "a", "b", "c").mapInArrow(apply, f"id {id_kind}, row long, n_tokens long, n_known long, log_c double, score double")
    every = F.lit(float(np.log10(n + v + 1.0)))
    out = scored.join(rare, "row", "left")
    base = F.col("log_c") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * every
    known = F.col("n_known") + F.coalesce("rare_known", F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def brute_force(texts: list[tuple[object, str | None, bool]]) -> tuple[dict, int, int]:
    """id -> (n_tokens, n_known, base_score) by counting in one place, with N and V; for tests."""
    tokens = {i: [*words_of(t.encode() if t else b""), None] for i, t, _ in texts}
    c = Counter(w for i, _, learns in texts if learns for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), float(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))) for i, w in tokens.items()}, n, v
