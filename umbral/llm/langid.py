"""Language identification with interpolated Kneser-Ney character models.

One model per language, over n-grams of up to ORDER characters of the lower-cased text (each run of
digits, marks and white space is one space). All models lie in common sorted arrays of
n-gram hashes, each with one row of log-probabilities, one column per language: the interpolated
value where the language has the n-gram, its back-off where it hasn't. The language of lowest
cross-entropy per character wins; ties go to the name that sorts first.

The classifier is fitted on a bounded sample of labelled rows: up to MAX_ROWS rows per language, those of
smallest hash whatever their length, of each of which at most MAX_CHARS characters. A fifth of them calibrates: the
temperature of the score, and rejection. What is judged is the cross-entropy of the best language at each character, so
that a text of several learned languages is in them. That of a language's texts of n characters is taken to have a
variance of s0 + s1 / n (between texts, and within one), fitted on whole texts and clips; a text is
rejected where it lies further above the mean than the tail of the calibration texts, continued as an exponential,
does at the rate FALSE_REJECTIONS. Prediction reads whole texts and nothing but texts.

Null texts and texts without a letter are `und` with score 0, and are rejected. With no labelled
rows every text is `und`. Repeated rows get equal predictions.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, rebuilt

ORDER = 5
#: The bounds of the sample that the classifier is fitted on.
MAX_ROWS, MAX_CHARS = 400, 20_000
#: Characters that are scored at once, and bytes of text that a worker turns into strings at once.
BLOCK, SLICE = 1 << 18, 1 << 21
#: Characters that an unseen one is taken to be one of.
ALPHABET = 5_000
#: Share of a language's own texts that may be rejected.
FALSE_REJECTIONS = 1e-6
#: Nats per character that unseen text costs at least; less is a sign of copies of fitted texts among those that calibrate.
LEAST_LOSS = 1.0
#: Lengths of the clips that calibrate, and the share of their largest losses that gives the tail.
CLIPS, TAIL = (20, 60, 200), 0.1

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with ORDER - 1 spaces before them; each run of what is no letter is one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    other = (c < 97) | ((c > 122) & (c < 0xAA)) | ((c > 0xAA) & (c < 0xC0) & (c != 0xB5) & (c != 0xBA)) | ((c >= 0x2000) & (c < 0x2070))
    again = other.copy()
    again[1:] &= other[:-1]
    again[:1] = False
    c = np.where(other, 32, c)[~again if len(c) else slice(0)]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint64), c.astype(np.uint64)])


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def rolling(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """[n][i]: the hash of the n characters that end at i; the first n - 1 places are of no use."""
    out, power = [np.zeros(len(codes), np.uint64)], 1
    for n in range(1, order + 1):
        h = out[-1].copy()
        h[n - 1 :] += (codes[: len(codes) - n + 1] + np.uint64(1)) * np.uint64(power)
        out.append(h)
        power = power * 0x100000001B3 % (1 << 64)
    return out


class Hashed:
    """Rows of values under sorted 64-bit hashes, found by the hash's leading bits and a few steps."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        mixed = self.mix(hashes)
        order = np.argsort(mixed)
        self.keys, self.values = mixed[order], np.ascontiguousarray(values[order], np.float32)
        bits = max(1, int(len(hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.start).max(initial=0))
        self.keys = np.append(self.keys, np.full(self.steps + 1, np.uint64(2**64 - 1)))

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = h * MULTIPLIER
        return (h ^ (h >> np.uint64(32))) * MULTIPLIER

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in values; -1 where there is none."""
        h = self.mix(hashes)
        at = self.start[h >> self.shift].astype(np.int64)
        found = np.where(self.keys[at] == h, at, -1)
        open_ = np.flatnonzero((found < 0) & (self.keys[at] < h))
        for _ in range(self.steps):
            if not len(open_):
                break
            at[open_] += 1
            key = self.keys[at[open_]]
            found[open_[key == h[open_]]] = at[open_[key == h[open_]]]
            open_ = open_[key < h[open_]]
        found[found >= len(self.values)] = -1
        return found


class Models:
    """grams[n]: log p of an n-gram's last character after the others; backoff[n]: log weight of a context of n characters."""

    def __init__(self, names: list[str], texts: dict[str, list[str]]):
        self.names = sorted(names)
        self.grams: list = [None] * (ORDER + 1)
        self.backoff: list = [None] * ORDER
        self.temperature = 1.0
        # Of each language: mean loss, variance between texts and per character, and how many deviations are too many.
        self.typical = np.tile([0.0, 1.0, 1.0, np.inf], (len(names), 1))
        if not names:
            return
        single = [self._fit([codes_of(t) for t in texts[name]]) for name in self.names]
        width = len(self.names)
        for n in range(1, ORDER + 1):
            grams = np.concatenate([s[n][0] for s in single])
            union, first = np.unique(grams, return_index=True)
            suffix, context = (np.concatenate([s[n][k] for s in single])[first] for k in (1, 2))
            value = np.zeros((len(union), width))
            if n == 1:
                self.floor = np.array([s[1][5] for s in single])
                value += self.floor
            else:
                contexts = np.unique(np.concatenate([s[n][4][0] for s in single]))
                weight = np.zeros((len(contexts), width))
                for k, s in enumerate(single):
                    weight[np.searchsorted(contexts, s[n][4][0]), k] = s[n][4][1]
                self.backoff[n - 1] = Hashed(contexts, weight)
                value = weight[np.searchsorted(contexts, context)] + self.grams[n - 1].values[self.grams[n - 1].find(suffix)]
            for k, s in enumerate(single):
                value[np.searchsorted(union, s[n][0]), k] = s[n][3]
            self.grams[n] = Hashed(union, value)

    @staticmethod
    def _fit(codes: list[np.ndarray]) -> list:
        """[n]: hashes of seen n-grams, their suffixes and contexts, log p, (contexts, log weight), floor."""
        seen: list = [None] * (ORDER + 1)
        for n in range(1, ORDER + 1):  # one length at a time, so that the driver holds little
            gram, suffix, context = [], [], []
            for c in codes:
                h = rolling(c, n)
                gram.append(h[n][ORDER - 1 :])
                suffix.append(h[n - 1][ORDER - 1 :])
                context.append(h[n - 1][ORDER - 2 : len(c) - 1])
            gram = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
            _, first, count = np.unique(gram, return_index=True, return_counts=True)
            pick = lambda parts, first=first: (np.concatenate(parts) if parts else np.zeros(0, np.uint64))[first]
            seen[n] = np.column_stack([gram[first], pick(suffix), pick(context)]), count
        out: list = [None] * (ORDER + 1)
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for n in range(1, ORDER + 1):
            table, count = seen[n]
            if n < ORDER:  # in how many contexts an n-gram continues, instead of how often it occurs
                left, times = np.unique(seen[n + 1][0][:, 1], return_counts=True)
                count = times[np.minimum(np.searchsorted(left, table[:, 0]), len(left) - 1)] if len(left) else count
            once, twice = int((count == 1).sum()), int((count == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, at, kinds = np.unique(table[:, 2], return_inverse=True, return_counts=True)
            total = np.bincount(at.ravel(), count, len(contexts)) if len(table) else np.zeros(0)
            weight = discount * kinds / total
            if n == 1:
                below = np.full(len(table), 1 / ALPHABET)
                floor = float(np.log((weight[0] if len(weight) else 1.0) / ALPHABET))
            else:
                keys, values = lower
                below = values[np.searchsorted(keys, table[:, 1])]
                floor = 0.0
            p = (count - discount) / total[at.ravel()] + weight[at.ravel()] * below
            lower = table[:, 0], p
            out[n] = table[:, 0], table[:, 1], table[:, 2], np.log(p), (contexts, np.log(weight)), floor
        return out

    def sums(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-probabilities of consecutive texts (each from starts[k] on, its padding included), by language; last, of the best one at each place."""
        total = np.zeros((len(starts), len(self.names) + 1))
        real = np.ones(len(codes), bool)
        for k in range(ORDER - 1):
            real[starts + k] = False
        for a in range(0, len(codes), BLOCK):
            lead = min(a, ORDER - 1)
            part = codes[a - lead : a + BLOCK]
            value = self.log_p(part)[lead:]
            value[~real[a : a + BLOCK]] = 0
            inside = np.flatnonzero((starts > a) & (starts < a + BLOCK))
            cuts = np.concatenate([[0], starts[inside] - a])
            first = int(np.searchsorted(starts, a, "right")) - 1
            total[first : first + len(cuts), :-1] += np.add.reduceat(value, cuts, axis=0, dtype=np.float64)
            total[first : first + len(cuts), -1] += np.add.reduceat(value.max(1), cuts, dtype=np.float64)
        return total

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        h = rolling(codes)
        out = np.zeros((len(codes), len(self.names)), np.float32)
        todo = np.arange(ORDER - 1, len(codes))
        for n in range(ORDER, 0, -1):
            at = self.grams[n].find(h[n][todo])
            hit = at >= 0
            out[todo[hit]] += self.grams[n].values[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if n == 1:
                out[todo] += self.floor.astype(np.float32)
            else:
                back = self.backoff[n - 1].find(h[n - 1][todo - 1])
                known = back >= 0
                out[todo[known]] += self.backoff[n - 1].values[back[known]]
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log-probability per character by language and of the best one at each, and lengths."""
        codes = [codes_of(t) for t in texts]
        length = np.array([len(c) for c in codes])
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])
        n = np.maximum(1, length - ORDER + 1)
        mean = self.sums(np.concatenate(codes), starts) / n[:, None]
        return mean[:, :-1], mean[:, -1], n

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Temperature of least log loss; the cross-entropy beyond which nothing of a language lies."""
        if not texts:
            return
        # Clips make the sample as hard as short texts are.
        clips = [(t[:n], lang) for n in CLIPS for t, lang in zip(texts, langs, strict=True)]
        mean, _, n = self.score([t for t, _ in clips])
        y = np.array([self.names.index(lang) for _, lang in clips])
        losses = []
        for t in (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0):
            z = mean * n[:, None] * t
            z = z - z.max(1, keepdims=True)
            losses.append((float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean()), t))
        self.temperature = min(losses)[1]
        _, best, n = self.score([t for t, _ in clips] + texts)
        y = np.concatenate([y, [self.names.index(lang) for lang in langs]])
        for k in range(len(self.names)):
            loss, length = -best[y == k], n[y == k]
            if len(loss):
                self.typical[k] = self.tail(loss, length)

    @staticmethod
    def tail(loss: np.ndarray, length: np.ndarray) -> tuple[float, float, float, float]:
        centre = float(np.average(loss, weights=length))
        # Least squares of the squared deviations on 1 and 1 / n, none of them negative.
        square, x = (loss - centre) ** 2, 1 / length
        slope = max(0.0, float(np.cov(x, square, bias=True)[0, 1] / max(x.var(), 1e-12)))
        between = max(1e-3, float(square.mean() - slope * x.mean()))
        far = np.sort((loss - centre) / np.sqrt(between + slope * x))
        start = far[int((1 - TAIL) * (len(far) - 1))]
        beyond = float((far[far >= start] - start).mean()) if len(far) > 1 else 1.0
        return max(centre, LEAST_LOSS), between, slope, float(start + max(beyond, 0.3) * np.log(TAIL / FALSE_REJECTIONS))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy in nats per character, rejected."""
        out: list = [("und", 0.0, None, True)] * len(texts)
        at, size = [], 0
        todo: list[list[int]] = []
        for i, t in enumerate(texts):
            if t and self.names and has_letter(t):
                if at and size + len(t) > BLOCK:
                    todo.append(at)
                    at, size = [], 0
                at.append(i)
                size += len(t)
        for group in [*todo, at] if at else todo:
            mean, any_, n = self.score([texts[i] for i in group])
            best = mean.argmax(1)
            z = (mean - mean.max(1, keepdims=True)) * n[:, None] * self.temperature
            p = 1 / np.exp(z).sum(1)
            for j, i in enumerate(group):
                k = int(best[j])
                loss, least = -float(mean[j, k]), -float(any_[j])
                centre, between, slope, far = self.typical[k]
                out[i] = self.names[k], float(p[j]), loss, bool(least - centre > far * np.sqrt(between + slope / n[j]))
        return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Models:
    """Models of the languages that rows of `learn` are labelled with."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # The hash takes the text in, so that rows of one id draw apart; equal rows draw alike, and one of them is enough.
    text = F.substring(text_col, 1, max_chars)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.lit(1), F.col(id_col).cast("string"), text_col), F.lit(1 << 40)).alias("h")).where("text <> ''")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Models([], {})
    # About max_rows rows of each language come to the driver, the bound itself is kept there.
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.2 * max_rows / n) * (1 << 40)))]), F.col("lang"))
    sample: dict[str, list[tuple[int, str]]] = {k: [] for k in counts}
    for r in rows.where(F.col("h") <= share).dropDuplicates(["lang", "h"]).toLocalIterator():
        sample[r[0]].append((r[2], r[1]))
    chosen = {k: [t for _, t in sorted(v)[:max_rows]] for k, v in sample.items()}
    held = {k: v[:: 5] if len(v) >= 5 else [] for k, v in chosen.items()}
    model = Models(list(chosen), {k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in chosen.items()})
    model.calibrate([t for v in held.values() for t in v], [k for k, v in held.items() for _ in v])
    return model


FOUND = (("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("cross_entropy", T.DoubleType(), pa.float64()), ("rejected", T.BooleanType(), pa.bool_()))


def slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose column `at` has about SLICE bytes."""
    for whole in batches:
        step = max(1, SLICE * whole.num_rows // max(1, whole.columns[at].nbytes))
        for first in range(0, whole.num_rows, step):
            yield whole.slice(first, step)


def predictions(docs: DataFrame, models: Models, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score, cross_entropy and rejected, which replace kept columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(plain(models))  # its size follows the bounded sample
    kept = docs.select(*[F.col(f"`{c}`") for c in keep if c not in {n for n, _, _ in FOUND}])
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t, _ in FOUND)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = rebuilt(shared.value, Models, Hashed)
        for b in slices(batches, -1):
            found = zip(*m.predict(b.columns[-1].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x, t) for x, (_, _, t) in zip(found, FOUND, strict=True)]], names=names)

    return docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(plain(models))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = rebuilt(shared.value, Models, Hashed)
        for b in slices(batches, at):
            yield b.filter(pa.array([not r[3] for r in m.predict(b.columns[at].to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
