"""Near-duplicates by Jaccard similarity of word shingles: SimHash candidates, completed by an exact prefix-filtered self-join.

Three differing bits find some of the texts of similarity 4/5 and not all, so ball hashing alone cannot
decide. It proposes the first candidates, by fingerprints of the same shingles; they are compared like all others.

A text's set holds the hashes of its runs of `width` words, lower-cased (A-Z); a shorter text is one
run. Texts of similarity 4/5 or more are linked, and every such link is found:

* equal sets are one node from the start;
* sets are put in one global order, and two that are linked share a hash of their prefixes, the first
  n - ceil(4 n / 5) + 1 of each. Hashes that a pilot saw often come last in that order, which keeps
  buckets of one hash small; what the pilot saw decides speed only, not results;
* sizes, places within the prefixes, and counts of the hashes by their leading byte rule out pairs that
  cannot be similar; all others are compared by their whole sets. No bucket is capped.

First, what ball hashing proposes is compared, and each bucket with one of its members, which joins large
groups of copies in O(n) comparisons. Then what is left are pairs of a bucket that lie in different components so far, and all of
these are compared. Pairs within one component need no comparison: they cannot change it.

Buckets of more than HOT sets that have sets in common are a family. Where the pairs of its buckets outnumber the copies
of sets that blocks need, and take more bytes, a family is compared in blocks: each pair of blocks meets in one task, which
gives a forest of the links it finds, so no pairs are made as rows. Other families are large and their buckets small; there,
and in small buckets, sketches meet bucket by bucket inside tasks, and only pairs that these allow, of sets that no
blocks compared, are made as rows and compared by their whole sets.

Null and empty texts have the empty set and are copies of each other. Empty tables give empty results.
"""

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .simhash import components, first_of_groups, forest, tag
from .simhash import links as ball_links

WIDTH = 5
#: Similarity of linked texts, as a fraction.
OF, IN = 4, 5
#: Documents that the pilot reads, and hashes that it may name as frequent.
PILOT, KNOWN = 5000, 50_000
#: Remainders of texts' tags that are told apart when texts are looked up; the bound of what is broadcast for it.
REMAINDERS = 1 << 20
#: Hashes of prefixes that one task sorts, and bytes of text that a worker reads at once.
CELL, SLICE = 1_000_000, 1 << 21
#: Hashes of a block of sets, of which two meet in one task.
BLOCK = 1 << 18
#: Rows of a block of a bucket, of which two meet in one task.
BUCKET = 4096
#: Sets of a bucket beyond which it may make a family.
HOT = 32
#: Bytes that travel for a hash, for a place of a bucket with its sketch, and for a pair.
HASH_BYTES, PLACE_BYTES, PAIR_BYTES = 8, 272, 16


def shingle_set(text: bytes | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The distinct hashes, ascending."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    plain = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(plain, seed)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends)]
    n = len(words) - width + 1
    return np.unique(np.fromiter((xxh64_intdigest(plain[a:b], seed) for a, b in zip(starts[:n], ends[width - 1 :], strict=True)), np.uint64, n))


def set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.astype("<u8").tobytes(), 7) - (1 << 63)


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of the distinct shingles: a bit is set where over half of the hashes have it."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def frequent(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that many of the pilot's documents hold, ascending, with their rank (more frequent: higher)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py()).view(np.int64))], names=["h"])

    share = int(min(1.0, PILOT / max(1, docs.count())) * (1 << 20))
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 20)) < share)
    often = drawn.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    known = often.orderBy(F.desc("n"), "h").limit(KNOWN).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], (len(known) - np.arange(len(known)))[order]


def prefix(hashes: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return hashes
    of = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        of = np.where(known[at] == hashes, rank[at], 0)
    n = len(hashes)
    return hashes[np.argsort(of, kind="stable")][: n + (-n * OF // IN) + 1]


def slices(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose columns have about SLICE bytes."""
    for whole in batches:
        step = max(1, SLICE * whole.num_rows // max(1, sum(whole.columns[c].nbytes for c in columns)))
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the hashes have each leading byte, up to 255."""
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row: id_col, tag (of the text), sid (of its set), fp (its SimHash), n (size of the set), prefix and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, id_col, text_col))  # at most KNOWN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in slices(batches, 2):
            sid, fp, n, first, counts = [], [], [], [], []
            for x in b.column(2):
                hashes = shingle_set(x.as_py())
                sid.append(set_id(hashes))
                fp.append(set_fingerprint(hashes))
                n.append(len(hashes))
                first.append(prefix(hashes, *known).view(np.int64))
                counts.append(sketch(hashes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sid, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(counts, pa.binary())], names=[id_col, "tag", "sid", "fp", "n", "prefix", "sketch"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.col(text_col)
    return docs.select(id_col, tag(text).alias("tag"), text.cast("binary").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, tag long, sid long, fp long, n int, prefix array<long>, sketch binary")


def possible(n_a: str, at_a: str, n_b: str, at_b: str) -> Column:
    """Whether sets whose first common hash is at these places can be similar."""
    n_a, at_a, n_b, at_b = map(F.col, (n_a, at_a, n_b, at_b))
    return F.least(n_a - at_a, n_b - at_b) * (OF + IN) >= (n_a + n_b) * OF


def alike(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sketches allow the similarity of sets of so many hashes in total: sets share at most the lesser count of each leading byte."""
    most = np.where((x == 255) & (y == 255), np.iinfo(np.int32).max // 256, np.minimum(x, y)).sum(1, dtype=np.int64)
    return most * (OF + IN) >= total * OF


def in_buckets(open_: DataFrame, one: DataFrame, block: int = BUCKET) -> DataFrame:
    """a, b: pairs of different components (root) that a bucket of open_ (h, sid, n, at, root) holds and sketches allow.

    Where open_ has a family, pairs of one family, which blocks compare, are left out.
    """
    if "family" not in open_.columns:
        open_ = open_.withColumn("family", F.col("sid"))

    def meet(t: pa.Table) -> pa.Table:
        h, sid, n, at, root, family, part, lo, hi = (t.column(c).to_numpy() for c in ("h", "sid", "n", "at", "root", "family", "part", "lo", "hi"))
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, 256)
        n, inner, found = n.astype(np.int64), lo[0] == hi[0], [np.zeros((0, 2), np.int64)]
        room = n - at
        order = np.argsort(h, kind="stable")
        for bucket in np.split(order, np.flatnonzero(np.diff(h[order])) + 1):
            left, right = (bucket, bucket) if inner else (bucket[part[bucket] == lo[0]], bucket[part[bucket] == hi[0]])
            for k, i in enumerate(left):
                to = right[k + 1 :] if inner else right
                total = n[i] + n[to]
                may = (root[to] != root[i]) & (family[to] != family[i]) & (np.minimum(room[i], room[to]) * (OF + IN) >= total * OF)
                if may.any():
                    to, total = to[may], total[may]
                    to = to[alike(sketches[i], sketches[to], total)]
                    found.append(np.column_stack([np.minimum(sid[i], sid[to]), np.maximum(sid[i], sid[to])]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    sizes = open_.groupBy("h").agg(F.ceil(F.count("*") / block).alias("parts"))
    cells = max(1, open_.count() // block)
    dealt = open_.join(sizes, "h").withColumn("part", F.pmod(F.xxhash64("sid"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # Buckets of one block share cells.
    cell = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("h"), F.lit(cells))).otherwise(F.col("h"))
    dealt = dealt.select("h", "sid", "n", "at", "root", "family", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), cell.alias("cell"))
    return dealt.join(one.select("sid", "sketch"), "sid").groupBy("cell", "lo", "hi").applyInArrow(meet, "a long, b long")


def plausible(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sketches allow the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("x", "y"))
            total = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(alike(x, y, total)))

    side = lambda end, name: one.select(F.col("sid").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(keep, "a long, b long")


def texts_of(sids: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """sid, text: one text of each of the sets."""
    # Texts are smaller than sets of hashes.
    need = durable(rows.select("sid", "tag").join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("tag").alias("tag")))
    # Only texts that may be needed travel: a remainder of the tag is looked up in a table of at most REMAINDERS rows.
    some = F.broadcast(need.select(F.pmod("tag", F.lit(REMAINDERS)).alias("remainder")).distinct())
    texts = docs.select(tag(F.col(text_col)).alias("tag"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.join(some, F.pmod(texts["tag"], F.lit(REMAINDERS)) == some["remainder"], "left_semi")
    return texts.join(need, "tag").dropDuplicates(["tag", "sid"]).select("sid", "text")


def similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """a, b: those of the pairs of set ids whose sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 3):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = shingle_set(x.as_py()), shingle_set(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * (OF + IN) >= (len(x) + len(y)) * OF)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), rows, docs, text_col)
    ready = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b")
    return ready.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def among(x: dict[int, np.ndarray], y: dict[int, np.ndarray]) -> np.ndarray:
    """Pairs of ids, the lesser first, of similar sets of x and y (distinct hashes, none empty)."""
    ids = sorted(y, key=lambda i: len(y[i]))
    if not x or not ids:
        return np.zeros((0, 2), np.int64)
    names, n = np.array(ids, np.int64), np.array([len(y[i]) for i in ids])
    ends = np.concatenate([[0], np.cumsum(n)])
    distinct, code = np.unique(np.concatenate([y[i] for i in ids]), return_inverse=True)
    mine, found = np.zeros(len(distinct), bool), [np.zeros((0, 2), np.int64)]
    for i, hashes in x.items():
        # Sets of other sizes cannot be similar.
        lo, hi = np.searchsorted(n, -(-len(hashes) * OF // IN)), np.searchsorted(n, len(hashes) * IN // OF, "right")
        if lo == hi:
            continue
        at = np.minimum(np.searchsorted(distinct, hashes), len(distinct) - 1)
        at = at[distinct[at] == hashes]
        mine[at] = True
        both = np.add.reduceat(mine[code[ends[lo] : ends[hi]]], ends[lo:hi] - ends[lo], dtype=np.int64)
        mine[at] = False
        mates = names[lo:hi][(both * (OF + IN) >= (len(hashes) + n[lo:hi]) * OF) & (names[lo:hi] != i)]
        found.append(np.column_stack([np.minimum(mates, i), np.maximum(mates, i)]))
    return np.unique(np.concatenate(found), axis=0)


def in_blocks(members: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect what similar sets of one family connect; members has family, sid, n and parts (blocks of the family)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], names=["sid", "hashes"])

    def meet(t: pa.Table) -> pa.Table:
        sides: dict[int, tuple[dict, dict]] = {}
        for family, part, lo, sid, hashes in zip(*(t.column(c) for c in ("family", "part", "lo", "sid", "hashes")), strict=True):
            side = sides.setdefault(family.as_py(), ({}, {}))[part.as_py() != lo.as_py()]
            side[sid.as_py()] = np.frombuffer(hashes.as_py(), np.uint64)
        inner = t.column("lo")[0] == t.column("hi")[0]
        pairs = [among(x, x if inner else y) for x, y in sides.values()]
        node, root = forest(np.concatenate(pairs))
        return pa.Table.from_arrays([pa.array(root, pa.int64()), pa.array(node, pa.int64())], names=["a", "b"])

    packed = texts_of(members.select("sid").distinct(), rows, docs, text_col).mapInArrow(pack, "sid long, hashes binary")
    # Families of one block share cells.
    cells = max(1, -(-(members.agg(F.sum("n")).first()[0] or 0) // block))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("sid"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("family"), F.lit(cells))).otherwise(F.col("family"))
    dealt = dealt.select("family", "sid", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), cell.alias("cell"))
    return dealt.join(packed, "sid").groupBy("cell", "lo", "hi").applyInArrow(meet, "a long, b long")


def families(open_: DataFrame, block: int = BLOCK) -> DataFrame:
    """sid, family, n, parts and dense (whether it is compared in blocks), of the sets in open_ (h, sid, n, root, main)."""
    head = open_.groupBy("h").agg(F.min("sid").alias("head"))
    root = components(open_.join(head, "h").select(F.col("head").alias("a"), F.col("sid").alias("b")))
    members = open_.groupBy("sid").agg(F.first("n").alias("n")).join(root, F.col("sid") == F.col("node"), "left").select("sid", "n", F.coalesce("root", "sid").alias("family"))
    # Pairs that a join of the buckets would make, and copies of sets that blocks need.
    joined = open_.join(members.select("sid", "family"), "sid").groupBy("h", "family").agg(F.count("*").alias("places"), (F.count("*") * F.sum((F.col("root") != F.col("main")).cast("long"))).alias("made"))
    joined = joined.groupBy("family").agg(F.sum("places").alias("places"), F.sum("made").alias("made"))
    size = members.groupBy("family").agg(F.count("*").alias("held"), F.sum("n").alias("hashes"), F.ceil(F.sum("n") / block).alias("parts"))
    fewer = F.col("held") * F.col("parts") <= F.col("made")
    # One block is no copy. The copies of more grow with the square of the family, be its buckets ever so small.
    lighter = F.col("hashes") * F.col("parts") * HASH_BYTES <= F.col("places") * PLACE_BYTES + F.col("made") * PAIR_BYTES
    dense = size.join(joined, "family").select("family", "parts", (fewer & ((F.col("parts") <= 1) | lighter)).alias("dense"))
    return members.join(dense, "family").select("sid", "family", "n", "parts", "dense")


def proposed(one: DataFrame) -> DataFrame:
    """a, b: pairs of sets that ball hashing brings together; sets of one fingerprint each meet the first of them."""
    heads = durable(one.groupBy("fp").agg(F.min("sid").alias("head")))
    mates = one.join(heads, "fp").where("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    named = lambda end: heads.select(F.col("fp").alias(f"fp_{end}"), F.col("head").alias(f"head_{end}"))
    met = ball_links(heads.select("fp")).toDF("fp_a", "fp_b").join(named("a"), "fp_a").join(named("b"), "fp_b")
    return mates.unionByName(met.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")))


def in_common(one: DataFrame, cell: int = CELL) -> DataFrame:
    """h, sid, n, at: the places of prefixes whose hash other sets have in theirs too; most hashes are of one set only and go no further.

    Hashes travel packed, dealt into cells by their mixed leading bits. Of those that several sets of a batch
    share, which are in common whatever the rest holds, one stands for all: a hash that is everywhere reaches its
    cell once for each batch.
    """
    total = one.agg(F.sum(F.size("prefix"))).first()[0] or 0
    bits = max(0, (max(1, -(-total // cell)) - 1).bit_length())
    longs, schema = pa.list_(pa.int64()), "cell int, h array<long>, sid array<long>, place array<long>, kind array<tinyint>"
    # Mixed first: prefixes favour small hashes.
    leading = lambda x: (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
    OPEN, STANDS, KNOWN_ = 0, 1, 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of cells: hashes of one set of the batch, one of each that several share, and all of these, which pass (spread by set)."""
        for b in batches:
            lists = b.column("prefix")
            length = np.diff(lists.offsets.to_numpy())
            h = lists.flatten().to_numpy(zero_copy_only=False)
            sid, n = (np.repeat(b.column(c).to_numpy(), length) for c in ("sid", "n"))
            at = np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)
            place = n.astype(np.int64) << 32 | at
            order = np.argsort(h, kind="stable")
            h, sid, place = h[order], sid[order], place[order]
            first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            alone = first & np.concatenate([first[1:], [True]]) if len(h) else first
            known, sends = np.flatnonzero(~alone), np.flatnonzero(first)
            rows = np.concatenate([sends, known])
            kind = np.concatenate([np.where(alone[sends], OPEN, STANDS), np.full(len(known), KNOWN_)]).astype(np.int8)
            to = np.concatenate([leading(h[sends]), leading(sid[known])])
            out = [[], [], [], [], []]
            for name in np.unique(to):
                mine = np.flatnonzero(to == name)
                for column, value in zip(out, (int(name), h[rows[mine]], sid[rows[mine]], place[rows[mine]], kind[mine]), strict=True):
                    column.append(value)
            kinds = (pa.int32(), longs, longs, longs, pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["cell", "h", "sid", "place", "kind"])

    def meet(t: pa.Table) -> pa.Table:
        h, sid, place, kind = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("h", "sid", "place", "kind"))
        known = np.flatnonzero(kind == KNOWN_)
        order = np.flatnonzero(kind != KNOWN_)
        order = order[np.argsort(h[order], kind="stable")]
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        met = order[np.union1d(same, same + 1)]
        mine = np.concatenate([known, met[kind[met] == OPEN]])  # what stands for others is among the known
        return pa.Table.from_arrays([pa.array(x[mine], pa.int64()) for x in (h, sid, place)], names=["h", "sid", "place"])

    found = one.select("sid", "n", "prefix").mapInArrow(deal, schema).groupBy("cell").applyInArrow(meet, "h long, sid long, place long")
    return found.select("h", "sid", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))


def linked(rows: DataFrame, docs: DataFrame, text_col: str, block: int = BLOCK) -> DataFrame:
    """node, root: components of the sets of rows; roots are left out."""
    one = durable(rows.where("n >= 4").groupBy("sid").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")))  # smaller sets are similar to equal ones only
    tokens = durable(in_common(one))
    sizes = tokens.groupBy("h").agg(F.count("*").alias("size"))
    shared = tokens.join(sizes, "h").select("h", "sid", "n", "at", "size")
    # One order for all buckets, so that the buckets of a large group of copies name few centres and few pairs.
    centre = shared.groupBy("h").agg(F.min(F.struct(F.xxhash64("sid").alias("r"), "sid", "n", "at")).alias("c"))
    stars = shared.join(centre.select("h", "c.sid", "c.n", "c.at").toDF("h", "c_sid", "c_n", "c_at"), "h").where(F.col("sid") != F.col("c_sid"))
    ends = (F.least("sid", "c_sid").alias("a"), F.greatest("sid", "c_sid").alias("b"))
    pairs = durable(stars.where(possible("n", "at", "c_n", "c_at")).select(*ends).unionByName(proposed(one.select("sid", "fp"))).distinct())
    links = durable(similar(durable(plausible(pairs, one)), rows, docs, text_col))
    root = components(links)

    # In buckets of two sets, and those of one component, nothing is left to compare.
    label = shared.where("size > 2").join(root, F.col("sid") == F.col("node"), "left").select("h", "sid", "n", "at", "size", F.coalesce("root", "sid").alias("root"))
    main = label.groupBy("h", "root").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("roots"))
    main = main.where("roots > 1").select("h", F.col("top.root").alias("main"))
    open_ = durable(label.join(main, "h"))
    family = durable(families(open_.where(F.col("size") > HOT), block).where("dense"))
    blocks = in_blocks(family, rows, docs, text_col, block)
    # A bucket that made a family lies in it; a family is named by one of its own sets, so other sets can stand for themselves.
    open_ = open_.join(family.select("sid", "family"), "sid", "left").where((F.col("size") <= HOT) | F.col("family").isNull())
    open_ = open_.withColumn("family", F.coalesce("family", "sid"))
    rest = in_buckets(open_, one).distinct().join(pairs, ["a", "b"], "left_anti")
    more = similar(durable(rest), rows, docs, text_col)
    return components(links.unionByName(durable(blocks)).unionByName(more))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, tag and root, which rows of one component share."""
    rows = durable(sets(docs, id_col, text_col))
    root = linked(rows, docs, text_col)
    return rows.select(id_col, "tag", "sid").join(root, F.col("sid") == F.col("node"), "left").select(id_col, "tag", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, then of the smallest tag. Rows without an id come after all others.

    Rows of one id and different texts are told apart.
    """
    return first_of_groups(docs, clusters(docs, id_col, text_col), id_col, text_col)


def brute_force(texts: dict[object, str | None]) -> dict[object, object]:
    """id -> smallest id of its component, by comparing all pairs of sets of plain shingles; for tests."""
    runs = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        runs[i] = {tuple(w[k : k + WIDTH]) for k in range(max(1, len(w) - WIDTH + 1))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(runs[i] & runs[j]) * IN >= len(runs[i] | runs[j]) * OF:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}
