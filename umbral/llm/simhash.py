"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at 3 or fewer differing bits are linked. Each distinct fingerprint emits variants of
itself, and two that are linked have a variant in common:

* near variants: itself and its 64 one-bit flips;
* far variants: flips of two bits p < q of the same half of the word, where bit p is set.

At distance 1 or 2 near variants meet. At distance 3, two of the three bits share a half, and
exactly one side has the lower of these set: its far variant meets the other's near variant. So a
fingerprint has some 561 variants, not the 2081 of the full ball.

Variants are shuffled by prefix: a few bits of the word, chosen for balance, name a cell of the
variant space. A fingerprint goes once to each cell that a variant of it falls in; the
variants themselves are made inside the cell, sorted, and colliding ones verified. Cells too full for
one task are divided by a hash of the variant. In a bucket of one variant, all near emitters
lie within 2 bits and far ones within 3 of each near one, so a star around one near emitter links
just what is linked, and a group of n fingerprints makes O(n) links. Connected components come from
alternating large-star and small-star steps over distributed links.

Null and empty texts have the fingerprint zero, linked like any other. Repeated rows get equal
fingerprints and one component. Rows with a null id get their group's component, which is null if
no row of the group has an id. Empty tables give empty results.
"""

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

#: Shingles whose hashes are held at once, and variants that a task sorts at once.
CHUNK, CELL = 1 << 16, 4_000_000
#: Variants of a fingerprint, on average.
BALL = 561
#: Rounds of components(), each of which roughly halves the longest path; reaching it is an error.
MAX_ROUNDS = 200


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Of the lower-cased (A-Z) text's word shingles; bit set where over half of the hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    plain = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    if len(words) <= width:
        return xxh64_intdigest(plain, seed)
    starts = [0, *(e + 1 for e in ends)]
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = np.fromiter((xxh64_intdigest(plain[a:b], seed) for a, b in zip(starts[at:to], ends[at + width - 1 : to + width - 1], strict=True)), np.uint64, to - at)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, keep: tuple | list = ()) -> DataFrame:
    """id_col, the columns `keep` and fp (the 64 bits as a signed long) of each row."""
    kept = docs.select(id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), width, seed) for x in b.columns[-1]), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[id_col, *keep, "fp"])

    schema = T.StructType([*kept.schema.fields, T.StructField("fp", T.LongType())])
    return docs.select(id_col, *keep, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def masks() -> tuple[list[int], list[tuple[int, int]]]:
    """Near flips; far flips with the bit that must be set."""
    far = [(1 << p | 1 << q, 1 << p) for h in (0, 32) for p in range(h, h + 32) for q in range(p + 1, h + 32)]
    return [0, *(1 << i for i in range(64))], far


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def meet(fps: np.ndarray, cell: int, cell_mask: int, part: int, parts: int, room: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """Links among fps through the variants that fall in the cell (and in this part of it)."""
    near, far = masks()
    groups = {int(d): fps[(fps & np.uint64(cell_mask)) ^ np.uint64(cell) == d] for d in np.unique((fps & np.uint64(cell_mask)) ^ np.uint64(cell))}
    rounds = max(1, -(-len(fps) * BALL // room // parts))
    links: list[np.ndarray] = []
    for turn in range(rounds):
        variants, owners, roles = [], [], []
        for role, flips in ((0, [(m, 0) for m in near]), (1, far)):
            for m, needs in flips:
                f = groups.get(m & cell_mask)
                if f is None:
                    continue
                if needs:
                    f = f[f & np.uint64(needs) != 0]
                v = f ^ np.uint64(m)
                if parts * rounds > 1:
                    mine = mixed(v) % np.uint64(parts * rounds) == part * rounds + turn
                    v, f = v[mine], f[mine]
                variants.append(v)
                owners.append(f)
                roles.append(np.full(len(v), role, np.uint8))
        if not variants:
            continue
        v, f, r = np.concatenate(variants), np.concatenate(owners), np.concatenate(roles)
        del variants, owners, roles
        # Only values that occur twice can meet.
        order = np.argsort(v)
        v = v[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        both = np.union1d(same, same + 1)
        v, f, r = v[both], f[order[both]], r[order[both]]
        order = np.lexsort((f, r, v))
        v, f, r = v[order], f[order], r[order]
        head = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(head, np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64)
        tied = (r[first] == 0) & (f != f[first])
        pair = np.unique(np.column_stack([f[first][tied], f[tied]]), axis=0)
        differing = np.bitwise_count(pair[:, 0] ^ pair[:, 1])
        links.append(pair[differing <= 3])
    pair = np.concatenate(links) if links else np.zeros((0, 2), np.uint64)
    return forest(pair.view(np.int64))


def forest(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the smallest of its component, with that smallest."""
    nodes, ends = np.unique(pair, return_inverse=True)
    a, b = ends.reshape(-1, 2).T if len(pair) else (np.zeros(0, np.int64),) * 2
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for x in (label[a], label[b], a, b):
            np.minimum.at(label, x, least)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(unique: DataFrame, cell_size: int = CELL) -> DataFrame:
    """a, b: links that connect just those distinct fingerprints (column fp) which linked pairs connect."""
    stats = unique.agg(F.count("*"), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))) for i in range(64)]).first()
    n, ones = stats[0], [x or 0 for x in stats[1:]]
    # As many bits as keep a cell's share in one task, so that rows and work stay in proportion to n: a
    # fingerprint reaches some 70 cells at 16 bits, 270 at 32, and with all 64 each of its variants.
    bits = min(64, max(0, (max(1, n * BALL // cell_size) - 1).bit_length()))
    chosen = sorted(sorted(range(64), key=lambda i: abs(2 * ones[i] - n))[:bits])
    cell_mask = sum(1 << i for i in chosen)
    reach = sorted({m & cell_mask for m in (*masks()[0], *(m for m, _ in masks()[1]))})
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    routed = unique.select("fp", F.explode(F.array(*map(signed, reach))).alias("flip")).select("fp", F.col("fp").bitwiseAND(signed(cell_mask)).bitwiseXOR(F.col("flip")).alias("cell"))
    full = routed.groupBy("cell").agg(F.count("*").alias("n"))
    # A row in each cell that it reaches makes BALL / len(reach) variants there, on average.
    room = max(1, cell_size * len(reach) // BALL)
    if (full.agg(F.max("n")).first()[0] or 0) > 2 * room:
        parts = full.select("cell", F.ceil(F.col("n") / room).cast("int").alias("parts"))
        routed = routed.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        routed = routed.withColumns({"parts": F.lit(1), "part": F.lit(0)})

    def run(t: pa.Table) -> pa.Table:
        fps = np.unique(t.column("fp").to_numpy()).view(np.uint64)
        one = lambda c: t.column(c)[0].as_py()
        a, b = meet(fps, one("cell") & (2**64 - 1), cell_mask, one("part"), one("parts"), cell_size)
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return routed.groupBy("cell", "part").applyInArrow(run, "a long, b long")


def components(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, root (the smallest node that links reach) for all nodes but roots, from links a, b.

    Rounds go on until the links no longer change; should that take more than max_rounds, it is an error.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
    now, rounds = print_of(edges), 0
    while now[0]:
        if rounds == max_rounds:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
        rounds += 1
        # Large star: each larger neighbour of a node is linked to the smallest of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: so is each smaller neighbour.
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        down = big.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, print_of(edges)
        if before == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """For each row: id_col, fp, component_id (the smallest id that links reach)."""
    fps = durable(fingerprints(docs, id_col, text_col, width, seed))
    unique = durable(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    root = components(links(unique))
    labelled = unique.join(root, unique["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(labelled.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def tag(text: Column) -> Column:
    """Tells rows of one id and different texts apart."""
    return F.xxhash64(text, F.length(text))


def first_of_groups(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each group of found (id_col, tag, root): that of the smallest id, then tag. Rows without an id come last."""
    order = F.struct(F.col(id_col).isNull().alias("lost"), F.col(id_col).alias("id"), "tag")
    first = found.groupBy("root").agg(F.min(order).alias("k"))
    # Keys without nulls, the same for the join and for what drops repeated rows: texts are shuffled once.
    keys = ["__lost", "__id", "__tag"]
    named = lambda lost, i, t: (lost.alias("__lost"), F.coalesce(i.cast("string"), F.lit("")).alias("__id"), t.alias("__tag"))
    stay = first.select(*named(F.col("k.lost"), F.col("k.id"), F.col("k.tag")))
    own = F.col(id_col)
    return docs.select("*", *named(own.isNull(), own, tag(F.col(text_col)))).join(stay, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """docs with one row of each component of clusters(): that of the smallest id, rows without an id last.

    Rows of one id and different texts are told apart; equal rows of one id are one row.
    """
    fps = durable(fingerprints(docs.select(id_col, tag(F.col(text_col)).alias("tag"), text_col), id_col, text_col, width, seed, ["tag"]))
    unique = durable(fps.select("fp").distinct())
    root = components(links(unique))
    found = fps.join(root, F.col("fp") == F.col("node"), "left").select(id_col, "tag", F.coalesce("root", "fp").alias("root"))
    return first_of_groups(docs, found, id_col, text_col)


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[str, int]]:
    """The same by comparing all pairs; for tests."""
    fp = {i: fingerprint(t.encode() if t is not None else None) for i, t in texts.items()}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{fp[i]:016x}", find(i)) for i in fp}
