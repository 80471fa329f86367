"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles; documents with equal sets are one
class. A class has a signature of symbols, the low bits of the smallest hash under each
of many hash functions. Signatures are cut into chunks; if two differ in at most
`chunks * (errors + 1) - 1` symbols, then by the pigeonhole principle some chunk differs
in at most `errors`, so classes are filed under every chunk with every choice of `errors`
symbols left out, and each pair within the threshold meets in a bucket. The threshold
lies more than five standard deviations above what a pair of the wanted similarity shows.

Buckets with the same members count once. Pairs within the threshold join classes into
regions; inside a bucket, members are paired with leaders and regions with regions, never
all with all. Each member is then compared with one leader on their full sets; where that
leaves a region in several parts, the members of all but the largest are compared with
those of the other parts, block by block, and only links that connect something leave a
block, so that rows grow with the members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import graph
from ._text import LOWER, NOT_SPACE, flat, materialised, mix, pair, slices, windows, word_hashes, words
from .anchors import KEY, keyed, public_id

CHUNKS, LENGTH, ERRORS = 24, 4, 1
SYMBOLS = CHUNKS * LENGTH
#: Signatures that differ in more symbols are not looked at: 47 of 96, where a similarity of 0.75 gives 24 +- 4.3.
MOST_DIFFERENT = CHUNKS * (ERRORS + 1) - 1
_A = np.random.Generator(np.random.PCG64(7)).integers(0, 2**31, SYMBOLS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.Generator(np.random.PCG64(8)).integers(0, 2**32, SYMBOLS).astype(np.uint32)
#: Keys of the first sixth of the chunks lie below this one.
_FIRST_KEYS = (CHUNKS // 6 * LENGTH) << (16 * (LENGTH - ERRORS))
_LEFT_OUT = [tuple(k for k in range(LENGTH) if k not in out) for out in combinations(range(LENGTH), ERRORS)]


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and where each document's begin."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, off, NOT_SPACE)
    each = word_hashes(buf, starts, ends)
    del buf, starts, ends
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s <= size:
            short = each[s : s + 1].copy()
            for k in range(s + 1, e):
                short = pair(short, each[k : k + 1])
            out.append(short if e > s else each[:0])
        else:
            h = np.sort(windows(each[s:e], size))
            out.append(h[np.append(True, h[1:] != h[:-1])])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum([0, *map(len, out)])


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each document that has shingles; zeros for the others."""
    n = np.diff(first)
    out = np.zeros((len(n), SYMBOLS), np.uint16)
    has = np.flatnonzero(n)
    if len(has):
        x, at = (h >> np.uint64(32)).astype(np.uint32), first[:-1][has]
        for k in range(SYMBOLS):
            out[has, k] = np.minimum.reduceat(x * _A[k] + _B[k], at).astype(np.uint16)
    return out


def file_keys(signature: np.ndarray) -> np.ndarray:
    """A row of keys for each signature: chunk, choice of symbols left out, and the symbols that stay."""
    s = signature.reshape(-1, CHUNKS, LENGTH).astype(np.int64)
    out = np.zeros((len(s), CHUNKS, len(_LEFT_OUT)), np.int64)
    for w, stay in enumerate(_LEFT_OUT):
        key = np.arange(CHUNKS, dtype=np.int64) * len(_LEFT_OUT) + w
        for k in stay:
            key = (key << 16) | s[:, :, k]
        out[:, :, w] = key
    return out.reshape(len(s), -1)


def _near(sig: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of `others` lie within the threshold of member i and have a fitting size."""
    o = others[np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]) - 1e-9]
    return o[(sig[o] != sig[i]).sum(1) <= MOST_DIFFERENT] if len(o) else o


def _buckets(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by bucket -> (cid, n, signature, component) of each bucket."""
    from .anchors import whole_groups

    for t in whole_groups(batches, "key", most):
        key, cid, n, comp = (t.column(c).to_numpy() for c in ("key", "cid", "n", "comp"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(len(cid), SYMBOLS)
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            o = a + np.argsort(cid[a:z], kind="stable")
            yield cid[o], n[o], sig[o], comp[o]


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of what a task has found, so far as it fits the bound."""

    def batch(held):
        pairs = np.unique(np.concatenate(held, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    held, size = [], 0
    for x, y in found:
        held.append(np.stack([x, y]))
        size += len(x)
        if size > most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def to_leaders(batches, similarity: float):
    """Each member with the first near member before it that leads: at most one pair a member and bucket."""

    def found():
        for cid, n, sig, _ in _buckets(batches):
            free = np.arange(len(cid))
            while len(free) > 1:
                lead, free = free[0], free[1:]
                near = _near(sig, n, lead, free, similarity)
                if len(near):
                    yield np.full(len(near), cid[lead]), cid[near]
                    free = free[~np.isin(free, near)]

    return _pairs(found())


def across(batches, similarity: float):
    """Pairs of regions, not of members, that have near members in a bucket."""

    def found():
        for cid, n, sig, comp in _buckets(batches):
            names, count = np.unique(comp, return_counts=True)
            if len(names) < 2:
                continue
            main = names[count.argmax()]
            every = np.arange(len(cid))
            for i in np.flatnonzero(comp != main):
                near = _near(sig, n, i, every[(comp != comp[i]) & ((comp == main) | (every > i))], similarity)
                if len(near):
                    other = np.unique(comp[near])
                    yield np.minimum(other, comp[i]), np.maximum(other, comp[i])

    return _pairs(found())


#: Members and bytes of a block; a region of more is compared block by block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 2 << 20
#: Regions in several parts are broadcast up to so many (some 32 bytes each); beyond it members are joined with them by region.
BROADCAST_REGIONS = 500_000


def similar(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of all pairs of sets with 100 * intersection >= percent * union; with `left` only pairs across it."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        k = len(np.intersect1d(*sets, assume_unique=True))
        ok = 100 * k >= percent * (n.sum() - k)
        return (np.array([0]), np.array([1])) if ok else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = np.repeat(np.arange(len(sets)), n)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    o = np.argsort(col, kind="stable")
    row, col = row[o], col[o]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        k = slice(*np.searchsorted(col, (at, at + 4096)))
        m = np.zeros((len(sets), min(4096, int(shared.sum()) - at)), np.float32)
        m[row[k], col[k] - at] = 1
        inter += m @ m.T
    inter = inter.astype(np.int64)
    good = np.triu(100 * inter >= percent * (n[:, None] + n[None, :] - inter), 1)
    if left is not None:
        good &= left[:, None] != left[None, :]
    return np.nonzero(good)


def linked_to_leaders(star: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the pairs of a leader and a member that are similar on their full sets.

    A member's set meets its leader's only; the leader's text goes to every task that has members of it.
    """
    mine = star.join(members.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    lead = star.select("a").distinct().join(members.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        for t in slices(batches, "tb"):
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            one, which = np.unique(a, return_index=True)
            own, first = shingle_sets(*flat(t.column("tb")), size)
            theirs, at = shingle_sets(*flat(t.column("ta").take(pa.array(which))), size)
            good = []
            for k, j in enumerate(np.searchsorted(one, a).tolist()):
                x, y = own[first[k] : first[k + 1]], theirs[at[j] : at[j + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            k = np.flatnonzero(good)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(a[k]), pa.array(b[k])], ["a", "b"])

    return mine.join(lead, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def across_parts(parts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links of the full sets between the parts of each region (component, node, text, part), enough of them to connect what is linked.

    A region's largest part is linked already, so its members are compared with those of the others only; these
    are compared with each other as well. Both are cut into blocks of bounded rows and bytes, and each pair of
    blocks is a group of its own, which gives at most one link a member. Rows that share a key and so
    a set give the same node twice, which links with itself and changes nothing.
    """
    counts = parts.groupBy("component", "part").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    each = counts.groupBy("component").agg(F.max_by(F.struct("part", "n", "bytes"), F.struct("n", "part")).alias("m"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    plan = each.select("component", F.col("m.part").alias("main"), blocks(F.col("m.n"), F.col("m.bytes")).alias("mains"), blocks(F.col("n") - F.col("m.n"), F.col("bytes") - F.col("m.bytes")).alias("others"))
    plan = materialised(plan, "minhash-parts")
    # a region's members are spread over many tasks unless there are too many open regions to tell each of them
    few = plan.limit(BROADCAST_REGIONS + 1).count() <= BROADCAST_REGIONS
    rows = parts.join(F.broadcast(plan) if few else plan, "component").withColumn("is_main", F.col("part") == F.col("main"))
    placed = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    own = F.col("own")
    with_mains = F.when(F.col("is_main"), F.transform(upto("others"), lambda j: pair(0, own, j))).otherwise(F.transform(upto("mains"), lambda i: pair(0, i, own)))
    with_others = F.when(~F.col("is_main"), F.transform(upto("others"), lambda j: pair(1, F.least(own, j), F.greatest(own, j))))
    dealt = placed.withColumn("p", F.explode(F.when(F.col("is_main"), with_mains).otherwise(F.concat(with_mains, with_others))))
    inner = F.col("p.kind") == 1
    dealt = dealt.select(F.xxhash64("component", "p.kind", "p.x", "p.y").alias("key"), "node", (inner & (F.col("p.x") == F.col("p.y"))).alias("same"), F.when(inner, own == F.col("p.x")).otherwise(F.col("is_main")).alias("first"), "text")

    def run(batches):
        from .anchors import whole_groups
        from .ego import _components

        for t in whole_groups(batches, "key", 2 << 20):
            t = t.combine_chunks()
            h, first = shingle_sets(*flat(t.column("text")), size)
            key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            same, left = (t.column(c).to_numpy(zero_copy_only=False) for c in ("same", "first"))
            cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            a, b = [], []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if e - s > 1:
                    i, j = similar([h[first[k] : first[k + 1]] for k in range(s, e)], percent, None if same[s] else left[s:e])
                    root = _components(i, j, e - s)
                    k = np.flatnonzero(root != np.arange(e - s))
                    a.append(node[s + root[k]]), b.append(node[s + k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def confirmed(star: DataFrame, regions: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links of the full sets of the members of each region (node, component), enough of them to connect what is linked.

    Leaders come first: each member is compared with one leader, and what that leaves of a region in
    several parts is compared between them. A group of near copies thus costs as much as it has members.
    """
    members = regions.join(classes.select(F.col("cid").alias("node"), "did", "chk"), "node").join(rows.select("did", "chk", "text"), KEY).select("component", "node", "text")
    members = materialised(members, "minhash-members")
    links = materialised(linked_to_leaders(star, members, size, percent), "minhash-led")
    parts = graph.components(links)
    parted = members.join(parts.select("node", F.col("component").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    return links.union(across_parts(parted.select("component", "node", "text", "part"), size, percent))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """nn, did, chk, n_shingles, low, first: one row for each row of docs; see anchors.keyed for nn, did and chk.

    `low` is the smallest key of its component, and `first` marks the document that has it.

    Null and empty texts have the empty set and are linked with nothing. Equal rows and rows that
    repeat an id are members of their classes like any other; a null id stands before all others.
    Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)

    def describe(batches):
        for b in slices(batches, "text"):
            h, first = shingle_sets(*flat(b.column("text")), size)
            n = np.diff(first)
            sums = []
            for salt in (0x1B873593CC9E2D51, 0x6C62272E07BB0142):
                c = np.append(np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64))
                sums.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
            sig = signatures(h, first).astype("<u2")
            yield pa.RecordBatch.from_arrays([b.column("nn"), b.column("did"), b.column("chk"), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array([s.tobytes() if k else None for s, k in zip(sig, n)], pa.binary())], ["nn", "did", "chk", "n", "c1", "c2", "sig"])

    sets = materialised(rows.mapInArrow(describe, "nn int, did long, chk long, n long, c1 long, c2 long, sig binary"), "minhash-sets")
    # a class stands for all documents with one set; its number is a hash of the set
    number = F.xxhash64("c1", "c2", "n")
    classes = sets.where("n > 0").groupBy("c1", "c2", "n").agg(F.min(F.struct("nn", "did", "chk")).alias("first"), F.first("sig").alias("sig"))
    classes = materialised(classes.select(number.alias("cid"), "n", F.col("first.nn").alias("nn"), F.col("first.did").alias("did"), F.col("first.chk").alias("chk"), "sig"), "minhash-classes")

    def file(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(b.num_rows, SYMBOLS)
            keys = file_keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("cid").to_numpy(), keys.shape[1]))], ["key", "cid"])

    filed = classes.select("cid", "sig").mapInArrow(file, "key long, cid long").repartition("key")
    members = F.struct(F.count("*").alias("k"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.xxhash64("cid", F.lit(1)).bitwiseAND(0xFFFFFFFF)).alias("s"))
    distinct = filed.groupBy("key").agg(members.alias("m")).where("m.k > 1").groupBy("m").agg(F.min("key").alias("key")).select("key")
    picked = filed.join(distinct, "key")
    buckets = materialised(picked.join(classes.select("cid", "n", "sig"), "cid").select("key", "cid", "n", "sig"), "minhash-buckets")

    similarity = percent / 100
    # regions: first from a sixth of the keys, then whatever near pairs of all keys still join
    one = buckets.where(F.col("key") < _FIRST_KEYS).withColumn("comp", F.col("cid")).repartition("key").sortWithinPartitions("key")
    pairs = materialised(one.mapInArrow(lambda it: to_leaders(it, similarity), "a long, b long").distinct(), "minhash-near")
    regions = graph.components(pairs)
    labelled = buckets.join(regions.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "n", "sig", F.coalesce("component", "cid").alias("comp"))
    two = labelled.repartition("key").sortWithinPartitions("key")
    more = materialised(two.mapInArrow(lambda it: across(it, similarity), "a long, b long").distinct(), "minhash-near")
    if not more.isEmpty():
        regions = graph.components(pairs.union(more))
    star = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    parts = graph.components(confirmed(star, regions, classes, rows, size, percent))
    known = classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = known.groupBy("component").agg(F.min(F.struct("nn", "did", "chk")).alias("lowest"))
    known = known.join(lowest, "component").select("cid", "lowest")
    own = F.struct("nn", "did", "chk")
    out = sets.select("nn", "did", "chk", "n", F.when(F.col("n") > 0, number).alias("cid"))
    # rows without shingles join nothing; they are dealt out by their ids
    out = out.withColumn("key", F.coalesce("cid", F.xxhash64("did", "chk"))).join(known.withColumnRenamed("cid", "key"), "key", "left")
    low = F.when(F.col("n") > 0, F.col("lowest")).otherwise(own)
    return out.select("nn", "did", "chk", F.col("n").alias("n_shingles"), low.alias("low"), (low == own).alias("first"))


def public(found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, with null for the null id."""
    component = public_id("low.nn", "low.did")
    return found.select(public_id().alias("doc_id"), "n_shingles", component.alias("component_id"), public_id().eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component; of equal rows one stays."""
    found = materialised(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).select("did", "chk", "first"), "minhash-kept")
    rows = keyed(docs, id_col, text_col, keep=tuple(docs.columns)).drop("text")
    # merged at every size, as the keys that stay grow with the documents
    kept = rows.join(found.where("first").select(*KEY).distinct().hint("merge"), KEY, "left_semi")
    if not found.groupBy(*KEY).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(KEY)
    return kept.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
