"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other, and so do their
projections on the leading principal dimensions. Vectors are sorted by the cells, of width
eps, of those projections, and cut into blocks: intervals of the sequence with a bounding
box. Each pair of blocks whose boxes lie within eps meets in one task of a product of the table of
blocks with itself, which reads that table again and shuffles nothing; a pair of intervals is halved
again and again, leaving out pairs whose boxes lie further apart than eps. What remains is screened in
single precision by leading coordinates and the lengths of the rest, which bound a cosine from above,
and what passes is compared in double precision.

A pair of blocks gives counts of links and, for each vector, one link to the smallest
vector of its component there, so that results grow with the vectors and not with links.
Equal vectors are one class from the start. Where the dimensions carry no structure,
few blocks are provably distant, and the work is that of all pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import graph
from ._text import materialised

#: Principal dimensions of the grid; least rows of a block, and how much larger blocks of large tables are; rows below which an interval is not halved.
DIMENSIONS, BLOCK, LARGER, LEAF = 4, 4096, 8, 512
#: How far a cosine in single precision may lie from its value.
SLACK = 1e-4


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, a row each, and which rows are usable.

    Null and empty vectors, zero vectors and those with null or non-finite components are not;
    rows of a length other than the batch's longest are padded with zeros and marked by length.
    """
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.array([len(x) if x.is_valid else 0 for x in col], np.int64)
    out = np.zeros((len(col), int(size.max()) if len(size) else 0))
    if out.shape[1]:
        values = col.flatten().to_numpy(zero_copy_only=False).astype(float)
        at = np.arange(out.shape[1])[None, :] < size[:, None]
        out[at] = values
    big = np.abs(out).max(1) if out.shape[1] else np.zeros(len(out))
    unit = _unit(out)
    good = (size > 0) & np.isfinite(big) & (big > 0) & np.isfinite(out).all(1)
    unit[~good] = 0
    return unit, good


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; very large or small components would overflow or vanish in the squares, so that rows are scaled first."""
    if not x.shape[1]:
        return x.astype(float)
    with np.errstate(all="ignore"):
        scaled = x / np.abs(x).max(1)[:, None]
        return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def _pack(rows: np.ndarray, kind: str = "<f8") -> list[bytes]:
    return [x.astype(kind).tobytes() for x in rows]


def _screen(p: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors and the lengths of the rest, in single precision: products of such rows are no smaller than the cosines."""
    d = p.shape[1]
    k = 3 * d // 8 if d >= 16 else d
    rest = np.sqrt(np.maximum(1 - (p[:, :k] ** 2).sum(1), 0))
    return np.column_stack([p[:, :k], rest]).astype(np.float32)


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n nodes' components, by hooking and halving."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def join_intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, eps: float, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs with dot product >= least; of one sequence with itself, i < j. px and py are x and y turned to the principal axes."""
    sx, sy = _screen(px), _screen(py)
    px, py = px[:, :DIMENSIONS], py[:, :DIMENSIONS]
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or (same and d <= a + 1 and c >= a):
            continue
        if same and c < a:
            continue
        gap = np.maximum(py[c:d].min(0) - px[a:b].max(0), px[a:b].min(0) - py[c:d].max(0))
        if (np.maximum(gap, 0) ** 2).sum() > eps * eps * (1 + 1e-9) + 1e-12:
            continue
        if b - a > LEAF or d - c > LEAF:
            m, k = (a + b) // 2, (c + d) // 2
            todo += [(p, q, r, s) for p, q in ((a, m), (m, b)) for r, s in ((c, k), (k, d))]
            continue
        near = sx[a:b] @ sy[c:d].T >= least - SLACK
        some = np.count_nonzero(near)
        if not some:
            continue
        if 16 * some > near.size:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
            i, j = i + a, j + c
        else:
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            good = np.einsum("ij,ij->i", x[i], y[j]) >= least
            i, j = i[good], j[good]
        if same:
            up = i < j
            i, j = i[up], j[up]
        if len(i):
            yield i, j


def epsilon_join(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so
    do vectors of different lengths. Rows that repeat an id are vectors of their own, and links count
    them all; their component is that of their class. A null id is a vector like any other and is never
    the smallest unless alone. Other columns are not read.
    """
    eps = float(np.sqrt(2 - 2 * least))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))

    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"

    def raw_rows(raws: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(float)

    def describe(batches):
        """Each row with its class; the first of a class in a batch has its components and their number there."""
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                unit, good = _matrix(part.column("v"))
                size = [len(x) if x.is_valid else 0 for x in part.column("v")]
                key = [int.from_bytes(hashlib.blake2b(p[: 8 * n], digest_size=8).digest(), "little", signed=True) if g else None for p, g, n in zip(_pack(unit), good, size)]
                times = Counter(key)
                raw, n = [], []
                for c, x in zip(key, part.column("v")):
                    first = c is not None and times[c] > 0
                    raw.append(x.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() if first else None)
                    n.append(times[c] if first else None)
                    times[c] = 0
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "cid", "n", "raw"])

    table = materialised(rows.mapInArrow(describe, "vec_id long, cid long, n long, raw binary"), "ego-vectors")
    classes = materialised(table.where("raw IS NOT NULL").groupBy("cid").agg(F.sum("n").alias("n"), F.first("raw").alias("raw")), "ego-classes")

    def moments(batches):
        total: dict[int, list[bytes]] = {}
        for b in batches:
            for raw in b.column("raw").to_pylist():
                total.setdefault(len(raw) // int(kind[2]), []).append(raw)
            for d, raws in list(total.items()):
                x = _unit(raw_rows(raws))
                for i, row in enumerate(np.vstack([x.sum(0), x.T @ x])):
                    yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([i]), pa.array([len(x)]), pa.array([row.tolist()], pa.list_(pa.float64()))], ["d", "i", "n", "row"])
            total = {}

    sums = classes.select("raw").mapInArrow(moments, "d long, i long, n long, row array<double>").select("d", "i", "n", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    axes: dict[int, np.ndarray] = {}
    got = sums.toPandas()  # the square of the vectors' length, whatever their number
    for d, part in got.groupby("d"):
        m = np.zeros((d + 1, d))
        m[part["i"], part["j"]] = part["x"]
        n = part["n"].iloc[0]
        values, vecs = np.linalg.eigh(m[1:] / n - np.outer(m[0] / n, m[0] / n))
        axes[int(d)] = np.ascontiguousarray(vecs[:, ::-1])
    shared = vectors.sparkSession.sparkContext.broadcast(axes)

    def grid(batches):
        for b in batches:
            cells = []
            for raw in b.column("raw").to_pylist():
                x = _unit(raw_rows([raw]))[0]
                p = x @ shared.value[len(x)][:, :DIMENSIONS]
                cells.append([len(x), *np.floor(p / eps).astype(int).tolist(), *[0] * (DIMENSIONS - len(p))])
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("n"), b.column("raw"), pa.array(cells, pa.list_(pa.int64()))], ["cid", "n", "raw", "cell"])

    n_classes = classes.count()
    block = min(max(block, n_classes // 16), block * LARGER)
    cut = max(1, -(-n_classes // (2 * block)))
    placed = classes.mapInArrow(grid, "cid long, n long, raw binary, cell array<long>")
    ordered = placed.repartitionByRange(cut, "cell", "cid").sortWithinPartitions("cell", "cid") if cut > 1 else placed.coalesce(1).sortWithinPartitions("cell", "cid")

    def cut_blocks(batches):
        held: list[tuple[int, int, bytes]] = []

        def made(part):
            x = raw_rows([r for _, _, r in part])
            p = _unit(x) @ shared.value[x.shape[1]][:, :DIMENSIONS]
            ids, weight = np.array([(c, n) for c, n, _ in part], "<i8").T
            name = int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x.shape[1]], pa.int64()), pa.array([p.min(0).tolist()], pa.list_(pa.float64())), pa.array([p.max(0).tolist()], pa.list_(pa.float64())), pa.array([ids.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())], ["block", "d", "lo", "hi", "ids", "weight", "x"])

        for b in batches:
            for c, n, u in zip(b.column("cid").to_pylist(), b.column("n").to_pylist(), b.column("raw").to_pylist()):
                if held and (len(held) >= block or len(held[0][2]) != len(u)):
                    yield made(held)
                    held = []
                held.append((c, n, u))
        if held:
            yield made(held)

    blocks = materialised(ordered.mapInArrow(cut_blocks, "block long, d long, lo array<double>, hi array<double>, ids binary, weight binary, x binary"), "ego-blocks")
    one, two = (blocks.select(*[F.col(c).alias(side + c) for c in blocks.columns]) for side in "ab")
    gaps = F.zip_with(F.zip_with("alo", "bhi", lambda x, y: x - y), F.zip_with("blo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g) <= eps * eps * (1 + 1e-9) + 1e-12
    # of both orders of a pair one is taken, by whether their sum is even, so that all tasks of the product have work
    even = F.col("ablock").bitwiseXOR(F.col("bblock")).bitwiseAND(F.lit(1)) == 0
    once = (F.col("ablock") == F.col("bblock")) | ((F.col("ablock") < F.col("bblock")) == even)
    # blocks are read from their table by each task of the product; nothing is shuffled or told to all
    both = one.join(two.hint("shuffle_replicate_nl"), (F.col("ad") == F.col("bd")) & once & near).drop("alo", "ahi", "blo", "bhi", "bd")

    def linked(r: dict) -> pa.RecordBatch | None:
        own, v = r["ablock"] == r["bblock"], shared.value[r["ad"]]
        sides = "a" if own else "ab"
        ids, weight = (np.frombuffer(b"".join(r[s + c] for s in sides), "<i8") for c in ("ids", "weight"))
        parts = [_unit(np.frombuffer(r[s + "x"], kind).reshape(-1, r["ad"]).astype(float)) for s in sides]
        turned = [x @ v for x in parts]
        found = list(join_intervals(parts[0], parts[-1], turned[0], turned[-1], eps, least, own))
        if not found:
            return None
        i, j = (np.concatenate(z) for z in zip(*found))
        j = j if own else j + len(parts[0])
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        root = _components(i, j, len(ids))
        k = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(links[k].astype(np.int64)), pa.array(ids[root[k]])], ["cid", "links", "to"])

    def compare(batches):
        for t in batches:
            for k in range(t.num_rows):
                made = linked(t.slice(k, 1).to_pylist()[0])
                if made is not None:
                    yield made

    found = materialised(both.mapInArrow(compare, "cid long, links long, to long"), "ego-links")
    parts = graph.components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = table.where("cid IS NOT NULL").groupBy("cid").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).join(counts, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = known.join(known.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # vectors that link with nothing are dealt out by their ids
    out = table.select("vec_id", F.col("cid").isNull().alias("alone"), F.coalesce("cid", F.xxhash64("vec_id", F.lit(1))).alias("cid")).join(known, "cid", "left")
    own = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.when(F.col("alone"), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
