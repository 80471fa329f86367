"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are numpy passes over each batch of texts; the trees are learned from a
bounded sample of labelled rows and flattened into arrays, so that scoring walks all
rows and all trees one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import NOT_SPACE, flat, mix, slices, word_hashes, words

#: Byte classes: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 . , ; : ' ", 7 ! ?, 8 other symbols, 9 | and tab, 10 not ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 8
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 10
_CLASS[0x20], _CLASS[[0x0A, 0x0D]] = 4, 5
_CLASS[[ord(c) for c in ".,;:'\""]], _CLASS[[ord(c) for c in "!?"]], _CLASS[[ord("|"), 9]] = 6, 7, 9
N_CLASSES = 11
_PART = 1 << 18
FEATURES = ("log_bytes", "log_words", *(f"class_{k}" for k in range(N_CLASSES)), "word_bytes", "longest_word", "distinct_words", "repeat_next", "longest_run", "distinct_triples", "capitalised", "symbol_words", "lines", "distinct_lines", "class_entropy")


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Different values in each document."""
    key = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    return np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES a document; an empty one has zeros."""
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(off)
    cls = _CLASS[buf]
    counts = np.zeros((n, N_CLASSES))
    for at in range(0, len(buf), _PART):  # texts of any length, a part at a time
        d0, d1 = int(np.searchsorted(off, at, "right")) - 1, int(np.searchsorted(off, min(at + _PART, len(buf)), "left"))
        own = np.repeat(np.arange(d1 - d0), np.diff(np.clip(off[d0 : d1 + 1], at, at + _PART)))
        counts[d0:d1] += np.bincount(own * N_CLASSES + cls[at : at + _PART], minlength=(d1 - d0) * N_CLASSES).reshape(-1, N_CLASSES)
    share = counts / np.maximum(size, 1)[:, None]
    starts, ends, first = words(buf, off, NOT_SPACE)
    nw = np.diff(first)
    many = np.maximum(nw, 1)
    out[:, 0], out[:, 1], out[:, 2 : 2 + N_CLASSES] = np.log1p(size), np.log1p(nw), share
    k = 2 + N_CLASSES
    logs = np.log(np.where(share > 0, share, 1))
    out[:, k + 10] = -(share * logs).sum(1)
    if len(starts):
        wdoc = np.repeat(np.arange(n), nw)
        long = ends - starts
        h = word_hashes(buf, starts, ends)
        out[:, k] = np.bincount(wdoc, long, n) / many
        np.maximum.at(out[:, k + 1], wdoc, np.log1p(long))
        out[:, k + 2] = _distinct(wdoc, h, n) / many
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
        out[:, k + 3] = np.bincount(wdoc, same, n) / many
        head = np.flatnonzero(~same)
        run = np.diff(np.append(head, len(h)))
        np.maximum.at(out[:, k + 4], wdoc[head], np.log1p(run))
        if len(h) > 2:
            three = mix(h[:-2] + np.uint64(3) * h[1:-1] + np.uint64(7) * h[2:])
            ok = wdoc[:-2] == wdoc[2:]
            out[:, k + 5] = _distinct(wdoc[:-2][ok], three[ok], n) / many
        out[:, k + 6] = np.bincount(wdoc, cls[starts] == 2, n) / many
        out[:, k + 7] = np.bincount(wdoc, cls[ends - 1] >= 7, n) / many
    lstart, lend, lfirst = words(buf, off, _LINE)
    nl = np.diff(lfirst)
    out[:, k + 8] = nl / np.maximum(nw, 1)
    if len(lstart):
        ldoc = np.repeat(np.arange(n), nl)
        out[:, k + 9] = _distinct(ldoc, word_hashes(buf, lstart, lend), n) / np.maximum(nl, 1)
    return out


_LINE = np.ones(256, bool)
_LINE[[0x0A, 0x0D]] = False


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays: node -> feature, bound, left, right, value; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[:, None], len(x), axis=1)
        row = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.bound[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-np.clip(self.start + self.value[node].sum(0), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boosts logistic loss; splits are searched in histograms of gradients over quantile bins.

    Without rows the score is 0.5; with one class only, it is near that class everywhere.
    """
    n, m = x.shape
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(bounds[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), np.int64)
    rate_of = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(rate_of / (1 - rate_of)))
    f = np.full(n, start)
    feature, bound, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(value)
        feature.append(0), bound.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(rounds if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        root = leaf(0.0)
        roots.append(root)
        todo = [(root, np.arange(n), 0)]
        while todo:
            node, rows, at = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            value[node] = -rate * sg / (sh + ridge)
            f_gain, best = 1e-6, None
            if at < depth and len(rows) >= 2 * least:
                for j in range(m):
                    size = len(bounds[j]) + 1
                    if size < 2:
                        continue
                    b = binned[rows, j]
                    lg, lh, lc = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1], np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
                    gain[(lc < least) | (len(rows) - lc < least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > f_gain:
                        f_gain, best = gain[k], (j, k)
            if best is None:
                f[rows] += value[node]
                continue
            j, k = best
            feature[node], bound[node] = j, bounds[j][k]
            goes = binned[rows, j] <= k
            left[node], right[node] = leaf(0.0), leaf(0.0)
            todo += [(left[node], rows[goes], at + 1), (right[node], rows[~goes], at + 1)]
    a = np.array
    return Trees(a(roots, np.int64), a(feature, np.int64), a(bound, float), a(left, np.int64), a(right, np.int64), a(value, float), start, depth)


def _scored(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield make(b, statistics(*flat(b.column("text"))))

    return run


def learn(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, **options) -> Trees:
    """Trees from labelled documents; at most `most_rows` labels, those whose ids have the smallest hashes.

    That bound is the only sample: the labels (a few bytes each) are broadcast, the text of
    labelled documents alone is turned into statistics, and those reach the driver, some 200
    bytes a row. Null labels and labels other than 0 and 1 are left out; repeated labels all count.
    """
    picked = labels.where(F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", F.col("quality").cast("long").alias("quality"))), "doc_id").select("doc_id", "text", "quality")
    make = lambda b, x: pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])
    got = rows.mapInArrow(_scored(make), "doc_id long, quality long, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["quality"].to_numpy(float), **options)


def score(docs: DataFrame, trees: Trees, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` with score, 0 to 1: one row for each row, null text as empty text, texts of any length whole.

    Equal texts have equal scores, whatever their ids; no rows give no rows. Other columns are not read.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in slices(batches, "text"):
            s = model.value.score(statistics(*flat(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s, pa.float64())], [*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, score double")
