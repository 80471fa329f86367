"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of `window` consecutive words of each benchmark item; an
item of fewer words is one pattern of its own length. For each pattern length there is
a shift table over blocks of two words: where a block stands in no pattern, the search
moves on by a whole pattern length; where it ends a pattern, the block's hash selects a
bucket of patterns, and comparing the words themselves confirms an occurrence. The
search pointers of all stretches of a batch move at once, as one numpy array.

The benchmark is read in blocks of a checked size. One block is searched as documents are
read, and they are not shuffled. Where there are more, each block is a pass of its own that
writes its hits to a table, and documents then join their hits by a hash of their text, so
that growth of the benchmark adds passes and no task or machine holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import ALNUM, LOWER, covered, flat, materialised, mix, pair, ragged, slices, spaced_words

#: Stretches that one search pointer walks over, in words.
LANE = 512
_TABLE = 1 << 18


@dataclass
class Length:
    """Tables for patterns of one length, in order of the hashes of their last blocks."""

    m: int
    shift: np.ndarray
    suffix: np.ndarray
    start: np.ndarray  # a pattern's first word among all words
    owner: np.ndarray  # its item


@dataclass
class Patterns:
    """All patterns of a block of the benchmark as flat tables over its words."""

    ids: list[str | None]
    hashes: np.ndarray
    text: bytes
    begin: np.ndarray
    end: np.ndarray
    lengths: list[Length]


def _last(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hash of the block of two words that ends at a place; of one word where patterns have no more."""
    return pair(h[at - 1], h[at]) if m > 1 else mix(h[at].copy())


def compile_patterns(items: list[tuple[str | None, str | None]], window: int) -> Patterns:
    """Tables of all windows of the given items; those without id own patterns that name no item."""
    buf, off = flat(pa.array([t for _, t in items], pa.large_string()))
    h, first, text, begin, end = spaced_words(LOWER[buf], off, ALNUM)
    n = np.diff(first)
    out = Patterns([i for i, _ in items], h, text, begin.astype(np.int32), end.astype(np.int32), [])
    for m in np.unique(np.minimum(n[n > 0], window)).tolist():
        own = np.flatnonzero(np.minimum(n, window) == m)
        start = ragged(first[:-1][own], n[own] - m + 1)
        owner = np.repeat(own, n[own] - m + 1)
        block = _last(h, start + m - 1, m)
        o = np.argsort(block, kind="stable")
        shift = np.full(_TABLE, max(m - 1, 1), np.int32)
        for j in range(1, m) if m > 1 else ():
            np.minimum.at(shift, (_last(h, start + j, m) & np.uint64(_TABLE - 1)).astype(np.int64), m - 1 - j)
        if m == 1:
            shift[(block & np.uint64(_TABLE - 1)).astype(np.int64)] = 0
        out.lengths.append(Length(m, shift, block[o], start[o].astype(np.int32), owner[o].astype(np.int32)))
    return out


def occurrences(h: np.ndarray, first: np.ndarray, text: bytes, begin: np.ndarray, end: np.ndarray, patterns: Patterns, tables: Length) -> tuple[np.ndarray, np.ndarray]:
    """All (first word, item) of the patterns of one length in documents whose words have hashes h and stand in `text`."""
    m = tables.m
    places = np.maximum(np.diff(first) - m + 1, 0)
    lanes = (places + LANE - 1) // LANE
    lane_doc = np.repeat(np.arange(len(places)), lanes)
    k = ragged(np.zeros(len(lanes), np.int64), lanes)
    lo = first[:-1][lane_doc] + k * LANE
    hi = np.minimum(lo + LANE, first[:-1][lane_doc] + places[lane_doc])
    at, hi = lo + m - 1, hi + m - 1
    found = []
    while len(at):
        block = _last(h, at, m)
        move = tables.shift[(block & np.uint64(_TABLE - 1)).astype(np.int64)]
        hit = np.flatnonzero(move == 0)
        if len(hit):
            l, r = np.searchsorted(tables.suffix, block[hit], "left"), np.searchsorted(tables.suffix, block[hit], "right")
            pattern, where = ragged(l, r - l), np.repeat(at[hit] - m + 1, r - l)
            ok = np.ones(len(where), bool)
            for j in range(m):
                ok &= h[where + j] == patterns.hashes[tables.start[pattern] + j]
            found.append(np.stack([where[ok], pattern[ok]]))
        at = at + np.maximum(move, 1)
        live = at < hi
        at, hi = at[live], hi[live]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, pattern = np.concatenate(found, 1)
    start = tables.start[pattern]
    spans = (begin[where], end[where + m - 1], patterns.begin[start], patterns.end[start + m - 1])
    sure = np.array([text[a:z] == patterns.text[p:q] for a, z, p, q in zip(*(x.tolist() for x in spans))], bool)
    return where[sure], tables.owner[pattern[sure]].astype(np.int64)


def search(col: pa.Array, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each document and one more, first word, end and item of each occurrence) of a slice."""
    buf, off = flat(col)
    h, first, text, begin, end = spaced_words(LOWER[buf], off, ALNUM)
    found = [np.zeros((3, 0), np.int64)]
    for tables in patterns.lengths:
        where, item = occurrences(h, first, text, begin, end, patterns, tables)
        found.append(np.stack([where, where + tables.m, item]))
    return first, *np.concatenate(found, 1)


def blocks(benchmark: DataFrame, most_bytes: int) -> tuple[int, Iterator[list[tuple[str | None, str]]]]:
    """The number of blocks of about `most_bytes` of text, or one item of more, and their items; each block is collected for itself."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // most_bytes))
    part = lambda k: items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return n, ([(r.item_id, r.text) for r in part(k).collect()] for k in range(n))


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_KINDS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _rows(b: pa.RecordBatch, keep: tuple[str, ...], n_words: np.ndarray, n_hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items], pa.string()), pa.array(n_hit > 0)]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *columns], [*keep, *_RESULT])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, most_bytes: int = 4 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `keep` with n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs.

    Null and empty texts have no words and no hits. Benchmark rows without text or words
    are no patterns; ids are of any type and compared as strings, items that repeat an id count
    once, those without id count for n_hit and contaminated only. Texts of any length are searched
    whole, rows that repeat each for itself. Other columns are not read.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    n, parts = blocks(benchmark, most_bytes)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(compile_patterns(next(parts), window))

        def run(batches):
            patterns = shared.value
            for b in slices(batches, "text"):
                first, where, upto, item = search(b.column("text"), patterns)
                hit = np.append(0, np.cumsum(covered(where, upto, int(first[-1]))))
                named: list[set[str]] = [set() for _ in range(b.num_rows)]
                for d, i in np.unique(np.stack([np.searchsorted(first, where, "right") - 1, item]), axis=1).T.tolist():
                    if patterns.ids[i] is not None:
                        named[d].add(patterns.ids[i])
                yield _rows(b, keep, np.diff(first), hit[first[1:]] - hit[first[:-1]], [list(x) for x in named])

        return rows.mapInArrow(run, f"{fields}, {_KINDS}")
    key = [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")]
    passes = []
    for items in parts:
        shared = docs.sparkSession.sparkContext.broadcast(compile_patterns(items, window))

        def one(batches, shared=shared):
            patterns = shared.value
            for b in slices(batches, "text"):
                first, where, upto, item = search(b.column("text"), patterns)
                doc = np.searchsorted(first, where, "right") - 1
                for d in np.unique(doc).tolist():
                    k = doc == d
                    spans = np.unique(np.stack([where[k], upto[k]], 1) - first[d], axis=0).astype("<i8")
                    ids = sorted({patterns.ids[i] for i in np.unique(item[k]).tolist()} - {None})
                    yield pa.RecordBatch.from_arrays([b.column("_k1").slice(d, 1), b.column("_k2").slice(d, 1), pa.array([spans.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.string()))], ["_k1", "_k2", "_spans", "_ids"])

        texts = docs.where("text IS NOT NULL").select(*key, "text")
        found = texts.mapInArrow(one, "_k1 long, _k2 long, _spans binary, _ids array<string>")
        passes.append(materialised(found.groupBy("_k1", "_k2").agg(F.first("_spans").alias("_spans"), F.first("_ids").alias("_ids")), "decontaminate-hits"))
        shared.unpersist()
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.union(more)
    hits = hits.groupBy("_k1", "_k2").agg(F.collect_list("_spans").alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_ids"))).alias("_ids"))
    joined = rows.select("*", *key).join(hits, ["_k1", "_k2"], "left").select(*rows.columns, "_spans", "_ids")

    def finish(batches):
        for b in slices(batches, "text"):
            buf, off = flat(b.column("text"))
            n_words = np.diff(spaced_words(LOWER[buf], off, ALNUM)[1])
            n_hit = np.zeros(b.num_rows, np.int64)
            for d, spans in enumerate(b.column("_spans").to_pylist()):
                if spans:
                    at = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
                    n_hit[d] = covered(at[:, 0], at[:, 1], int(n_words[d])).sum()
            yield _rows(b, keep, n_words, n_hit, [x or [] for x in b.column("_ids").to_pylist()])

    return joined.mapInArrow(finish, f"{fields}, {_KINDS}")
