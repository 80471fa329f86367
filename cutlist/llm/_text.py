"""Vectorised text helpers that the operators of this subpackage share inside Spark tasks.

A batch of texts is one flat uint8 array plus document offsets; words, hashes of
windows and sliding minima are numpy passes over that array, so a task's cost is
a few nanoseconds a byte. Arrays of eight bytes a byte are made a block at a time, so
that memory beyond the text itself is bounded for texts of any length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes that end a word in `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: A number for each byte at each of the first places of a word.
_PLACES = 64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, (_PLACES, 256), np.uint64)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines of a cluster share.

    Where the setting is unset a session on one machine gets a folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="cutlist-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(v: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order; not linear in either, so that no pattern of symbols cancels out."""
    v = a ^ (a >> np.uint64(32))
    v *= np.uint64(0x9DDFEA08EB382D69)
    v ^= v >> np.uint64(29)
    v += b
    v *= np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(v)


def windows(h: np.ndarray, width: int, reach: int = 1) -> np.ndarray:
    """Hashes of each `width` neighbours, put together from halves; h covers `reach` of them already."""
    while reach * 2 <= width:
        h = pair(h[:-reach], h[reach:]) if len(h) > reach else h[:0]
        reach *= 2
    rest = width - reach
    return pair(h[:-rest], h[rest:]) if rest and len(h) > rest else h[:0] if rest else h


def byte_grams(buf: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each `width` neighbouring bytes; the first eight go in as they are."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width < 8:
        buf = np.concatenate([buf, np.zeros(8 - width, np.uint8)])
    v = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,)).copy()
    if width < 8:
        v &= np.uint64(2 ** (8 * width) - 1)
    return windows(v, width, 8) if width > 8 else mix(v)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Hash of each stretch of bytes: the sum of random numbers for its bytes at their places, with its length.

    Different stretches have equal hashes with a chance of one in 2^64 whatever they hold.
    """
    out = np.zeros(len(starts), np.uint64)
    size = np.asarray(ends - starts, np.int64)
    upto = np.cumsum(size)
    k = 0
    while k < len(starts):  # stretches of about `block` bytes at a time, or one of more
        z = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + 4 * block, "right")))
        n = size[k:z]
        if z == k + 1 and n[0] > 8 * block:
            total = 0
            for at in range(0, int(n[0]), block):
                total += int(_placed(buf[starts[k] + at : min(starts[k] + at + block, ends[k])], np.arange(at, min(at + block, int(n[0])))).sum(dtype=np.uint64))
            out[k] = np.uint64(total % 2**64)
        else:
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
            at = place + np.repeat(starts[k:z], n)
            some = np.flatnonzero(n)
            if len(some):
                out[k + some] = np.add.reduceat(_placed(buf[at], place), first[some])
        k = z
    out += size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def _placed(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    v = _TABLE.ravel()[np.minimum(place, _PLACES - 1) * 256 + data]
    far = np.flatnonzero(place >= _PLACES - 1)
    if len(far):
        v[far] = mix((place[far].astype(np.uint64) << np.uint64(8) | data[far]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1B873593CC9E2D51))
    return v


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its documents' offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about `most` bytes of the column, or one document."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = flat(b.column(column))
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(off, off[at] + most, "right")) - 1
            end = min(max(end, at + 1), b.num_rows)
            yield b.slice(at, end - at)
            at = end


def words(buf: np.ndarray, off: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    n = len(buf)
    inside = word_byte[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    close = inside
    close = close.copy()
    close[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, off)


def spaced_words(buf: np.ndarray, off: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document, the words with one space between them, begin and end of each there)."""
    buf, off = np.insert(buf, off[1:], 0x20), off + np.arange(len(off))  # a space ends each document
    starts, ends, first = words(buf, off, word_byte)
    inside = word_byte[buf]
    text = np.where(inside, buf, np.uint8(0x20))
    inside[ends] = True
    size = ends - starts
    begin = np.cumsum(size + 1) - (size + 1)
    return word_hashes(buf, starts, ends), first, text[inside].tobytes(), begin, begin + size


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - first, count)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    if len(a) < width:
        return a[:0]
    reach, cur = 1, a
    while reach * 2 <= width:
        cur = np.minimum(cur[:-reach], cur[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(cur[:-rest], cur[rest:]) if rest else cur


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal intervals of the union of [start, end); touching ones merge."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]
