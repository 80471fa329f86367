"""Suffix-array dedup: removes each byte of a 100-byte string that also starts earlier.

Segments with a common anchor (see `anchors`) meet in one partition, where they are laid
end to end and their suffixes sorted in two stages: a suffix smaller than its successor is
sorted directly, by eight bytes at a time and to the depth that matters; the others follow
by one scan over the buckets of first bytes, in which every suffix read places its
predecessor. Common prefixes of neighbours in that order then group equal windows; the
earliest of a group, by document and place, stays and the others are removed. A segment that
occurs more than once is laid out twice, and what the order says about its second copy is
carried to all its later places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import anchors
from ._text import byte_grams, flat, materialised, ragged, slices

GRAM = 16


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the ones that start one byte later; the last is not."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    return np.repeat(rises, np.diff(np.append(-1, ends)))


def _direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes: by eight bytes, then ties by the next eight."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    group = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(at) else np.zeros(0, np.int64)
    last = len(words) - 1
    live = np.arange(len(at))
    for k in range(8, depth, 8):
        tied = np.zeros(len(live), bool)
        eq = group[live][1:] == group[live][:-1] if len(live) else np.zeros(0, bool)
        tied[1:] |= eq
        tied[:-1] |= eq
        live = live[tied]
        if not len(live):
            break
        place = at[live] + k
        key = np.where(place <= last, words[np.minimum(place, last)], 0)
        g = group[live]
        # groups that differ here have to be ordered; equal ones stay as they are
        uneven = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        if not uneven.any():
            continue
        new = np.append(0, np.cumsum(g[1:] != g[:-1]))
        differs = np.zeros(new[-1] + 1, bool)
        differs[new[1:][uneven]] = True
        own = np.flatnonzero(differs[new])
        o = own[np.lexsort((key[own], g[own]))]
        at[live[own]] = at[live[o]]
        key[own] = key[o]
        group[live] = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (g[1:] != g[:-1])))
    return at


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """The wanted suffixes (a mask) in order of their first `depth` bytes; `words` are words_of(text)."""
    n = len(text)
    rises = smaller_than_next(text)
    # a suffix that is not smaller than its successor is placed by it, so its whole chain is needed
    need = wanted.copy()
    run = np.flatnonzero(need & ~rises)
    while len(run):
        run = run[run + 1 < n] + 1
        run = run[~need[run]]
        need[run] = True
        run = run[~rises[run]]
    direct = _direct(np.flatnonzero(need & rises), words, depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(read: np.ndarray) -> None:
        before = read[read > 0] - 1
        before = before[need[before] & ~rises[before]]
        if len(before):
            c = text[before]
            o = np.argsort(c, kind="stable")
            before, c = before[o], c[o]
            heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            for a, z in zip(heads.tolist(), np.append(heads[1:], len(c)).tolist()):
                placed[c[a]].append(before[a:z])

    if n and need[n - 1]:
        placed[text[n - 1]].append(np.array([n - 1]))  # the successor of the last suffix is empty, the smallest of all
    for c in range(256):
        k = 0
        while k < len(placed[c]):  # a run of one byte places suffixes in its own bucket
            out.append(placed[c][k])
            induce(placed[c][k])
            k += 1
        if cut[c] < cut[c + 1]:
            out.append(direct[cut[c] : cut[c + 1]])
            induce(out[-1])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def alike(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first, whether its common prefix with the one before is `depth` bytes or more."""
    live = np.arange(1, len(order))
    for k in [*range(0, depth - 7, 8), depth - 8]:
        live = live[words[order[live] + k] == words[order[live - 1] + k]]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[live - 1] = True
    return out


def repeats(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes of each segment that lie in a window which also starts earlier, and which segments' later copies go."""
    times = table.column("times").to_numpy()
    # the second copy of a segment stands for all later ones
    source = np.append(np.arange(len(times)), np.flatnonzero(times > 1))
    text, off = flat(table.column("data").combine_chunks().take(pa.array(source)))
    nn, did, chk, start, n = (table.column(c).to_numpy()[source] for c in ("nn", "did", "chk", "start", "n"))
    copy = np.arange(len(source)) >= len(times)
    wanted = np.zeros(len(text), bool)
    wanted[ragged(off[:-1], n)] = True
    words = words_of(text)
    order = two_stage(text, wanted, window, words)
    same = alike(order, words, window)
    keep = np.zeros(len(order), bool)
    keep[1:] |= same
    keep[:-1] |= same
    at = order[keep]
    row = np.searchsorted(off, at, "right") - 1
    # windows in order of documents and places, a copy behind its original
    _, doc = np.unique(np.rec.fromarrays([nn, did, chk]), return_inverse=True)
    rank = (doc[row] << 37) | ((start[row] + at - off[row]) << 1) | copy[row]
    head = np.flatnonzero(np.append(True, ~same)[keep])
    least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(rank)))) if len(rank) else rank
    at = np.sort(at[rank != least])
    row = np.searchsorted(off, at, "right") - 1
    whole = np.bincount(row, minlength=len(source)) == n
    again = np.zeros(len(times), bool)
    again[source[copy]] = whole[copy]
    at, row = at[~copy[row]], row[~copy[row]]
    # neighbouring windows of a segment make one interval
    new = np.append(True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window)) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return row[head], at[head] - off[row[head]], (at[last] - off[row[last]] + window) if len(at) else at, again


def _method(window: int) -> anchors.Method:
    if window < 8:
        raise ValueError("windows have at least eight bytes")
    return anchors.Method(window=window, gram=max(min(GRAM, window // 2), window - anchors.MOST_WINDOWS + 1), units=lambda buf, off: anchors.Units(buf, off, buf.tobytes()), grams=byte_grams, compare=lambda t: repeats(t, window))


def dedup(docs: DataFrame, *, window: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, and the columns of `keep`.

    With `with_text` also `kept`, the remaining bytes as text; a character that loses a part of its
    bytes is left out whole there, though not in the digest.

    Null text is empty. Rows that repeat an id are documents of their own, in order of a checksum of
    their texts; of rows equal in id and text one stays. A null id stands before all others. Other columns are not read.
    """
    rows = anchors.keyed(docs, id_col, text_col, keep)
    kept = [c for c in rows.columns if c.startswith("_keep_")]
    fields = "nn int, did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "") + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    # rows equal in id and text: the first is a document, what the others hold stands there already
    twins = rows.groupBy(*anchors.KEY).count().where("count > 1").select(*anchors.KEY)
    others = None
    if not twins.isEmpty():
        twins = materialised(twins, "suffix-twins")
        numbered = materialised(rows.join(twins, anchors.KEY, "left_semi").withColumn("number", F.row_number().over(W.partitionBy(*anchors.KEY).orderBy("nn"))), "suffix-twin-rows")
        others = numbered.where("number > 1").select(*rows.columns)
        rows = rows.join(twins, anchors.KEY, "left_anti").select(*rows.columns).union(numbered.where("number = 1").select(*rows.columns))
    joined = rows.join(anchors.find(rows, _method(window)), anchors.KEY, "left")

    def apply(batches):
        for b in slices(batches, "text"):
            buf, off = flat(b.column("text"))
            raw = memoryview(buf.tobytes())
            rows_out = []
            for r, (nn, did, spans, carried) in enumerate(zip(*(b.column(c).to_pylist() for c in ("nn", "did", "spans", "carried")))):
                n = int(off[r + 1] - off[r])
                s, e = anchors.intervals(spans, carried)
                h, at, left = hashlib.sha256(), int(off[r]), []
                for x, y in zip([*s.tolist(), n], [*e.tolist(), n]):
                    piece = raw[at : int(off[r]) + x]
                    h.update(piece)
                    left.append(piece)
                    at = int(off[r]) + y
                rows_out.append((nn, did, n, int((e - s).sum()), len(s), h.hexdigest(), *([b"".join(left).decode("utf-8", "ignore")] if with_text else [])))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["nn", "did", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*rows_out), types)], *[b.column(c) for c in kept]], [*names, *kept])

    names = ["nn", "did", "chk", "text", *kept]
    out = joined.select(*names, "spans", "carried").mapInArrow(apply, fields)
    if others is not None:
        gone = F.when(F.octet_length("text") >= window, F.octet_length("text")).otherwise(0).cast("long")
        left = F.when(F.octet_length("text") >= window, "").otherwise(F.col("text"))
        out = out.union(others.select("nn", "did", F.octet_length("text").cast("long"), gone, F.when(gone > 0, 1).otherwise(0).cast("long"), F.sha2(left.cast("binary"), 256), *[left] * with_text, *kept))
    return out.select(anchors.public_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text, *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
