"""Substring dedup by repeated-phrase automata.

Segments of documents that share an anchor (see `anchors`) meet in one shard. Windows of
words that seem to recur there, by their hashes, are confirmed candidates; they are compiled
into Aho-Corasick automata of a bounded number of phrases, and all segments of the shard
stream through each automaton, which locates every occurrence word for word. A phrase that
is located at two places or more is a repeated one, and its occurrences are what goes. No
document can hold a phrase without its anchor, so a document's segments need only the shards
of their anchors, and the work grows with the documents and not with documents times shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import anchors
from ._text import NOT_SPACE, flat, mix, slices, spaced_words, windows, words

GRAM = 8
#: Words are characters of the automata's alphabet, in two characters each where there are more; 0 ends a segment.
_LETTERS = 0x10FFFF - 0x800
#: Phrases of one automaton, each of as many nodes as it has words.
PHRASES = 20_000


def units(buf: np.ndarray, off: np.ndarray) -> anchors.Units:
    """Words as symbols, in a text that has one space between them."""
    return anchors.Units(*spaced_words(buf, off, NOT_SPACE))


def spell(ids: np.ndarray, n_ids: int) -> tuple[str, int]:
    """Word numbers as text, and the characters a word takes."""
    if n_ids > _LETTERS:
        low, high = ids % 0x8000, 0x10000 + ids // 0x8000
        ids, width = np.stack([high, low], 1).ravel(), 2
    else:
        ids, width = np.where(ids >= 0xD800, ids + 0x800, ids), 1
    return ids.astype("<u4").tobytes().decode("utf-32-le"), width


def locate(text: str, width: int, phrases: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence of the phrases in a text of spelled words."""
    import ahocorasick

    found = []
    for at in range(0, len(phrases), PHRASES):
        machine = ahocorasick.Automaton()
        for k, x in enumerate(phrases[at : at + PHRASES], at):
            machine.add_word(x, (k, len(x) - 1))
        machine.make_automaton()
        found += [(k, last - n) for last, (k, n) in machine.iter(text)]
    got = np.array(found, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1] // width


def chains(ids: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that only ever occur together: (first, length) of one run of windows for each such group.

    `ids` numbers the windows in order of place, and `follows` says which stand right behind the one before them.
    Two neighbours belong together if each stands beside the other wherever it occurs.
    """
    n = int(ids.max()) + 1 if len(ids) else 0
    after, before = np.full(len(ids), -1), np.full(len(ids), -1)
    k = np.flatnonzero(follows)
    after[k - 1], before[k] = ids[k], ids[k - 1]
    always = []
    for side in (after, before):
        low, high = np.full(n, n), np.full(n, -2)
        np.minimum.at(low, ids, side)
        np.maximum.at(high, ids, side)
        always.append(np.where(low == high, low, -1))
    glued = np.zeros(len(ids), bool)  # with the one before
    glued[k] = (always[0][ids[k - 1]] == ids[k]) & (always[1][ids[k]] == ids[k - 1])
    head = np.flatnonzero(~glued)
    _, one = np.unique(ids[head], return_index=True)
    return head[one], np.diff(np.append(head, len(ids)))[one]


def recurring(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the words in recurring windows of segments, and which segments recur whole."""
    n, times = table.column("n").to_numpy(), table.column("times").to_numpy()
    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    for raw in table.column("data").to_pylist():
        ids += [numbers.setdefault(w, len(numbers) + 1) for w in raw.split(b" ")]
        ids.append(0)
    ids = np.array(ids, np.int64)
    # windows that may recur, by their hashes; those that reach over the end of a segment are none
    size = n + window
    first = np.cumsum(size) - size
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.arange(len(n)), n)
    h = windows(mixed(ids), window)[at]
    _, back = np.unique(h, return_inverse=True)
    maybe = np.flatnonzero(np.bincount(back, times[row])[back] > 1)
    at = at[maybe]
    head, long = chains(back[maybe], np.append(False, (at[1:] == at[:-1] + 1) & (row[maybe][1:] == row[maybe][:-1])) if len(at) else np.zeros(0, bool))
    text, width = spell(ids, len(numbers) + 1)
    phrases = sorted({text[a * width : (a + k + window - 1) * width] for a, k in zip(at[head].tolist(), long.tolist())})
    phrase, place = locate(text, width, phrases)
    words_in = np.array([len(x) // width for x in phrases], np.int64)
    own = np.searchsorted(first, place, "right") - 1
    k = np.flatnonzero(np.bincount(phrase, times[own], len(phrases))[phrase] > 1)
    k = k[np.argsort(place[k], kind="stable")]
    row, start, end = own[k], place[k] - first[own[k]], place[k] - first[own[k]] + words_in[phrase[k]]
    # windows of a row that are found: those of its occurrences, each counted once
    done = np.zeros(len(ids) + 1, np.int32)
    np.add.at(done, place[k], 1)
    np.add.at(done, place[k] + words_in[phrase[k]] - window + 1, -1)
    found = np.append(0, np.cumsum(np.cumsum(done[:-1]) > 0))
    again = (found[first + n] - found[first] == n) & (times > 1)
    return row, start, end, again


def mixed(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def _method(window: int) -> anchors.Method:
    return anchors.Method(window=window, gram=max(min(GRAM, max(1, window // 3)), window - anchors.MOST_WINDOWS + 1), units=units, grams=windows, compare=lambda t: recurring(t, window))


def dedup(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row, and the columns of `keep`; with `with_text` also `kept`.

    A word goes if it lies in a window of `window` words that occurs anywhere else, in the same
    document too. Null and empty texts have no words; equal rows are documents of their own, so
    their windows recur. Texts shorter than a window stay whole. Other columns are not read.
    """
    rows = anchors.keyed(docs, id_col, text_col, keep)
    joined = rows.join(anchors.find(rows, _method(window)), anchors.KEY, "left")
    kept = [c for c in rows.columns if c.startswith("_keep_")]
    fields = "nn int, did long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "") + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def apply(batches):
        for b in slices(batches, "text"):
            buf, off = flat(b.column("text"))
            starts, ends, first = words(buf, off, NOT_SPACE)
            stays = np.ones(len(starts), bool)
            for r, (spans, carried) in enumerate(zip(b.column("spans").to_pylist(), b.column("carried").to_pylist())):
                if spans or carried:
                    for s, e in zip(*(x + first[r] for x in anchors.intervals(spans, carried))):
                        stays[s:e] = False
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            own = np.flatnonzero(stays)
            # a kept word and one space, but for a document's last
            inner = np.append(doc[own][1:] == doc[own][:-1], False) if len(own) else np.zeros(0, bool)
            edges = np.zeros(len(buf) + 2, np.int8)
            np.add.at(edges, starts[own], 1)
            np.add.at(edges, ends[own] + inner, -1)
            text = buf.copy()
            text[ends[own][inner]] = 0x20
            chosen = np.cumsum(edges[:-2], dtype=np.int8).astype(bool) if len(buf) else np.zeros(0, bool)
            out = memoryview(text[chosen].tobytes())
            cut = np.append(0, np.cumsum(chosen))[off]
            pieces = [out[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            n_words = np.diff(first)
            n_kept = np.bincount(doc[own], minlength=b.num_rows)
            cols = [b.column("nn"), b.column("did"), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in pieces])]
            if with_text:
                cols.append(pa.array([bytes(p).decode() for p in pieces]))
            yield pa.RecordBatch.from_arrays([*cols, *[b.column(c) for c in kept]], ["nn", "did", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text, *kept])

    out = joined.select("nn", "did", "chk", "text", *kept, "spans", "carried").mapInArrow(apply, fields)
    return out.select(anchors.public_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", *["kept"] * with_text, *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
