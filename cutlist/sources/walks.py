"""The nesting of many small files at once, as columns of numbers: what `containers.elements` and `walk_boxes` find one by one.

A level is a set of ranges in the bytes of a batch, which step from one element to the next together; where few are
left, and in large files, the rest is walked one by one. Spark deals the files out and works on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ranges that are stepped together, at least; bytes and files that are walked at once, and rows given out at once.
FEW, MOST_BYTES, MOST_FILES, MOST_ROWS = 16, 8 << 20, 4_000, 20_000
#: By the first byte of a number: its length (0: none); by its length: bits to shift out of eight bytes, and the highest value.
LENGTH = np.array([0] + [9 - k.bit_length() for k in range(1, 256)])
SHIFT = np.array([0] + [64 - 8 * n for n in range(1, 9)], np.uint64)
MOST = np.array([(1 << 7 * n) - 1 for n in range(9)])


def spread(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all bytes of strings of some lengths."""
    return np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def nth(*keys: np.ndarray) -> np.ndarray:
    """Number of each row among those with the same keys, in order."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    begins = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    return out


class Level(NamedTuple):
    """Elements below each range, in order: the range, the element's name or number, its place, and where its payload starts and stops."""

    owner: np.ndarray
    name: np.ndarray
    at: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    def where(self, rows: np.ndarray) -> Level:
        return Level(*(x[rows] for x in self))


class Bytes:
    """Contents of some files, one behind the other; a null content is empty."""

    def __init__(self, content: pa.Array):
        c = pc.fill_null(content, b"").cast(pa.large_binary())
        ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        self.first, self.last = ends[:-1] - ends[0], ends[1:] - ends[0]
        self.data = np.zeros(ends[-1] - ends[0] + 24, np.uint8)
        self.data[:-24] = np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.view = memoryview(self.data)
        self._words = np.ndarray(len(self.data) - 7, ">u8", self.data, strides=(1,))

    def word(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes at a place as a number, of which those behind the file are anything."""
        return self._words[at].astype(np.uint64)

    def number(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Unsigned numbers of up to seven bytes; of none, 0."""
        n = stop - start
        return np.where(n > 0, self.word(start) >> SHIFT[np.minimum(n, 8)], 0).astype(np.int64)

    def numbers(self, start: np.ndarray, stop: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned numbers of 64 bits, of however many bytes, and which of them there are: none without bytes, none that is larger."""
        n = stop - start
        known = known & (n > 0)
        value = self.word(start) >> SHIFT[np.minimum(n, 8)]
        for k in np.flatnonzero(known & (n > 8)).tolist():
            whole = int.from_bytes(self.view[start[k] : stop[k]], "big")
            known[k] = whole < 1 << 64
            value[k] = whole if known[k] else 0
        return value, known

    def vint(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `containers.vint` without its mark, and lengths; 0 where there is none."""
        n = LENGTH[self.data[at]]
        value = (self.word(at) >> SHIFT[n]).astype(np.int64) & MOST[n]
        return np.where(value == MOST[n], -1, value), n

    def _element(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        n = LENGTH[self.data[at]]
        name = (self.word(at) >> SHIFT[n]).astype(np.int64)
        good = (n > 0) & (at + n < end)
        place = np.where(good, at + n, at)
        m = LENGTH[self.data[place]]
        size = (self.word(place) >> SHIFT[m]).astype(np.int64) & MOST[m]
        start = place + m
        stop = np.where(size == MOST[m], end, start + size)
        return name, start, stop, good & (m > 0) & (start <= end) & (stop <= end)

    def _box(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        word = self.word(at)
        size = (word >> np.uint64(32)).astype(np.int64)
        wide = size == 1
        good = at + np.where(wide, 16, 8) <= end
        if wide.any():
            size = np.where(wide, self.word(np.minimum(at + 8, len(self.data) - 8)).astype(np.int64), size)
        size = np.where(size == 0, end - at, size)
        head = np.where(wide, 16, 8)
        # a size that is too large for a place is beyond the end, too
        return (word & np.uint64(0xFFFFFFFF)).astype(np.int64), at + head, at + np.minimum(size, 1 << 62), good & (size >= head) & (size <= end - at)

    def _level(self, step: Callable, at: np.ndarray, end: np.ndarray, alone: Callable) -> Level:
        own = np.arange(len(at))
        live = at < end
        own, at, end = own[live], at[live], end[live]
        found = []
        while len(own) > FEW:
            name, start, stop, good = step(at, end)
            found.append((own[good], name[good], at[good], start[good], stop[good]))
            live = good & (stop < end)
            own, at, end = own[live], stop[live], end[live]
        for o, a, z in zip(own.tolist(), at.tolist(), end.tolist()):
            rows = np.array(list(alone(a, z)), np.int64).reshape(-1, 4)
            found.append((np.full(len(rows), o), *rows.T))
        if not found:
            return Level(*[np.zeros(0, np.int64)] * 5)
        out = Level(*(np.concatenate(x) for x in zip(*found)))
        return out.where(np.argsort(out.owner, kind="stable"))

    def elements(self, at: np.ndarray, end: np.ndarray) -> Level:
        """Elements of EBML below each range; a broken one ends it."""
        from .containers import elements

        def alone(a, z):
            for number, start, stop in elements(self.view, a, z):
                yield number, a, start, stop
                a = stop

        return self._level(self._element, at, end, alone)

    def boxes(self, at: np.ndarray, end: np.ndarray) -> Level:
        """Boxes of MP4 below each range; a broken one ends it."""

        def alone(a, z):
            while a < z:
                name, start, stop, good = (x[0] for x in self._box(np.array([a]), np.array([z])))
                if not good:
                    return
                yield name, a, start, stop
                a = stop

        return self._level(self._box, at, end, alone)

    def strings(self, start: np.ndarray, stop: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
        """Parts of the bytes, null where not known."""
        lengths = stop - start if known is None else np.where(known, stop - start, 0)
        ends = np.append(0, np.cumsum(lengths)).astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(self.data[spread(start, lengths)])]).cast(pa.binary())
        return out if known is None else pc.if_else(pa.array(known), out, pa.scalar(None, pa.binary()))

    def texts(self, start: np.ndarray, stop: np.ndarray) -> pa.Array:
        """Parts of the bytes as UTF-8; what is none is replaced."""
        out = self.strings(start, stop)
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


def firsts(n: int, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some ranges the first of each of n owners: starts, stops, and which owners have one."""
    order = np.argsort(-start, kind="stable")
    first, last, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    first[owner[order]], last[owner[order]], known[owner] = start[order], stop[order], True
    return first, last, known


def lists(kind: pa.ListType, files: int, file: np.ndarray, *columns: pa.Array | np.ndarray) -> pa.Array:
    """A list for each file out of columns that are sorted by file."""
    ends = np.searchsorted(file, np.arange(files + 1)).astype(np.int32)
    made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(made, fields=list(kind.value_type)), type=kind)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Paths and contents of as many files as are walked at once."""
    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(length):
            n = max(1, int(np.searchsorted(np.cumsum(length[at : at + MOST_FILES]), MOST_BYTES, "right")))
            yield b.column(0).slice(at, n), b.column(1).slice(at, n)
            at += n


def told(schema: pa.Schema, *columns: pa.Array | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of some files, so many at once."""
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)
    for k in range(0, whole.num_rows, MOST_ROWS):
        yield whole.slice(k, MOST_ROWS)
