"""Media containers as tables: boxes of MP4, blocks of Matroska, and the packets they describe.

Files come as rows (path, content), as `binaryFile` reads them. Python only walks the nesting of a
file and gives out rows; tables inside boxes are decoded, expanded and joined by Spark. A file is
one row, so its size bounds what a task holds; payloads of media data never leave the walk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.binary import rows, uint
from ..functions.timing import minus
from ..operators import packets as P
from . import walks

#: Boxes that hold boxes, boxes of sample tables, and element numbers of Matroska.
HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"moof", b"traf", b"mvex")
TABLES = ("mdhd", "hdlr", "stts", "ctts", "stss", "stsc", "stsz", "stco", "co64")
HELD, CHPL = tuple(int.from_bytes(n, "big") for n in HOLDERS), int.from_bytes(b"chpl", "big")
SEGMENT, CLUSTER, TIMECODE, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, DURATION = 0x18538067, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
INFO, SCALE, TRACKS, TRACK, NUMBER, KIND, CODEC, FRAME_NS, LANGUAGE = 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x23E383, 0x22B59C


def container_of(content: Column) -> Column:
    """Kind of a file by its first bytes; an EBML head is matroska, whatever its document type."""
    head, brand = F.hex(F.substring(content, 1, 12)), F.substring(content, 9, 4).cast("string")
    isobmff = F.substring(head, 9, 8) == "66747970"
    return F.when(isobmff & (brand == "qt  "), "mov").when(isobmff, "mp4").when(F.substring(head, 1, 8) == "1A45DFA3", "matroska").otherwise("unknown")


def sniffed(files: DataFrame) -> DataFrame:
    """(path, container) of each file."""
    return files.select("path", container_of(F.col("content")).alias("container"))


def arrow(fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


def together(files: Iterator[tuple[int, list[tuple]]], schema: pa.Schema, most_rows: int = 20_000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of many small files as one batch; those of a large one as several. Files come as their lengths and rows."""
    held, length = [], 0
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for n, found in files:
        held += found
        length += n
        while len(held) >= most_rows or (held and length >= most_bytes):
            yield made(held[:most_rows])
            held, length = held[most_rows:], 0
    if held:
        yield made(held)


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Path and content of each file; a null content is empty."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield path, content or b""


def walk_boxes(data: memoryview, start: int, end: int, parent: str, depth: int = 0, only: frozenset[bytes] | None = None) -> Iterator[tuple]:
    """(path of names, place, size, payload) of all boxes, or of those of some names; holders have no payload, media data none either."""
    at, seen = start, {}
    while at + 8 <= end and depth < 16:
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            return
        label = name.decode("latin-1")
        k = seen.get(label, 0)
        seen[label] = k + 1
        own = f"{parent}/{label}.{k}"
        holder = name in HOLDERS
        if only is None or name in only:
            yield own, at, size, None if holder or name == b"mdat" else bytes(data[at + head : at + size])
        if holder:
            yield from walk_boxes(data, at + head, at + size, own, depth + 1, only)
        at += size


def boxes(files: DataFrame, *names: str) -> DataFrame:
    """(path, box, place, size, payload): every well-formed box, or those of some names; a broken one ends its level."""
    only, fields = frozenset(n.encode() for n in names) or None, "path string, box string, place long, size long, payload binary"
    schema = arrow(fields)

    def run(batches):
        yield from together(((len(data), [(path, *x) for x in walk_boxes(memoryview(data), 0, len(data), "", 0, only)]) for path, data in contents(batches)), schema)

    return files.select("path", "content").mapInArrow(run, fields)


def mp4_tables(found: DataFrame) -> DataFrame:
    """One row a track: path, track, scale, language, and its sample tables as arrays; null where a table is broken.

    stco is preferred over co64; no ctts means no offsets, no stss that all samples are key samples.
    """
    named = found.where("payload IS NOT NULL").withColumn("track", F.regexp_extract("box", r"^/moov\.0/trak\.(\d+)/", 1)).where("track <> ''")
    name = F.regexp_extract("box", r"/(\w+)\.\d+$", 1)
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("payload")))
    t = named.withColumn("name", name).groupBy("path", "track").agg(*[one(n).alias(n) for n in TABLES])
    wide = uint(F.col("mdhd"), 0, 1) == 1
    count = lambda c, at=4: uint(F.col(c), at, 4)
    fixed = uint(F.col("stsz"), 4, 4)
    sizes = F.when(fixed > 0, F.transform(F.sequence(F.lit(1), F.greatest(count("stsz", 8), F.lit(1)).cast("int")), lambda _: fixed)).otherwise(F.transform(rows(F.col("stsz"), 12, count("stsz", 8), (4,)), lambda r: r["f0"]))
    offsets = F.coalesce(F.transform(rows(F.col("stco"), 8, count("stco"), (4,)), lambda r: r["f0"]), F.transform(rows(F.col("co64"), 8, count("co64"), (4, 4)), lambda r: r["f0"] * 2**32 + r["f1"]))
    return t.select(
        "path", F.col("track").cast("bigint").alias("track"), F.substring(F.col("hdlr"), 9, 4).cast("string").alias("handler"),
        F.when(wide, uint(F.col("mdhd"), 20, 4)).otherwise(uint(F.col("mdhd"), 12, 4)).alias("scale"),
        rows(F.col("stts"), 8, count("stts"), (4, 4)).alias("durations"),
        F.when(F.col("ctts").isNotNull(), rows(F.col("ctts"), 8, count("ctts"), (4, 4), signed=(1,))).alias("offsets"),
        F.transform(rows(F.col("stss"), 8, count("stss"), (4,)), lambda r: r["f0"]).alias("keys"),
        rows(F.col("stsc"), 8, count("stsc"), (4, 4, 4)).alias("runs"), sizes.alias("sizes"), offsets.alias("chunk_offsets"),
    )


def _expanded(runs: Column) -> Column:
    """Values of a run-length table, one a sample."""
    return F.flatten(F.transform(F.filter(runs, lambda r: r["f0"] > 0), lambda r: F.array_repeat(r["f1"], r["f0"].cast("int"))))


def _slots() -> Column:
    """Places of samples, in order: the offset of their chunk (at) and its number, by the latest run that begins at or before it.

    Chunks behind as many places as there are samples are not expanded.
    """
    n, chunks = F.size("sizes"), F.size("chunk_offsets")
    runs = F.array_sort(F.filter("runs", lambda r: r["f0"] >= 1))

    def sizes(r: Column, i: Column) -> Column:
        end = F.least(F.coalesce(F.get(runs, i + 1)["f0"], chunks + 1), chunks + 1)
        count = F.greatest(end - r["f0"], F.lit(0))
        most = F.when(r["f1"] > 0, F.least(count, F.ceil(n / r["f1"]))).otherwise(count)
        return F.array_repeat(F.least(r["f1"], n.cast("bigint")), most.cast("int"))

    unled = F.array_repeat(F.lit(0).cast("bigint"), F.least(F.get(runs, F.lit(0))["f0"] - 1, chunks).cast("int"))
    each = F.concat(unled, F.flatten(F.transform(runs, sizes)))
    return F.flatten(F.transform(each, lambda size, c: F.array_repeat(F.struct(F.get("chunk_offsets", c).alias("at"), c.alias("chunk")), size.cast("int"))))


def mp4_packets(files: DataFrame) -> DataFrame:
    """(path, track, ix, source_offset, size, pts, dts, duration, scale, keyframe) of all tracks whose tables agree.

    A track is left out as a whole where run lengths do not give as many samples as it has sizes, or
    key samples repeat.
    """
    t = mp4_tables(boxes(files, *TABLES)).where("scale > 0 AND sizes IS NOT NULL AND durations IS NOT NULL AND runs IS NOT NULL AND chunk_offsets IS NOT NULL")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, r: a + r["f0"])
    t = t.where((total("durations") == F.size("sizes")) & (F.col("offsets").isNull() | (total("offsets") == F.size("sizes"))) & (F.col("keys").isNull() | (F.size(F.array_distinct("keys")) == F.size("keys"))))
    offsets = F.coalesce(_expanded(F.col("offsets")), F.transform("sizes", lambda _: F.lit(0).cast("bigint")))
    # all that is known of a sample stands in one row, so that files are walked once and samples are shuffled once
    rows_ = t.select("path", F.col("track").alias("own"), F.concat_ws("\n", "path", F.col("track").cast("string")).alias("track"), "scale", "keys", F.posexplode(F.arrays_zip(F.col("sizes").alias("size"), _expanded(F.col("durations")).alias("duration"), offsets.alias("offset"), _slots().alias("slot"))).alias("ix", "s"))
    keyframe = F.col("keys").isNull() | F.array_contains("keys", F.col("ix") + 1)
    rows_ = rows_.select("path", "own", "track", "scale", F.col("ix").cast("bigint").alias("ix"), "s.size", "s.duration", "s.offset", "s.slot.at", "s.slot.chunk", keyframe.alias("keyframe")).where("size IS NOT NULL")
    before = W.partitionBy("track", "chunk").orderBy("ix").rowsBetween(W.unboundedPreceding, -1)
    out = P.normalised(rows_, "path", "own", "scale", "size", "at", "chunk", "keyframe").where("at IS NOT NULL")
    return out.select("path", F.col("own").alias("track"), "ix", (F.col("at") + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("source_offset"), "size", "pts", "dts", "duration", "scale", "keyframe")


def nested(b: walks.Bytes, deepest: int = 16) -> Iterator[tuple[walks.Level, np.ndarray]]:
    """Boxes of some files, a level at a time, with the rows of the level above that hold them; those of the first level are held by files."""
    at, end, above = b.first, b.last, np.arange(len(b.first))
    for _ in range(deepest):
        level = b.boxes(at, end)
        yield level, above[level.owner]
        above = np.flatnonzero(np.isin(level.name, HELD))
        at, end = level.start[above], level.stop[above]
        if not len(above):
            break


def extents(files: DataFrame) -> DataFrame:
    """(path, boxes, first_end): the well-formed boxes of each file that has any, and the earliest end among them; nothing is shuffled."""
    fields = "path string, boxes long, first_end long"
    schema = arrow(fields)

    def run(batches):
        for paths, content in walks.groups(batches):
            b = walks.Bytes(content)
            file = np.arange(len(paths))
            count, end = np.zeros(len(paths), np.int64), np.full(len(paths), np.iinfo(np.int64).max)
            for level, above in nested(b):
                file = file[above]
                count += np.bincount(file, minlength=len(paths))
                np.minimum.at(end, file, level.stop - b.first[file])
            some = np.flatnonzero(count)
            yield from walks.told(schema, paths.take(pa.array(some)), count[some], end[some])

    return files.select("path", "content").mapInArrow(run, fields)


def track_boxes(b: walks.Bytes, *names: str) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, ...]]]:
    """(file, ix, boxes) of the tracks of the first movie box of some files: of each name where the payload starts and stops, and which tracks have one; of several the highest."""
    code = lambda name: int.from_bytes(name.encode(), "big")
    # of each box of a level, the movie box or track that holds it; -1 outside of them
    held, ix, tracks, found = np.arange(len(b.first)), np.zeros(0, np.int64), np.zeros(0, np.int64), {name: [] for name in names}
    for depth, (level, above) in enumerate(nested(b)):
        held = held[above]
        if depth == 0:
            movie = level.name == code("moov")
            first = np.flatnonzero(movie)[walks.nth(held[movie]) == 0]
            held = np.full(len(above), -1)
            held[first] = above[first]
        elif depth == 1:
            own = np.flatnonzero((level.name == code("trak")) & (held >= 0))
            tracks, ix = held[own], walks.nth(held[own])
            held = np.full(len(above), -1)
            held[own] = np.arange(len(own))
        else:
            for name in names:
                some = (level.name == code(name)) & (held >= 0)
                found[name].append((held[some], level.start[some], level.stop[some]))
    out = {}
    for name in names:
        own, start, stop = (np.concatenate(x) for x in zip(*found[name])) if found[name] else (np.zeros(0, np.int64),) * 3
        if len(own) > len(np.unique(own)):
            order = np.array(sorted(range(len(own)), key=lambda k: bytes(b.view[start[k] : stop[k]])))
            own, start, stop = own[order], start[order], stop[order]
        first, last, known = np.zeros(len(tracks), np.int64), np.zeros(len(tracks), np.int64), np.zeros(len(tracks), bool)
        first[own], last[own], known[own] = start, stop, True
        out[name] = first, last, known
    return tracks, ix, out


def mp4_lasting(b: walks.Bytes, tracks: np.ndarray, found: dict[str, tuple[np.ndarray, ...]]) -> pa.Array:
    """Latest end in milliseconds of the packets that `mp4_packets` gives of some files, null without any; `found` has the TABLES of `track_boxes`.

    Runs of samples that are alike in duration and offset are taken at their ends, and no sample is written out.
    """
    high, low = np.uint64(32), np.uint64(0xFFFFFFFF)

    def uint32(name: str, at: int) -> tuple[np.ndarray, np.ndarray]:
        start, stop, known = found[name]
        fits = known & (start + at + 4 <= stop)
        return (b.word(np.where(fits, start + at, 0)) >> high).astype(np.int64), fits

    def counted(name: str, width: int, at: int = 8) -> tuple[np.ndarray, np.ndarray]:
        n, known = uint32(name, at - 4)
        return n, known & (found[name][1] - found[name][0] >= at + n * width)

    def entries(name: str, some: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(some)
        return np.repeat(own, n[own]), np.repeat(found[name][0][own] + 8, n[own]) + spread_from_zero(n[own]) * width

    def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = b.word(at)
        return (word >> high).astype(np.int64), (word & low).astype(np.int64)

    def total(own: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(own, of, len(tracks))

    def before(own: np.ndarray, of: np.ndarray) -> np.ndarray:
        begins = np.append(True, own[1:] != own[:-1])[: len(own)]
        out = np.cumsum(of) - of
        return out - out[np.flatnonzero(begins)[np.cumsum(begins) - 1]] if len(own) else out

    start, stop, known = found["mdhd"]
    wide = known & (stop > start) & (b.data[start] == 1)
    (scale, said), (wide_scale, wide_said) = uint32("mdhd", 12), uint32("mdhd", 20)
    scale, good = np.where(wide, wide_scale, scale), np.where(wide, wide_said, said)
    fixed, alike = uint32("stsz", 4)
    alike &= fixed > 0
    (n, sized), (_, told) = counted("stsz", 4, 12), uint32("stsz", 8)
    n = np.where(alike, np.maximum(np.where(told, n, 1), 1), n)
    (durations, a), (runs, c), (chunks, d), (wide_chunks, e) = counted("stts", 8), counted("stsc", 12), counted("stco", 4), counted("co64", 8)
    (offsets, shifted), (keys, keyed) = counted("ctts", 8), counted("stss", 4)
    good &= (scale > 0) & (alike | sized) & a & c & (d | e)
    chunks = np.where(d, chunks, wide_chunks)

    own, at = entries("stts", good, durations, 8)
    count, lasts = pairs(at)
    good &= total(own, count) == n
    own_o, at = entries("ctts", good & shifted, offsets, 8)
    count_o, offset = pairs(at)
    offset = np.where(offset >= 1 << 31, offset - (1 << 32), offset)
    good &= ~shifted | (total(own_o, count_o) == n)
    own_k, at = entries("stss", good & keyed, keys, 4)
    key, _ = pairs(at)
    if np.any((key[1:] <= key[:-1]) & (own_k[1:] == own_k[:-1])):
        good[own_k[walks.nth(own_k, key) > 0]] = False

    # samples that chunks have places for
    own_r, at = entries("stsc", good, runs, 12)
    first, each = pairs(at)
    own_r, first, each = (x[first >= 1] for x in (own_r, first, each))
    order = np.lexsort((each, first, own_r))
    own_r, first, each = own_r[order], first[order], each[order]
    behind = np.where(np.append(own_r[1:] == own_r[:-1], False)[: len(own_r)], np.append(first[1:], 0)[: len(first)], 1 << 33)
    filled = np.maximum(np.minimum(behind, chunks[own_r] + 1) - first, 0)
    placed = np.minimum(total(own_r, np.minimum(filled.astype(float) * each, n[own_r])), n).astype(np.int64)
    good &= placed > 0

    def kept(own: np.ndarray, count: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
        some = good[own] & (count > 0)
        return [x[some] for x in (own, count, *more)]

    own, count, lasts = kept(own, count, lasts)
    own_o, count_o, offset = kept(own_o, count_o, offset)
    out, any_ = np.zeros(len(b.first), np.int64), np.zeros(len(b.first), bool)
    if not len(own):
        return pa.array(out, mask=~any_)
    if np.any(total(own, count.astype(float) * lasts) > 9.2e18 / 2):
        raise OverflowError("a time is beyond 64 bits")
    # places of samples, each behind the number of its track
    begin, dts = before(own, count), before(own, count * lasts)
    at = own << 33 | begin
    none = np.flatnonzero(good & ~shifted)
    at_o, offset = np.append(own_o << 33 | before(own_o, count_o), none << 33), np.append(offset, np.zeros(len(none), np.int64))
    order = np.argsort(at_o, kind="stable")
    at_o, offset = at_o[order], offset[order]
    cut = np.flatnonzero(good & (placed < n))
    place = np.unique(np.concatenate((at, at_o, cut << 33 | placed[cut])))
    track, k = place >> 33, place & (1 << 33) - 1
    begins = np.flatnonzero(np.append(True, track[1:] != track[:-1]))
    last = np.append(k[1:], 0) - 1
    last[np.append(begins[1:], len(track)) - 1] = n[track[begins]] - 1
    run, moved = np.searchsorted(at, place, "right") - 1, offset[np.searchsorted(at_o, place, "right") - 1]
    dts = dts[run] + (k - begin[run]) * lasts[run]
    ends = np.where(k < placed[track], dts + (last - k + 1) * lasts[run] + moved, np.iinfo(np.int64).min)
    track = track[begins]
    end = np.maximum.reduceat(ends, begins) - np.minimum(np.minimum.reduceat(dts + moved, begins), 0)
    ms = end // scale[track] * 1000 + end % scale[track] * 1000 // scale[track]
    if np.any(end / scale[track] > 9.2e15):
        raise OverflowError("a time is beyond 64 bits")
    np.maximum.at(out, tracks[track], ms)
    any_[tracks[track]] = True
    return pa.array(out, mask=~any_)


def chapter_lists(b: walks.Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(file, ix, start_ms, end_ms, title) of the chapters of some MP4 files, list by list and entry by entry."""

    def found_in(b: walks.Bytes) -> Iterator[tuple[np.ndarray, ...]]:
        file = np.arange(len(b.first))
        for level, above in nested(b):
            file = file[above]
            found = np.flatnonzero(level.name == CHPL)
            found = found[walks.nth(above[found]) == 0]
            yield file[found], level.start[found], level.stop[found]

    file, start, stop = (np.concatenate(x) for x in zip(*found_in(b)))
    full = stop - start > 8
    file, at, stop = file[full], start[full] + 9, stop[full]
    n, own = b.data[start[full] + 8].astype(np.int64), np.arange(len(file))
    found = [(np.zeros(0, np.int64),) * 5]
    for k in range(int(n.max(initial=0))):
        live = (n[own] > k) & (at[own] + 9 <= stop[own])
        own = own[live]
        end = at[own] + 9 + b.data[at[own] + 8]
        fits = end <= stop[own]
        own, end = own[fits], end[fits]
        found.append((own, np.full(len(own), k), (b.word(at[own]) // np.uint64(10_000)).astype(np.int64), at[own] + 9, end))
        at[own] = end
    own, ix, ms, title, end = (np.concatenate(x) for x in zip(*found))
    whole = np.bincount(own, minlength=len(n))[own] == n[own]
    order = np.lexsort((ix[whole], own[whole]))
    own, ix, ms, title, end = (x[whole][order] for x in (own, ix, ms, title, end))
    last = ix + 1 == n[own]
    return file[own], ix, ms, pa.array(np.append(ms[1:], 0)[: len(ms)], mask=last), b.texts(title, end)


def mp4_chapters(files: DataFrame) -> DataFrame:
    """(path, ix, id, start_ms, end_ms, title): starts in 100 ns units, each until the next of its list; a cut list gives none.

    All files of a batch are walked at once, and their lists entry by entry; nothing is shuffled.
    """
    fields = "path string, ix long, start_ms long, end_ms long, title string"
    schema = arrow(fields)

    def run(batches):
        for paths, content in walks.groups(batches):
            file, *columns = chapter_lists(walks.Bytes(content))
            yield from walks.told(schema, paths.take(pa.array(file)), *columns)

    got = files.select("path", "content").mapInArrow(run, fields)
    return got.select("path", "ix", F.concat(F.lit("ch"), F.col("ix").cast("string")).alias("id"), "start_ms", "end_ms", "title")


def vint(data: memoryview, at: int, end: int, keep_mark: bool) -> tuple[int, int] | None:
    """Value and length of a variable-length number; all ones mean an unknown size, -1."""
    if at >= end or data[at] == 0:
        return None
    n = 9 - data[at].bit_length()
    if at + n > end:
        return None
    value = int.from_bytes(data[at : at + n], "big")
    if not keep_mark:
        value -= 1 << (7 * n)
        value = -1 if value == (1 << (7 * n)) - 1 else value
    return value, n


def elements(data: bytes | memoryview, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(number, start and end of the payload) of the elements of a level; a broken one ends it."""
    number_of = int.from_bytes
    while at < end:
        mark = data[at]
        if mark >= 0x80:
            place, number = at + 1, mark
        else:
            place = at + 9 - mark.bit_length()
            number = number_of(data[at:place], "big")
        if not mark or place >= end:
            return
        mark = data[place]
        if mark == 1:
            start, most = place + 8, (1 << 56) - 1
            size = number_of(data[place + 1 : start], "big")
        else:
            n = 9 - mark.bit_length()
            start, most = place + n, (1 << 7 * n) - 1
            size = number_of(data[place:start], "big") & most
        if not mark or start > end:
            return
        stop = end if size == most else start + size
        if stop > end:
            return
        yield number, start, stop
        at = stop


def lace(data: memoryview, at: int, end: int, flags: int) -> list[tuple[int, int]] | None:
    """(start, size) of a block's frames: one, Xiph, equal or EBML sizes; None where they do not add up."""
    kind = (flags >> 1) & 3
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        return None
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % n:
            return None
        sizes = [(end - at) // n] * (n - 1)
    for k in range(n - 1 if kind != 2 else 0):
        if kind == 1:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                return None
            size, at = size + data[at], at + 1
        else:
            got = vint(data, at, end, False)
            if not got:
                return None
            size = got[0] if k == 0 else sizes[-1] + got[0] - ((1 << (7 * got[1] - 1)) - 1)
            at += got[1]
        sizes.append(size)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        return None
    out = []
    for size in [*sizes, rest]:
        out.append((at, size))
        at += size
    return out


def _number(data: memoryview, s: int, e: int) -> int:
    return int.from_bytes(data[s:e], "big")


def file_frames(path: str, data: bytes | memoryview, only: int | None = None) -> Iterator[tuple]:
    """Rows of `matroska_frames` of one file, or of its tracks of one kind."""
    scale, tracks, block = 1_000_000, {}, 0
    for number, s, e in elements(data, 0, len(data)):
        if number != SEGMENT:
            continue
        for part, ps, pe in elements(data, s, e):
            if part == INFO:
                scale = next((_number(data, a, z) for n, a, z in elements(data, ps, pe) if n == SCALE), scale)
            elif part == TRACKS:
                for n, a, z in elements(data, ps, pe):
                    if n == TRACK:
                        t = {m: (x, y) for m, x, y in elements(data, a, z)}
                        get = lambda m, t=t: _number(data, *t[m]) if m in t else None
                        tracks[get(NUMBER)] = (bytes(data[slice(*t[CODEC])]).decode("ascii", "replace") if CODEC in t else None, get(KIND), get(FRAME_NS))
            elif part == CLUSTER:
                base = 0
                for n, a, z in elements(data, ps, pe):
                    base = _number(data, a, z) if n == TIMECODE else base
                    group = list(elements(data, a, z)) if n == BLOCK_GROUP else [(n, a, z)] if n == SIMPLE_BLOCK else []
                    for m, x, y in group:
                        track = vint(data, x, y, False) if m in (SIMPLE_BLOCK, BLOCK) else None
                        if not track or x + track[1] + 3 > y:
                            continue
                        codec, kind, frame_ns = tracks.get(track[0], (None, None, None))
                        if only is not None and kind != only:
                            block += 1
                            continue
                        at = x + track[1]
                        flags = data[at + 2]
                        found = lace(data, at + 3, y, flags)
                        key = bool(flags & 0x80) if m == SIMPLE_BLOCK else not any(q == REFERENCE for q, _, _ in group)
                        length = next((_number(data, q, r) for w, q, r in group if w == DURATION), None)
                        ticks = base + int.from_bytes(data[at : at + 2], "big", signed=True)
                        for k, (place, size) in enumerate(found or ()):
                            yield path, track[0], codec, kind, block, k, ticks, scale, frame_ns, length, key, place, size
                        block += 1


def matroska_frames(files: DataFrame) -> DataFrame:
    """(path, track, codec, kind, block, k, ticks, scale_ns, frame_ns, duration, keyframe, source_offset, size): a row a frame.

    ticks is the cluster's time with the block's; blocks whose frames do not add up are left out.
    """
    fields = "path string, track long, codec string, kind long, block long, k long, ticks long, scale_ns long, frame_ns long, duration long, keyframe boolean, source_offset long, size long"
    schema = arrow(fields)

    def run(batches):
        yield from together(((len(data), list(file_frames(path, data))) for path, data in contents(batches)), schema)

    return files.select("path", "content").mapInArrow(run, fields)


def timed_frames(frames: DataFrame) -> DataFrame:
    """Rows of `matroska_frames` with ix, pts and lasts in milliseconds: laced frames follow each other.

    A frame lasts until the next of its track; the last as long as its frames are declared to, else as
    the one before it.
    """
    step = F.coalesce(((F.col("frame_ns") - F.col("frame_ns") % 1_000_000) / 1_000_000).cast("bigint"), F.lit(0))
    whole = F.greatest(F.col("ticks"), F.lit(0)) * F.col("scale_ns")
    ms = ((whole - whole % 1_000_000) / 1_000_000).cast("bigint") + F.col("k") * step
    by = W.partitionBy("path", "track").orderBy("block", "k")
    rows_ = frames.withColumn("pts", ms).withColumn("step", step)
    ahead = minus(F.lead("pts").over(by), F.col("pts"))
    before = minus(F.col("pts"), F.lag("pts").over(by))
    return rows_.withColumns({"ix": (F.row_number().over(by) - 1).cast("bigint"), "lasts": _lasts(F.col("step"), ahead, before)})


def _lasts(step: Column, ahead: Column, before: Column) -> Column:
    """How long a frame lasts: until the next of its track; the last as long as its frames are declared to, else as the one before it."""
    return F.coalesce(ahead, F.nullif(step, F.lit(0)), before, F.lit(0))


def _laced(b: walks.Bytes, at: np.ndarray, end: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, k, place, size) of the frames of many blocks, as `lace` of each."""
    kind, whole = (flags >> 1) & 3, np.arange(len(at))
    n = np.where(kind == 0, 1, b.data[at].astype(np.int64) + 1)
    good = (kind == 0) | (at < end)
    at = at + (kind != 0)
    even = kind == 2
    good &= ~even | ((end - at) % n == 0)
    own, ks, sizes = [], [], []
    some = np.flatnonzero(good & even)
    each = n[some] - 1
    own, ks, sizes = [np.repeat(some, each)], [spread_from_zero(each)], [np.repeat((end[some] - at[some]) // n[some], each)]
    # sizes that are written out: one of each block at a time, and of Xiph's a byte at a time
    last, begun = np.zeros(len(at), np.int64), at.copy()
    for k in range(int(n[good & (kind & 1 == 1)].max(initial=1)) - 1):
        own_k = np.flatnonzero(good & (kind == 3) & (n - 1 > k))
        value, length = b.vint(begun[own_k])
        fits = (length > 0) & (begun[own_k] < end[own_k]) & (begun[own_k] + length <= end[own_k])
        good[own_k[~fits]] = False
        own_k, value, length = own_k[fits], value[fits], length[fits]
        last[own_k] = value if k == 0 else last[own_k] + value - ((1 << (7 * length - 1)) - 1)
        begun[own_k] += length
        xiph = live = np.flatnonzero(good & (kind == 1) & (n - 1 > k))
        last[xiph] = 0
        while len(live):
            inside = begun[live] < end[live]
            good[live[~inside]] = False
            live = live[inside]
            byte = b.data[begun[live]]
            last[live] += byte
            begun[live] += 1
            live = live[byte == 255]
        own_k = np.concatenate((own_k, xiph[good[xiph]]))
        own.append(own_k)
        ks.append(np.full(len(own_k), k))
        sizes.append(last[own_k])
    own, ks, sizes = (np.concatenate(x) for x in (own, ks, sizes))
    total = np.zeros(len(at), np.int64)
    np.add.at(total, own, sizes)
    rest = end - begun - total
    good[own[sizes < 0]] = False
    good &= rest >= 0
    some = whole[good]
    own, ks, sizes = np.concatenate((own, some)), np.concatenate((ks, n[some] - 1)), np.concatenate((sizes, rest[some]))
    order = np.lexsort((ks, own))
    order = order[good[own[order]]]
    own, ks, sizes = own[order], ks[order], sizes[order]
    before = np.cumsum(sizes) - sizes
    return own, ks, begun[own] + before - before[np.arange(len(own)) - ks], sizes


def spread_from_zero(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... as often as each length says."""
    return walks.spread(np.zeros(len(lengths), np.int64), lengths)


def _plain_frames(b: walks.Bytes) -> tuple[np.ndarray, ...]:
    """(file, track, block, k, ticks, scale, frame_ns, key, place, size) of the frames of many files, and which files are not plain and have to be walked one by one.

    A file is plain where it declares scale and tracks once each and before its clusters, and each cluster has its time before its blocks.
    """
    files = len(b.first)
    plain, scale = np.ones(files, bool), np.full(files, 1_000_000)
    top = b.elements(b.first, b.last)
    top = top.where(top.name == SEGMENT)
    parts = b.elements(top.start, top.stop)
    file = top.owner[parts.owner]
    cluster = parts.name == CLUSTER
    begin = np.full(files, np.iinfo(np.int64).max)
    np.minimum.at(begin, file[cluster], parts.at[cluster])
    head = (parts.name == INFO) | (parts.name == TRACKS)
    plain[file[head & (parts.at > begin[file])]] = False

    def below(rows: np.ndarray) -> tuple[walks.Level, np.ndarray]:
        level = b.elements(parts.start[rows], parts.stop[rows])
        return level, file[rows][level.owner]

    def once(own: np.ndarray, *keys: np.ndarray) -> None:
        plain[own[walks.nth(own, *keys) > 0]] = False

    info, own = below(parts.name == INFO)
    said = info.name == SCALE
    once(own[said])
    plain[own[said & (info.stop - info.start > 7)]] = False
    scale[own[said]] = b.number(info.start[said], info.stop[said])
    tracks, track_file = below(parts.name == TRACKS)
    track_file, tracks = track_file[tracks.name == TRACK], tracks.where(tracks.name == TRACK)
    fields = b.elements(tracks.start, tracks.stop)
    value = np.full((2, len(track_file)), -1)
    for row, name in enumerate((NUMBER, FRAME_NS)):
        some = fields.name == name
        once_of, start, stop = fields.owner[some], fields.start[some], fields.stop[some]
        again = (walks.nth(once_of) > 0) | (stop - start > 7)
        plain[track_file[once_of[again]]] = False
        value[row, once_of] = b.number(start, stop)
    numbered = value[0] >= 0
    track_file, value = track_file[numbered], value[:, numbered]
    once(track_file, value[0])

    at, end, clusters = parts.start[cluster], parts.stop[cluster], file[cluster]
    inside = b.elements(at, end)
    time = inside.name == TIMECODE
    block = (inside.name == SIMPLE_BLOCK) | (inside.name == BLOCK_GROUP)
    base, when = np.zeros(len(at), np.int64), np.full(len(at), -1)
    own = inside.owner[time]
    plain[clusters[own[(walks.nth(own) > 0) | (inside.stop[time] - inside.start[time] > 7)]]] = False
    base[own], when[own] = b.number(inside.start[time], inside.stop[time]), inside.at[time]
    plain[clusters[inside.owner[block & (inside.at < when[inside.owner])]]] = False

    simple, group = inside.where(inside.name == SIMPLE_BLOCK), inside.where(inside.name == BLOCK_GROUP)
    held = b.elements(group.start, group.stop)
    refers = np.zeros(len(group.at), bool)
    refers[held.owner[held.name == REFERENCE]] = True
    held = held.where((held.name == SIMPLE_BLOCK) | (held.name == BLOCK))
    in_cluster = np.concatenate((simple.owner, group.owner[held.owner]))
    start, stop = np.concatenate((simple.start, held.start)), np.concatenate((simple.stop, held.stop))
    flagged = np.concatenate((np.ones(len(simple.at), bool), held.name == SIMPLE_BLOCK))
    alone = np.concatenate((np.zeros(len(simple.at), bool), ~refers[held.owner]))
    track, length = b.vint(start)
    fits = (start < stop) & (length > 0) & (start + length + 3 <= stop)
    order = np.flatnonzero(fits)
    order = order[np.argsort(start[order], kind="stable")]
    in_cluster, start, stop, flagged, alone, track = (x[order] for x in (in_cluster, start + length, stop, flagged, alone, track))
    of = clusters[in_cluster]
    flags = b.data[start + 2]
    ticks = base[in_cluster] + (b.word(start) >> np.uint64(48)).astype(np.uint16).view(np.int16)
    own, k, place, size = _laced(b, start + 3, stop, flags)
    # tracks of a file are few, and looked up by both
    frame_ns = np.full(len(of), -1)
    if len(track_file):
        # numbers of tracks have up to 56 bits, their places among those there are fewer
        numbers = np.unique(value[0])
        nth, known = np.searchsorted(numbers, track), np.isin(track, numbers)
        keys = track_file * len(numbers) + np.searchsorted(numbers, value[0])
        sort = np.argsort(keys, kind="stable")
        asked = np.where(known, of * len(numbers) + nth, -1)
        found = np.minimum(np.searchsorted(keys[sort], asked), len(sort) - 1)
        frame_ns = np.where(keys[sort][found] == asked, value[1][sort][found], -1)
    key = np.where(flagged, flags & 0x80 != 0, alone)
    out = (of[own], track[own], own, k, ticks[own], scale[of[own]], frame_ns[own], key[own], place - b.first[of[own]], size)
    return tuple(x[plain[of[own]]] for x in out), np.flatnonzero(~plain)


def _timed(b: walks.Bytes) -> tuple[pa.Array | np.ndarray, ...]:
    """(file, track, ix, place, size, pts, step, ahead, before, key) of the frames of many files: times in milliseconds, and those of the frames behind and before on the same track."""
    columns, odd = _plain_frames(b)
    for f in odd.tolist():
        rows = [(f, r[1], r[4], r[5], r[6], r[7], -1 if r[8] is None else r[8], r[10], r[11], r[12]) for r in file_frames("", b.view[b.first[f] : b.last[f]])]
        if rows:
            columns = tuple(np.concatenate((c, np.array(x, c.dtype))) for c, x in zip(columns, zip(*rows)))
    file, track, block, k, ticks, scale, frame_ns, key, place, size = columns
    order = np.lexsort((k, block, track, file))
    file, track, k, ticks, scale, frame_ns, key, place, size = (x[order] for x in (file, track, k, ticks, scale, frame_ns, key, place, size))
    ticks, step = np.maximum(ticks, 0), np.maximum(frame_ns, 0) // 1_000_000
    if np.any(ticks.astype(float) * scale > 9.2e18):
        raise OverflowError("a time is beyond 64 bits")
    pts = ticks * scale // 1_000_000 + k * step
    begins = np.append(True, (file[1:] != file[:-1]) | (track[1:] != track[:-1]))[: len(file)]
    ends = np.append(begins[1:], True)[: len(file)]
    ix = np.arange(len(file)) - np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(file) else np.zeros(0, np.int64)
    return file, track, ix, place, size, pts, step, pa.array(np.roll(pts, -1), mask=ends), pa.array(np.roll(pts, 1), mask=begins), key


def matroska_lasting(b: walks.Bytes) -> pa.Array:
    """Latest end in milliseconds of the packets that `matroska_packets` gives of some files, null without any."""
    file, _, _, _, _, pts, step, ahead, before, _ = _timed(b)
    follows = ahead.is_valid().to_numpy(zero_copy_only=False)
    known = before.is_valid().to_numpy(zero_copy_only=False)
    ahead, before = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (ahead, before))
    before = np.where(known, before, pts)
    end = np.where(follows, np.maximum(pts, ahead), pts + np.where(step != 0, step, np.maximum(pts - before, 0)))
    out, any_ = np.full(len(b.first), np.iinfo(np.int64).min), np.zeros(len(b.first), bool)
    np.maximum.at(out, file, end)
    any_[file] = True
    return pa.array(out, mask=~any_)


#: What `_timed` gives out of each frame.
_TIMED = "track long, ix long, source_offset long, size long, pts long, step long, ahead long, before long, keyframe boolean"


def _duration() -> Column:
    return _lasts(F.col("step"), minus(F.col("ahead"), F.col("pts")), minus(F.col("pts"), F.col("before"))).alias("duration")


def matroska_packets(files: DataFrame) -> DataFrame:
    """(path, track, ix, source_offset, size, pts, duration, keyframe) in milliseconds, timed as `timed_frames` does.

    All files of a batch are walked at once; frames meet their neighbours there, and nothing is shuffled.
    """
    fields = f"path string, {_TIMED}"
    schema = arrow(fields)

    def run(batches):
        for paths, content in walks.groups(batches):
            file, *columns = _timed(walks.Bytes(content))
            yield from walks.told(schema, paths.take(pa.array(file)), *columns)

    rows_ = files.select("path", "content").mapInArrow(run, fields)
    return rows_.select("path", "track", "ix", "source_offset", "size", "pts", _duration(), "keyframe")


def matroska_packets_with_content(files: DataFrame) -> DataFrame:
    """Rows of `matroska_packets` with the content of their file, which comes out of the same walk and is not shuffled; operators that read it should take their part at once."""
    fields = f"path string, content binary, p array<struct<{', '.join(x.replace(' ', ': ') for x in _TIMED.split(', ')) }>>"
    schema = arrow(fields)

    def run(batches):
        for paths, content in walks.groups(batches):
            file, *columns = _timed(walks.Bytes(content))
            ends = np.searchsorted(file, np.arange(len(paths) + 1)).astype(np.int32)
            made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
            yield from walks.told(schema, paths, content.fill_null(b""), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(made, fields=list(schema.field("p").type.value_type)), type=schema.field("p").type))

    rows_ = files.select("path", "content").mapInArrow(run, fields).select("path", "content", F.explode("p").alias("p")).select("path", "content", "p.*")
    return rows_.select("path", "track", "ix", "source_offset", "size", "pts", _duration(), "keyframe", "content")


def fragments(files: DataFrame) -> DataFrame:
    """(path, fragment, decode_time, samples, duration, bytes, problem): each traf's run, and the first rule it breaks.

    A run is of version 1 with flags 0x000f01 and rows of 16 bytes, at most 2,000,000; durations and
    sizes are positive.
    """
    b = boxes(files, "trun", "tfdt").withColumn("fragment", F.regexp_extract("box", r"^(/moof\.\d+/traf\.\d+)/", 1)).where("fragment <> ''").withColumn("name", F.regexp_extract("box", r"/(\w+)\.\d+$", 1))
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("payload")))
    t = b.groupBy("path", "fragment").agg(one("trun").alias("trun"), one("tfdt").alias("tfdt"))
    n = uint(F.col("trun"), 4, 4)
    table = rows(F.col("trun"), 12, n, (4, 4, 4, 4), signed=(3,))
    head = F.hex(F.substring("trun", 1, 4)) == "01000F01"
    fits = head & (n <= 2_000_000) & (F.octet_length("trun") == 12 + n * 16)
    base = F.when(uint(F.col("tfdt"), 0, 1) == 1, uint(F.col("tfdt"), 4, 4) * 2**32 + uint(F.col("tfdt"), 8, 4)).otherwise(uint(F.col("tfdt"), 4, 4))
    out = t.select("path", "fragment", base.alias("decode_time"), fits.alias("fits"), F.when(fits, table).alias("rows"))
    total = lambda f: F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, r: a + r[f])
    problem = F.when(~F.coalesce("fits", F.lit(False)), "run").when(F.exists("rows", lambda r: r["f0"] <= 0), "duration").when(F.exists("rows", lambda r: r["f1"] <= 0), "size").when(F.col("decode_time").isNull(), "time")
    return out.select("path", "fragment", "decode_time", F.size("rows").alias("samples"), total("f0").alias("duration"), total("f1").alias("bytes"), problem.alias("problem"))


def layouts(files: DataFrame) -> DataFrame:
    """(path, boxes, starts_fast, is_fragment): names of the outermost boxes, and whether they begin with a movie's head or a fragment's."""
    outer = boxes(files).where("box RLIKE '^/[^/]*$'")
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", F.regexp_extract("box", r"^/(.*)\.\d+$", 1).alias("name")))), lambda b: b["name"])
    found = outer.groupBy("path").agg(names.alias("boxes"))
    begins = lambda a, b: (F.size("boxes") >= 2) & (F.get("boxes", F.lit(0)) == a) & (F.get("boxes", F.lit(1)) == b)
    return found.select("path", "boxes", begins("ftyp", "moov").alias("starts_fast"), begins("moof", "mdat").alias("is_fragment"))


def checked_fragments(files: DataFrame) -> DataFrame:
    """(path, problem, tracks, samples, bytes): totals of a file's fragment, and the first rule that it breaks.

    Besides the rules of `fragments`, each track begins with a key sample, has no negative composition
    offset, and its data lies inside the media data, behind that of the track before it.
    """
    b = boxes(files, "trun", "mdat").withColumn("traf", F.regexp_extract("box", r"^/moof\.0/traf\.(\d+)/", 1)).withColumn("name", F.regexp_extract("box", r"/(\w+)\.\d+$", 1))
    media = b.where("box = '/mdat.0'").select("path", (F.col("place") + 8).alias("media_start"), (F.col("place") + F.col("size")).alias("media_end"))
    runs = b.where("traf <> '' AND name = 'trun'").groupBy("path", F.concat(F.lit("/moof.0/traf."), "traf").alias("fragment")).agg(F.first("payload").alias("run"), F.min("traf").cast("int").alias("k"))
    n = uint(F.col("run"), 4, 4)
    more = runs.select("path", "fragment", "k", uint(F.col("run"), 8, 4).alias("at"), uint(F.col("run"), 20, 4).alias("first_flags"), rows(F.col("run"), 12, n, (4, 4, 4, 4), signed=(3,)).alias("rows"))
    t = fragments(files).join(more, ["path", "fragment"]).join(media, "path", "left")
    end = F.col("at") + F.col("bytes")
    before = F.lag(end).over(W.partitionBy("path").orderBy("k"))
    problem = F.coalesce(
        "problem",
        F.when(F.col("samples") == 0, "run").when(F.col("first_flags").bitwiseAND(0x01000000) != 0, "key").when(F.exists("rows", lambda r: r["f3"] < 0), "offset")
        .when(F.col("media_start").isNull() | (F.col("at") < F.col("media_start")) | (end > F.col("media_end")), "outside").when(F.col("at") < before, "overlap"),
    )
    found = t.withColumn("found", problem)
    return found.groupBy("path").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("k"))).alias("problem"), F.count("*").alias("tracks"), F.sum("samples").alias("samples"), F.sum("bytes").alias("bytes"))


def work(files: DataFrame, most_depth: int = 32, most_boxes: int = 100_000, most_tracks: int = 256, most_samples: int = 2_000_000) -> DataFrame:
    """(path, depth, boxes, tracks, samples, problem): what reading each MP4 file costs, and the first budget that it breaks."""
    b = boxes(files)
    name, own = F.regexp_extract("box", r"/(\w+)\.\d+$", 1), F.size(F.split("box", "/")) - 1
    samples = F.when(name == "stsz", uint(F.col("payload"), 8, 4))
    got = b.groupBy("path").agg(F.max(own).cast("bigint").alias("depth"), F.count("*").alias("boxes"), F.count(F.when(F.regexp_like("box", F.lit(r"^/moov\.0/trak\.\d+$")), 1)).alias("tracks"), F.coalesce(F.sum(samples), F.lit(0)).alias("samples"))
    problem = F.lit(None).cast("string")
    for column, most in reversed((("depth", most_depth), ("boxes", most_boxes), ("tracks", most_tracks), ("samples", most_samples))):
        problem = F.when(F.col(column) > most, column).otherwise(problem)
    return got.withColumn("problem", problem)
