"""What a file holds, as tables that the planning operators read: tracks, chapters, attachments, seek points."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import codecs, names
from ..functions.binary import uint
from . import walks
from .containers import TABLES, arrow, chapter_lists, container_of, contents, elements, file_frames, matroska_frames, matroska_lasting, mp4_lasting, timed_frames, together, track_boxes

#: Elements that hold elements, by name.
MASTERS = {0x18538067: "Segment", 0x1549A966: "Info", 0x1654AE6B: "Tracks", 0xAE: "Track", 0xE0: "Video", 0xE1: "Audio", 0x1043A770: "Chapters", 0x45B9: "Edition", 0xB6: "Atom", 0x80: "Display", 0x1941A469: "Attachments", 0x61A7: "Attached", 0x1C53BB6B: "Cues", 0xBB: "Point", 0xB7: "Position", 0x6D80: "Encodings", 0x6240: "Encoding", 0x5034: "Compression"}
#: Elements with values, by name.
VALUES = {0x2AD7B1: "Scale", 0x4489: "Duration", 0xD7: "Number", 0x83: "Kind", 0x86: "Codec", 0x22B59C: "Language", 0x88: "Default", 0x55AA: "Forced", 0x536E: "Title", 0xB0: "Width", 0xBA: "Height", 0x9F: "Channels", 0xB5: "Rate", 0x23E383: "FrameNs", 0x73C4: "Uid", 0x91: "Start", 0x92: "End", 0x85: "Text", 0x437C: "TextLanguage", 0x466E: "FileName", 0x4660: "MimeType", 0x465C: "FileData", 0xB3: "Time", 0xF7: "CueTrack", 0xF1: "CuePlace", 0x5031: "Order", 0x5032: "Scope", 0x5033: "EncodingKind", 0x4254: "Algorithm", 0x4255: "Settings"}
#: Kinds of Matroska tracks and of MP4 handlers.
KINDS = {1: "video", 2: "audio", 17: "subtitle"}
HANDLERS = {"video": ("vide",), "audio": ("soun",), "subtitle": ("sbtl", "subt", "text", "clcp")}
#: Values longer than this are given out by size only; payloads that grow beyond the second have none.
MOST_VALUE, MOST_PAYLOAD = 64 << 10, 64 << 20


def walk_elements(data: bytes | memoryview, at: int, end: int, parent: str, within: tuple[str, ...] = (), depth: int = 0) -> Iterator[tuple]:
    """(parent, name, place, size, value) of the known elements of a level and below it, or of some parts of the segment."""
    seen: dict[str, int] = {}
    for number, s, e in elements(data, at, end):
        if number in MASTERS and depth < 32:
            name = MASTERS[number]
            k = seen[name] = seen.get(name, -1) + 1
            if within and depth == 1 and name not in within:
                continue
            own = f"{parent}/{name}.{k:06d}"
            yield own, "", s, e - s, None
            yield from walk_elements(data, s, e, own, within, depth + 1)
        elif number in VALUES:
            yield parent, VALUES[number], s, e - s, bytes(data[s:e]) if e - s <= MOST_VALUE else None


def matroska_elements(files: DataFrame, *within: str) -> DataFrame:
    """(path, parent, ix, name, place, size, value): known elements in file order; `parent` names the holders with their places among equals.

    `within` names parts of the segment, as "Tracks", to walk only those.
    """
    fields = "path string, parent string, ix long, name string, place long, size long, value binary"
    schema = arrow(fields)

    def run(batches):
        yield from together(((len(data), [(path, p, k, *x) for k, (p, *x) in enumerate(walk_elements(data, 0, len(data), "", within))]) for path, data in contents(batches)), schema)

    return files.select("path", "content").mapInArrow(run, fields)


def _number(value: Column) -> Column:
    """Unsigned number of up to seven bytes; longer ones are taken where their upper bytes are 0."""
    return F.conv(F.hex(value), 16, 10).try_cast("bigint")


def _value(name: str, of: Column | None = None) -> Column:
    """First value of an element below each holder."""
    return F.min_by(F.when(F.col("name") == name, of if of is not None else F.col("value")), F.when(F.col("name") == name, F.col("ix")))


def _matroska_track(code: Column, identifier: Column, default: Column) -> dict[str, Column]:
    """What the numbers of a track say: kind, codec, is_default."""
    kind = F.lit("unknown")
    for k, name in KINDS.items():
        kind = F.when(code == k, name).otherwise(kind)
    return {"kind": kind, "codec": codecs.matroska_codec(identifier), "is_default": F.coalesce(default, F.lit(1)) != 0}


def matroska_tracks(found: DataFrame) -> DataFrame:
    """(path, ix, number, kind, codec, language, title, is_default, forced, width, height, channels, frame_ns)."""
    rows = found.withColumn("track", F.regexp_extract("parent", r"^(/Segment\.0+/Tracks\.0+/Track\.\d+)", 1)).where("track <> ''")
    n = lambda name: _value(name, _number(F.col("value")))
    text = lambda name: _value(name, F.col("value").cast("string"))
    t = rows.groupBy("path", "track").agg(n("Number").alias("number"), n("Kind").alias("k"), text("Codec").alias("id"), text("Language").alias("language"), text("Title").alias("title"), n("Default").alias("d"), n("Forced").alias("f"), n("Width").alias("width"), n("Height").alias("height"), n("Channels").alias("channels"), n("FrameNs").alias("frame_ns"))
    said = _matroska_track(F.col("k"), F.col("id"), F.col("d"))
    ix = F.row_number().over(W.partitionBy("path").orderBy("track")) - 1
    return t.select("path", ix.cast("bigint").alias("ix"), "number", said["kind"].alias("kind"), said["codec"].alias("codec"), "language", "title", said["is_default"].alias("is_default"), (F.coalesce("f", F.lit(0)) != 0).alias("forced"), "width", "height", "channels", "frame_ns")


def encodings_of(data: bytes) -> dict[int, list[dict]]:
    """Number of each encoded track of a Matroska file -> what was done to its frames, the last step first."""
    if b"\x6d\x80" not in data:
        return {}
    numbers: dict[str, bytes | None] = {}
    steps: dict[str, dict[str, dict]] = {}
    for parent, name, _, _, value in walk_elements(data, 0, len(data), "", ("Tracks",)):
        track = re.match(r"/Segment\.0+/Tracks\.0+/Track\.\d+", parent)
        if not track:
            continue
        if name == "Number":
            numbers.setdefault(track[0], value)
        step = re.match(r".*/Encodings\.\d+/Encoding\.\d+", parent)
        if step:
            steps.setdefault(track[0], {}).setdefault(step[0], {}).setdefault(name, value)

    def n(value: bytes | None, default: int | None) -> int | None:
        got = int.from_bytes(value, "big") if value else None
        return default if got is None or got >= 1 << 63 else got

    out = {}
    for track, own in steps.items():
        done = [(n(v.get("Order"), 0), step, v) for step, v in own.items() if n(v.get("Scope"), 1) & 1]
        if done:
            out[n(numbers.get(track), None)] = [{"kind": n(v.get("EncodingKind"), 0), "algorithm": n(v.get("Algorithm"), 0), "settings": v.get("Settings")} for _, _, v in sorted(done, key=lambda x: x[:2], reverse=True)]
    return out


def decoded(payload: bytes | None, encodings: list | None) -> bytes | None:
    """A frame with zlib and header stripping undone; null where a step is another one or fails."""
    for step in encodings or ():
        if payload is None or step["kind"] != 0 or step["algorithm"] not in (0, 3):
            return None
        if step["algorithm"] == 3:
            payload = bytes(step["settings"] or b"") + bytes(payload)
            continue
        z = zlib.decompressobj()
        try:
            payload = z.decompress(bytes(payload), MOST_PAYLOAD)
        except zlib.error:
            return None
        if not z.eof:
            return None
    return payload


def matroska_chapters(found: DataFrame) -> DataFrame:
    """(path, ix, id, start_ms, end_ms, title, language): atoms depth first, those without a start left out; the first display counts."""
    rows = found.withColumn("atom", F.regexp_extract("parent", r"^(.*/Atom\.\d+)(?:/Display\.\d+)?$", 1)).where("atom <> ''")
    ms = lambda name: _value(name, ((_number(F.col("value")) - _number(F.col("value")) % 1_000_000) / 1_000_000).cast("bigint"))
    text = lambda name: _value(name, F.col("value").cast("string"))
    a = rows.groupBy("path", "atom").agg(_value("Uid", F.conv(F.hex(F.col("value")), 16, 10)).alias("uid"), ms("Start").alias("start_ms"), ms("End").alias("end_ms"), text("Text").alias("title"), text("TextLanguage").alias("language")).where("start_ms IS NOT NULL")
    ix = (F.row_number().over(W.partitionBy("path").orderBy("atom")) - 1).cast("bigint")
    return a.withColumn("ix", ix).select("path", "ix", F.coalesce("uid", F.concat(F.lit("ch"), F.col("ix").cast("string"))).alias("id"), "start_ms", "end_ms", "title", "language")


def attachments(found: DataFrame) -> DataFrame:
    """(path, ix, name, mime, place, size): attached files by where their data lies."""
    rows = found.withColumn("own", F.regexp_extract("parent", r"^(.*/Attached\.\d+)$", 1)).where("own <> ''")
    text = lambda name: _value(name, F.col("value").cast("string"))
    a = rows.groupBy("path", "own").agg(text("FileName").alias("name"), text("MimeType").alias("mime"), _value("FileData", F.col("place")).alias("place"), _value("FileData", F.col("size")).alias("size"))
    ix = F.row_number().over(W.partitionBy("path").orderBy("own")) - 1
    return a.select("path", ix.cast("bigint").alias("ix"), "name", "mime", "place", "size")


#: Elements that hold elements, and the number of each name.
HOLDERS, NUMBERS = np.array(list(MASTERS)), {name: k for k, name in {**MASTERS, **VALUES}.items()}


def _holders(b: walks.Bytes, part: str, name: str, through: str = "") -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Files of the holders of a name at any depth of a part of the segment, in file order, and (holder, name, start, stop) of what is in them or in those of a second name there."""
    at, end, file = b.first, b.last, np.arange(len(b.first))
    # of each range of a level the holder that it is or stands for, and whether it is one; -1 outside of them
    held, own, count, found, inside = np.full(len(at), -1), np.zeros(len(at), bool), 0, [], []
    for depth in range(33):
        level = b.elements(at, end)
        holder = held[level.owner]
        some = holder >= 0
        inside.append((holder[some], level.name[some], level.start[some], level.stop[some]))
        some = np.isin(level.name, HOLDERS) if depth != 1 else level.name == NUMBERS[part]
        if depth == 32 or not some.any():
            break
        holder, direct = holder[some], own[level.owner[some]]
        level = level.where(some)
        at, end, file = level.start, level.stop, file[level.owner]
        own = level.name == NUMBERS[name]
        held = np.where(direct & (level.name == NUMBERS[through]), holder, -1) if through else np.full(len(at), -1)
        held[own] = count + np.arange(own.sum())
        count += own.sum()
        found.append((file[own], at[own]))
    file, at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((at, file))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    holder, *values = (np.concatenate(x) for x in zip(*inside))
    return file[order], place[holder], tuple(values)


def _value_of(files: int, own: np.ndarray, values: tuple[np.ndarray, ...], element: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the first value of a name in each holder starts and stops, and which holders have one."""
    name, start, stop = values
    some = name == NUMBERS[element]
    return walks.firsts(files, own[some], start[some], stop[some])


def _attached(b: walks.Bytes) -> tuple[pa.Array | np.ndarray, ...]:
    """(file, ix, name, mime, place, size) of the attached files of some files."""
    file, *found = _holders(b, "Attachments", "Attached")
    own = [_value_of(len(file), *found, name) for name in ("FileName", "MimeType", "FileData")]
    texts = [b.strings(start, stop, known & (stop - start <= MOST_VALUE)) for start, stop, known in own[:2]]
    start, stop, known = own[2]
    place, size = (pa.array(x, mask=~known) for x in (start - b.first[file], stop - start))
    return file, walks.nth(file), *texts, place, size


def attached(files: DataFrame) -> DataFrame:
    """Rows of `attachments` of all files, in file order, out of one walk of each: neither elements nor holders are shuffled."""
    schema = arrow("path string, ix long, name binary, mime binary, place long, size long")

    def run(batches):
        for paths, content in walks.groups(batches):
            file, *columns = _attached(walks.Bytes(content))
            yield from walks.told(schema, paths.take(pa.array(file)), *columns)

    found = files.select("path", "content").mapInArrow(run, "path string, ix long, name binary, mime binary, place long, size long")
    return found.withColumns({c: F.col(c).cast("string") for c in ("name", "mime")})


def seek_points(found: DataFrame) -> DataFrame:
    """(path, track, ix, ticks, position): index entries of a Matroska file in file order."""
    rows = found.withColumn("point", F.regexp_extract("parent", r"^(.*/Point\.\d+)", 1)).where("point <> ''")
    rows = rows.where(F.col("name").isin("", "Time", "CueTrack", "CuePlace")).select("path", "point", "parent", "ix", "name", _number(F.col("value")).alias("n")).repartition("path")
    n = lambda name: _value(name, F.col("n"))
    held = rows.groupBy("path", "point", "parent").agg(n("Time").alias("time"), F.min(F.when(F.col("name") == "Time", F.col("ix"))).alias("at"), n("CueTrack").alias("track"), n("CuePlace").alias("position"))
    held = held.withColumn("ticks", F.min_by("time", "at").over(W.partitionBy("path", "point"))).where("parent LIKE '%/Position.%'")
    ix = F.row_number().over(W.partitionBy("path").orderBy("point", "parent")) - 1
    return held.select("path", "track", ix.cast("bigint").alias("ix"), "ticks", "position")


#: Boxes that say what a track is.
SAID = ("hdlr", "stsd", "mdhd", "tkhd")


def _track_boxes(files: DataFrame) -> DataFrame:
    """(path, ix, hdlr, stsd, mdhd, tkhd): payloads of each track of the first movie box, of several the highest; files of a batch are walked at once and nothing is shuffled."""
    fields = "path string, ix long, " + ", ".join(f"{name} binary" for name in SAID)
    schema = arrow(fields)

    def run(batches):
        for paths, content in walks.groups(batches):
            b = walks.Bytes(content)
            file, *columns = _said(b, *track_boxes(b, *SAID))
            yield from walks.told(schema, paths.take(pa.array(file)), *columns)

    return files.select("path", "content").mapInArrow(run, fields)


def _said(b: walks.Bytes, tracks: np.ndarray, ix: np.ndarray, found: dict[str, tuple[np.ndarray, ...]]) -> tuple[pa.Array | np.ndarray, ...]:
    """(file, ix, hdlr, stsd, mdhd, tkhd) of the tracks that have one of these boxes."""
    some = np.any([found[name][2] for name in SAID], axis=0)
    return tracks[some], ix[some], *(b.strings(*(x[some] for x in found[name])) for name in SAID)


def _said_within(b: walks.Bytes, tracks: np.ndarray, ix: np.ndarray, found: dict[str, tuple[np.ndarray, ...]]) -> tuple[pa.Array | np.ndarray, ...]:
    """(file, ix, handler, entry, packed, enabled) of the same tracks: only the fields of these boxes that are read."""
    some = np.any([found[name][2] for name in SAID], axis=0)

    def text(name: str, at: int) -> pa.Array:
        start, stop, known = (x[some] for x in found[name])
        return _text(b, np.minimum(start + at, stop), np.minimum(start + at + 4, stop), known)

    def number(name: str, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        start, stop, known = (x[some] for x in found[name])
        known = known & (start + at + size <= stop)
        start = np.where(known, start + at, 0)
        return b.number(start, start + size), known

    (version, said), (packed, a), (wide, c), (flags, flagged) = number("mdhd", 0, 1), number("mdhd", 20, 2), number("mdhd", 32, 2), number("tkhd", 3, 1)
    version = said & (version == 1)
    packed = pa.array(np.where(version, wide, packed).astype(np.int32), mask=~np.where(version, c, a))
    return tracks[some], ix[some], text("hdlr", 8), text("stsd", 12), packed, pa.array(flags & 1 == 1, mask=~flagged)


def _mp4_track(handler: Column, entry: Column, packed: Column, enabled: Column) -> dict[str, Column]:
    """What the boxes of a track say: kind, codec, is_default, language."""
    kind = F.lit("unknown")
    for name, codes in HANDLERS.items():
        kind = F.when(handler.isin(*codes), name).otherwise(kind)
    return {"kind": kind, "codec": codecs.sample_entry_codec(entry, kind, F.lit(None).cast("string")), "is_default": enabled, "language": names.language_of(packed)}


def mp4_tracks(files: DataFrame) -> DataFrame:
    """(path, ix, kind, codec, language, is_default): the first sample entry names the codec."""
    packed = F.when(uint(F.col("mdhd"), 0, 1) == 1, uint(F.col("mdhd"), 32, 2)).otherwise(uint(F.col("mdhd"), 20, 2)).cast("int")
    t = _mp4_track(F.substring("hdlr", 9, 4).cast("string"), F.substring("stsd", 13, 4).cast("string"), packed, uint(F.col("tkhd"), 3, 1).bitwiseAND(1) == 1)
    return _track_boxes(files).select("path", "ix", *(t[c].alias(c) for c in ("kind", "codec", "language", "is_default")))


def tracks(files: DataFrame) -> DataFrame:
    """(source, ix, kind, codec, is_default, language) of MP4 and Matroska files alike; unknown files have none.

    `source` is the path; operators.selection plans on these rows.
    """
    kinds = files.withColumn("container", container_of(F.col("content")))
    own = ("path", "ix", "kind", "codec", "is_default", "language")
    mp4 = mp4_tracks(kinds.where("container IN ('mp4', 'mov')")).select(*own)
    mkv = matroska_tracks(matroska_elements(kinds.where("container = 'matroska'"), "Tracks")).select(*own)
    return mp4.union(mkv).withColumnRenamed("path", "source")


def probed(files: DataFrame) -> DataFrame:
    """(path, container, duration_ms, tracks, chapters, attachments): one row a file; unknown and broken files have empty lists.

    A file lasts as long as its packets do, by the latest end in milliseconds.
    """
    from .containers import matroska_packets, mp4_chapters, mp4_packets

    kinds = files.withColumn("container", container_of(F.col("content")))
    named = kinds.select("path", "container")
    mp4, mkv = kinds.where("container IN ('mp4', 'mov')"), kinds.where("container = 'matroska'")
    # each list walks its own part of the file, so that no rows of the other parts are given out
    part = lambda name: matroska_elements(mkv, name)
    listed = lambda df, name, *own: df.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ix", *own))).alias(name))
    end = lambda c, scale: F.max(((c * 1000 - c * 1000 % scale) / scale).cast("bigint")).alias("duration_ms")
    long = mp4_packets(mp4).groupBy("path").agg(end(F.col("pts") + F.col("duration"), F.col("scale"))).union(matroska_packets(mkv).groupBy("path").agg(F.max(F.col("pts") + F.col("duration")).alias("duration_ms")))
    t = listed(tracks(files).withColumnRenamed("source", "path"), "tracks", "kind", "codec", "is_default", "language")
    own = ("id", "start_ms", "end_ms", "title")
    c = listed(mp4_chapters(mp4).select("path", "ix", *own).union(matroska_chapters(part("Chapters")).select("path", "ix", *own)), "chapters", *own)
    a = listed(attachments(part("Attachments")), "attachments", "name", "mime", "size")
    out = named.join(long, "path", "left").join(t, "path", "left").join(c, "path", "left").join(a, "path", "left")
    full = lambda name, df: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    return out.select("path", "container", "duration_ms", full("tracks", t), full("chapters", c), full("attachments", a))


def _tracks_within(b: walks.Bytes) -> tuple[pa.Array | np.ndarray, ...]:
    """(file, ix, kind, codec, default, language) of the tracks of some Matroska files, as they stand there."""
    level = b.elements(b.first, b.last)
    for name in ("Segment", "Tracks"):
        own = level.where(level.name == NUMBERS[name])
        own = own.where(walks.nth(own.owner) == 0)
        file = own.owner if name == "Segment" else file[own.owner]
        level = b.elements(own.start, own.stop)
    level = level.where(level.name == NUMBERS["Track"])
    file, at, end, track, found = file[level.owner], level.start, level.stop, np.arange(len(level.at)), []
    for _ in range(30):
        level = b.elements(at, end)
        found.append((track[level.owner], level.name, level.start, level.stop))
        level = level.where(np.isin(level.name, HOLDERS))
        at, end, track = level.start, level.stop, track[level.owner]
        if not len(at):
            break
    track, name, start, stop = (np.concatenate(x) for x in zip(*found))
    columns = []
    for own in ("Kind", "Codec", "Default", "Language"):
        some = name == NUMBERS[own]
        first, last, known = walks.firsts(len(file), track[some], start[some], stop[some])
        known &= last - first <= MOST_VALUE
        if own in ("Codec", "Language"):
            columns.append(_text(b, first, last, known))
        else:
            columns.append(_whole(*b.numbers(first, last, known)))
    return file, walks.nth(file), *columns


def _text(b: walks.Bytes, start: np.ndarray, stop: np.ndarray, known: np.ndarray) -> pa.Array:
    """Parts of the bytes as text, as they stand there."""
    return b.strings(start, stop, known).cast(pa.string(), safe=False)


def _whole(value: np.ndarray, known: np.ndarray) -> pa.Array:
    """Unsigned numbers that fit a bigint, null for others."""
    return pa.array(value.astype(np.int64), mask=~known | (value >> np.uint64(63) > 0))


def _chapters_within(b: walks.Bytes) -> tuple[pa.Array | np.ndarray, ...]:
    """(file, ix, id, start_ms, end_ms, title) of the chapters of some Matroska files, as `matroska_chapters` gives them."""
    file, *found = _holders(b, "Chapters", "Atom", "Display")

    def first(element: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, stop, known = _value_of(len(file), *found, element)
        return start, stop, known & (stop - start <= MOST_VALUE)

    def ms(element: str) -> tuple[np.ndarray, np.ndarray]:
        value, known = b.numbers(*first(element))
        return (value // np.uint64(1_000_000)).astype(np.int64), known & (value >> np.uint64(63) == 0)

    (begin, some), (until, ends), (uid, named) = ms("Start"), ms("End"), b.numbers(*first("Uid"))
    text = first("Text")
    own, ix = file[some], walks.nth(file[some])
    number = pc.binary_join_element_wise("ch", pa.array(ix).cast(pa.string()), "")
    own_id = pc.if_else(pa.array(named[some]), pa.array(uid[some]).cast(pa.string()), number)
    return own, ix, own_id, begin[some], pa.array(until[some], mask=~ends[some]), _text(b, *(x[some] for x in text))


def probed_at_once(files: DataFrame) -> DataFrame:
    """Rows of `probed`, each out of one file: all files of a batch are walked at once, and nothing is kept, joined or shuffled.

    Files that share a path are told apart, and numbers beyond 64 bits are none.
    """
    chapter, file = "array<struct<ix: long, id: string, start_ms: long, end_ms: long, title: string>>", "array<struct<ix: long, name: string, mime: string, size: long>>"
    fields = f"path string, container string, duration_ms long, mp4 array<struct<ix: long, handler: string, entry: string, packed: int, enabled: boolean>>, mkv array<struct<ix: long, kind: long, codec: string, default: long, language: string>>, chapters {chapter}, attachments {file}"
    schema = arrow(fields)

    def lists(b: walks.Bytes, **columns: tuple) -> list[pa.Array]:
        return [walks.lists(schema.field(c).type, len(b.first), *columns[c]) if c in columns else pa.array([[]] * len(b.first), schema.field(c).type) for c in schema.names[3:]]

    def of_mp4(b: walks.Bytes) -> list[pa.Array]:
        tracks, ix, found = track_boxes(b, *dict.fromkeys((*SAID, *TABLES)))
        own, n, *more = chapter_lists(b)
        order = np.lexsort((n, own))
        own, n, more = own[order], n[order], [(c if isinstance(c, pa.Array) else pa.array(c)).take(pa.array(order)) for c in more]
        number = pc.binary_join_element_wise("ch", pa.array(n).cast(pa.string()), "")
        return [mp4_lasting(b, tracks, found), *lists(b, mp4=_said_within(b, tracks, ix, found), chapters=(own, n, number, *more))]

    def of_matroska(b: walks.Bytes) -> list[pa.Array]:
        own, ix, name, mime, _, size = _attached(b)
        name, mime = (x.cast(pa.string(), safe=False) for x in (name, mime))
        return [matroska_lasting(b), *lists(b, mkv=_tracks_within(b), chapters=_chapters_within(b), attachments=(own, ix, name, mime, size))]

    def of_others(b: walks.Bytes) -> list[pa.Array]:
        return [pa.nulls(len(b.first), pa.int64()), *lists(b)]

    def run(batches):
        for named, content in walks.groups(batches):
            path, kind = named.field("path"), named.field("container")
            for kinds, made in ((("mp4", "mov"), of_mp4), (("matroska",), of_matroska), (("unknown",), of_others)):
                some = pc.is_in(kind, pa.array(kinds))
                if pc.any(some).as_py():
                    yield from walks.told(schema, path.filter(some), kind.filter(some), *made(walks.Bytes(content.filter(some))))

    found = files.select(F.struct("path", container_of(F.col("content")).alias("container")).alias("file"), "content").mapInArrow(run, fields)
    row = lambda t, said, language: F.struct(t["ix"].alias("ix"), *(said[c].alias(c) for c in ("kind", "codec", "is_default")), language.alias("language"))
    mp4 = F.transform("mp4", lambda t: row(t, said := _mp4_track(t["handler"], t["entry"], t["packed"], t["enabled"]), said["language"]))
    mkv = F.transform("mkv", lambda t: row(t, _matroska_track(t["kind"], t["codec"], t["default"]), t["language"]))
    return found.select("path", "container", "duration_ms", F.when(F.col("container") == "matroska", mkv).otherwise(mp4).alias("tracks"), "chapters", "attachments")


def subtitle_blocks(files: DataFrame) -> DataFrame:
    """(path, track, codec, block, ticks, scale_ns, duration, source_offset, size) of subtitle tracks, for payload reads and cues."""
    return matroska_frames(files).where("kind = 17").select("path", "track", codecs.matroska_codec(F.col("codec")).alias("codec"), "block", "ticks", "scale_ns", "duration", "source_offset", "size")


def text_frames(files: DataFrame) -> DataFrame:
    """(path, track, codec, block, k, ticks, scale_ns, frame_ns, duration, payload): frames of Matroska's subtitle tracks with what is in them, out of one walk of each file."""
    fields = "path string, track long, codec string, block long, k long, ticks long, scale_ns long, frame_ns long, duration long, payload binary"
    schema = arrow(fields)

    def frames(path: str, data: bytes) -> Iterator[tuple]:
        encodings = encodings_of(data)
        for _, track, codec, _, block, k, ticks, scale, frame_ns, duration, _, at, size in file_frames(path, data, 17):
            yield path, track, codec, block, k, ticks, scale, frame_ns, duration, decoded(data[at : at + size], encodings.get(track))

    def run(batches):
        yield from together(((len(data), list(frames(path, data))) for path, data in contents(batches)), schema)

    return files.select("path", "content").mapInArrow(run, fields)


def payloads(files: DataFrame, packets: DataFrame) -> DataFrame:
    """Packets (path, source_offset, size, ...) with `payload`, or `error` where they lie outside their file.

    Files are joined by path once for all of their packets; bytes are sliced without Python.
    """
    return sliced(packets.join(files.select("path", "content"), "path", "left"))


def sliced(packets: DataFrame) -> DataFrame:
    """Packets with the `content` of their file, as `payloads` gives them: `payload` or `error` stand for the content."""
    length, end = F.octet_length("content").cast("bigint"), F.col("source_offset") + F.col("size")
    error = F.when((F.col("source_offset") < 0) | (F.col("size") < 0), "invalid range").when(length.isNull(), "no such file").when(end > length, "outside the source")
    part = F.substring(F.col("content"), (F.col("source_offset") + 1).cast("int"), F.col("size").cast("int"))
    rows = packets.withColumn("error", error)
    return rows.withColumn("payload", F.when(F.col("error").isNull(), part)).drop("content")


def text_cues(files: DataFrame) -> DataFrame:
    """(track, ix, start_ms, end_ms, text) of the text tracks of MP4 and Matroska files; `track` is the path and the track's number.

    A cue lasts as its packet does, and 1 ms at least; packets without text give none. Matroska's zlib
    and header stripping are undone; packets encrypted or compressed otherwise give no cues.
    """
    from ..operators.formats import payload_text
    from .containers import mp4_packets

    kinds = files.withColumn("container", container_of(F.col("content")))
    mp4, mkv = kinds.where("container IN ('mp4', 'mov')"), kinds.where("container = 'matroska'")
    ms = lambda c: ((F.col(c) * 1000 - F.col(c) * 1000 % F.col("scale")) / F.col("scale")).cast("bigint")
    own = ("path", "track", "ix", "start_ms", "end_ms", "codec", "payload")
    a = mp4_packets(mp4).join(mp4_tracks(mp4).where("kind = 'subtitle'").select("path", F.col("ix").alias("track"), "codec"), ["path", "track"]).withColumn("start_ms", ms("pts")).withColumn("end_ms", F.col("start_ms") + ms("duration"))
    length = ((F.col("duration") * F.col("scale_ns") - F.col("duration") * F.col("scale_ns") % 1_000_000) / 1_000_000).cast("bigint")
    b = timed_frames(text_frames(mkv)).withColumn("start_ms", F.col("pts")).withColumn("end_ms", F.col("pts") + F.coalesce(length, "lasts")).withColumn("codec", codecs.matroska_codec(F.col("codec")))
    read = payloads(mp4, a).select(*own).union(b.select(*own))
    cues = read.select(F.concat_ws("#", "path", F.col("track").cast("string")).alias("track"), "ix", "start_ms", F.greatest("end_ms", F.col("start_ms") + 1).alias("end_ms"), payload_text(F.col("codec"), F.col("payload")).alias("text"))
    return cues.where("text IS NOT NULL")
