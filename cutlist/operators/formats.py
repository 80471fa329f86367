"""Further subtitle formats as cues (track, ix, start_ms, end_ms, text), and cues as lines of ASS."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import timing
from ..functions.binary import rows, uint
from .cues import plain_text


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    ix = F.row_number().over(W.partitionBy("track").orderBy(order)) - 1
    return rows.select("track", ix.cast("bigint").alias("ix"), "start_ms", "end_ms", "text")


def microdvd(files: DataFrame) -> DataFrame:
    """(track, text, fps) -> cues from lines `{from}{to}text` in frames.

    A first line {0}{0} or {1}{1} declares the rate, else the source's counts. `|` breaks lines, and
    leading {y:...} groups style the whole line. Files with a line of another shape, or without a
    rate of 1 to 1,000, give nothing.
    """
    shape = r"^\{(\d+)\}\{(\d+)\}(.*)$"
    lines = files.select("track", "fps", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("k", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    part = lambda i: F.regexp_extract("line", shape, i)
    rows = lines.withColumns({"ok": F.regexp_like("line", F.lit(shape)), "a": part(1).try_cast("bigint"), "b": part(2).try_cast("bigint"), "body": part(3)})
    every = W.partitionBy("track")
    first = F.col("k") == F.min("k").over(every)
    rows = rows.withColumn("head", first).withColumn("declares", F.col("head") & (F.col("a") == F.col("b")) & F.col("a").isin(0, 1))
    rows = rows.withColumn("rate", F.coalesce(F.max(F.when(F.col("declares"), F.trim("body").try_cast("double"))).over(every), "fps")).withColumn("all_ok", F.min(F.col("ok").cast("int")).over(every) == 1)
    good = rows.where("all_ok AND NOT declares AND rate BETWEEN 1 AND 1000 AND b > a")
    tags = F.regexp_extract("body", r"^((?:\{[^}]*\})*)", 1)
    text = F.replace(F.regexp_replace("body", r"^(?:\{[^}]*\})+", ""), F.lit("|"), F.lit("\n"))
    text = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for letter in "ibu":
        has = F.regexp_like(tags, F.lit(rf"\{{[yY]:[^}}]*{letter}"))
        text = F.when(has, F.concat(F.lit(f"<{letter}>"), text, F.lit(f"</{letter}>"))).otherwise(text)
    ms = lambda c: F.round(F.col(c) * 1000.0 / F.col("rate")).cast("bigint")
    return _numbered(good.select("track", "k", ms("a").alias("start_ms"), ms("b").alias("end_ms"), text.alias("text")), "k")


def subviewer(files: DataFrame) -> DataFrame:
    """(track, text) -> cues from a line `start,end` and the lines up to the next blank one; [br] breaks lines."""
    lines = files.select("track", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("k", "line"))
    cut = F.split(F.trim("line"), ",", 2)
    by = W.partitionBy("track").orderBy("k")
    rows = lines.withColumns({"start_ms": timing.stamp_millis(cut[0]), "end_ms": timing.stamp_millis(F.try_element_at(cut, F.lit(2))), "blank": F.trim("line") == ""})
    rows = rows.withColumn("part", F.sum(F.col("blank").cast("int")).over(by)).where("NOT blank")
    rows = rows.withColumn("timed", F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    # times inside a body are text: the first of a part counts
    head = F.min(F.when(F.col("timed"), F.col("k"))).over(W.partitionBy("track", "part"))
    rows = rows.withColumn("head", head).where("k >= head")
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") > F.col("head"), F.struct("k", "line")))), lambda x: F.replace(x["line"], F.lit("[br]"), F.lit("\n")))
    got = rows.groupBy("track", "part").agg(F.min_by("start_ms", "k").alias("start_ms"), F.min_by("end_ms", "k").alias("end_ms"), F.array_join(body, "\n").alias("text"))
    return _numbered(got, "part")


def payload_text(codec: Column, payload: Column) -> Column:
    """Plain text of a native sample: length-prefixed, ASS with its fields, or as it stands; null where nothing is left."""
    length = F.conv(F.hex(F.substring(payload, 1, 2)), 16, 10).cast("int")
    timed = F.when((F.octet_length(payload) >= 2) & (F.octet_length(payload) >= length + 2), F.substring(payload, F.lit(3), length).cast("string"))
    raw = payload.cast("string")
    dialogue, event = F.split(F.trim(F.regexp_replace(raw, "^Dialogue:", "")), ",", 10), F.split(raw, ",", 9)
    ass = F.coalesce(F.when(F.startswith(raw, F.lit("Dialogue:")), F.try_element_at(dialogue, F.lit(10))), F.try_element_at(event, F.lit(9)), raw)
    ass = F.replace(F.replace(ass, F.lit("\\N"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    text = F.when(codec.isin("mov_text", "tx3g", "text"), timed).when(codec.isin("ass", "ssa"), ass).when(codec.isin("subrip", "webvtt", "subviewer", "microdvd"), raw)
    return F.nullif(plain_text(text), F.lit(""))


def ass_dialogue(event: Column, start: Column, duration: Column) -> Column:
    """A line of ASS from a Matroska event of nine fields, lasting 10 ms at least; null for another number of fields."""
    f = F.split(F.regexp_replace(event, "\u0000+$", ""), ",", 9)
    rest = F.array_join(F.slice(f, 3, 7), ",")
    line = F.concat(F.lit("Dialogue: "), F.try_element_at(f, F.lit(2)), F.lit(","), timing.ass_clock(start), F.lit(","), timing.ass_clock(start + F.greatest(duration, F.lit(10))), F.lit(","), rest, F.lit("\n"))
    return F.when((F.size(f) == 9) & F.regexp_like(F.trim(f[0]), F.lit(r"^\d+$")), line)


def ass_alignment(settings: Column) -> Column:
    """Number-pad place of a WebVTT cue: columns by align, rows by the line's per cent, the bottom middle by default."""
    align = F.regexp_extract(settings, r"(?:^|\s)align:(\S*)", 1)
    col = F.when(align.isin("left", "start"), 0).when(align.isin("right", "end"), 2).otherwise(1)
    line = F.regexp_extract(settings, r"(?:^|\s)line:([^%\s]*)", 1).try_cast("double")
    return F.lit(1) + F.when(line <= 20, 6).when(line < 80, 3).otherwise(0) + col


def ttml(files: DataFrame) -> DataFrame:
    """(track, text) -> cues of all paragraphs, whose times lie within those of their parents; <br/> breaks lines.

    The nesting of a document is walked by a small parser that gives out each element's own begin, end
    and dur as written; Spark turns them into times and intersects them from the outside in. Broken
    documents give nothing.
    """

    def local(tag) -> str:
        return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""

    def words(node) -> str:
        inner = "".join(("\n" if local(c.tag) == "br" else words(c)) + (c.tail or "") for c in node)
        return (node.text or "") + inner

    def walk(node, outer):
        own = [*outer, {k: node.get(k) for k in ("begin", "end", "dur")}]
        if local(node.tag) == "p":
            yield own, words(node)
        elif local(node.tag) != "head":
            for child in node:
                yield from walk(child, own)

    def run(batches):
        for b in batches:
            out = []
            for track, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                out += [(track, k, levels, body) for k, (levels, body) in enumerate(walk(root, []))]
            if out:
                level = pa.list_(pa.struct([("begin", pa.string()), ("end", pa.string()), ("dur", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), level, pa.string()))], ["track", "k", "levels", "text"])

    rows = files.select("track", "text").mapInArrow(run, "track long, k long, levels array<struct<begin:string,end:string,dur:string>>, text string")
    far = F.lit(30 * 24 * 3_600_000).cast("bigint")

    def inside(span: Column, level: Column) -> Column:
        start = span["s"] + F.coalesce(timing.ttml_millis(level["begin"]), F.lit(0).cast("bigint"))
        end = F.least(span["e"], F.coalesce(span["s"] + timing.ttml_millis(level["end"]), far), F.coalesce(start + timing.ttml_millis(level["dur"]), far))
        return F.struct(start.alias("s"), end.alias("e"))

    span = F.aggregate("levels", F.struct(F.lit(0).cast("bigint").alias("s"), far.alias("e")), inside)
    timed = rows.withColumn("span", span).select("track", "k", F.col("span.s").alias("start_ms"), F.col("span.e").alias("end_ms"), F.regexp_replace(F.trim("text"), r"[ \t]*\n[ \t]*", "\n").alias("text"))
    return _numbered(timed.where("end_ms > start_ms AND text <> ''"), "k")


def sami(files: DataFrame) -> DataFrame:
    """(track, text, duration_ms) -> (track, class, ix, start_ms, end_ms, text): what each class shows from one sync point to the next.

    The last point lasts until the duration, if there is one. Line breaks and bold, italic and underlined
    text stay; a point that shows nothing but hard spaces clears. Files without a body, or whose points
    run backwards, give nothing.
    """
    body = F.regexp_extract("text", r"(?is)<body[^>]*>(.*)$", 1)
    clean = F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1>", "")
    parts = files.select("track", "duration_ms", F.posexplode(F.split(clean, r"(?i)<sync\b")).alias("k", "part")).where("k > 0")
    start = F.regexp_extract("part", r"""(?i)^[^>]*\bstart\s*=\s*['"]?(\d+)""", 1).try_cast("bigint")
    rows = parts.withColumn("start_ms", start)
    by, every = W.partitionBy("track").orderBy("k"), W.partitionBy("track")
    rows = rows.withColumn("bad", F.col("start_ms").isNull() | F.coalesce(F.lag("start_ms").over(by) > F.col("start_ms"), F.lit(False)))
    rows = rows.withColumns({"broken": F.max("bad").over(every), "end_ms": F.coalesce(F.lead("start_ms").over(by), "duration_ms")}).where("NOT broken AND end_ms > start_ms")
    shown = rows.withColumn("inner", F.regexp_replace("part", r"^[^>]*>", ""))
    # what stands before the first paragraph belongs to the default class
    groups = shown.select("track", "k", "start_ms", "end_ms", F.posexplode(F.split("inner", r"(?i)<p(?=[\s>])")).alias("g", "raw"))
    name = F.when(F.col("g") > 0, F.coalesce(F.nullif(F.regexp_extract("raw", r"""(?i)^[^>]*\bclass\s*=\s*['"]?([^'"\s>]+)""", 1), F.lit("")), F.lit("default"))).otherwise("default")
    text = F.when(F.col("g") > 0, F.regexp_replace("raw", r"^[^>]*>", "")).otherwise(F.col("raw"))
    text = F.regexp_replace(F.regexp_replace(text, r"\s*\n\s*", " "), r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)<(?!/?[biu]>)[^>]*>", "")
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n")
    cues = groups.select("track", "k", "g", "start_ms", "end_ms", name.alias("class"), lines.alias("text"))
    cues = cues.groupBy("track", "class", "k", "start_ms", "end_ms").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "text"))), lambda x: x["text"]), " ").alias("text"))
    cues = cues.where(F.trim(F.regexp_replace("text", r"&nbsp;|&#160;|\s", "")) != "")
    ix = F.row_number().over(W.partitionBy("track", "class").orderBy("k")) - 1
    return cues.select("track", "class", ix.cast("bigint").alias("ix"), "start_ms", "end_ms", F.trim("text").alias("text"))


def sami_classes(files: DataFrame) -> DataFrame:
    """(track, class, language, name): what the style sheets of SAMI files say about each class; the last rule of a class counts."""
    sheet = F.array_join(F.regexp_extract_all("text", F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1)), "\n")
    rules = files.select("track", F.posexplode(F.regexp_extract_all(sheet, F.lit(r"\.([A-Za-z0-9_-]+\s*\{[^}]*)\}"), F.lit(1))).alias("k", "rule"))
    said = lambda name: F.nullif(F.trim(F.regexp_extract("rule", rf"""(?i)[{{;]\s*{name}\s*:\s*['"]?([^;'"}}]*)""", 1)), F.lit(""))
    parts = rules.select("track", "k", F.trim(F.regexp_extract("rule", r"^([^{\s]*)", 1)).alias("class"), said("lang").alias("language"), said("name").alias("name"))
    return parts.groupBy("track", "class").agg(F.max_by("language", "k").alias("language"), F.max_by("name", "k").alias("name"))


#: What the bits of a face mean, from the inside out.
FACES = ((4, "u"), (2, "i"), (1, "b"))


def _faced(text: Column, face: Column) -> Column:
    for code, sign in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    for bit, tag in FACES:
        text = F.when(face.bitwiseAND(bit) > 0, F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(text)
    return text


def styled_text(payload: Column, face: Column | int = 0) -> Column:
    """Text of a timed-text sample with its runs of bold, italic and underlined characters; null where the sample is broken.

    Runs come out of a `styl` box right behind the text: first and last character, font, face, size and colour.
    They must not overlap, and lie within the text; what they leave has the face given. Places count
    characters, so that texts beyond the basic plane, where they count halves, have no runs here.
    """
    face = F.lit(face) if isinstance(face, int) else face
    length = uint(payload, 0, 2)
    text = F.when(F.octet_length(payload) >= length + 2, F.substring(payload, F.lit(3), length.cast("int")).cast("string"))
    box = F.substring(payload, (length + 3).cast("int"), F.octet_length(payload))
    styled = (F.substring(box, 5, 4).cast("string") == "styl") & (uint(box, 0, 4) == F.octet_length(box)) & (F.octet_length(box) == 10 + uint(box, 8, 2) * 12)
    runs = F.array_sort(F.when(styled, rows(box, 10, uint(box, 8, 2), (2, 2, 2, 1, 1, 4))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"), F.lit(True).alias("good"))

    def step(s: Column, r: Column) -> Column:
        fits = s["good"] & (r["f0"] >= s["at"]) & (r["f1"] > r["f0"]) & (r["f1"] <= F.length(text)) & (r["f3"] < 8)
        piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
        between = F.when(r["f0"] > s["at"], _faced(piece(s["at"], r["f0"]), face)).otherwise("")
        return F.struct(r["f1"].alias("at"), F.concat(s["out"], between, _faced(piece(r["f0"], r["f1"]), r["f3"])).alias("out"), fits.alias("good"))

    def done(s: Column) -> Column:
        rest = F.when(s["at"] < F.length(text), _faced(F.substring(text, (s["at"] + 1).cast("int"), F.length(text)), face)).otherwise("")
        return F.when(s["good"], F.concat(s["out"], rest))

    plain = F.when(F.octet_length(box) == 0, _faced(text, face))
    return F.nullif(F.coalesce(plain, F.aggregate(runs, start, step, done)), F.lit(""))


def webvtt_samples(samples: DataFrame) -> DataFrame:
    """(track, ix, start_ms, end_ms, payload) -> (track, ix, k, start_ms, end_ms, id, settings, text): the cues of MP4 samples of WebVTT.

    A sample is a list of boxes: `vttc` holds a cue's text, settings and identifier, `vtte` says that nothing is
    shown. A cue without text, or a sample that a box leads out of, gives nothing.
    """

    def boxes(data: memoryview):
        at = 0
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if size < 8 or at + size > len(data):
                break
            yield bytes(data[at + 4 : at + 8]), data[at + 8 : at + size]
            at += size
        if at != len(data):
            raise ValueError("a box leads out of its sample")

    def cues(raw: bytes):
        out = []
        for name, body in boxes(memoryview(raw)):
            if name == b"vttc":
                parts = {k: bytes(v).decode() for k, v in boxes(body)}
                out.append((parts.get(b"iden"), parts.get(b"sttg"), parts.get(b"payl")))
        return out

    def run(batches):
        for b in batches:
            made = []
            for row in b.to_pylist():
                try:
                    found = cues(row["payload"] or b"")
                except ValueError:
                    continue
                made += [{**{c: row[c] for c in ("track", "ix", "start_ms", "end_ms")}, "k": k, "id": i, "settings": s, "text": t} for k, (i, s, t) in enumerate(found) if t]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=wanted)

    wanted = pa.schema([("track", pa.int64()), ("ix", pa.int64()), ("k", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("id", pa.string()), ("settings", pa.string()), ("text", pa.string())])
    return samples.select("track", "ix", "start_ms", "end_ms", "payload").mapInArrow(run, "track long, ix long, k long, start_ms long, end_ms long, id string, settings string, text string")
