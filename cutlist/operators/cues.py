"""Subtitle cues: parsing, rendering, segments, playlists and budgets. Cues are rows (track, ix, start_ms, end_ms, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import timing

#: Budgets of segmentation, checked in this order.
MOST_SEGMENTS, MOST_VISITS, MOST_BYTES, ROW_BYTES = 100_000, 2_000_000, 32 << 20, 128


def subrip_millis(stamp: Column) -> Column:
    """h:m:s,mmm in milliseconds: three parts, minutes and seconds under 60, up to three digits of fraction; else null."""
    s = F.trim(stamp)
    ok = F.regexp_like(s, F.lit(r"^\+?\d+:\+?\d+:\+?\d+[.,]\d"))
    part = lambda k: F.when(ok, F.regexp_extract(s, r"^\+?(\d+):\+?(\d+):\+?(\d+)[.,](.*)$", k))
    tail = F.substring(part(4), 1, 3)
    h, m, sec = (part(k).cast("bigint") for k in (1, 2, 3))
    good = F.regexp_like(tail, F.lit(r"^\d+$")) & (m < 60) & (sec < 60)
    return F.when(good, ((h * 60 + m) * 60 + sec) * 1000 + F.rpad(tail, 3, "0").cast("bigint"))


def parse_subrip(files: DataFrame) -> DataFrame:
    """(track, text) -> cues: blocks between blank lines, an index line if any, a line of times, then text.

    Blocks without times, without text, or that end no later than they start are left out.
    """
    unix = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n")
    blocks = files.select("track", F.posexplode(F.split(unix, "\n\n")).alias("b", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    rows = blocks.withColumn("lines", lines).where(F.size("lines") > 0)
    rows = rows.withColumn("k", F.when(F.contains(F.try_element_at("lines", F.lit(1)), F.lit("-->")), 1).otherwise(2)).where(F.size("lines") >= F.col("k"))
    head = F.try_element_at("lines", F.col("k"))
    times = F.split(head, "-->", 2)
    end = F.element_at(F.split(F.trim(F.regexp_replace(F.try_element_at(times, F.lit(2)), r"\s+", " ")), " "), 1)
    text = F.array_join(F.slice("lines", F.col("k") + 1, F.size("lines")), "\n")
    out = rows.select("track", "b", subrip_millis(times[0]).alias("start_ms"), subrip_millis(end).alias("end_ms"), text.alias("text"))
    out = out.where("start_ms IS NOT NULL AND end_ms > start_ms AND trim(text) <> ''")
    return out.select("track", (F.row_number().over(W.partitionBy("track").orderBy("b")) - 1).cast("bigint").alias("ix"), "start_ms", "end_ms", "text")


def webvtt_cue(start: Column, end: Column, text: Column) -> Column:
    return F.concat(timing.clock(start), F.lit(" --> "), timing.clock(end), F.lit("\n"), F.trim(text), F.lit("\n\n"))


def _joined(rows: DataFrame, keys: list[str], order: str, text: Column, head: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), body).alias("body"))


def render_webvtt(cues: DataFrame) -> DataFrame:
    """(track, body): one document a track."""
    return _joined(cues, ["track"], "ix", webvtt_cue(F.col("start_ms"), F.col("end_ms"), F.col("text")), "WEBVTT\n\n")


def segment_counts(cues: DataFrame, segment_ms: int, prefix: str = "") -> DataFrame:
    """(track, segments, visits, bytes, rejected): what segmentation would cost, and the first budget that it breaks."""
    whole = lambda c: ((c - c % segment_ms) / segment_ms).cast("bigint")
    live = F.col("end_ms") > F.col("start_ms")
    again = F.when(live, whole(F.col("end_ms") - 1) - whole(F.col("start_ms")) + 1).otherwise(0)
    rows = cues.withColumn("again", again)
    got = rows.groupBy("track").agg(whole(F.max("end_ms") + segment_ms - 1).alias("segments"), F.sum("again").alias("visits"), F.sum(F.col("again") * (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES)).alias("b"))
    got = got.withColumn("bytes", F.col("b") + F.col("segments") * (len(prefix.encode()) + ROW_BYTES)).drop("b")
    return got.withColumn("rejected", F.when(F.col("segments") > MOST_SEGMENTS, "subtitle segments").when(F.col("visits") > MOST_VISITS, "subtitle cue expansions").when(F.col("bytes") > MOST_BYTES, "subtitle output bytes"))


def segment_webvtt(cues: DataFrame, segment_ms: int, prefix: str = "") -> DataFrame:
    """(track, segment, start_ms, duration_ms, uri, body): cues in every segment that they touch, in order.

    Empty segments have the header only; tracks that break a budget have no segments.
    """
    if segment_ms <= 0:
        raise ValueError("subtitle segment duration must be positive")
    within = segment_counts(cues, segment_ms, prefix).where("rejected IS NULL AND segments > 0")
    ends = cues.groupBy("track").agg(F.max("end_ms").alias("last"))
    grid = within.join(ends, "track").select("track", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("segments") - 1)).alias("segment"))
    live = cues.join(within.select("track"), "track").where("end_ms > start_ms")
    whole = lambda c: ((c - c % segment_ms) / segment_ms).cast("bigint")
    spread = live.withColumn("segment", F.explode(F.sequence(whole(F.col("start_ms")), whole(F.col("end_ms") - 1))))
    bodies = _joined(spread, ["track", "segment"], "ix", webvtt_cue(F.col("start_ms"), F.col("end_ms"), F.col("text")), "WEBVTT\n\n")
    start = F.col("segment") * segment_ms
    uri = F.format_string((f"{prefix}/" if prefix else "") + "seg-%05d.vtt", "segment")
    return grid.join(bodies, ["track", "segment"], "left").select("track", "segment", start.alias("start_ms"), F.least(F.lit(segment_ms), F.col("last") - start).alias("duration_ms"), uri.alias("uri"), F.coalesce("body", F.lit("WEBVTT\n\n")).alias("body"))


def bounded_tracks(sizes: DataFrame, most: int = MOST_BYTES, tracks: int = 128) -> DataFrame:
    """(owner, ix, bytes) -> with `fits`: whether all tracks up to this one, in order, are within both limits."""
    upto = W.partitionBy("owner").orderBy("ix").rowsBetween(W.unboundedPreceding, 0)
    return sizes.withColumn("fits", (F.sum("bytes").over(upto) <= most) & (F.count("*").over(upto) <= tracks))


def display_cues(displays: DataFrame) -> DataFrame:
    """(track, ix, time_ms, objects, width, height) -> cues: each display lasts until the next one, empty ones clear.

    Rows of `error` say where time runs backwards or the canvas changes; a track with one has no cues.
    """
    by = W.partitionBy("track").orderBy("ix")
    changed = (F.lag("width").over(by) != F.col("width")) | (F.lag("height").over(by) != F.col("height"))
    rows = displays.withColumns({"end_ms": F.lead("time_ms").over(by), "bad": F.when(F.lag("time_ms").over(by) > F.col("time_ms"), "time runs backwards").when(changed, "canvas changed")})
    rows = rows.withColumn("error", F.max("bad").over(W.partitionBy("track")))
    return rows.where("error IS NULL AND objects > 0 AND end_ms > time_ms").select("track", "ix", F.col("time_ms").alias("start_ms"), "end_ms", "objects")


def plain_text(text: Column) -> Column:
    """Text without {...} groups, nested to any depth, and <...> tags; trimmed lines, blank ones left out.

    A fold over the pieces between braces and angles: an open group or tag that never closes takes all
    that follows, and a tag inside a group is part of it.
    """

    def step(s: Column, piece: Column) -> Column:
        deep, tag = s["deep"], s["tag"]
        opens, closes = (piece == "{") & ~tag, (piece == "}") & ~tag & (deep > 0)
        begins, ends = (piece == "<") & ~tag & (deep == 0), (piece == ">") & tag
        stays = ~(tag | opens | closes | begins) & (deep == 0)
        return F.struct((deep + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("deep"), ((tag | begins) & ~ends).alias("tag"), F.when(stays, F.concat(s["out"], piece)).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("deep"), F.lit(False).alias("tag"), F.lit("").alias("out"))
    pieces = F.regexp_extract_all(text, F.lit(r"([{}<>]|[^{}<>]+)"), F.lit(1))
    out = F.when(F.regexp_like(text, F.lit("[{}<>]")), F.aggregate(pieces, start, step, lambda s: s["out"])).otherwise(text)
    lines = F.filter(F.transform(F.split(F.regexp_replace(out, "\r\n", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(lines, "\n")


def mov_text(text: Column) -> Column:
    """A timed-text sample in hex: two bytes of length, then UTF-8; null for empty text or more than 65,535 bytes."""
    n = F.octet_length(text)
    return F.when((n > 0) & (n <= 65_535), F.concat(F.lpad(F.hex(n.cast("bigint")), 4, "0"), F.hex(F.encode(text, "UTF-8"))))


def color_classes(cues: DataFrame, most: int = 4096) -> DataFrame:
    """(track, colors): the different colours that a track's cues name by class, in order; null where they are more than `most`."""
    named = cues.select("track", F.explode(F.regexp_extract_all("text", F.lit(r"<c\.ttmlc([0-9a-f]{6})>"), F.lit(1))).alias("color"))
    got = named.groupBy("track").agg(F.array_sort(F.collect_set("color")).alias("colors"))
    return got.select("track", F.when(F.size("colors") <= most, F.col("colors")).alias("colors"))
