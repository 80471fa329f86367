"""Keyframe-aligned chunks, segment windows, and lookups in packet order.

Packets are rows (track, ix, pts, duration, size, keyframe) with times in milliseconds and ix in
decode order. The greedy cut has no closed form, but only keyframes can cut: the fold runs over
them, and all else is windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timing import minus
from .asof import latest
from .fold import ordered_fold

#: Fixed value: windows shorter than this many milliseconds merge into their neighbour.
SHORT = 1000


def cuts(packets: DataFrame, target_ms: int, origin: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(track, ix, pts): the first packet of each chunk of at least `target_ms`, cut before a keyframe.

    The first chunk counts from its first packet, or from `origin`. Bigint columns of `carry` come along.
    """
    first = F.lag("ix").over(W.partitionBy("track").orderBy("ix")).isNull()
    rows = packets.select("track", "ix", "pts", "keyframe", first.alias("first"), *carry).where("keyframe OR first").drop("first")
    names = ["track", "ix", "pts", *carry]

    def step(start, row):
        if start is None:
            return row["pts"] if origin is None else origin, [tuple(row[n] for n in names)]
        if row["keyframe"] and max(row["pts"] - start, 0) >= target_ms:
            return row["pts"], [tuple(row[n] for n in names)]
        return start, []

    return ordered_fold(rows, ["track"], ["ix"], lambda: None, step, ", ".join(f"{n} long" for n in names), names)


def numbered(packets: DataFrame, heads: DataFrame) -> DataFrame:
    """Packets with the number of the chunk they are in, `chunk`."""
    marked = packets.join(heads.select("track", "ix", F.lit(1).alias("cut")), ["track", "ix"], "left")
    return marked.withColumn("chunk", F.sum(F.coalesce("cut", F.lit(0))).over(W.partitionBy("track").orderBy("ix")) - 1).drop("cut")


def plan_chunks(packets: DataFrame, target_ms: int) -> DataFrame:
    """(track, chunk, start_ms, duration_ms, packet_start, packet_end, key_aligned).

    A chunk ends where its last packet in decode order does, not at the latest end. A target of 0
    plans nothing.
    """
    if target_ms <= 0:
        packets = packets.limit(0)
    rows = numbered(packets, cuts(packets, target_ms))
    start = F.min_by("pts", "ix")
    return rows.groupBy("track", "chunk").agg(
        start.alias("start_ms"), F.greatest(F.max_by(F.col("pts") + F.col("duration"), "ix") - start, F.lit(0)).alias("duration_ms"),
        F.min("ix").alias("packet_start"), (F.max("ix") + 1).alias("packet_end"), F.min_by("keyframe", "ix").alias("key_aligned"),
    )


def plan_sample_chunks(packets: DataFrame, target_ms: int, scale: int) -> DataFrame:
    """The plan of a sample table: times in units of 1/scale s, rounded once (start + duration), from time 0."""
    ms = lambda c: ((c * 1000 - F.pmod(c * 1000, F.lit(scale))) / scale).cast("bigint")
    t = packets.withColumn("end_ms", ms(F.col("pts") + F.col("duration"))).withColumn("pts", ms(F.col("pts")))
    rows = numbered(t, cuts(t, target_ms, origin=0))
    start = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("first")).cast("bigint")
    return rows.groupBy("track", "chunk").agg(F.min_by("pts", "ix").alias("first"), F.max_by("end_ms", "ix").alias("last"), F.min("ix").alias("packet_start"), (F.max("ix") + 1).alias("packet_end"), F.min_by("keyframe", "ix").alias("key_aligned")).select("track", "chunk", start.alias("start_ms"), minus(F.col("last"), start).alias("duration_ms"), "packet_start", "packet_end", "key_aligned")


def collapse(windows: DataFrame, short: int = SHORT) -> DataFrame:
    """(track, n, start_ms, end_ms) with windows shorter than `short` merged into the one before; the first, if still short, into the next."""
    by = W.partitionBy("track").orderBy("n")
    kept = windows.withColumn("g", F.sum(F.when((F.row_number().over(by) == 1) | (F.col("end_ms") - F.col("start_ms") >= short), 1).otherwise(0)).over(by))
    merged = kept.groupBy("track", "g").agg(F.min_by("start_ms", "n").alias("start_ms"), F.max_by("end_ms", "n").alias("end_ms"))
    by = W.partitionBy("track").orderBy("g")
    brief = (F.col("g") == 1) & (F.col("end_ms") - F.col("start_ms") < short) & (F.count("*").over(W.partitionBy("track")) > 1)
    merged = merged.withColumn("brief", brief).withColumn("start_ms", F.when(F.lag("brief").over(by), F.lag("start_ms").over(by)).otherwise(F.col("start_ms")))
    return merged.where("NOT brief").select("track", (F.row_number().over(by) - 1).cast("bigint").alias("n"), "start_ms", "end_ms")


def segment_windows(packets: DataFrame, target_ms: int, short: int = SHORT) -> DataFrame:
    """Segments of a video track: each ends where the next begins, the last at the latest packet end."""
    last = F.max(F.col("pts") + F.col("duration")).over(W.partitionBy("track"))
    heads = cuts(packets.withColumn("last", last), target_ms, carry=("last",))
    by = W.partitionBy("track").orderBy("ix")
    w = heads.withColumn("next", F.lead("pts").over(by)).withColumn("n", F.row_number().over(by))
    return collapse(w.select("track", "n", F.col("pts").alias("start_ms"), F.coalesce("next", F.greatest("last", F.col("pts") + 1)).alias("end_ms")), short)


def chunk_windows(plan: DataFrame, short: int = SHORT) -> DataFrame:
    """Chunks as windows: each ends where the next starts, at least 1 ms after its own start."""
    by = W.partitionBy("track").orderBy("chunk")
    end = F.greatest(F.coalesce(F.lead("start_ms").over(by), F.col("start_ms") + F.col("duration_ms")), F.col("start_ms") + 1)
    return collapse(plan.select("track", F.col("chunk").alias("n"), "start_ms", end.alias("end_ms")), short)


def spaced_durations(plan: DataFrame) -> DataFrame:
    """Durations up to the next chunk, at least 1; the last chunk keeps its own."""
    gap = F.lead("start_ms").over(W.partitionBy("track").orderBy("chunk")) - F.col("start_ms")
    return plan.withColumn("duration_ms", F.coalesce(F.when(gap.isNotNull(), F.greatest(gap, F.lit(1))), F.col("duration_ms")))


def fixed_tiles(durations: DataFrame, target_ms: int) -> DataFrame:
    """(track, duration_ms) -> tiles of `target_ms`, the last one shorter; none for a duration of 0."""
    tiles = durations.where(F.col("duration_ms") > 0).select("track", "duration_ms", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("duration_ms") - 1, F.lit(target_ms).cast("bigint"))).alias("chunk", "start_ms"))
    return tiles.select("track", F.col("chunk").cast("bigint").alias("chunk"), "start_ms", F.least(F.lit(target_ms), F.col("duration_ms") - F.col("start_ms")).alias("length_ms"))


def bytes_by_window(packets: DataFrame, windows: DataFrame, bucket_ms: int) -> DataFrame:
    """(track, n, start_ms, end_ms, bytes): sizes of the packets whose pts lies in each window, 0 where none does.

    An interval join as an equi-join: windows stand in every bucket of time they touch.
    """
    touched = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))))
    p = packets.select(F.col("track").alias("t"), "pts", "size", F.floor(F.col("pts") / bucket_ms).alias("b"))
    inside = touched.join(p, (F.col("track") == F.col("t")) & (F.col("bucket") == F.col("b")) & (F.col("pts") >= F.col("start_ms")) & (F.col("pts") < F.col("end_ms")), "left")
    return inside.groupBy("track", "n", "start_ms", "end_ms").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def whole(a: Column, b: Column) -> Column:
    """Integer quotient of numbers >= 0."""
    return ((a - a % b) / b).cast("bigint")


def target_seconds(start: Column, end: Column) -> Column:
    """Longest window of a group in seconds, rounded up, at least 1: an aggregate."""
    return F.greatest(F.coalesce(F.max(whole(F.greatest(end - start, F.lit(1)) + 999, F.lit(1000))), F.lit(1)), F.lit(1))


def bandwidth(bytes_: Column, start: Column, end: Column) -> Column:
    """Largest bits a second of any window, a tenth added, at least 128,000: an aggregate."""
    top = F.coalesce(F.max(whole(bytes_ * 8000, F.greatest(end - start, F.lit(1)))), F.lit(0))
    return F.greatest(top + whole(top, F.lit(10)), F.lit(128_000))


def size_bandwidth(length: Column, duration_ms: Column) -> Column:
    """Average bits a second of a file with a quarter added, at least 128,000; 12,000,000 without a duration."""
    average = whole(length * 8000, duration_ms)
    return F.when(F.coalesce(duration_ms, F.lit(0)) > 0, F.greatest(average + whole(average, F.lit(4)), F.lit(128_000))).otherwise(12_000_000)


def hls_plan(packets: DataFrame, target_ms: int, bucket_ms: int) -> DataFrame:
    """One row a track: segments, target duration in seconds, bandwidth in bits a second."""
    windows = bytes_by_window(packets, segment_windows(packets, target_ms), bucket_ms)
    return windows.groupBy("track").agg(F.count("*").alias("segments"), target_seconds(F.col("start_ms"), F.col("end_ms")).alias("target_seconds"), bandwidth(F.col("bytes"), F.col("start_ms"), F.col("end_ms")).alias("bandwidth"), F.sum("bytes").alias("bytes"))


def peak_bitrate(packets: DataFrame, plan: DataFrame) -> DataFrame:
    """(track, peak): largest bits a second of any chunk over the time to the next, rounded up; chunks without time are left out."""
    span = F.coalesce(F.lead("start_ms").over(W.partitionBy("track").orderBy("chunk")) - F.col("start_ms"), F.col("duration_ms"))
    rows = packets.join(plan.select("track", F.col("packet_start").alias("ix"), F.lit(1).alias("cut")), ["track", "ix"], "left")
    sizes = rows.withColumn("chunk", F.sum(F.coalesce("cut", F.lit(0))).over(W.partitionBy("track").orderBy("ix")) - 1).groupBy("track", "chunk").agg(F.sum("size").alias("bytes"))
    return plan.withColumn("span", span).join(sizes, ["track", "chunk"]).where("span > 0").groupBy("track").agg(F.max(whole(F.col("bytes") * 8000 + F.col("span") - 1, F.col("span"))).alias("peak"))


def seek_anchors(packets: DataFrame, requests: DataFrame) -> DataFrame:
    """(track, request, target_ms) -> where to start reading: the last keyframe before the first later packet.

    The search stops at the first packet with a later pts, though earlier ones may follow it; without
    a keyframe it is the last packet before that, and without any the first packet. The latest pts so far
    never falls, so that the first later packet is a lookup by it, and no request meets every packet.
    """
    by = W.partitionBy("track").orderBy("ix").rowsBetween(W.unboundedPreceding, 0)
    own = F.struct("ix", "pts", "keyframe")
    key = F.last(F.when(F.col("keyframe"), own), ignorenulls=True).over(by)
    rows = packets.withColumns({"target_ms": F.max("pts").over(by), "value": F.coalesce(key, own)})
    first = packets.groupBy("track").agg(F.min_by(own, "ix").alias("first"))
    found = latest(rows, requests, ["track"], "target_ms", "ix", F.col("value")).join(first, "track").withColumn("at", F.coalesce("found", "first"))
    return found.select("track", "request", "target_ms", F.col("at.pts").alias("anchor_ms"), F.col("at.ix").alias("packet_index"), minus(F.col("target_ms"), F.col("at.pts")).alias("preroll_ms"), F.col("at.keyframe").alias("key_aligned"))


#: Packets whose latest end is kept as one number.
_GROUP = 256


def copy_seeks(packets: DataFrame, requests: DataFrame, window_ms: int) -> DataFrame:
    """Anchors with the packets up to the first one at or beyond the window's end; the duration runs to the latest end.

    The end is a lookup by the latest pts so far, as in seek_anchors; the latest packet end of a range comes from
    groups of packets that lie in it whole, and from the packets of the groups at its ends.
    """
    by = W.partitionBy("track").orderBy("ix").rowsBetween(W.unboundedPreceding, 0)
    anchors = seek_anchors(packets, requests)
    # the first packet of a track ends no range, whatever its time
    inner = F.when(F.row_number().over(W.partitionBy("track").orderBy("ix")) > 1, F.col("pts"))
    rows = packets.withColumn("limit_ms", F.coalesce(F.max(inner).over(by), F.lit(-(2**62)).cast("bigint")))
    asked = anchors.withColumn("limit_ms", F.col("target_ms") + max(window_ms, 1) - 1)
    ranges = latest(rows, asked, ["track"], "limit_ms", "ix", F.col("ix")).withColumnRenamed("found", "last_ix").drop("limit_ms")
    ends = packets.select("track", F.col("ix").alias("at"), (F.col("pts") + F.col("duration")).alias("end"), F.floor(F.col("ix") / _GROUP).alias("part"))
    groups = ends.groupBy("track", "part").agg(F.max("end").alias("end"))
    low, high = F.floor(F.col("packet_index") / _GROUP), F.floor(F.col("last_ix") / _GROUP)
    keys = ranges.select("track", "request", "packet_index", "last_ix", low.alias("low"), high.alias("high"))
    edges = keys.withColumn("part", F.explode(F.array_distinct(F.array("low", "high")))).join(ends, ["track", "part"]).where("at BETWEEN packet_index AND last_ix")
    middle = keys.where("high > low + 1").withColumn("part", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1))).join(groups, ["track", "part"])
    last = edges.select("track", "request", "end").union(middle.select("track", "request", "end")).groupBy("track", "request").agg(F.max("end").alias("last"))
    return ranges.join(last, ["track", "request"]).select("track", "request", "target_ms", "anchor_ms", "packet_index", (F.col("last_ix") + 1).alias("packet_end"), minus(F.col("last"), F.col("anchor_ms")).alias("duration_ms"), "key_aligned")


def video_window(packets: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Whole groups of pictures: from the first keyframe at or after the start to before the first at or after the end, both for good."""
    by = W.partitionBy("track").orderBy("ix")
    begun = F.max((F.col("keyframe") & (F.col("pts") >= start_ms)).cast("int")).over(by) == 1
    ended = F.max((F.col("keyframe") & (F.col("pts") >= end_ms)).cast("int")).over(by) == 1
    return packets.withColumns({"begun": begun, "ended": ended}).where("begun AND NOT ended").drop("begun", "ended")


def codec_window_start(packets: DataFrame, codec: Column, start_ms: int) -> DataFrame:
    """(track, first): the packet from which a window of audio is decoded, by codec.

    Opus decodes from the very first; plain codecs from the first packet at or after the start; others
    from the first that ends after it, and TrueHD from the last keyframe up to that one.
    """
    rows = packets.withColumn("codec", codec)
    late = rows.withColumn("decode", F.min(F.when(F.col("pts") + F.greatest("duration", F.lit(1)) > start_ms, F.col("ix"))).over(W.partitionBy("track")))
    first = F.when(F.col("codec") == "opus", F.lit(0)).when(F.col("codec") == "truehd", F.coalesce(F.max(F.when(F.col("keyframe") & (F.col("ix") <= F.col("decode")), F.col("ix"))), F.lit(0)))
    first = first.when(F.col("codec").isin("aac", "ac3", "eac3", "flac", "alac"), F.min(F.when(F.col("pts") >= start_ms, F.col("ix")))).otherwise(F.min("decode"))
    return late.groupBy("track", "codec").agg(F.when(F.min("decode").isNotNull(), first).cast("bigint").alias("first"))


def samples(packets: DataFrame, plan: DataFrame) -> DataFrame:
    """Packets of each chunk with their offset in the chunk's payload."""
    rows = numbered(packets, plan.select("track", F.col("packet_start").alias("ix")))
    before = W.partitionBy("track", "chunk").orderBy("ix").rowsBetween(W.unboundedPreceding, -1)
    return rows.select("track", "chunk", "ix", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("payload_offset"), "size", "pts", "duration", "keyframe")


def read_spans(packets: DataFrame, gap: int = 256, most: int = 64 << 10, times: int = 2) -> DataFrame:
    """(track, span_ix, offset, length, packets, payload): reads that join packets lying close together.

    A packet joins the span before it if it lies at or behind its end by at most `gap` bytes, and the
    span then has at most `most` bytes and at most `times` its payload; or if it touches a span without gaps.
    """

    def step(state, row):
        start, size = row["source_offset"], row["size"]
        if state:
            first, end, count, payload, n = state
            long = max(end, start + size) - first
            touching = start == end and end - first == payload
            if touching or (0 <= start - end <= gap and long <= most and long <= times * (payload + size)):
                return (first, start + size, count + 1, payload + size, n), []
            return (start, start + size, 1, size, n + 1), [(row["track"], n, first, end - first, count, payload)]
        return (start, start + size, 1, size, 0), []

    ends = packets.withColumn("last", F.lead("ix").over(W.partitionBy("track").orderBy("ix")).isNull())
    # the last row of a track closes its span by a row of its own, far beyond all others
    closing = ends.where("last").select("track", (F.col("ix") + 1).alias("ix"), F.lit(2**62).alias("source_offset"), F.lit(0).cast("bigint").alias("size"))
    rows = packets.select("track", "ix", "source_offset", "size").unionByName(closing)
    names = ["track", "span_ix", "offset", "length", "packets", "payload"]
    return ordered_fold(rows, ["track"], ["ix"], lambda: None, step, "track long, span_ix long, offset long, length long, packets long, payload long", names)
