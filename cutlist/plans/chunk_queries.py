"""Queries of operators.chunks over packets that stand for media."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import chunks as C
from ..sources import adapters as A
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
DAY = A.DAY

_CUTS = f"""cut AS (SELECT track, 0 AS chunk, ix, pts FROM packets WHERE ix = 0
    UNION ALL SELECT c.track, c.chunk + 1, min(p.ix), arg_min(p.pts, p.ix) FROM cut c JOIN packets p ON p.track = c.track AND p.ix > c.ix AND p.keyframe AND p.pts - c.pts >= {DAY} GROUP BY c.track, c.chunk),
    heads AS (SELECT track, chunk, ix AS head, coalesce(lead(ix) OVER (PARTITION BY track ORDER BY ix), 9223372036854775807) AS stop, pts AS start_ms FROM cut)"""
_PLAN = f"""{_CUTS}, plan AS (SELECT h.track, h.chunk, any_value(start_ms) AS start_ms, greatest(arg_max(pts + duration, ix) - any_value(start_ms), 0) AS duration_ms, min(ix) AS packet_start, max(ix) + 1 AS packet_end, arg_min(keyframe, ix) AS key_aligned
    FROM heads h JOIN packets p ON p.track = h.track AND p.ix >= head AND p.ix < stop GROUP BY ALL)"""
_COLLAPSE = """kept AS (SELECT *, sum(CASE WHEN k = 1 OR end_ms - start_ms >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY n) AS g FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n) AS k FROM raw)),
    merged AS (SELECT track, g, arg_min(start_ms, n) AS start_ms, arg_max(end_ms, n) AS end_ms FROM kept GROUP BY track, g),
    brief AS (SELECT *, g = 1 AND end_ms - start_ms < 1000 AND count(*) OVER (PARTITION BY track) > 1 AS b FROM merged),
    moved AS (SELECT track, g, b, end_ms, CASE WHEN lag(b) OVER w THEN lag(start_ms) OVER w ELSE start_ms END AS start_ms FROM brief WINDOW w AS (PARTITION BY track ORDER BY g)),
    windows AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY g) - 1 AS n, start_ms, end_ms FROM moved WHERE NOT b)"""
_WINDOWS = f"""{_CUTS}, raw AS (SELECT h.track, chunk AS n, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY h.track ORDER BY head), greatest(last, start_ms + 1)) AS end_ms
    FROM heads h JOIN (SELECT track, max(pts + duration) AS last FROM packets GROUP BY track) e USING (track)), {_COLLAPSE}"""
_BYTES = f"""{_WINDOWS}, filled AS (SELECT w.track, n, start_ms, end_ms, coalesce(sum(size), 0)::BIGINT AS bytes FROM windows w LEFT JOIN packets p ON p.track = w.track AND pts >= start_ms AND pts < end_ms GROUP BY ALL)"""
_PER_TRACK = """per AS (SELECT track, count(*) AS segments, greatest(max((greatest(end_ms - start_ms, 1) + 999) // 1000), 1) AS target_seconds, max(bytes * 8000 // greatest(end_ms - start_ms, 1)) AS top, sum(bytes)::BIGINT AS bytes FROM filled GROUP BY track)"""


@query(f"WITH {_BYTES}, {_PER_TRACK} SELECT track, segments, target_seconds, greatest(top + top // 10, 128000) AS bandwidth, bytes FROM per", "packets")
def hls_plan(spark, d):
    """F03, F05, D01, E02, E03."""
    return C.hls_plan(A.packets(spark, d), DAY, DAY)


@query(f"WITH {_BYTES}, {_PER_TRACK} SELECT track, segments, target_seconds, greatest(top + top // 10, 128000) AS bandwidth, bytes FROM per", "reordered")
def hls_plan_reordered(spark, d):
    return C.hls_plan(A.packets(spark, d, reordered=True), DAY, DAY)


@query(f"WITH {_PLAN} SELECT * FROM plan", "packets")
def chunk_plan(spark, d):
    """F01."""
    return C.plan_chunks(A.packets(spark, d), DAY)


@query(f"WITH {_PLAN} SELECT * FROM plan", "reordered")
def chunk_plan_reordered(spark, d):
    return C.plan_chunks(A.packets(spark, d, reordered=True), DAY)




@query(f"""WITH p30 AS (SELECT track, ix, pts * 1000 // 30 AS pts, (pts + duration) * 1000 // 30 - pts * 1000 // 30 AS duration, size, keyframe FROM (SELECT track, ix, pts // 40 AS pts, duration // 40 AS duration, size, keyframe FROM packets)),
    cut AS (SELECT track, 0 AS chunk, ix, 0::BIGINT AS pts FROM p30 WHERE ix = 0
    UNION ALL SELECT c.track, c.chunk + 1, min(p.ix), arg_min(p.pts, p.ix) FROM cut c JOIN p30 p ON p.track = c.track AND p.ix > c.ix AND p.keyframe AND p.pts - c.pts >= {DAY} GROUP BY c.track, c.chunk),
    heads AS (SELECT track, chunk, ix AS head, coalesce(lead(ix) OVER (PARTITION BY track ORDER BY ix), 9223372036854775807) AS stop, pts AS start_ms FROM cut)
    SELECT h.track, h.chunk, any_value(start_ms) AS start_ms, greatest(arg_max(pts + duration, ix) - any_value(start_ms), 0) AS duration_ms, min(ix) AS packet_start, max(ix) + 1 AS packet_end, arg_min(keyframe, ix) AS key_aligned
    FROM heads h JOIN p30 p ON p.track = h.track AND p.ix >= head AND p.ix < stop GROUP BY ALL""", "packets")
def sample_chunk_plan(spark, d):
    """times in thirtieths of a second, rounded once, the first chunk from 0."""
    p = A.packets(spark, d)
    whole = lambda c: ((F.col(c) - F.col(c) % 40) / 40).cast("bigint")
    return C.plan_sample_chunks(p.withColumns({"pts": whole("pts"), "duration": whole("duration")}), DAY, 30)


@query(f"WITH {_WINDOWS} SELECT * FROM windows", "packets")
def segment_windows(spark, d):
    """F03, F05."""
    return C.segment_windows(A.packets(spark, d), DAY)


@query(f"""WITH {_PLAN}, raw AS (SELECT track, chunk AS n, start_ms, greatest(coalesce(lead(start_ms) OVER (PARTITION BY track ORDER BY chunk), start_ms + duration_ms), start_ms + 1) AS end_ms FROM plan), {_COLLAPSE} SELECT * FROM windows""", "reordered")
def chunk_windows(spark, d):
    """F04, F05."""
    return C.chunk_windows(C.plan_chunks(A.packets(spark, d, reordered=True), DAY))


@query(f"WITH {_PLAN} SELECT track, chunk, start_ms, CASE WHEN lead(start_ms) OVER (PARTITION BY track ORDER BY chunk) IS NULL THEN duration_ms ELSE greatest(lead(start_ms) OVER (PARTITION BY track ORDER BY chunk) - start_ms, 1) END AS duration_ms, packet_start, packet_end, key_aligned FROM plan", "reordered")
def spaced_durations(spark, d):
    """F14."""
    return C.spaced_durations(C.plan_chunks(A.packets(spark, d, reordered=True), DAY))


@query(f"WITH {_BYTES} SELECT * FROM filled", "reordered")
def bytes_by_window(spark, d):
    """D01."""
    p = A.packets(spark, d, reordered=True)
    return C.bytes_by_window(p, C.segment_windows(p, DAY), DAY)


@query(f"""WITH {_PLAN}, gap AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY track ORDER BY chunk) - start_ms, duration_ms) AS span FROM plan),
    b AS (SELECT h.track, h.chunk, sum(size) AS bytes FROM heads h JOIN packets p ON p.track = h.track AND ix >= head AND ix < stop GROUP BY ALL)
    SELECT track, max((bytes * 8000 + span - 1) // span)::BIGINT AS peak FROM gap JOIN b USING (track, chunk) WHERE span > 0 GROUP BY track""", "packets")
def peak_bitrate(spark, d):
    """E05."""
    p = A.packets(spark, d)
    return C.peak_bitrate(p, C.plan_chunks(p, DAY))


@query("""SELECT user_id AS track, sum(value)::BIGINT AS size, CASE WHEN max(event_id) % 5 = 0 THEN 0 ELSE count(*) * 1000 END AS duration_ms,
    CASE WHEN max(event_id) % 5 = 0 THEN 12000000 ELSE greatest(sum(value)::BIGINT * 8000 // (count(*) * 1000) + sum(value)::BIGINT * 8000 // (count(*) * 1000) // 4, 128000) END AS bandwidth
    FROM (SELECT user_id, event_id, round(coalesce(value, 0) * 1000)::BIGINT AS value FROM events) GROUP BY user_id""")
def size_bandwidth(spark, d):
    """E04."""
    ev = A.table(spark, d, "events").select("user_id", "event_id", F.round(F.coalesce("value", F.lit(0.0)) * 1000).cast("bigint").alias("value"))
    g = ev.groupBy(F.col("user_id").alias("track")).agg(F.sum("value").alias("size"), F.when(F.max("event_id") % 5 == 0, 0).otherwise(F.count("*") * 1000).alias("duration_ms"))
    return g.withColumn("bandwidth", C.size_bandwidth(F.col("size"), F.col("duration_ms")))


_REQUESTS = "requests AS (SELECT track, k AS request, lo + (hi - lo) * k // 5 AS target_ms FROM (SELECT track, min(pts) AS lo, max(pts) AS hi FROM packets GROUP BY track), range(0, 6) r(k))"
_ANCHOR = f"""{_REQUESTS}, early AS (SELECT p.*, request, target_ms, max(CASE WHEN pts > target_ms THEN 1 ELSE 0 END) OVER (PARTITION BY p.track, request ORDER BY ix) = 0 AS e FROM packets p JOIN requests r ON p.track = r.track),
    picked AS (SELECT track, request, target_ms, coalesce(max(ix) FILTER (e AND keyframe), max(ix) FILTER (e), min(ix)) AS ix FROM early GROUP BY ALL),
    anchors AS (SELECT track, request, target_ms, pts AS anchor_ms, ix AS packet_index, greatest(target_ms - pts, 0) AS preroll_ms, keyframe AS key_aligned FROM picked JOIN packets USING (track, ix))"""


def _requests(p):
    """Six points of time over each track."""
    g = p.groupBy("track").agg(F.min("pts").alias("lo"), F.max("pts").alias("hi"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")))
    step = (F.col("hi") - F.col("lo")) * F.col("request")
    return g.withColumn("request", k).select("track", "request", (F.col("lo") + ((step - step % 5) / 5).cast("bigint")).alias("target_ms"))


@query(f"WITH {_ANCHOR} SELECT * FROM anchors", "reordered")
def seek_anchor(spark, d):
    """D02."""
    p = A.packets(spark, d, reordered=True)
    return C.seek_anchors(p, _requests(p))


@query(f"""WITH {_ANCHOR}, ahead AS (SELECT p.track, p.ix, p.pts, p.duration, a.request, max(CASE WHEN p.ix > packet_index AND p.pts >= target_ms + {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY p.track, a.request ORDER BY p.ix) = 0 AS i
        FROM packets p JOIN anchors a ON p.track = a.track AND p.ix >= packet_index),
    e AS (SELECT track, request, max(ix) + 1 AS packet_end, max(pts + duration) AS last FROM ahead WHERE i GROUP BY ALL)
    SELECT track, request, target_ms, anchor_ms, packet_index, packet_end, greatest(last - anchor_ms, 0) AS duration_ms, key_aligned FROM anchors JOIN e USING (track, request)""", "reordered")
def copy_seek(spark, d):
    """D03."""
    p = A.packets(spark, d, reordered=True)
    return C.copy_seeks(p, _requests(p), DAY)




@query(f"""WITH b AS (SELECT *, max(CASE WHEN keyframe AND pts >= (SELECT min(pts) + {5 * DAY} FROM packets) THEN 1 ELSE 0 END) OVER w = 1 AS begun,
        max(CASE WHEN keyframe AND pts >= (SELECT min(pts) + {12 * DAY} FROM packets) THEN 1 ELSE 0 END) OVER w = 1 AS ended FROM packets WINDOW w AS (PARTITION BY track ORDER BY ix))
    SELECT track, ix, pts, duration, size, keyframe FROM b WHERE begun AND NOT ended""", "reordered")
def video_window(spark, d):
    """Whole groups of pictures of a window that starts five days in and lasts a week."""
    p = A.packets(spark, d, reordered=True)
    first = p.agg(F.min("pts")).first()[0]
    return C.video_window(p, first + 5 * DAY, first + 12 * DAY)


@query(f"""WITH t AS (SELECT track, CASE track % 4 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' WHEN 2 THEN 'truehd' ELSE 'mp3' END AS codec, ix, pts, duration, keyframe, (SELECT min(pts) + {10 * DAY} FROM packets) AS s FROM packets),
    dec AS (SELECT *, min(ix) FILTER (pts + greatest(duration, 1) > s) OVER (PARTITION BY track) AS decode FROM t)
    SELECT track, codec, CASE WHEN min(decode) IS NULL THEN NULL WHEN codec = 'opus' THEN 0 WHEN codec = 'truehd' THEN coalesce(max(ix) FILTER (keyframe AND ix <= decode), 0)
        WHEN codec = 'aac' THEN min(ix) FILTER (pts >= s) ELSE min(decode) END AS first FROM dec GROUP BY track, codec""", "packets")
def codec_window_start(spark, d):
    """D06."""
    p = A.packets(spark, d)
    first = p.agg(F.min("pts")).first()[0]
    codec = F.when(F.col("track") % 4 == 0, "aac").when(F.col("track") % 4 == 1, "opus").when(F.col("track") % 4 == 2, "truehd").otherwise("mp3")
    return C.codec_window_start(p, codec, first + 10 * DAY)


@query(f"""WITH {_CUTS} SELECT p.track, chunk, p.ix, coalesce(sum(size) OVER (PARTITION BY p.track, chunk ORDER BY p.ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS payload_offset, size, p.pts, duration, keyframe
    FROM packets p JOIN heads h ON p.track = h.track AND p.ix >= head AND p.ix < stop""", "packets")
def chunk_samples(spark, d):
    """F12."""
    p = A.packets(spark, d)
    return C.samples(p, C.plan_chunks(p, DAY))


@query("""SELECT o_custkey AS track, n AS chunk, n * 40000 AS start_ms, least(40000, duration_ms - n * 40000) AS length_ms FROM (
    SELECT o_custkey, duration_ms, unnest(range(0, (duration_ms + 39999) // 40000)) AS n FROM (SELECT o_custkey, (sum(round(o_totalprice)::BIGINT)::BIGINT) // 10 AS duration_ms FROM orders GROUP BY o_custkey) WHERE duration_ms > 0)""")
def fixed_tiles(spark, d):
    """F16."""
    total = F.sum(F.round("o_totalprice").cast("bigint"))
    o = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("track")).agg(total.alias("t")).select("track", ((F.col("t") - F.col("t") % 10) / 10).cast("bigint").alias("duration_ms"))
    return C.fixed_tiles(o, 40_000)


@query(f"""WITH {_BYTES}, {_PER_TRACK} SELECT track, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || max(target_seconds) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10)
        || string_agg(printf('#EXTINF:%d.%03d,', (end_ms - start_ms) // 1000, (end_ms - start_ms) % 1000) || chr(10) || printf('seg-%05d.ts', n) || chr(10), '' ORDER BY n) || '#EXT-X-ENDLIST' || chr(10) AS playlist
    FROM filled JOIN per USING (track) GROUP BY track""", "packets")
def media_playlist(spark, d):
    """B04, J17."""
    return _playlist(spark, d, 3, "ts", None)


@query(f"""WITH {_BYTES}, {_PER_TRACK} SELECT track, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || max(target_seconds) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || '#EXT-X-MAP:URI="init.mp4"' || chr(10)
        || string_agg(printf('#EXTINF:%d.%03d,', (end_ms - start_ms) // 1000, (end_ms - start_ms) % 1000) || chr(10) || printf('seg-%05d.m4s', n) || chr(10), '' ORDER BY n) || '#EXT-X-ENDLIST' || chr(10) AS playlist
    FROM filled JOIN per USING (track) GROUP BY track""", "packets")
def fragment_playlist(spark, d):
    """B04."""
    return _playlist(spark, d, 7, "m4s", "init.mp4")


def _playlist(spark, d, version, suffix, init):
    w = C.segment_windows(A.packets(spark, d), DAY)
    t = w.groupBy("track").agg(C.target_seconds(F.col("start_ms"), F.col("end_ms")).alias("target_seconds"))
    return names.media_playlist(w.join(t, "track"), version, suffix, init)


@query(f"""WITH {_WINDOWS}, part AS (SELECT *, max(n) OVER (PARTITION BY track) AS last FROM windows),
    shown AS (SELECT * FROM part WHERE n BETWEEN 2 AND 6),
    t AS (SELECT track, greatest(max((greatest(end_ms - start_ms, 1) + 999) // 1000), 1) AS target FROM shown GROUP BY track)
    SELECT track, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || max(target) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:2' || chr(10) || '#EXT-X-MAP:URI="init.mp4"' || chr(10)
        || string_agg(printf('#EXTINF:%d.%03d,', (end_ms - start_ms) // 1000, (end_ms - start_ms) % 1000) || chr(10) || printf('seg-%05d.m4s', n) || chr(10), '' ORDER BY n) || CASE WHEN max(last) <= 6 THEN '#EXT-X-ENDLIST' || chr(10) ELSE '' END AS playlist
    FROM shown JOIN t USING (track) GROUP BY track""", "packets")
def windowed_playlist(spark, d):
    """Segments 2 to 6; the list ends only where they reach the last."""
    w = C.segment_windows(A.packets(spark, d), DAY)
    part = w.where("n BETWEEN 2 AND 6")
    ends = w.groupBy("track").agg(F.max("n").alias("last")).where("last <= 6").select("track")
    t = part.groupBy("track").agg(C.target_seconds(F.col("start_ms"), F.col("end_ms")).alias("target_seconds"))
    rows = part.join(t, "track")
    make = lambda df, ended: names.media_playlist(df, 7, "m4s", "init.mp4", first=2, vod=False, ended=ended)
    return make(rows.join(ends, "track", "left_semi"), True).union(make(rows.join(ends, "track", "left_anti"), False))
