"""Queries of operators.cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import cues as U
from ..sources import adapters as A
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_CLOCK = lambda c, m=".": f"printf('%02d:%02d:%02d{m}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
_CUE = f"{_CLOCK('start_ms')} || ' --> ' || {_CLOCK('end_ms')} || chr(10) || trim(coalesce(text, '')) || chr(10) || chr(10)"
_SEG = f"""live AS (SELECT * FROM cues WHERE end_ms > start_ms), ends AS (SELECT track, max(end_ms) AS last FROM cues GROUP BY track HAVING max(end_ms) > 0),
    grid AS (SELECT track, last, unnest(range(0, (last + 3999) // 4000)) AS segment FROM ends),
    spread AS (SELECT *, unnest(range(start_ms // 4000, (end_ms - 1) // 4000 + 1)) AS segment FROM live), bodies AS (SELECT track, segment, string_agg({_CUE}, '' ORDER BY ix) AS b FROM spread GROUP BY ALL),
    segs AS (SELECT track, segment, segment * 4000 AS start_ms, least(4000, last - segment * 4000) AS duration_ms, printf('subs/seg-%05d.vtt', segment) AS uri, 'WEBVTT' || chr(10) || chr(10) || coalesce(b, '') AS body FROM grid LEFT JOIN bodies USING (track, segment))"""


@query(f"SELECT track, 'WEBVTT' || chr(10) || chr(10) || string_agg({_CUE}, '' ORDER BY ix) AS body FROM cues GROUP BY track", "cues")
def webvtt_documents(spark, d):
    """J03, I12."""
    return U.render_webvtt(A.cues(spark, d).withColumn("text", F.coalesce("text", F.lit(""))))


@query(f"WITH {_SEG} SELECT * FROM segs", "cues")
def webvtt_segments(spark, d):
    """Four seconds each."""
    return U.segment_webvtt(A.cues(spark, d), 4000, "subs")


@query("""WITH c AS (SELECT *, CASE WHEN end_ms > start_ms THEN (end_ms - 1) // 40 - start_ms // 40 + 1 ELSE 0 END AS again FROM cues),
    g AS (SELECT track, (max(end_ms) + 39) // 40 AS segments, sum(again)::BIGINT AS visits, sum(again * (strlen(coalesce(text, '')) + 128))::BIGINT + (max(end_ms) + 39) // 40 * 128 AS bytes FROM c GROUP BY track)
    SELECT *, CASE WHEN segments > 100000 THEN 'subtitle segments' WHEN visits > 2000000 THEN 'subtitle cue expansions' WHEN bytes > 33554432 THEN 'subtitle output bytes' END AS rejected FROM g""", "cues")
def segment_budgets(spark, d):
    """E09, at 40 ms a segment."""
    return U.segment_counts(A.cues(spark, d), 40)


@query(f"""WITH {_SEG}, t AS (SELECT track, greatest(max((duration_ms + 999) // 1000), 1) AS target FROM segs GROUP BY track)
    SELECT track, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || max(target) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10)
      || string_agg(printf('#EXTINF:%d.%03d,', duration_ms // 1000, duration_ms % 1000) || chr(10) || printf('seg-%05d.vtt', segment) || chr(10), '' ORDER BY segment) || '#EXT-X-ENDLIST' || chr(10) AS playlist FROM segs JOIN t USING (track) GROUP BY track""", "cues")
def webvtt_playlists(spark, d):
    """J04."""
    s = U.segment_webvtt(A.cues(spark, d), 4000, "subs")
    t = s.groupBy("track").agg(F.greatest(F.max(((F.col("duration_ms") + 999 - (F.col("duration_ms") + 999) % 1000) / 1000).cast("bigint")), F.lit(1)).alias("target_seconds"))
    return names.media_playlist(s.join(t, "track").withColumns({"n": F.col("segment"), "end_ms": F.col("start_ms") + F.col("duration_ms")}), 3, "vtt")


@query("""SELECT owner, ix, bytes, sum(bytes) OVER w <= 20000 AND count(*) OVER w <= 20 AS fits FROM (SELECT conv_id % 7 AS owner, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn, text) - 1 AS ix, strlen(coalesce(text, '')) AS bytes FROM conversations)
    WINDOW w AS (PARTITION BY owner ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def sidecar_budgets(spark, d):
    """20,000 bytes and 20 tracks."""
    from pyspark.sql import Window as W

    ix = F.row_number().over(W.partitionBy("owner").orderBy("conv_id", "turn", "text")) - 1
    c = A.table(spark, d, "conversations").withColumn("owner", F.col("conv_id") % 7).withColumn("ix", ix.cast("bigint"))
    return U.bounded_tracks(c.select("owner", "ix", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes")), 20_000, 20)


@query("""WITH s AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ix, epoch_us(ts) // 1000 - CASE WHEN user_id % 6 = 0 AND event_id % 11 = 0 THEN 900000000 ELSE 0 END AS t, event_id % 3 AS o, CASE WHEN user_id % 5 = 0 AND event_id % 50 = 0 THEN 720 ELSE 1920 END AS w FROM events),
    b AS (SELECT *, lead(t) OVER q AS e, coalesce(lag(t) OVER q > t, false) OR coalesce(lag(w) OVER q <> w, false) AS bad FROM s WINDOW q AS (PARTITION BY track ORDER BY ix)),
    ok AS (SELECT track FROM b GROUP BY track HAVING NOT bool_or(bad)) SELECT track, ix, t AS start_ms, e AS end_ms, o AS objects FROM b JOIN ok USING (track) WHERE o > 0 AND e > t""")
def display_cues(spark, d):
    """B11."""
    from pyspark.sql import Window as W

    ev = A.table(spark, d, "events")
    t = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000") - F.when((F.col("user_id") % 6 == 0) & (F.col("event_id") % 11 == 0), 900_000_000).otherwise(0)
    ix = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint")
    wide = F.when((F.col("user_id") % 5 == 0) & (F.col("event_id") % 50 == 0), 720).otherwise(1920)
    return U.display_cues(ev.select(F.col("user_id").alias("track"), ix.alias("ix"), t.alias("time_ms"), (F.col("event_id") % 3).alias("objects"), wide.alias("width"), F.lit(1080).alias("height")))




@query("""WITH l AS (SELECT track, ix, start_ms, end_ms, array_to_string(list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> ''), chr(10)) AS text FROM cues WHERE end_ms > start_ms)
    SELECT track, row_number() OVER (PARTITION BY track ORDER BY ix) - 1 AS ix, start_ms, end_ms, text FROM l WHERE trim(text) <> ''""", "cues")
def subrip_round_trip(spark, d):
    """J01, I11; as a blank line would end a cue, the file has a text's other lines only."""
    from ..functions.timing import clock

    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n"), lambda x: F.regexp_like(x, F.lit(r"\S")))
    block = F.concat((F.col("ix") + 1).cast("string"), F.lit("\r\n"), clock(F.col("start_ms"), ","), F.lit(" --> "), clock(F.col("end_ms"), ","), F.lit("\r\n"), F.array_join(lines, "\r\n"))
    files = A.cues(spark, d).groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", block.alias("b")))), lambda x: x["b"]), "\r\n\r\n").alias("text"))
    return U.parse_subrip(files)


REGISTRY.also("subrip_round_trip", "whole_subrip_round_trip")
