"""Queries of operators.selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, names
from ..operators import selection as S
from ..sources import adapters as A
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_FAMILY = "CASE " + " ".join(f"WHEN {_in('lower(trim(codec))', v)} THEN '{k}'" for k, v in codecs.FAMILIES.items()) + " ELSE 'unknown' END"
_COPY = "CASE " + " ".join(f"WHEN kind = '{k}' AND target = '{t}' THEN {_in('family', v)}" for (k, t), v in codecs.PLAYBACK_COPY.items()) + " ELSE false END"
_HLS = "CASE " + " ".join(f"WHEN kind = '{k}' AND target = '{t}' THEN {_in('family', v)}" for (k, t), v in codecs.HLS_COPY.items()) + " ELSE false END"
_READY = _in("family", codecs.TRANSCODED_AUDIO)
_T = f"""t AS (SELECT *, CASE WHEN kind = 'subtitle' THEN CASE family WHEN 'text_subtitle' THEN 'text' WHEN 'bitmap_subtitle' THEN 'bitmap' ELSE 'unknown' END END AS format,
    CASE kind WHEN 'video' THEN 'v' WHEN 'audio' THEN 'a' WHEN 'subtitle' THEN 's' ELSE 'x' END || (row_number() OVER (PARTITION BY source, kind ORDER BY ix) - 1) AS id FROM (SELECT *, {_FAMILY} AS family FROM tracks)),
    tt AS (SELECT t.*, target FROM t, (SELECT unnest(['native', 'apple', 'browser']) AS target))"""
_PRIMARY = f"""pa AS (SELECT source, target, arg_min(id, [rank, ix]) AS id, arg_min(ix, [rank, ix]) AS ix, min(rank) AS rank FROM (SELECT *, CASE WHEN is_default AND {_COPY} THEN 0 WHEN {_COPY} THEN 1 WHEN is_default AND target <> 'native' AND {_READY} THEN 2 WHEN target <> 'native' AND {_READY} THEN 3 WHEN is_default THEN 4 ELSE 5 END AS rank FROM tt WHERE kind = 'audio') GROUP BY source, target)"""
_HLS_AUDIO = f"""ha AS (SELECT source, target, arg_min(id, [rank, ix]) AS id, arg_min(ix, [rank, ix]) AS ix, min(rank) AS rank FROM (SELECT *, CASE WHEN is_default AND {_HLS} THEN 0 WHEN {_HLS} THEN 1 WHEN is_default AND {_READY} THEN 2 WHEN {_READY} THEN 3 WHEN is_default THEN 4 ELSE 5 END AS rank FROM tt WHERE kind = 'audio') GROUP BY source, target)"""
_SELECTED = f"""{_PRIMARY}, chosen AS (SELECT source, target, min(ix) AS ix, 0 AS part FROM tt WHERE kind = 'video' GROUP BY ALL UNION ALL SELECT source, target, ix, 1 FROM pa
    UNION ALL SELECT source, target, ix, 2 FROM tt WHERE kind = 'subtitle' AND NOT (target <> 'native' AND format = 'bitmap')),
    sel AS (SELECT source, target, row_number() OVER (PARTITION BY source, target ORDER BY part, ix) - 1 AS place, id, kind, family, ix FROM tt JOIN chosen USING (source, target, ix))"""
_STAGES = f"""copies AS (SELECT *, {_COPY} AS c FROM sel), st AS (
    SELECT source, target, 0 AS ordinal, 'demux' AS stage, 'shared' AS mode, place, id FROM copies UNION ALL SELECT source, target, 1, 'packet-copy', 'copy', place, id FROM copies WHERE c
    UNION ALL SELECT source, target, 2, 'decode', 'decode', place, id FROM copies WHERE NOT c UNION ALL SELECT source, target, 3, 'encode', 'encode', place, id FROM copies WHERE NOT c
    UNION ALL SELECT source, target, 4, 'subtitle-text', 'transform', place, id FROM copies WHERE kind = 'subtitle' AND family = 'text_subtitle' UNION ALL SELECT source, target, 5, 'mux', 'shared', place, id FROM copies)"""


@query(f"WITH {_T} SELECT source, ix, kind, codec, is_default, language, family, format, kind = 'audio' AND {_in('family', codecs.LOSSLESS)} AS lossless, id FROM t", "tracks")
def described_tracks(spark, d):
    """C01, C02, C04 and the numbering of tracks."""
    return S.described(A.tracks(spark, d))


@query(f"""WITH {_T} SELECT source, coalesce(bool_or(NOT {_in('family', codecs.PROBE_COPY['video'])}) FILTER (kind = 'video'), false) AS decode_video, coalesce(bool_or(NOT {_in('family', codecs.PROBE_COPY['audio'])}) FILTER (kind = 'audio'), false) AS decode_audio,
    coalesce(string_agg(id, ',' ORDER BY ix) FILTER (family = 'unknown'), '') AS unsupported, NOT (decode_video OR decode_audio) AS copies_whole FROM t GROUP BY source""", "tracks")
def capabilities(spark, d):
    """E01, C13."""
    return S.capabilities(A.tracks(spark, d))


@query(f"WITH {_T}, {_PRIMARY} SELECT * FROM pa", "tracks")
def primary_audio(spark, d):
    """G01, C11."""
    return S.primary_audio(A.tracks(spark, d))


@query(f"WITH {_T}, {_HLS_AUDIO} SELECT * FROM ha", "tracks")
def hls_audio(spark, d):
    """G02, C12, C14."""
    return S.hls_audio(A.tracks(spark, d))


_RUN = _in("family", ("aac", "ac3", "eac3", *codecs.TRANSCODED_AUDIO))


@query(f"""WITH {_T} SELECT source, arg_min(id, [rank, ix]) AS id, arg_min(ix, [rank, ix]) AS ix, min(rank) AS rank FROM (SELECT *, CASE WHEN is_default AND {_RUN} THEN 0 WHEN {_RUN} THEN 1 WHEN is_default THEN 2 ELSE 3 END AS rank FROM t WHERE kind = 'audio') GROUP BY source""", "tracks")
def executable_audio(spark, d):
    """G03."""
    return S.executable_audio(A.tracks(spark, d))


@query(f"WITH {_T} SELECT source, arg_min(id, [CASE WHEN is_default THEN 0 ELSE 1 END, ix]) AS id, arg_min(ix, [CASE WHEN is_default THEN 0 ELSE 1 END, ix]) AS ix FROM t WHERE kind = 'audio' AND {_in('family', codecs.HLS_SEGMENTS['audio'])} GROUP BY source", "tracks")
def hls_default_track(spark, d):
    """G04 for Matroska, C09."""
    return S.hls_track(A.tracks(spark, d), "audio", True)


@query(f"WITH {_T} SELECT source, arg_min(id, ix) AS id, min(ix) AS ix FROM t WHERE kind = 'video' AND {_in('family', codecs.HLS_SEGMENTS['video'])} GROUP BY source", "tracks")
def hls_first_track(spark, d):
    """G04 for MP4."""
    return S.hls_track(A.tracks(spark, d), "video", False)


@query(f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(language, 'und') <> 'fr', NOT is_default, ix) AS k FROM t WHERE kind = 'audio')
    SELECT source, id, language FROM r WHERE k = 1 AND language = 'fr'""", "tracks")
def analysis_audio_wanted(spark, d):
    """G06 with a wanted language, C15."""
    return S.analysis_audio(A.tracks(spark, d), "fr")


@query(f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(language, 'und') <> 'und', coalesce(language, 'und') <> 'ja', NOT is_default, ix) AS k FROM t WHERE kind = 'audio')
    SELECT source, id, language FROM r WHERE k = 1""", "tracks")
def analysis_audio_any(spark, d):
    """G06 without one."""
    return S.analysis_audio(A.tracks(spark, d), None)


@query(f"WITH {_T}, {_SELECTED} SELECT * FROM sel", "tracks")
def selected_tracks(spark, d):
    """G10, C10."""
    return S.selected(A.tracks(spark, d))


@query(f"WITH {_T}, {_SELECTED}, {_STAGES} SELECT source, target, ordinal, stage, mode, string_agg(id, ',' ORDER BY place) AS track_ids FROM st GROUP BY ALL", "tracks")
def playback_plan(spark, d):
    """M01, C11."""
    return S.playback_plan(A.tracks(spark, d))


@query(f"WITH {_T}, {_SELECTED}, {_STAGES} SELECT source, target, id, arg_max(stage, ordinal) AS stage FROM st WHERE ordinal IN (1, 3, 4) GROUP BY ALL", "tracks")
def output_stages(spark, d):
    """D13."""
    return S.output_stages(S.staged(A.tracks(spark, d)))


@query(f"""WITH {_T}, {_SELECTED}, {_STAGES}, o AS MATERIALIZED (SELECT source, target, id, arg_max(stage, ordinal) AS stage FROM st WHERE ordinal IN (1, 3) AND id NOT LIKE 's%' GROUP BY ALL)
    SELECT a.source, a.target, a.id AS audio_id, a.stage AS audio_stage, v.id AS video_id, v.stage AS video_stage FROM o a LEFT JOIN o v ON v.source = a.source AND v.target = a.target AND v.id LIKE 'v%' WHERE a.id LIKE 'a%'""", "tracks")
def audio_outputs(spark, d):
    """D14, M03."""
    return S.audio_outputs(A.tracks(spark, d))


@query(f"""WITH {_T}, {_HLS_AUDIO}, v AS (SELECT source, target, arg_min(id, ix) AS id, arg_min(kind, ix) AS kind, arg_min(family, ix) AS family FROM tt WHERE kind = 'video' GROUP BY ALL),
    a AS (SELECT ha.source, ha.target, tt.id, kind, family FROM ha JOIN tt ON tt.source = ha.source AND tt.target = ha.target AND tt.id = ha.id), s AS (SELECT DISTINCT source, target FROM tt),
    vm AS (SELECT *, CASE WHEN {_HLS} THEN 'copy' WHEN {_in('family', codecs.DECODED_VIDEO)} THEN 'transcode' ELSE 'missing' END AS m FROM v), am AS (SELECT *, CASE WHEN {_HLS} THEN 'copy' WHEN {_READY} THEN 'transcode' ELSE 'missing' END AS m FROM a)
    SELECT s.source, s.target, vm.id AS video_id, coalesce(vm.m, 'none') AS video_mode, am.id AS audio_id, coalesce(am.m, 'none') AS audio_mode,
      concat_ws(',', CASE WHEN coalesce(vm.m, 'none') IN ('missing', 'none') THEN 'video' END, CASE WHEN am.m = 'missing' THEN 'audio' END) AS missing, coalesce(vm.m, 'none') NOT IN ('missing', 'none') AND coalesce(am.m, 'none') <> 'missing' AS executable
    FROM s LEFT JOIN vm USING (source, target) LEFT JOIN am USING (source, target)""", "tracks")
def transcode_plan(spark, d):
    """M02, C12, C14."""
    return S.transcode_plan(A.tracks(spark, d))


_CHUNKS = "SELECT source, target, id, k AS chunk FROM tt, range(0, 2) r(k)"


@query(f"WITH {_T}, {_SELECTED}, {_STAGES}, c AS ({_CHUNKS}) SELECT c.source, c.target, c.id, chunk, stage, mode FROM c JOIN st USING (source, target, id) WHERE ordinal NOT IN (0, 5)", "tracks")
def chunk_stages(spark, d):
    """Rows with a stage."""
    return _chunk_stages(spark, d)[0]


@query(f"WITH {_T}, {_SELECTED}, {_STAGES}, c AS ({_CHUNKS}) SELECT * FROM c ANTI JOIN (SELECT source, target, id FROM st WHERE ordinal NOT IN (0, 5)) USING (source, target, id)", "tracks")
def chunk_errors(spark, d):
    """Rows without one."""
    return _chunk_stages(spark, d)[1]


def _chunk_stages(spark, d):
    t = A.tracks(spark, d)
    two = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    return S.chunk_stages(S.staged(t), S.for_targets(t).select("source", "target", "id").withColumn("chunk", two))


@query(f"""WITH {_T}, firsts AS (SELECT source, codec, min(ix) AS ix FROM t WHERE kind = 'audio' GROUP BY ALL) SELECT source AS track, string_agg(codec, ',' ORDER BY ix) AS codecs FROM firsts GROUP BY source""", "tracks")
def distinct_codecs(spark, d):
    """H03."""
    return names.distinct_codecs(A.tracks(spark, d).where("kind = 'audio'").select(F.col("source").alias("track"), "ix", "codec"))


@query(f"""WITH {_T}, r AS (SELECT source AS track, ix, id || '"' AS name, language, codec, is_default FROM t WHERE kind = 'audio'),
    m AS (SELECT track, string_agg('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="' || replace(name, '"', '\\"') || '"' || coalesce(',LANGUAGE="' || language || '"', '') || ',DEFAULT=' || CASE WHEN is_default THEN 'YES' ELSE 'NO' END || ',AUTOSELECT=' || CASE WHEN language IS NULL THEN 'NO' ELSE 'YES' END || ',URI="' || name || '/playlist.m3u8"' || chr(10), '' ORDER BY ix) AS media FROM r GROUP BY track),
    f AS (SELECT track, codec, min(ix) AS ix FROM (SELECT track, codec, ix FROM r UNION ALL SELECT DISTINCT source, 'avc1.640028', -1 FROM t) GROUP BY track, codec), c AS (SELECT track, string_agg(codec, ',' ORDER BY ix) AS codecs FROM f GROUP BY track)
    SELECT c.track, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || coalesce(media, '') || '#EXT-X-STREAM-INF:BANDWIDTH=' || (128000 + c.track % 1000) || ',CODECS="' || codecs || '",AUDIO="audio"' || chr(10) || 'video/playlist.m3u8' || chr(10) AS playlist FROM c LEFT JOIN m USING (track)""", "tracks")
def master_playlist(spark, d):
    """B06, J16."""
    t = S.described(A.tracks(spark, d))
    variants = t.groupBy(F.col("source").alias("track")).agg((F.lit(128_000) + F.max(F.col("source")) % 1000).alias("bandwidth"), F.lit("avc1.640028").alias("video_codec"))
    audio = t.where("kind = 'audio'").select(F.col("source").alias("track"), "ix", F.concat("id", F.lit('"')).alias("name"), "language", "codec", "is_default")
    return names.master_playlist(variants, audio)


@query("""WITH x AS (SELECT p_partkey AS part, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 200000 END AS pixels, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey * 90000 END AS src, p_partkey % 2 = 0 AS copied, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 9 END AS ch,
      CASE p_size % 3 WHEN 0 THEN 'opus' WHEN 1 THEN 'aac' ELSE 'dts' END AS fam FROM part),
    y AS (SELECT *, CASE WHEN coalesce(pixels, 2073600) >= 8294400 THEN 16000000 WHEN coalesce(pixels, 2073600) >= 2073600 THEN 8000000 WHEN coalesce(pixels, 2073600) >= 921600 THEN 4500000 ELSE 2500000 END AS ladder FROM x)
    SELECT part, CASE WHEN copied THEN coalesce(src, ladder) ELSE least(coalesce(src, ladder), ladder) END AS video_bps, CASE WHEN copied THEN coalesce(src, 384000) WHEN coalesce(ch, 2) <= 2 THEN 192000 ELSE 640000 END AS audio_bps, least(coalesce(ch, 2), CASE WHEN fam = 'aac' THEN 2 ELSE 6 END) AS channels FROM y""")
def bitrates(spark, d):
    """Parts stand for tracks."""
    p = A.table(spark, d, "part")
    big = lambda c: F.col(c).cast("bigint")
    x = p.select(big("p_partkey").alias("part"), F.when(F.col("p_size") % 5 != 0, big("p_size") * 200_000).alias("pixels"), F.when(F.col("p_partkey") % 3 != 0, big("p_partkey") * 90_000).alias("src"), (F.col("p_partkey") % 2 == 0).alias("copied"), F.when(F.col("p_size") % 4 != 0, big("p_size") % 9).alias("ch"), F.element_at(F.array(F.lit("opus"), F.lit("aac"), F.lit("dts")), (F.col("p_size") % 3 + 1).cast("int")).alias("fam"))
    return x.select("part", S.video_bitrate(F.col("src"), F.col("pixels"), F.col("copied")).alias("video_bps"), S.audio_bitrate(F.col("src"), F.col("ch"), F.col("copied")).alias("audio_bps"), S.audio_channels(F.col("ch"), F.col("fam")).alias("channels"))
