"""Names, attributes and playlists as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def safe_component(value: Column, empty: str) -> Column:
    """Letters, digits, - and _; any other character is _, and no text is `empty`."""
    return F.coalesce(F.nullif(F.regexp_replace(value, "[^A-Za-z0-9_-]", "_"), F.lit("")), F.lit(empty))


def escape_attribute(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def language_of(packed: Column) -> Column:
    """Three letters of five bits each; null for 0, for the unknown mark and where a letter is none."""
    letters = [F.shiftright(packed, k).bitwiseAND(31) for k in (10, 5, 0)]
    good = (packed != 0) & (packed != 0x55C4)
    for x in letters:
        good = good & x.between(1, 26)
    return F.when(good, F.concat(*[F.char(x + 96) for x in letters]))


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)), F.lit(""))


def media_playlist(segments: DataFrame, version: int, suffix: str, map_uri: str | None = None, first: int = 0, vod: bool = True, ended: bool = True) -> DataFrame:
    """(track, n, start_ms, end_ms, target_seconds) -> (track, playlist): segments in order, seconds with three decimals."""
    head = F.concat(F.lit(f"#EXTM3U\n#EXT-X-VERSION:{version}\n#EXT-X-TARGETDURATION:"), F.max("target_seconds").cast("string"), F.lit(f"\n#EXT-X-MEDIA-SEQUENCE:{first}\n" + ("#EXT-X-PLAYLIST-TYPE:VOD\n" if vod else "") + (f'#EXT-X-MAP:URI="{map_uri}"\n' if map_uri else "")))
    ms = F.col("end_ms") - F.col("start_ms")
    line = F.format_string(f"#EXTINF:%d.%03d,\nseg-%05d.{suffix}\n", ((ms - ms % 1000) / 1000).cast("bigint"), ms % 1000, F.col("n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n").alias("o"), line.alias("t")))), lambda x: x["t"]), "")
    return segments.groupBy("track").agg(F.concat(head, body, F.lit("#EXT-X-ENDLIST\n" if ended else "")).alias("playlist"))


def distinct_codecs(renditions: DataFrame) -> DataFrame:
    """(track, ix, codec) -> (track, codecs): each codec once, in order of first appearance."""
    firsts = renditions.groupBy("track", "codec").agg(F.min("ix").alias("ix"))
    return firsts.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "codec"))), lambda x: x["codec"]), ",").alias("codecs"))


def master_playlist(variants: DataFrame, renditions: DataFrame) -> DataFrame:
    """(track, bandwidth, video_codec) and audio (track, ix, name, language, codec, is_default) -> (track, playlist).

    A rendition is chosen automatically if it has a language; the variant names each codec once, video first.
    """
    lang = F.when(F.col("language").isNotNull(), F.concat(F.lit(',LANGUAGE="'), escape_attribute(F.col("language")), F.lit('"'))).otherwise("")
    yes = lambda c: F.when(c, "YES").otherwise("NO")
    line = F.concat(F.lit('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="'), escape_attribute(F.col("name")), F.lit('"'), lang, F.lit(",DEFAULT="), yes(F.col("is_default")), F.lit(",AUTOSELECT="), yes(F.col("language").isNotNull()), F.lit(',URI="'), F.col("name"), F.lit('/playlist.m3u8"\n'))
    media = renditions.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", line.alias("t")))), lambda x: x["t"]), "").alias("media"))
    every = variants.select("track", F.lit(-1).cast("bigint").alias("ix"), F.col("video_codec").alias("codec")).union(renditions.select("track", F.col("ix").cast("bigint"), "codec"))
    rows = variants.join(media, "track", "left").join(distinct_codecs(every), "track")
    return rows.select("track", F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n"), F.coalesce("media", F.lit("")), F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), F.col("bandwidth").cast("string"), F.lit(',CODECS="'), F.col("codecs"), F.lit('",AUDIO="audio"\nvideo/playlist.m3u8\n')).alias("playlist"))
