"""Which tracks play, are copied or are converted, and the plans that follow.

Tracks are rows (source, ix, kind, codec, is_default, language); `described` adds what the rules need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import codecs

#: First letters of track ids by kind.
PREFIX = {"video": "v", "audio": "a", "subtitle": "s"}
#: What plans are made for.
TARGETS = ("native", "apple", "browser")


def described(tracks: DataFrame) -> DataFrame:
    """Adds family, format, lossless, and the id: a letter by kind and the number among its kind."""
    prefix = F.lit("x")
    for kind, letter in PREFIX.items():
        prefix = F.when(F.col("kind") == kind, letter).otherwise(prefix)
    number = F.row_number().over(W.partitionBy("source", "kind").orderBy("ix")) - 1
    fam = codecs.family(F.col("codec"))
    return tracks.withColumns({"family": fam, "format": F.when(F.col("kind") == "subtitle", codecs.subtitle_format(F.col("codec"))), "lossless": (F.col("kind") == "audio") & fam.isin(*codecs.LOSSLESS), "id": F.concat(prefix, number.cast("string"))})


def capabilities(tracks: DataFrame) -> DataFrame:
    """One row a source: whether video or audio must be decoded, and the ids of tracks of unknown family."""
    t = described(tracks)
    hard = lambda kind: F.coalesce(F.bool_or(F.when(F.col("kind") == kind, ~codecs.can_copy_at_all(F.col("kind"), F.col("family")))), F.lit(False))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("family") == "unknown", F.struct("ix", "id")))), lambda x: x["id"]), ",")
    out = t.groupBy("source").agg(hard("video").alias("decode_video"), hard("audio").alias("decode_audio"), ids.alias("unsupported"))
    return out.withColumn("copies_whole", ~F.col("decode_video") & ~F.col("decode_audio"))


def _cascade(*rules: Column) -> Column:
    """Number of the first rule that holds."""
    out = F.lit(len(rules))
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(rule, k).otherwise(out)
    return out


def _first(rows: DataFrame, rank: Column) -> DataFrame:
    chosen = rows.withColumn("rank", rank).groupBy("source", "target").agg(F.min_by(F.struct("id", "ix", "rank"), F.struct("rank", "ix")).alias("t"))
    return chosen.select("source", "target", "t.id", "t.ix", "t.rank")


def for_targets(tracks: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """Described tracks once for each target."""
    return described(tracks).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))


def _playback_rank(target: Column | None = None) -> Column:
    target = F.col("target") if target is None else target
    copy, change = codecs.can_copy(F.col("kind"), F.col("family"), target), codecs.can_transcode_audio(F.col("family"), target)
    d = F.col("is_default")
    return _cascade(d & copy, copy, d & change, change, d)


def _hls_rank() -> Column:
    copy, ready = codecs.can_copy_for_hls(F.col("kind"), F.col("family"), F.col("target")), F.col("family").isin(*codecs.TRANSCODED_AUDIO)
    d = F.col("is_default")
    return _cascade(d & copy, copy, d & ready, ready, d)


def primary_audio(tracks: DataFrame) -> DataFrame:
    """For playback: default and copied, copied, default and convertible, convertible, default, first."""
    return _first(for_targets(tracks).where("kind = 'audio'"), _playback_rank())


def hls_audio(tracks: DataFrame) -> DataFrame:
    """For transcoding: the same order over its own copy rules and the codecs with a decoder, whatever the target."""
    return _first(for_targets(tracks).where("kind = 'audio'"), _hls_rank())


def executable_audio(tracks: DataFrame) -> DataFrame:
    """For execution: default and executable, executable, default, first."""
    t = for_targets(tracks, ("any",)).where("kind = 'audio'")
    run = F.col("family").isin("aac", "ac3", "eac3", *codecs.TRANSCODED_AUDIO)
    return _first(t, _cascade(F.col("is_default") & run, run, F.col("is_default"))).drop("target")


def hls_track(tracks: DataFrame, kind: str, prefer_default: bool) -> DataFrame:
    """First track of a kind that segments can hold; with `prefer_default` a default one comes first."""
    t = for_targets(tracks, ("any",)).where(F.col("kind") == kind).where(codecs.hls_supports(F.col("kind"), F.col("family")))
    rank = F.when(F.col("is_default"), 0).otherwise(1) if prefer_default else F.lit(0)
    return _first(t, rank).drop("target", "rank")


def analysis_audio(tracks: DataFrame, wanted: str | None) -> DataFrame:
    """Audio for analysis: the wanted language first, Japanese first if none is wanted, then defaults, then order."""
    lang = F.coalesce("language", F.lit("und"))
    keys = [lang != (wanted or "und"), F.lit(wanted is None) & (lang != "ja"), ~F.col("is_default"), F.col("ix")]
    t = described(tracks).where("kind = 'audio'")
    out = t.groupBy("source").agg(F.min_by(F.struct("id", "language"), F.struct(*keys)).alias("t"))
    return out.select("source", "t.id", "t.language").where(F.lit(True) if wanted is None else F.coalesce(F.col("language") == wanted, F.lit(False)))


def selected(tracks: DataFrame, subtitles: bool = True) -> DataFrame:
    """(source, target, place, id, kind, family, ix): first video, primary audio, usable subtitles, in that order.

    All of it is windows over a source's tracks in the order of kind and ix, so that tracks that are dealt by source
    are not shuffled again and are sorted once; what each target takes stands beside a track until the end.
    """
    targets = TARGETS
    of, of_kind = W.partitionBy("source"), W.partitionBy("source", "kind").orderBy("ix")
    t = described(tracks)
    best = [F.when(F.col("kind") == "audio", F.struct(_playback_rank(F.lit(name)).alias("rank"), F.col("ix").alias("at"))) for name in targets]
    t = t.withColumns({"first_video": F.min(F.when(F.col("kind") == "video", F.col("ix"))).over(of)} | {f"audio_{name}": F.min(b).over(of) for name, b in zip(targets, best)})
    part = {}
    for name, b in zip(targets, best):
        own = F.when((F.col("kind") == "video") & (F.col("ix") == F.col("first_video")), 0).when((F.col("kind") == "audio") & (b == F.col(f"audio_{name}")), 1)
        if subtitles:
            own = own.when((F.col("kind") == "subtitle") & codecs.usable(F.col("kind"), F.col("format"), F.lit(name)), 2)
        part[f"part_{name}"] = own
    t = t.withColumns(part).drop(*[f"audio_{name}" for name in targets], "first_video").where(" OR ".join(f"{c} IS NOT NULL" for c in part))
    # each part has tracks of one kind, so that a place is made of the tracks in parts before and of those before among the kind
    count = lambda c, over: F.coalesce(F.sum(c.cast("bigint")).over(over), F.lit(0).cast("bigint"))
    places, video = {}, count(F.coalesce(F.col(f"part_{targets[0]}") == 0, F.lit(False)), of)
    for c in part:
        audio = count(F.coalesce(F.col(c) == 1, F.lit(False)), of)
        among = count(F.col(c).isNotNull(), of_kind.rowsBetween(W.unboundedPreceding, -1))
        places[c] = F.when(F.col(c).isNotNull(), among + F.when(F.col(c) > 0, video).otherwise(0) + F.when(F.col(c) > 1, audio).otherwise(0))
    each = F.array(*[F.struct(F.lit(name).alias("target"), p.alias("place")) for name, p in zip(targets, places.values())])
    rows = t.withColumn("t", each).select("source", "id", "kind", "family", "ix", F.explode("t").alias("t")).where("t.place IS NOT NULL")
    return rows.select("source", "t.target", "t.place", "id", "kind", "family", "ix")


def _stages() -> list[tuple[str, str, Column]]:
    """Stages of a plan in order, their modes and what they take; text subtitles that are copied are transformed too."""
    copy = codecs.can_copy(F.col("kind"), F.col("family"), F.col("target"))
    text = (F.col("kind") == "subtitle") & (F.col("family") == "text_subtitle")
    #: Stages and their modes.
    return [("demux", "shared", F.lit(True)), ("packet-copy", "copy", copy), ("decode", "decode", ~copy), ("encode", "encode", ~copy), ("subtitle-text", "transform", text), ("mux", "shared", F.lit(True))]


def playback_plan(tracks: DataFrame, subtitles: bool = True) -> DataFrame:
    """(source, target, stage, mode, track_ids) in order of `ordinal`: demux, copy, decode, encode, text, mux.

    Demux and mux are always there, the others where they have tracks. Tracks of a source and target are
    gathered once, each with the stages that take it, and stages read them there.
    """
    stages = _stages()
    takes = [rule.alias(f"s{k}") for k, (_, _, rule) in enumerate(stages)]
    t = selected(tracks, subtitles).groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("place", "id", *takes))).alias("own"))
    ids = lambda k: F.array_join(F.transform(F.filter("own", lambda x: x[f"s{k}"]), lambda x: x["id"]), ",")
    each = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("stage"), F.lit(m).alias("mode"), ids(k).alias("track_ids")) for k, (n, m, _) in enumerate(stages)])
    return t.select("source", "target", F.explode(each).alias("s")).select("source", "target", "s.*").where("track_ids <> ''")


def staged(tracks: DataFrame, subtitles: bool = True) -> DataFrame:
    """(source, target, id, ordinal, stage, mode): the plan's copying, decoding, encoding and transforming stages with a row for each track, gathered nowhere."""
    each = F.array(*[F.when(rule, F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("stage"), F.lit(m).alias("mode"))) for k, (n, m, rule) in enumerate(_stages()) if m != "shared"])
    return selected(tracks, subtitles).select("source", "target", "id", F.explode(F.array_compact(each)).alias("s")).select("source", "target", "id", "s.*")


def _by_track(plan: DataFrame) -> DataFrame:
    """Rows of `playback_plan` with an id each; those of `staged` have one."""
    return plan if "id" in plan.columns else plan.withColumn("id", F.explode(F.split("track_ids", ",")))


def output_stages(plan: DataFrame) -> DataFrame:
    """(source, target, id, stage): the last copying, encoding or transforming stage that a track of a plan, or of `staged`, passes."""
    rows = _by_track(plan.where(F.col("stage").isin("packet-copy", "encode", "subtitle-text")))
    return rows.groupBy("source", "target", "id").agg(F.max_by("stage", "ordinal").alias("stage"))


def audio_outputs(tracks: DataFrame) -> DataFrame:
    """Selected audio fanned out against the one video stage of its source and target."""
    out = output_stages(staged(tracks, subtitles=False))
    video = out.where("id LIKE 'v%'").select("source", "target", F.col("id").alias("video_id"), F.col("stage").alias("video_stage"))
    return out.where("id LIKE 'a%'").select("source", "target", F.col("id").alias("audio_id"), F.col("stage").alias("audio_stage")).join(video, ["source", "target"], "left")


def transcode_plan(tracks: DataFrame) -> DataFrame:
    """One row a source and target: video and audio, how each gets into segments, and what is missing.

    A plan is executable where nothing is missing; video without any video track is itself missing.
    """
    t = for_targets(tracks).withColumn("rank", _hls_rank())
    own, is_video, is_audio = F.struct("id", "kind", "family"), F.col("kind") == "video", F.col("kind") == "audio"
    rows = t.groupBy("source", "target").agg(F.min_by(F.when(is_video, own), F.when(is_video, F.col("ix"))).alias("v"), F.min_by(F.when(is_audio, own), F.when(is_audio, F.struct("rank", "ix"))).alias("a"))

    def way(part: str, decoded: tuple[str, ...]) -> Column:
        c = lambda f: F.col(f"{part}.{f}")
        return F.when(c("id").isNull(), "none").when(codecs.can_copy_for_hls(c("kind"), c("family"), F.col("target")), "copy").when(c("family").isin(*decoded), "transcode").otherwise("missing")

    rows = rows.withColumns({"video_mode": way("v", codecs.DECODED_VIDEO), "audio_mode": way("a", codecs.TRANSCODED_AUDIO)})
    missing = F.array_compact(F.array(F.when(F.col("video_mode").isin("missing", "none"), "video"), F.when(F.col("audio_mode") == "missing", "audio")))
    return rows.select("source", "target", F.col("v.id").alias("video_id"), "video_mode", F.col("a.id").alias("audio_id"), "audio_mode", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("executable"))


def chunk_stages(plan: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of chunks (source, target, id, chunk) with every copying, decoding, encoding or transforming stage of a plan or of `staged`, and those without any."""
    rows = _by_track(plan.where(~F.col("stage").isin("demux", "mux"))).select("source", "target", "id", "stage", "mode")
    keys = ["source", "target", "id"]
    return chunks.join(rows, keys), chunks.join(rows.select(*keys), keys, "left_anti")


def video_ladder(pixels: Column) -> Column:
    """Bits a second by picture size; 1080p where it is unknown."""
    p = F.coalesce(pixels, F.lit(1920 * 1080))
    return F.when(p >= 3840 * 2160, 16_000_000).when(p >= 1920 * 1080, 8_000_000).when(p >= 1280 * 720, 4_500_000).otherwise(2_500_000)


def video_bitrate(source: Column, pixels: Column, copied: Column) -> Column:
    """The source's own or the ladder's; converted video never more than the ladder's."""
    own = F.coalesce(source, video_ladder(pixels))
    return F.when(copied, own).otherwise(F.least(own, video_ladder(pixels)))


def audio_channels(channels: Column, fam: Column) -> Column:
    """Channels of converted audio: up to 6 for the families with a bridge, else 2; 2 where unknown."""
    n = F.coalesce(channels, F.lit(2))
    return F.when(fam.isin(*codecs.TRANSCODED_AUDIO), F.least(n, F.lit(6))).otherwise(F.least(n, F.lit(2)))


def audio_bitrate(source: Column, channels: Column, copied: Column) -> Column:
    return F.when(copied, F.coalesce(source, F.lit(384_000))).otherwise(F.when(F.coalesce(channels, F.lit(2)) <= 2, 192_000).otherwise(640_000))


def requested(tracks: DataFrame, requests: DataFrame) -> DataFrame:
    """(source, id) asked for -> (source, id, kind, codec): null where there is no such track; nothing else stands in for it."""
    return requests.join(described(tracks).select("source", "id", "kind", "codec"), ["source", "id"], "left")
