"""Codec labels, families and what each playback target takes unchanged."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Label -> family.
FAMILIES = {
    "h264": ("h264", "avc1", "avc3"),
    "hevc": ("hevc", "h265", "hvc1", "hev1", "dvh1", "dvhe"),
    "av1": ("av1", "av01"),
    "vp9": ("vp9", "vp09"),
    "aac": ("aac", "mp4a"),
    "ac3": ("ac3", "ac-3"),
    "eac3": ("eac3", "ec-3"),
    "dts": ("dts", "dca"),
    "truehd": ("truehd",),
    "flac": ("flac",),
    "alac": ("alac",),
    "opus": ("opus",),
    "mp3": ("mp3", ".mp3"),
    "text_subtitle": ("subrip", "ass", "ssa", "mov_text", "webvtt", "text", "subviewer", "microdvd"),
    "bitmap_subtitle": ("hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "dvb_teletext", "xsub"),
}
#: What may be copied, by use, kind and target. The three uses differ on purpose.
_ALL_AUDIO = ("aac", "ac3", "eac3", "dts", "truehd", "flac", "alac", "opus", "mp3")
_ALL_VIDEO = ("h264", "hevc", "av1", "vp9")
PLAYBACK_COPY = {
    ("video", "native"): _ALL_VIDEO,
    ("video", "apple"): ("h264", "hevc"),
    ("video", "browser"): ("h264", "av1", "vp9"),
    ("audio", "native"): _ALL_AUDIO,
    ("audio", "apple"): ("aac", "ac3", "eac3", "alac", "mp3"),
    ("audio", "browser"): ("aac", "mp3", "opus"),
    ("subtitle", "native"): ("text_subtitle", "bitmap_subtitle"),
    ("subtitle", "apple"): ("text_subtitle",),
    ("subtitle", "browser"): ("text_subtitle",),
}
PROBE_COPY = {"video": _ALL_VIDEO, "audio": _ALL_AUDIO}
HLS_SEGMENTS = {"video": ("h264", "hevc"), "audio": ("aac", "ac3", "eac3")}
HLS_COPY = {
    ("video", "native"): ("h264", "hevc"),
    ("video", "apple"): ("h264", "hevc"),
    ("video", "browser"): ("h264",),
    ("audio", "native"): ("aac", "ac3", "eac3", "mp3"),
    ("audio", "apple"): ("aac", "ac3", "eac3", "mp3"),
    ("audio", "browser"): ("aac", "mp3"),
}
DECODED_VIDEO = ("h264", "hevc", "av1")
TRANSCODED_AUDIO = ("opus", "truehd", "dts")
LOSSLESS = ("truehd", "flac", "alac")


def label(codec: Column) -> Column:
    return F.lower(F.trim(codec))


def family(codec: Column) -> Column:
    """Family of a codec label; `unknown` for any other label and for null."""
    out = F.lit("unknown")
    for name, labels in FAMILIES.items():
        out = F.when(label(codec).isin(*labels), name).otherwise(out)
    return out


def subtitle_format(codec: Column) -> Column:
    return F.when(label(codec).isin(*FAMILIES["text_subtitle"]), "text").when(label(codec).isin(*FAMILIES["bitmap_subtitle"]), "bitmap").otherwise("unknown")


def _matrix(matrix: dict, kind: Column, fam: Column, target: Column) -> Column:
    out = F.lit(False)
    for (k, t), families in matrix.items():
        out = F.when((kind == k) & (target == t), fam.isin(*families)).otherwise(out)
    return out


def can_copy(kind: Column, fam: Column, target: Column) -> Column:
    """For a playback plan: whether a target plays a track as it is."""
    return _matrix(PLAYBACK_COPY, kind, fam, target)


def can_copy_for_hls(kind: Column, fam: Column, target: Column) -> Column:
    """For a transcode plan: whether a track goes into the target's segments as it is."""
    return _matrix(HLS_COPY, kind, fam, target)


def can_copy_at_all(kind: Column, fam: Column) -> Column:
    """For a probe: whether any target can play it as it is."""
    return F.when(kind == "video", fam.isin(*PROBE_COPY["video"])).when(kind == "audio", fam.isin(*PROBE_COPY["audio"])).otherwise(False)


def hls_supports(kind: Column, fam: Column) -> Column:
    """Whether segments can hold the codec at all."""
    return F.when(kind == "video", fam.isin(*HLS_SEGMENTS["video"])).when(kind == "audio", fam.isin(*HLS_SEGMENTS["audio"])).otherwise(False)


def can_transcode_audio(fam: Column, target: Column) -> Column:
    return (target != "native") & fam.isin(*TRANSCODED_AUDIO)


def usable(kind: Column, fmt: Column, target: Column) -> Column:
    """All tracks but bitmap subtitles on browsers and Apple players; a missing format passes."""
    return ~((kind == "subtitle") & target.isin("browser", "apple") & F.coalesce(fmt == "bitmap", F.lit(False)))


#: Container ids -> labels; other ids keep their own text.
MATROSKA_IDS = {
    "h264": ("V_MPEG4/ISO/AVC",), "hevc": ("V_MPEGH/ISO/HEVC",), "av1": ("V_AV1",), "vp9": ("V_VP9",),
    "aac": ("A_AAC", "A_AAC/MPEG4/LC", "A_AAC/MPEG2/LC"), "ac3": ("A_AC3",), "eac3": ("A_EAC3",), "dts": ("A_DTS",), "truehd": ("A_TRUEHD",), "flac": ("A_FLAC",), "opus": ("A_OPUS",), "vorbis": ("A_VORBIS",),
    "subrip": ("S_TEXT/UTF8",), "ass": ("S_TEXT/ASS",), "ssa": ("S_TEXT/SSA",), "webvtt": ("S_TEXT/WEBVTT",), "ttml": ("S_TEXT/TTML",), "hdmv_pgs_subtitle": ("S_HDMV/PGS",), "dvd_subtitle": ("S_VOBSUB",), "dvb_subtitle": ("S_DVBSUB",),
}
#: Sample entries -> labels.
SAMPLE_ENTRIES = {"h264": ("avc1", "avc3"), "hevc": ("hvc1", "hev1", "dvh1", "dvhe"), "av1": ("av01",), "vp9": ("vp09",), "aac": ("mp4a",), "ac3": ("ac-3",), "eac3": ("ec-3",), "alac": ("alac",), "flac": ("fLaC",), "opus": ("Opus",), "mov_text": ("tx3g", "text"), "webvtt": ("wvtt",)}
#: Transfer characteristics -> range.
RANGES = {"PQ": (16,), "HLG": (18,), "SDR": (1, 6, 13, 14, 15)}


def _looked_up(value: Column, table: dict, default: Column) -> Column:
    out = default
    for name, keys in table.items():
        out = F.when(value.isin(*keys), name).otherwise(out)
    return out


def matroska_codec(identifier: Column) -> Column:
    return _looked_up(F.upper(F.trim(identifier)), MATROSKA_IDS, F.trim(identifier))


def sample_entry_codec(fourcc: Column, kind: Column, config: Column) -> Column:
    """Label of a sample entry; for mp4a audio the codec string decides: 40.* is aac, a9 and ac are dts, others stand as they are."""
    mp4a = (fourcc == "mp4a") & (kind == "audio") & config.isNotNull()
    plain = F.when((fourcc == "mp4a") & (kind != "audio"), fourcc).otherwise(_looked_up(fourcc, SAMPLE_ENTRIES, fourcc))
    return F.when(mp4a & F.startswith(config, F.lit("mp4a.40.")), "aac").when(mp4a & config.isin("mp4a.a9", "mp4a.ac"), "dts").when(mp4a, config).otherwise(plain)


def video_range(transfer: Column) -> Column:
    return _looked_up(transfer, RANGES, F.lit(None).cast("string"))


def avc_string(profile: Column, limits: Column, level: Column) -> Column:
    return F.format_string("avc1.%02X%02X%02X", profile, limits, level)


def mp4a_string(indication: Column, object_type: Column) -> Column:
    """mp4a.40.n for MPEG-4 audio, null without an object type; else the indication in hex."""
    return F.when(indication == 0x40, F.when(object_type > 0, F.concat(F.lit("mp4a.40."), object_type.cast("string")))).otherwise(F.format_string("mp4a.%02x", indication))


def pixel_format(sampling: Column, depth: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("monochrome", "yuv420", "yuv422", "yuv444")])
    return F.when(sampling.between(0, 3), F.concat(F.element_at(names, sampling.cast("int") + 1), F.lit("-"), depth.cast("string"), F.lit("bit")))


def frame_rate_ratio(rate: Column) -> tuple[Column, Column]:
    """Numerator and denominator: the NTSC rates within a hundredth, else thousandths in lowest terms; 24/1 where there is no rate.

    What thousandths share with 1000 is a power of 2 and one of 5, up to the third each.
    """
    good = rate.isNotNull() & ~F.isnan(rate) & (rate > 0) & (rate < float("inf"))
    n = F.least(F.greatest(F.round(rate * 1000), F.lit(1.0)), F.lit(2.0**32 - 1)).cast("bigint")
    power = lambda p: F.when(n % p**3 == 0, p**3).when(n % p**2 == 0, p**2).when(n % p == 0, p).otherwise(1)
    divisor = power(2) * power(5)
    num, den = ((n - n % divisor) / divisor).cast("bigint"), (F.lit(1000) / divisor).cast("bigint")
    for near, top in ((23.976, 24_000), (29.97, 30_000), (59.94, 60_000)):
        hit = F.abs(rate - near) < 0.01
        num, den = F.when(hit, top).otherwise(num), F.when(hit, 1001).otherwise(den)
    return F.when(good, num).otherwise(24), F.when(good, den).otherwise(1)


def fitted_size(width: Column, height: Column, most_width: int, most_height: int) -> tuple[Column, Column]:
    """Even picture size of at least 2 within bounds, never larger than the source."""
    scale = F.least(F.lit(float(most_width)) / F.greatest(width, F.lit(1)), F.lit(float(most_height)) / F.greatest(height, F.lit(1)), F.lit(1.0))
    even = lambda x: F.greatest(F.round(x * scale).cast("bigint") - F.round(x * scale).cast("bigint") % 2, F.lit(2).cast("bigint"))
    return even(width), even(height)
