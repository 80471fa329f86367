"""Files built byte by byte, read as tracks, chapters, attachments and plans."""

import struct

from cutlist.functions import binary
from cutlist.operators import selection
from cutlist.sources import probes

from .test_containers import box, ebml, files, mp4, table

IDS = {v: k for k, v in {**probes.MASTERS, **probes.VALUES}.items()}


def e(name, *parts):
    return ebml(IDS[name], b"".join(parts))


def mkv():
    video = e("Track", e("Number", b"\x01"), e("Kind", b"\x01"), e("Codec", b"V_MPEGH/ISO/HEVC"), e("Video", e("Width", b"\x07\x80"), e("Height", b"\x04\x38")))
    audio = e("Track", e("Number", b"\x02"), e("Kind", b"\x02"), e("Codec", b"A_AC3"), e("Language", b"jpn"), e("Default", b"\x00"), e("Audio", e("Channels", b"\x06")))
    text = e("Track", e("Number", b"\x03"), e("Kind", b"\x11"), e("Codec", b"S_TEXT/UTF8"))
    inner = e("Atom", e("Start", (3 * 10**9).to_bytes(8, "big")), e("Display", e("Text", b"inner")))
    atom = e("Atom", e("Uid", b"\xff" * 8), e("Start", b"\x00"), e("Display", e("Text", b"one"), e("TextLanguage", b"eng")), e("Display", e("Text", b"eins")), inner)
    silent = e("Atom", e("Uid", b"\x05"), e("Atom", e("Start", struct.pack(">Q", 9_999_999))))
    files_ = e("Attachments", e("Attached", e("FileName", b"a.ttf"), e("MimeType", b"font/ttf"), e("FileData", b"x" * 70_000)))
    cues = e("Cues", e("Point", e("Time", b"\x0a"), e("Position", e("CueTrack", b"\x01"), e("CuePlace", b"\x64"))))
    return ebml(0x1A45DFA3, b"") + e("Segment", e("Tracks", video, audio, text), e("Chapters", e("Edition", atom, silent)), files_, cues)


def test_matroska(spark):
    found = probes.matroska_elements(files(spark, m=mkv(), cut=mkv()[:100], empty=b"")).cache()
    t = [(r.ix, r.kind, r.codec, r.language, r.is_default, r.width, r.channels) for r in probes.matroska_tracks(found).where("path = 'm'").orderBy("ix").collect()]
    assert t == [(0, "video", "hevc", None, True, 1920, None), (1, "audio", "ac3", "jpn", False, None, 6), (2, "subtitle", "subrip", None, True, None, None)]
    c = [(r.id, r.start_ms, r.title, r.language) for r in probes.matroska_chapters(found).orderBy("ix").collect()]
    assert c == [("18446744073709551615", 0, "one", "eng"), ("ch1", 3000, "inner", None), ("ch2", 9, None, None)]
    assert [(r.name, r.mime, r.size) for r in probes.attachments(found).collect()] == [("a.ttf", "font/ttf", 70_000)]
    assert [(r.track, r.ticks, r.position) for r in probes.seek_points(found).collect()] == [(1, 10, 100)]


def test_files_to_plans(spark):
    stsd = box(b"stsd", struct.pack(">II", 0, 1), box(b"avc1", bytes(20)))
    f = files(spark, a=mp4(extra=(stsd,)), m=mkv(), junk=b"no media")
    t = probes.tracks(f)
    assert sorted((r.source, r.ix, r.codec) for r in t.collect()) == [("a", 0, "h264"), ("m", 0, "hevc"), ("m", 1, "ac3"), ("m", 2, "subrip")]
    plan = {(r.source, r.target, r.stage): r.track_ids for r in selection.playback_plan(t).collect()}
    assert plan["a", "browser", "packet-copy"] == "v0" and plan["m", "apple", "packet-copy"] == "v0,a0,s0" and plan["m", "browser", "decode"] == "v0,a0"


def test_languages_and_start_codes(spark):
    from pyspark.sql import functions as F

    assert table(b"mdhd", 1)[4:8] == b"mdhd"
    df = spark.createDataFrame([(bytes.fromhex("00000002674200000001 65".replace(" ", "")),), (b"\x00\x00\x00\x09\x01",)], "d binary")
    assert [r[0] for r in df.select(F.hex(binary.annex_b(F.col("d")))).collect()] == ["000000016742" + "0000000165", None]


def test_text_cues_and_payload_errors(spark):
    from cutlist.sources import containers

    block = lambda ticks, body: ebml(containers.BLOCK_GROUP, ebml(containers.BLOCK, b"\x83" + struct.pack(">hB", ticks, 0) + body) + ebml(containers.DURATION, b"\x07\xd0"))
    text = e("Track", e("Number", b"\x03"), e("Kind", b"\x11"), e("Codec", b"S_TEXT/UTF8"))
    file = ebml(0x1A45DFA3, b"") + e("Segment", e("Tracks", text), ebml(containers.CLUSTER, ebml(containers.TIMECODE, b"\x03\xe8") + block(0, b"<i>Hi</i>") + block(3000, b" {x} ") + block(5000, b"Bye")))
    got = [tuple(r) for r in probes.text_cues(files(spark, m=file)).orderBy("ix").collect()]
    assert got == [("m#3", 0, 1000, 3000, "Hi"), ("m#3", 2, 6000, 8000, "Bye")]
    packets = spark.createDataFrame([("m", 0, 4), ("m", 10**6, 1), ("m", 3, -1), ("x", 0, 1)], "path string, source_offset long, size long")
    assert sorted((r.path, r.size, r.error, r.payload and bytes(r.payload)) for r in probes.payloads(files(spark, m=file), packets).collect()) == [("m", -1, "invalid range", None), ("m", 1, "outside the source", None), ("m", 4, None, b"\x1a\x45\xdf\xa3"), ("x", 1, "no such file", None)]


def test_text_cues_of_compressed_tracks(spark):
    import zlib

    from cutlist.sources import containers

    squeeze = e("Encodings", e("Encoding", e("Compression", e("Algorithm", b"\x00"))))
    strip = e("Encodings", e("Encoding", e("Compression", e("Algorithm", b"\x03"), e("Settings", b"Hel"))))
    both = e("Encodings", e("Encoding", e("Order", b"\x00"), e("Compression", e("Algorithm", b"\x03"), e("Settings", b"Hel"))), e("Encoding", e("Order", b"\x01"), e("Compression")))
    other = e("Encodings", e("Encoding", e("Compression", e("Algorithm", b"\x02"))))
    private = e("Encodings", e("Encoding", e("Scope", b"\x02"), e("Compression")))
    bodies = {"zlib": (squeeze, zlib.compress(b"Hello there")), "strip": (strip, b"lo there"), "both": (both, zlib.compress(b"lo there")), "broken": (squeeze, b"Hello"), "cut": (squeeze, zlib.compress(b"Hello there")[:-6]), "lzo": (other, b"Hello"), "private": (private, b"Hello there")}
    made = {}
    for name, (how, body) in bodies.items():
        text = e("Track", e("Number", b"\x03"), e("Kind", b"\x11"), e("Codec", b"S_TEXT/UTF8"), how)
        block = ebml(containers.BLOCK_GROUP, ebml(containers.BLOCK, b"\x83" + struct.pack(">hB", 0, 0) + body) + ebml(containers.DURATION, b"\x07\xd0"))
        made[name] = ebml(0x1A45DFA3, b"") + e("Segment", e("Tracks", text), ebml(containers.CLUSTER, ebml(containers.TIMECODE, b"\x03\xe8") + block))
    got = {r.track: r.text for r in probes.text_cues(files(spark, **made)).collect()}
    assert got == dict.fromkeys(("zlib#3", "strip#3", "both#3", "private#3"), "Hello there")


def test_audio_configurations(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytes.fromhex("1190"),), (bytes.fromhex("17800005DC08"),), (b"",)], "d binary")
    got = [tuple(r[0]) for r in df.select(binary.aac_config(F.col("d"))).collect()]
    assert got[0] == (2, 3, 48000, 2) and got[1][0] == 2 and got[1][1] == 15 and got[2] == (None, None, None, None)
    df = spark.createDataFrame([(bytes.fromhex("103DC0"),)], "d binary")
    assert tuple(df.select(binary.ac3_config(F.col("d"))).collect()[0][0]) == (48000, 6, 384, 8)


def test_probes_walk_only_the_parts_they_read(spark, monkeypatch):
    parts, own = [], probes.matroska_elements
    monkeypatch.setattr(probes, "matroska_elements", lambda files, *within: parts.append(within) or own(files, *within))
    r = probes.probed(files(spark, m=mkv())).collect()[0]
    assert sorted(parts) == [("Attachments",), ("Chapters",), ("Tracks",)]
    assert (len(r.tracks), len(r.chapters), len(r.attachments)) == (3, 3, 1)
