"""Walks of many files at once against those of one file after another, over whole, cut and damaged files."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutlist.plans import catalog
from cutlist.sources import containers, made, probes, walks

from .test_containers import box, ebml, matroska, mp4
from .test_probes import e, mkv


def damaged(whole, seed, many):
    """Files as they are, cut off, and with some bytes changed."""
    r, out = random.Random(seed), []
    for k in range(many):
        data = bytearray(whole[k % len(whole)])
        if k >= len(whole) and k % 3 == 0:
            del data[r.randrange(len(data)) :]
        elif k >= len(whole):
            for _ in range(r.randrange(1, 4)):
                data[r.randrange(len(data))] = r.choice((0, 1, 2, 8, 16, 0x40, 0x7F, 0x80, 0x81, 0xFF, r.randrange(256)))
        out.append(bytes(data))
    return [*out, b"", None]


def items(n=40):
    return pa.table({"o": [k // 4 for k in range(n)], "size": [k % 50 + 1 for k in range(n)], "step": [k % 40 + 1 for k in range(n)], "shift": [k % 3 for k in range(n)], "note": [f"A F {k}" for k in range(n)]})


def made_files(make):
    return [c for b in made._batches(iter(items().to_batches()), make) for c in b.column(1).to_pylist()]


MKV = [*made_files(made._matroska), matroska(), mkv()]
MP4 = [*made_files(made._mp4), *made_files(made._fragment)[:3], mp4(), box(b"moov", box(b"udta", b"x")) * 2]


@pytest.mark.parametrize("few", [0, 16])
def test_levels_equal_walks_one_by_one(few, monkeypatch):
    monkeypatch.setattr(walks, "FEW", few)
    for whole, step in ((MKV, "elements"), (MP4, "boxes")):
        contents = damaged(whole, few, 300)
        b = walks.Bytes(pa.array(contents, pa.binary()))
        level = getattr(b, step)(b.first, b.last)
        want = []
        for k, data in enumerate(contents):
            first = int(b.first[k])
            if step == "elements":
                want += [(k, number, s + first, z + first) for number, s, z in containers.elements(data or b"", 0, len(data or b""))]
            else:
                want += [(k, int.from_bytes(own.rsplit(".", 1)[0][1:].encode("latin-1"), "big"), at + first, at + size + first) for own, at, size, _ in containers.walk_boxes(memoryview(data or b""), 0, len(data or b""), "") if own.count("/") == 1]
        got = list(zip(*(x.tolist() for x in (level.owner, level.name, level.start if step == "elements" else level.at, level.stop))))
        assert got == want and len(want) > 250


def test_numbers_among_equals():
    assert walks.nth(np.array([1, 2, 1, 1, 2]), np.array([0, 0, 0, 5, 0])).tolist() == [0, 0, 1, 0, 1] and walks.nth(np.array([], int)).tolist() == []


def table_of(spark, contents):
    return spark.createDataFrame([(f"p{k}", c) for k, c in enumerate(contents)], "path string, content binary")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def same(a, b, *cols):
    got, want = (sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) for df in (a, b))
    assert got == want and got


def test_attachments_without_shuffles(spark):
    large = e("Segment", e("Attachments", e("Attached", e("FileName", b"x" * 70_000), e("FileName", b"b"), e("FileData", b"")), e("Attached")))
    f = table_of(spark, damaged([*MKV, large], 3, 200))
    assert shuffles(probes.attached(f)) == 0
    same(probes.attached(f), probes.attachments(probes.matroska_elements(f, "Attachments")), "path", "ix", "name", "mime", "place", "size")


def listed(*entries, n=None):
    rows = [int(s).to_bytes(8, "big") + bytes([len(t)]) + t for s, t in entries]
    return box(b"moov", box(b"udta", box(b"chpl", bytes(8), bytes([len(rows) if n is None else n]), *rows)))


def test_chapters_without_shuffles(spark):
    f = table_of(spark, [listed((0, b"a"), (2**64 - 1, b""), (30_000, "é".encode())), listed((5, b"cut"), n=2), listed(), box(b"udta", box(b"chpl", bytes(8)) + box(b"chpl", bytes(8), b"\x01", bytes(9))), listed(*[(k * 10_000, b"t") for k in range(255)]), None])
    assert shuffles(containers.mp4_chapters(f)) == 0
    got = sorted(tuple(r) for r in containers.mp4_chapters(f).where("path <> 'p4'").select("path", "ix", "id", "start_ms", F.coalesce("end_ms", F.lit(-1)), "title").collect())
    assert got == [("p0", 0, "ch0", 0, (2**64 - 1) // 10_000, "a"), ("p0", 1, "ch1", (2**64 - 1) // 10_000, 3, ""), ("p0", 2, "ch2", 3, -1, "é")]
    assert [(r.ix, r.start_ms, r.end_ms) for r in containers.mp4_chapters(f).where("path = 'p4'").orderBy("ix").collect()] == [(k, k, k + 1 if k < 254 else None) for k in range(255)]


def test_chapters_of_damaged_files(spark):
    contents = damaged(MP4, 5, 300)
    want = []
    for k, data in enumerate(contents):
        for own, _, _, p in containers.walk_boxes(memoryview(data or b""), 0, len(data or b""), ""):
            if own.endswith("/chpl.0") and len(p) > 8:
                at, found = 9, []
                while len(found) < p[8] and at + 9 <= len(p) and at + 9 + p[at + 8] <= len(p):
                    found.append((f"p{k}", len(found), int.from_bytes(p[at : at + 8], "big") // 10_000, p[at + 9 : at + 9 + p[at + 8]].decode("utf-8", "replace")))
                    at += 9 + p[at + 8]
                want += found if len(found) == p[8] else []
    got = sorted(tuple(r) for r in containers.mp4_chapters(table_of(spark, contents)).select("path", "ix", "start_ms", "title").collect())
    assert got == sorted(want) and len(want) > 100


def test_boxes_of_files_without_shuffles(spark):
    contents = damaged(MP4, 7, 300)
    f = table_of(spark, contents)
    assert shuffles(containers.extents(f)) == 0
    same(containers.extents(f), containers.boxes(f).groupBy("path").agg(F.count("*").alias("boxes"), F.min(F.col("place") + F.col("size")).alias("first_end")), "path", "boxes", "first_end")


def test_tracks_of_files_without_shuffles(spark):
    twice = box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", b"a"), box(b"hdlr", b"b"))), box(b"trak"), box(b"trak", box(b"tkhd", b"")), box(b"hdlr", b"no track")) + box(b"moov", box(b"trak", box(b"hdlr", b"z")))
    f = table_of(spark, damaged([*MP4, twice], 9, 300))
    assert shuffles(probes.mp4_tracks(f)) == 0
    b = containers.boxes(f, *probes.SAID).withColumn("track", F.regexp_extract("box", r"^/moov\.0/trak\.(\d+)/", 1)).where("track <> ''")
    one = lambda n: F.max(F.when(F.col("box").contains(f"/{n}."), F.col("payload"))).alias(n)
    same(probes._track_boxes(f), b.groupBy("path", F.col("track").cast("bigint").alias("ix")).agg(*[one(n) for n in probes.SAID]), "path", "ix", *probes.SAID)


def laced(*sizes, kind):
    """A block of frames of some sizes, in Xiph's way or EBML's."""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:
        head += (0x4000 | sizes[0]).to_bytes(2, "big") + b"".join((0x4000 | b - a + (1 << 13) - 1).to_bytes(2, "big") for a, b in zip(sizes, sizes[1:-1]))
    return b"\x81\x00\x05" + bytes([kind << 1]) + head + b"z" * sum(sizes)


def odd_matroska():
    """Several frames a block, times behind blocks, tracks behind clusters, two segments, scales and times of their own."""
    c = containers
    el = lambda name, *parts: e(name, *parts)
    track = lambda n, ns: el("Track", el("Number", bytes([n])), el("FrameNs", ns.to_bytes(4, "big")))
    cluster = lambda *parts: ebml(c.CLUSTER, b"".join(parts))
    time, simple = lambda t: ebml(c.TIMECODE, t), lambda x: ebml(c.SIMPLE_BLOCK, x)
    many = [laced(300, 7, 255, 0, 600, kind=1), laced(300, 7, 255, 0, 600, kind=3), laced(5, 5, 5, kind=2), laced(4, 4, kind=1)]
    info = ebml(c.INFO, ebml(c.SCALE, (10_000_000).to_bytes(4, "big")))
    group = ebml(c.BLOCK_GROUP, ebml(c.BLOCK, many[1]) + ebml(c.BLOCK, many[2]) + ebml(c.REFERENCE, b"\x01"))
    plain = e("Segment", info, el("Tracks", track(1, 40_000_000), track(2, 1)), cluster(time(b"\x01\x00"), *map(simple, many), group), cluster(time(b""), simple(b"\x82\xff\xff\x80" + b"q")))
    late = e("Segment", cluster(simple(many[0]), time(b"\x07"), simple(many[1])), info, el("Tracks", track(1, 40_000_000)), cluster(time(b"\x09"), simple(many[3])))
    return [plain, late, plain + late, e("Segment", el("Tracks", track(1, 9_000_000), track(1, 5_000_000)), cluster(time(b"\x01"), simple(many[2])))]


def test_packets_of_matroska_without_shuffles(spark):
    contents = damaged([*MKV, *odd_matroska()], 11, 600)
    f = table_of(spark, contents)
    assert shuffles(containers.matroska_packets(f)) == 0
    want = containers.timed_frames(containers.matroska_frames(f)).withColumn("duration", F.col("lasts"))
    same(containers.matroska_packets(f), want, "path", "track", "ix", "source_offset", "size", "pts", "duration", "keyframe")
    plain, odd = containers._plain_frames(walks.Bytes(pa.array(contents[: len(MKV) + 4])))
    assert odd.tolist() == [len(MKV) + k for k in range(1, 4)] and len(plain[0]) > 100


def test_payloads_without_joins_and_shuffles(spark):
    f = table_of(spark, damaged([*MKV, *odd_matroska()], 13, 200))
    moved = lambda df: df.withColumn("source_offset", F.col("source_offset") + F.when(F.col("ix") % 3 == 2, 200).when(F.col("ix") % 5 == 4, -600).otherwise(0))
    got = probes.sliced(moved(containers.matroska_packets_with_content(f)))
    plan = catalog.QUERIES["packet_payloads"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert shuffles(got) == 0 and plan.count("Exchange") == 1 and "Join" not in plan and "InMemoryTableScan" not in plan
    # files without content have no packets, so that neither has an error of its own here
    same(got, probes.payloads(f, moved(containers.matroska_packets(f))), "path", "track", "ix", "source_offset", "size", "payload", "error")
    assert {r.error for r in got.select("error").distinct().collect()} == {None, "invalid range", "outside the source"}


def sampled(scale=1000, head=None, **tables):
    """A track with some sample tables; those that are not named have three samples, one a chunk."""
    rows = {"stts": ((2, 10), (1, 7)), "stsc": ((1, 1, 1),), "stco": ((100,), (200,), (300,)), "stsz": (0, 3, 5, 6, 7)} | tables
    number = lambda x: (x & 0xFFFFFFFF).to_bytes(4, "big")
    sizes = box(b"stsz", bytes(4), *map(number, rows.pop("stsz")))
    own = [box(n.encode(), bytes(4), number(len(r)), *(number(x) for row in r for x in row)) for n, r in rows.items()]
    return box(b"trak", box(b"mdia", box(b"mdhd", bytes(12) + number(scale) + bytes(8) if head is None else head), box(b"minf", box(b"stbl", *own, sizes))))


def movie(*tracks):
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", *tracks)


def odd_mp4():
    """Tables that do not agree, samples beyond their chunks, offsets below 0, sizes that are alike, runs out of order and of none, wide times, several tracks."""
    track = sampled
    wide = b"\x01" + bytes(19) + (600).to_bytes(4, "big") + bytes(12)
    return [
        movie(track()), movie(track(scale=0)), movie(track(scale=7), track(scale=90_000)), movie(track(head=wide)), movie(track(head=wide[:22])), movie(track(head=b"")),
        movie(track(ctts=((1, 30), (2, -5)))), movie(track(ctts=((1, -40), (1, 5), (1, 0)))), movie(track(ctts=((2, 3),))), movie(track(ctts=((0, 9), (3, -1)))),
        movie(track(stss=((1,), (2,)))), movie(track(stss=((2,), (1,), (2,)))), movie(track(stss=((3,), (1,)))), movie(track(stss=())),
        movie(track(stts=((0, 5), (3, 0), (0, 1)))), movie(track(stts=((2, 1),))), movie(track(stts=((4, 1),))), movie(track(stts=((1, 2**32 - 1), (2, 2**31)))),
        movie(track(stsc=((1, 2, 1), (2, 0, 1)))), movie(track(stsc=((2, 1, 1),))), movie(track(stsc=())), movie(track(stsc=((3, 1, 1), (1, 1, 1), (0, 9, 9)))), movie(track(stsc=((1, 1, 1), (1, 0, 1)))), movie(track(stsc=((1, 2**32 - 1, 1),))), movie(track(stsc=((9, 1, 1),))),
        movie(track(stsz=(4, 3))), movie(track(stsz=(4, 0), stts=((1, 6),))), movie(track(stsz=(0, 4, 1, 1, 1))), movie(track(stsz=(0, 0), stts=())), movie(track(stco=(), co64=((0, 1),))), movie(track(stco=((7,),))), movie(track(co64=((0, 1), (0, 2)))),
        movie(track(stsz=(1, 5_000), stts=((4_000, 3), (1_000, 1)), ctts=((4_500, 1), (500, 900)), stsc=((1, 2_000, 1),))),
    ]


def test_ends_of_packets_without_writing_samples_out(spark):
    contents = [*MP4, *odd_mp4()]
    contents += [c[:-k] for c in contents for k in (1, 9, 40)]
    got = []
    for k in range(0, len(contents), 7):
        b = walks.Bytes(pa.array(contents[k : k + 7]))
        file, _, found = containers.track_boxes(b, *containers.TABLES)
        got += containers.mp4_lasting(b, file, found).to_pylist()
    p = containers.mp4_packets(table_of(spark, contents)).withColumn("end", F.expr("(pts + duration) * 1000 div scale"))
    want = {r.path: r.end for r in p.groupBy("path").agg(F.max("end").alias("end")).collect()}
    assert {f"p{k}": end for k, end in enumerate(got) if end is not None} == want and len(want) > 25
    # as many samples as no memory holds
    many = movie(sampled(stts=((2**32 - 2, 10), (1, 7)), stsz=(9, 2**32 - 1), stsc=((1, 2**32 - 1, 1),)))
    b = walks.Bytes(pa.array([many]))
    file, _, found = containers.track_boxes(b, *containers.TABLES)
    assert containers.mp4_lasting(b, file, found).to_pylist() == [(2**32 - 2) * 10 + 7]


def odd_probes():
    """Two segments, lists of tracks and chapters, displays in displays, values in places of their own, numbers of many bytes, text that is none."""
    start = lambda ms: e("Start", (ms * 1_000_000).to_bytes(8, "big"))
    track = lambda *parts: e("Track", *parts)
    tracks = e("Tracks", track(), track(e("Kind", bytes(9) + b"\x02"), e("Codec", b" a_aac "), e("Codec", b"A_DTS")), track(e("Video", e("Kind", b"\x11"), e("Width", b"\x01")), e("Kind", b"\x01"), e("Default", b""), e("Language", b"x\xffy")), track(e("Kind", b"\xff" * 8), e("Codec", b"x" * 70_000)))
    deep = e("Atom", start(4), e("Atom", start(2), e("Atom", e("Text", b"none"))), e("Display", e("Uid", b"\x07"), e("Display", e("Text", b"too deep"))), e("Uid", b"\x08"), e("Text", b"\xfe"), e("Display", e("Text", b"late")))
    chapters = e("Chapters", e("Edition", deep, e("Atom", start(0), e("End", b"\xff" * 8), e("Uid", b""))), e("Edition", e("Atom", e("Start", b"")), e("Atom", start(9), e("End", b"\x0f\x42\x40"))))
    head = ebml(0x1A45DFA3, b"")
    return [head + e("Segment", tracks, chapters, e("Tracks", track(e("Kind", b"\x02"))), chapters) + e("Segment", tracks), head + tracks + chapters, head + e("Segment", e("Edition", deep), e("Attachments", deep, e("Attached", e("FileName", b"\xff"), e("FileData", b"abc"))))]


def test_probes_out_of_one_walk(spark):
    contents = [*damaged([*MKV, *odd_probes(), *odd_matroska()], 17, 200), *MP4, *odd_mp4(), *(c[:-k] for c in MP4 for k in (1, 9, 40)), b"none"]
    f = table_of(spark, [ebml(0x1A45DFA3, b"") + c if c and c[:4] == b"\x18\x53\x80\x67" else c for c in contents])
    got, want = probes.probed_at_once(f), probes.probed(f)
    assert got.dtypes == want.dtypes and shuffles(got) == 0
    same(got, want, *want.columns)
    plan = catalog.QUERIES["media_probes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InMemoryTableScan" not in plan and plan.count("MapInArrow") == 2 and plan.count("Exchange") == 1


def test_probes_of_numbers_that_are_too_large(spark):
    atom = e("Atom", e("Uid", b"\x01" + bytes(8)), e("Start", b"\x00"), e("End", b"\x01" + bytes(9)))
    file = ebml(0x1A45DFA3, b"") + e("Segment", e("Tracks", e("Track", e("Kind", b"\x01" + bytes(8)))), e("Chapters", e("Edition", atom, e("Atom", e("Start", b"\x01" + bytes(8))), e("Atom", e("Start", b"\x7f" + b"\xff" * 7)))))
    r = probes.probed_at_once(table_of(spark, [file])).collect()[0]
    assert [(c.ix, c.id, c.start_ms, c.end_ms) for c in r.chapters] == [(0, "ch0", 0, None), (1, "ch1", (2**63 - 1) // 1_000_000, None)] and [t.kind for t in r.tracks] == ["unknown"]
