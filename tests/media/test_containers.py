"""Containers built byte by byte, read back as packets; streams against batches."""

import struct

import pytest

from cutlist.functions import binary
from cutlist.operators import chunks, packets
from cutlist.sources import containers
from cutlist.streaming import planner


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, name) + body


def table(name, *numbers, head=0):
    return box(name, struct.pack(f">{len(numbers) + 1}I", head, *numbers))


def mp4(extra=()):
    stbl = box(b"stbl", table(b"stts", 2, 3, 1000, 2, 500), table(b"ctts", 2, 1, 1000, 4, 0), table(b"stss", 2, 1, 4), table(b"stsc", 2, 1, 2, 1, 2, 3, 1), table(b"stsz", 0, 5, 10, 20, 30, 40, 50), table(b"stco", 2, 100, 500), *extra)
    mdia = box(b"mdia", table(b"mdhd", 0, 0, 1000, 4000, 0), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", stbl))
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", box(b"trak", mdia))


def files(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "path string, content binary")


def test_sniffing(spark):
    f = files(spark, a=mp4(), b=b"\x1a\x45\xdf\xa3rest", c=b"", d=box(b"ftyp", b"qt  ", bytes(4)))
    assert {r.path: r.container for r in containers.sniffed(f).collect()} == {"a": "mp4", "b": "matroska", "c": "unknown", "d": "mov"}


def test_mp4_packets(spark):
    rows = containers.mp4_packets(files(spark, a=mp4(), broken=mp4()[:-9], empty=b"")).orderBy("path", "ix").collect()
    assert [(r.path, r.ix, r.source_offset, r.size, r.pts, r.dts, r.duration, r.keyframe) for r in rows] == [
        ("a", 0, 100, 10, 1000, 0, 1000, True), ("a", 1, 110, 20, 1000, 1000, 1000, False), ("a", 2, 500, 30, 2000, 2000, 1000, False), ("a", 3, 530, 40, 3000, 3000, 500, True), ("a", 4, 570, 50, 3500, 3500, 500, False)]
    assert {r.scale for r in rows} == {1000}


def ebml(number, body):
    n = number.to_bytes((number.bit_length() + 7) // 8, "big")
    return n + struct.pack(">Q", len(body) | 1 << 56) + body


def block(track, ticks, flags, payload):
    return bytes([0x80 | track]) + struct.pack(">hB", ticks, flags) + payload


def matroska():
    c = containers
    tracks = ebml(c.TRACKS, ebml(c.TRACK, ebml(c.NUMBER, b"\x01") + ebml(c.KIND, b"\x01") + ebml(c.CODEC, b"V_TEST") + ebml(c.FRAME_NS, (40_000_000).to_bytes(4, "big"))))
    one = ebml(c.CLUSTER, ebml(c.TIMECODE, b"\x00") + ebml(c.SIMPLE_BLOCK, block(1, 0, 0x80, b"abcd")) + ebml(c.SIMPLE_BLOCK, block(1, 40, 0x02, b"\x02\x02\x01" + b"aabbbb")))
    two = ebml(c.CLUSTER, ebml(c.TIMECODE, b"\x03\xe8") + ebml(c.BLOCK_GROUP, ebml(c.BLOCK, block(1, 0, 0x04, b"\x01" + b"xxyy"))) + ebml(c.SIMPLE_BLOCK, block(1, 80, 0x06, b"\x02\x82\xc0" + b"aabbbcc")))
    return ebml(0x1A45DFA3, b"") + ebml(c.SEGMENT, tracks + one + two)


def test_matroska_packets_with_all_lacings(spark):
    rows = containers.matroska_packets(files(spark, m=matroska(), junk=b"\x00\x01")).orderBy("ix").collect()
    assert [(r.pts, r.size, r.keyframe) for r in rows] == [(0, 4, True), (40, 2, False), (80, 1, False), (120, 3, False), (1000, 2, True), (1040, 2, True), (1080, 2, False), (1120, 3, False), (1160, 2, False)]
    assert rows[0].duration == 40 and rows[-1].duration == 40 and rows[3].duration == 880


def test_fragments(spark):
    def trun(rows, flags=0x01000F01):
        return box(b"trun", struct.pack(">III", flags, len(rows), 8), *[struct.pack(">IIIi", *r) for r in rows])

    good = box(b"moof", box(b"traf", box(b"tfdt", struct.pack(">IQ", 0x01000000, 900)), trun([(10, 5, 0, -1), (10, 6, 0, 1)])))
    bad = box(b"moof", box(b"traf", box(b"tfdt", struct.pack(">II", 0, 7)), trun([(10, 5, 0, 0)], flags=0x00000F01)))
    rows = containers.fragments(files(spark, a=good + bad)).orderBy("fragment").collect()
    assert [(r.decode_time, r.samples, r.duration, r.bytes, r.problem) for r in rows] == [(900, 2, 20, 11, None), (7, None, None, None, "run")]


def test_chapters(spark):
    body = bytes(8) + bytes([2]) + struct.pack(">QB", 0, 3) + b"one" + struct.pack(">QB", 50_000_000, 3) + b"two"
    f = files(spark, a=box(b"moov", box(b"udta", box(b"chpl", body))), cut=box(b"moov", box(b"udta", box(b"chpl", body[:-1]))))
    assert [tuple(r) for r in containers.mp4_chapters(f).orderBy("ix").collect()] == [("a", 0, "ch0", 0, 5000, "one"), ("a", 1, "ch1", 5000, None, "two")]


def test_nal_units_and_adts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytes.fromhex("00000002674200000001650000"),), (bytes.fromhex("0000000267420000000165"),), (b"",)], "d binary")
    got = [r[0] for r in df.select(binary.nal_units(F.col("d"))).collect()]
    assert got[0] is None and [(u.offset, u.length, u.type) for u in got[1]] == [(4, 2, 7), (10, 1, 5)] and got[2] == []
    df = spark.createDataFrame([(bytes(100), 2, 4, 2), (bytes(9000), 2, 4, 2)], "f binary, o int, r int, c int")
    assert [r[0] for r in df.select(binary.adts_header(F.col("f"), F.col("o"), F.col("r"), F.col("c"))).collect()] == ["FFF150800D7FFC", None]


@pytest.mark.parametrize("batches", [1, 3])
def test_streams_equal_batches(spark, tmp_path, batches):
    rows = [(t, i, i * 40 + (t * i) % 7, 40, 1, i % 9 == 0, i == 49) for t in range(3) for i in range(50)]
    schema = "track long, ix long, pts long, duration long, size long, keyframe boolean, last boolean"
    for k in range(batches):
        spark.createDataFrame([r for r in rows if r[1] * batches // 50 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    outs = {"chunks": planner.stream_chunks(source, 200), "timed": planner.stream_durations(source)}
    for name, df in outs.items():
        q = df.writeStream.format("memory").queryName(f"{name}{batches}").option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    batch = spark.createDataFrame(rows, schema)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    cols = ("track", "chunk", "start_ms", "duration_ms", "packet_start", "packet_end", "key_aligned")
    assert key(spark.table(f"chunks{batches}"), *cols) == key(chunks.plan_chunks(batch, 200), *cols)
    assert key(spark.table(f"timed{batches}"), "track", "ix", "pts", "duration") == key(packets.lookahead_durations(batch), "track", "ix", "pts", "duration")


def test_small_files_share_batches():
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("n", pa.int64())])
    got = list(containers.together(((100, [(f"p{i}", i)] if i % 2 else []) for i in range(1000)), schema))
    assert [b.num_rows for b in got] == [500]
    large = list(containers.together(iter([(1, [("a", k) for k in range(50)]), (9, [("b", 0)])]), schema, most_rows=20, most_bytes=5))
    assert [b.num_rows for b in large] == [20, 20, 11]


def test_files_of_made_items_stream(spark):
    """Neither lists of items nor a second shuffle stand behind a made file."""
    from cutlist.sources import made

    plan = made.matroska_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan


def test_seek_points_walk_files_once(spark):
    from cutlist.sources import probes

    files = spark.createDataFrame([("a", b"")], "path string, content binary")
    plan = probes.seek_points(probes.matroska_elements(files, "Cues"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


def test_files_of_a_batch_are_made_at_once():
    """Not order by order; an order that lies in two batches is one file."""
    import pyarrow as pa

    from cutlist.sources import made

    n = 4000
    t = pa.table({"o": [k // 4 for k in range(n)], "size": [k % 50 + 1 for k in range(n)], "step": [k % 40 + 1 for k in range(n)], "shift": [k % 3 for k in range(n)], "note": [f"A F {k % 1000}" for k in range(n)]})
    calls = []

    def counted(i):
        calls.append(len(i.o))
        return made._matroska(i)

    files = lambda rows, make: [x for b in made._batches(iter(t.to_batches(max_chunksize=rows)), make) for x in zip(*(c.to_pylist() for c in b.columns))]
    cut = files(999, counted)
    assert sum(calls) == len(cut) == 1000 and len(calls) <= 6 and [p for p, _ in cut] == [f"o{k}" for k in range(1000)]
    assert cut == files(10_000, made._matroska) == files(1, made._matroska)
    frames = list(containers.file_frames("o1", memoryview(cut[1][1]), 17))
    assert [cut[1][1][f[-2] : f[-2] + f[-1]] for f in frames] == [b"A F 4", b"A F 5", b"A F 6", b"A F 7"]


def test_text_cues_walk_matroska_once(spark):
    """Texts come out of the walk of their file; its content meets no packets."""
    from cutlist.sources import probes

    plan = probes.text_frames(files(spark, a=b""))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_mp4_packets_walk_files_once(spark):
    plan = containers.mp4_packets(files(spark, a=b""))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_samples_beyond_the_chunks_are_left_out(spark):
    """A first run that begins late leaves chunks empty, an empty run too; of five samples three have places."""
    cut = mp4().replace(struct.pack(">8I", 2, 1, 2, 1, 2, 3, 1, 0)[:28], struct.pack(">7I", 2, 2, 3, 1, 9, 1, 1))
    assert cut != mp4()
    got = [(r.ix, r.source_offset) for r in containers.mp4_packets(files(spark, a=cut)).orderBy("ix").collect()]
    assert got == [(0, 500), (1, 510), (2, 530)]
