"""Subtitle formats, pictures and publishing on small inputs."""

import random

import numpy as np
import pytest

from cutlist.operators import cues, formats, frames, sessions


def files(spark, *texts):
    return spark.createDataFrame([(i, t, None if i else 25.0) for i, t in enumerate(texts)], "track long, text string, fps double")


def rows(df):
    return [tuple(r) for r in df.orderBy("track", "ix").collect()]


def test_subrip_blocks(spark):
    text = "1\r\n00:00:01,5 --> 00:00:02,250 X1:3\r\nHello\r\n\r\n00:00:03.000 --> 00:00:04.000\nNo <i>index</i>\n\n3\n00:00:09,000 --> 00:00:08,000\nbackwards\n\n4\n00:61:00,000 --> 00:62:00,000\nbad\n\n5\n00:00:05,000 --> 00:00:06,000\n \n"
    assert rows(cues.parse_subrip(files(spark, text, "", "junk"))) == [(0, 0, 1500, 2250, "Hello"), (0, 1, 3000, 4000, "No <i>index</i>")]


def test_microdvd(spark):
    got = rows(formats.microdvd(files(spark, "{25}{50}{y:ib}one|two & <3>\n\n{50}{50}none\n{75}{100}last", "{1}{1}10\n{10}{20}ten", "{10}{20}no rate", "{0}{5}a\nnot a line")))
    assert got == [(0, 0, 1000, 2000, "<b><i>one\ntwo &amp; &lt;3&gt;</i></b>"), (0, 1, 3000, 4000, "last"), (1, 0, 1000, 2000, "ten")]


def test_subviewer(spark):
    got = rows(formats.subviewer(files(spark, "[INFORMATION]\n\n00:00:01.00,00:00:02.50\nA[br]B\nC\n\nnoise, here\n\n00:00:03.00,00:00:04.00\nD")))
    assert got == [(0, 0, 1000, 2500, "A\nB\nC"), (0, 1, 3000, 4000, "D")]


def test_ttml_times_lie_within_their_parents(spark):
    doc = '<tt xmlns="http://www.w3.org/ns/ttml"><head><p>no</p></head><body begin="10s"><div end="20s"><p begin="1s" end="3s">a<br/>b</p><p begin="00:00:15.500" dur="9s">late <span>x</span></p><p begin="25s" end="30s">out</p></div></body></tt>'
    assert rows(formats.ttml(files(spark, doc, "<broken"))) == [(0, 0, 11_000, 13_000, "a\nb"), (0, 1, 25_500, 30_000, "late x")]


def test_payloads_and_dialogues(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("mov_text", b"\x00\x03abcxx"), ("mov_text", b"\x00\x09abc"), ("ass", b"1,0,Default,,0,0,0,,{\\i1}Hi\\Nyou"), ("ass", b"Dialogue: 0,0:00:01.00,0:00:02.00,D,,0,0,0,,Yes, no"), ("subrip", b" <b>x</b> "), ("subrip", b"{only}"), ("other", b"x")], "c string, p binary")
    assert [r[0] for r in df.select(formats.payload_text(F.col("c"), F.col("p"))).collect()] == ["abc", None, "Hi\nyou", "Yes, no", "x", None, None]
    df = spark.createDataFrame([("7,2,Default,N,1,2,3,fx,Text, more",), ("x,2,D,N,1,2,3,fx,T",), ("1,2",)], "e string")
    assert [r[0] for r in df.select(formats.ass_dialogue(F.col("e"), F.lit(1234), F.lit(0))).collect()] == ["Dialogue: 2,0:00:01.23,0:00:01.24,Default,N,1,2,3,fx,Text, more\n", None, None]
    df = spark.createDataFrame([("",), ("align:start line:5%",), ("line:50% align:right",), ("line:90%",)], "s string")
    assert [r[0] for r in df.select(formats.ass_alignment(F.col("s"))).collect()] == [2, 7, 6, 2]


def test_glyph_boxes_equal_a_flood_fill():
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((rng.integers(1, 24), rng.integers(1, 30))) < rng.random()
        seen, want = np.zeros_like(mask), []
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x]:
                continue
            todo, part = [(y, x)], []
            seen[y, x] = True
            while todo:
                i, j = todo.pop()
                part.append((i, j))
                for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                    if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                        seen[a, b] = True
                        todo.append((a, b))
            ys, xs = zip(*part)
            want.append((min(xs), max(xs), min(ys), max(ys), len(part)))
        assert sorted(map(tuple, frames.glyph_boxes(mask).tolist())) == sorted(want)


def test_text_rows_and_noise(spark):
    page = np.full((180, 320), 10, np.uint8)
    for line in range(8):
        for k in range(20):
            page[10 + line * 20 : 18 + line * 20, 10 + k * 14] = 200
            page[17 + line * 20, 10 + k * 14 : 15 + k * 14] = 200
    noise = np.where(np.random.default_rng(1).random((180, 320)) < 0.02, 200, 10).astype(np.uint8)
    df = spark.createDataFrame([(1, 0, 320, 180, page.tobytes(), 0.0), (1, 1, 320, 180, noise.tobytes(), 0.0), (1, 2, 320, 180, page.tobytes(), 0.5), (1, 3, 8, 8, bytes(64), 0.0), (1, 4, 320, 180, bytes(7), 0.0)], "source long, time_ms long, width long, height long, luma binary, color_fraction double")
    assert [(r.time_ms, r.text_like) for r in frames.observed(df).orderBy("time_ms").collect()] == [(0, True), (1, False), (2, False)]


def test_reduction(spark):
    raw = bytes([0, 0, 255, 0] * 4 + [255, 255, 255, 0] * 4)
    df = spark.createDataFrame([(1, 0, 4, 2, raw), (1, 1, 4, 2, raw[:-1])], "source long, time_ms long, width long, height long, bgra binary")
    (got,) = frames.reduced(df).collect()
    assert (got.width, got.height, list(got.luma), got.color_fraction) == (4, 2, [53] * 4 + [255] * 4, 0.0)


def test_publishing_never_replaces(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "out")
    assert sessions.published(df, path) == "written" and sessions.published(df.repartition(3), path) == "same"
    for other in (df.limit(2), df.withColumn("w", df.k), df.union(df.limit(1))):
        with pytest.raises(FileExistsError):
            sessions.published(other, path)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_segments_repeat_cues_in_every_window(spark, seed):
    rng = random.Random(seed)
    made, t = [], 0
    for i in range(30):
        s = t + rng.randint(0, 999)
        t = s + rng.randint(0, 3999)
        made.append((1, i, s, t, f"cue {i}"))
    df = spark.createDataFrame(made, "track long, ix long, start_ms long, end_ms long, text string")
    got = cues.segment_webvtt(df, 700).orderBy("segment").collect()
    assert [r.segment for r in got] == list(range(-(-t // 700))) and sum(r.duration_ms for r in got) == t
    for r in got:
        want = [f"cue {i}" for _, i, s, e, _ in made if e > s and s < r.start_ms + 700 and e > r.start_ms]
        assert [x for x in r.body.split("\n") if x.startswith("cue")] == want


def test_budgets_are_checked_in_order(spark):
    df = spark.createDataFrame([(1, 0, 0, 3, "x"), (2, 0, 0, 200_000, "x"), (3, 0, 0, 90_000, "y" * 400)], "track long, ix long, start_ms long, end_ms long, text string")
    assert [(r.track, r.rejected) for r in cues.segment_counts(df, 1).orderBy("track").collect()] == [(1, None), (2, "subtitle segments"), (3, "subtitle output bytes")]
    assert [(r.segment, r.body.count("-->")) for r in cues.segment_webvtt(df, 1).orderBy("segment").collect()] == [(0, 1), (1, 1), (2, 1)]


def test_sami_classes(spark):
    doc = '<SAMI><HEAD><STYLE><!-- .ENCC {lang: en} --></STYLE></HEAD><BODY><SYNC Start=1000><P Class=ENCC>Hello<br>there <font color="red">now</font><P Class="JPCC"><i>Oi</i><SYNC Start=2500><P Class=ENCC>&nbsp;<SYNC Start="4000"><P>plain</BODY></SAMI>'
    df = spark.createDataFrame([(1, doc, 5000), (2, doc.replace("4000", "2000"), 5000), (3, "no", None), (4, doc, None)], "track long, text string, duration_ms long")
    got = [tuple(r) for r in formats.sami(df).orderBy("track", "class", "ix").collect()]
    first = [(1, "ENCC", 0, 1000, 2500, "Hello\nthere now"), (1, "JPCC", 0, 1000, 2500, "<i>Oi</i>")]
    assert got == [*first, (1, "default", 0, 4000, 5000, "plain"), *[(4, *r[1:]) for r in first]]
