"""Rules of the media operators on small tables, against plain loops written from the rules."""

import random

import pytest

from cutlist.functions import timing
from cutlist.operators import chunks, markers, packets, selection
from cutlist.sources import adapters

PACKETS = "track long, ix long, pts long, duration long, size long, keyframe boolean"


def made(spark, rows, schema=PACKETS):
    return spark.createDataFrame(rows, schema)


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def loop_plan(rows, target):
    out, first, start, end, key, n = [], 0, None, 0, False, 0
    for track, ix, pts, duration, _, keyframe in rows:
        if start is None:
            start, key = pts, keyframe
        elif keyframe and max(pts - start, 0) >= target:
            out.append((track, n, start, max(end - start, 0), first, ix, key))
            first, start, key, n = ix, pts, keyframe, n + 1
        end = pts + duration
    return out + [(track, n, start, max(end - start, 0), first, ix + 1, key)]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_follow_the_loop_on_disordered_packets(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for track in range(12):
        own = [(track, i, max(0, i * 40 + rng.randint(-90, 90)), rng.randint(0, 60), rng.randint(1, 999), rng.random() < 0.2) for i in range(rng.randint(1, 60))]
        rows += own
        want += loop_plan(own, 200)
    plan = chunks.plan_chunks(made(spark, rows), 200)
    assert got(plan, "track", "chunk") == want
    tiles = got(plan.select("track", "packet_start", "packet_end"), "track", "packet_start")
    assert all(a[2] == b[1] for a, b in zip(tiles, tiles[1:]) if a[0] == b[0])


def test_a_target_of_nothing_plans_nothing_and_empty_tables_give_none(spark):
    assert chunks.plan_chunks(made(spark, [(1, 0, 0, 40, 5, True)]), 0).count() == 0
    assert chunks.plan_chunks(made(spark, []), 100).count() == 0
    assert chunks.hls_plan(made(spark, []), 100, 100).count() == 0


def test_short_windows_merge_and_the_first_merges_forward(spark):
    w = made(spark, [(1, 0, 0, 500), (1, 1, 500, 2500), (1, 2, 2500, 2900), (1, 3, 2900, 5000), (2, 0, 0, 10)], "track long, n long, start_ms long, end_ms long")
    assert got(chunks.collapse(w), "track", "n") == [(1, 0, 0, 2900), (1, 1, 2900, 5000), (2, 0, 0, 10)]


def test_seek_stops_at_the_first_later_packet(spark):
    rows = [(1, 0, 0, 40, 1, True), (1, 1, 120, 40, 1, False), (1, 2, 40, 40, 1, True), (1, 3, 80, 40, 1, False)]
    r = spark.createDataFrame([(1, 0, 100), (1, 1, 500)], "track long, request long, target_ms long")
    assert got(chunks.seek_anchors(made(spark, rows), r), "request") == [(1, 0, 100, 0, 0, 100, True), (1, 1, 500, 40, 2, 460, True)]


def test_read_spans_join_small_gaps_only(spark):
    p = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 100), (1, 2, 250, 100), (1, 3, 10_000, 10), (1, 4, 500, 5)], "track long, ix long, source_offset long, size long")
    assert got(chunks.read_spans(p), "span_ix") == [(1, 0, 0, 350, 3, 300), (1, 1, 10_000, 10, 1, 10), (1, 2, 500, 5, 1, 5)]


def test_rescaling_rounds_as_named(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7, 2, 1), (-7, 2, 1), (5, 0, 1), (2**62, 90_000, 1000)], "n long, s long, t long")
    out = df.select(*[timing.rescale(F.col("n"), F.col("s"), F.col("t"), r) for r in timing.ROUNDINGS])
    assert [tuple(r) for r in out.collect()][:3] == [(3, 3, 4, 4), (-3, -4, -3, -4), (None,) * 4]
    assert out.collect()[3][0] == 2**62 * 1000 // 90_000


def test_upper_median_and_nothing_for_single_packets(spark):
    rows = [(1, i, p, 0, 1, True) for i, p in enumerate((0, 1, 3, 6, 10))] + [(2, 0, 0, 0, 1, True)]
    assert got(packets.nominal_duration(made(spark, rows)), "track") == [(1, 3)]


def test_islands_break_at_gaps_and_negatives(spark):
    times = [0, 8000, 16_000, 24_000, 30_000, 60_000, 68_000, 76_000, 84_000]
    yes = [True] * 4 + [False] + [True] * 4
    s = spark.createDataFrame([(1, i, t, y) for i, (t, y) in enumerate(zip(times, yes))], "source long, ix long, time_ms long, text_like boolean")
    assert got(markers.islands(s), "first_ix") == [(1, 0, 3, 0, 24_000, 4), (1, 5, 8, 60_000, 84_000, 4)]


def test_planted_series_is_found_and_noise_is_not(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(32) for _ in range(900)]
    peer = [rng.getrandbits(32) for _ in range(900)]
    peer[225:725] = base[150:650]
    schema = "source long, ix long, t_ms long, bits long, voiced boolean"
    a = spark.createDataFrame([(1, i, i * 124, b, True) for i, b in enumerate(base)], schema)
    b = spark.createDataFrame([(2, i, i * 124, x, True) for i, x in enumerate(peer)] + [(3, i, i * 124, rng.getrandbits(32), True) for i in range(900)] + [(4, i, i * 124, 7, True) for i in range(900)], schema)
    found = got(markers.align(a, b), "peer")
    assert [(r[0], r[1]) for r in found] == [(1, 2)]
    assert abs(found[0][2] - 150 * 124) <= 600 and abs(found[0][3] - 649 * 124) <= 600 and found[0][4] > 0.95


def test_refined_boundaries(spark):
    s = spark.createDataFrame([(1, i, t, y) for i, (t, y) in enumerate([(0, False), (8000, True), (16_000, True), (24_000, True), (32_000, True), (40_000, False)])], "source long, ix long, time_ms long, text_like boolean")
    runs = markers.islands(s)
    probes = spark.createDataFrame([(1, t, 5000 <= t <= 36_000) for t in range(0, 41_000, 1000)], "source long, time_ms long, text_like boolean")
    dur = spark.createDataFrame([(1, 60_000)], "source long, duration_ms long")
    assert [(r.start_ms, r.end_ms) for r in markers.refined(runs, s, probes, dur).collect()] == [(5000, 36_000)]


def test_plans_of_a_small_source(spark):
    t = spark.createDataFrame([(1, 0, "video", "hevc", True, None), (1, 1, "audio", "truehd", True, "en"), (1, 2, "audio", "ac3", False, "en"), (1, 3, "subtitle", "subrip", False, "en"), (1, 4, "subtitle", "hdmv_pgs_subtitle", False, "en")], "source long, ix long, kind string, codec string, is_default boolean, language string")
    plan = {(r.target, r.stage): r.track_ids for r in selection.playback_plan(t).collect()}
    assert plan["browser", "demux"] == "v0,a0,s0" and plan["browser", "packet-copy"] == "s0" and plan["browser", "encode"] == "v0,a0" and plan["browser", "subtitle-text"] == "s0"
    assert plan["apple", "packet-copy"] == "v0,a1,s0" and ("apple", "decode") not in plan
    assert plan["native", "demux"] == "v0,a0,s0,s1"


def test_plans_gather_tracks_once_and_stages_of_tracks_nowhere(spark):
    from cutlist.operators import selection

    t = spark.createDataFrame([(1, 0, "video", "h264", True, None), (1, 1, "audio", "flac", True, "en"), (1, 2, "subtitle", "subrip", False, "en")], "source long, ix long, kind string, codec string, is_default boolean, language string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    staged = selection.staged(t)
    assert "collect_list" not in plan(selection.output_stages(staged))
    gathered = plan(selection.playback_plan(t))
    assert gathered.count("Generate") == 2 and gathered.index("Aggregate") > gathered.index("Generate")
    by = lambda df: sorted(tuple(r) for r in df.select("source", "target", "id", "stage").collect())
    assert by(selection.output_stages(staged)) == by(selection.output_stages(selection.playback_plan(t)))


def test_selection_sorts_tracks_once_before_targets(spark):
    """Memory of a task goes by its tracks, not by what each target takes of them."""
    r = random.Random(5)
    codecs_of = {"video": ("h264", "vp9", None), "audio": ("aac", "truehd", "opus", "flac", "?"), "subtitle": ("subrip", "hdmv_pgs_subtitle"), "data": ("x",)}
    rows = [(s, ix, k := r.choice(list(codecs_of)), r.choice(codecs_of[k]), r.random() < 0.4, None) for s in range(80) for ix in range(r.randrange(1, 9))]
    t = made(spark, [*rows, (None, 0, "video", "h264", True, None)], "source long, ix long, kind string, codec string, is_default boolean, language string")
    audio = {(x.source, x.target): x.ix for x in selection.primary_audio(t).collect()}
    first = {s: min((ix for q, ix, k, *_ in rows if q == s and k == "video"), default=None) for s in range(80)}
    for subtitles in (True, False):
        want = []
        for s in range(80):
            for target in selection.TARGETS:
                own = [(0, first[s])] if first[s] is not None else []
                own += [(1, audio[s, target])] if (s, target) in audio else []
                own += sorted((2, ix) for q, ix, k, c, *_ in rows if q == s and k == "subtitle" and subtitles and (target == "native" or c == "subrip"))
                want += [(s, target, place, ix) for place, (_, ix) in enumerate(own)]
        found = selection.selected(t, subtitles).select("source", "target", "place", "ix")
        assert sorted(tuple(x) for x in found.where("source IS NOT NULL").collect()) == sorted(want)
        assert sorted(x.target for x in found.where("source IS NULL").collect()) == sorted(selection.TARGETS)
    plan = selection.selected(adapters.tracks(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort [" not in plan[: plan.index("Generate explode")] and plan.count("Sort [") == 2
