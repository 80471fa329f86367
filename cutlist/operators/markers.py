"""Repeated passages and credits: matching of fingerprint series, agreement of peers, runs of evidence, choice of markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timing import minus
from .asof import latest, overlapping
from .fold import ordered_fold

#: Fixed values of the rules, in milliseconds and shares.
MIN_MATCH, MAX_MATCH, MAX_SCORE = 15_000, 300_000, 3.2
MIN_OVERLAP, MIN_QUALITY, MIN_CONFIDENCE = 0.8, 0.9, 0.9
MIN_ROLL, MIN_ROLL_SAMPLES, ROLL_GAP, REFINED_CONFIDENCE = 20_000, 4, 10_000, 0.93
MOST_FRAMES, MIN_DISTINCT, MOST_MARKERS, MOST_CANDIDATES = 8_000, 32, 128, 8


def eligible(prints: DataFrame) -> DataFrame:
    """(source): series of at most 8,000 frames with at least 32 different voiced hashes."""
    return prints.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("voiced"), F.col("bits"))).alias("d")).where((F.col("n") <= MOST_FRAMES) & (F.col("d") >= MIN_DISTINCT)).select("source")


def align(left: DataFrame, right: DataFrame, bits: int = 12, top: int | None = None, smooth: int = 4, often: float | None = None) -> DataFrame:
    """(source, peer, start_ms, end_ms, quality): stretches of a series that a peer repeats.

    Frames that agree in their upper `bits` bits vote for the offset between them; for every offset of a pair
    with two votes, frames are compared along the diagonal, and runs whose mean difference over
    a few frames stays small are matches. Of 32 bits, a match differs in 3.2 on average at most, and
    lasts 15 to 300 seconds. `top` looks at the offsets with most votes only, and `often` leaves hashes of more
    than that share of a series without votes; both save work and may lose matches, so neither is set by default.
    """
    a = left.join(eligible(left), "source")
    b = right.join(eligible(right), "source").select(F.col("source").alias("peer"), F.col("ix").alias("jx"), F.col("bits").alias("other"))
    key = lambda c: F.shiftright(c, 32 - bits)

    def voting(df: DataFrame, series: str) -> DataFrame:
        if often is None:
            return df
        share = F.count("*").over(W.partitionBy(series, "key")) / F.count("*").over(W.partitionBy(series))
        return df.withColumn("share", share).where(F.col("share") <= often)

    va, vb = voting(a.withColumn("key", key("bits")), "source").select("source", "ix", "key"), voting(b.withColumn("key", key("other")), "peer").select("peer", "jx", "key")
    best = va.join(vb, "key").where("source <> peer").groupBy("source", "peer", (F.col("jx") - F.col("ix")).alias("shift")).agg(F.count("*").alias("n")).where("n > 1")
    if top is not None:
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("source", "peer").orderBy(F.desc("n"), "shift"))).where(F.col("rank") <= top).drop("rank")
    pairs = a.join(best, "source").withColumn("jx", F.col("ix") + F.col("shift")).join(b, ["peer", "jx"])
    diag = W.partitionBy("source", "peer", "shift").orderBy("ix")
    near = pairs.withColumn("d", F.bit_count(F.col("bits").bitwiseXOR(F.col("other")))).withColumn("mean", F.avg("d").over(diag.rowsBetween(-smooth, smooth)))
    runs = near.where(F.col("mean") <= 2 * MAX_SCORE).withColumn("run", F.col("ix") - F.row_number().over(diag))
    found = runs.groupBy("source", "peer", "shift", "run").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.avg("d").alias("score"))
    long = (F.col("end_ms") - F.col("start_ms")).between(MIN_MATCH, MAX_MATCH)
    return found.where(long & (F.col("score") <= MAX_SCORE)).select("source", "peer", "start_ms", "end_ms", (1 - F.col("score") / 32).alias("quality"))


def consensus(first: DataFrame, second: DataFrame) -> DataFrame:
    """(source, start_ms, end_ms, quality): what two lists of matches of a source agree on.

    Each pair that overlaps by 15 s and four fifths of the longer one gives the overlap with the lower
    quality, if that is 0.9 or more; for equal overlaps the last pair counts. Matches carry `ix`, their
    place in the list.
    """
    a = first.select("source", F.col("ix").alias("i"), F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"), F.col("quality").alias("q1"))
    b = second.select("source", F.col("ix").alias("j"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"), F.col("quality").alias("q2"))
    start, end = F.greatest("s1", "s2"), F.least("e1", "e2")
    pairs = a.join(b, (a["source"] == b["source"]) & (b["s2"] < a["e1"]) & (b["e2"] > a["s1"])).drop(b["source"]).withColumns({"start_ms": start, "end_ms": end, "quality": F.least("q1", "q2")})
    share = (F.col("end_ms") - F.col("start_ms")) / F.greatest(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2"))
    good = (F.col("end_ms") - F.col("start_ms") >= MIN_MATCH) & (share >= MIN_OVERLAP) & (F.col("quality") >= MIN_QUALITY)
    return pairs.where(good).groupBy("source", "start_ms", "end_ms").agg(F.max_by("quality", F.struct("i", "j")).alias("quality"))


def best_match(matches: DataFrame) -> DataFrame:
    """The longest match of each source, then the best, then the earliest."""
    by = W.partitionBy("source").orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), F.desc("quality"), "start_ms", "end_ms")
    return matches.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def terminal(start: Column, end: Column, source_end: Column) -> Column:
    """Whether a stretch lies where credits do: it starts in the last 240 s and ends in the last 90 s."""
    return (start >= minus(source_end, F.lit(240_000))) & (end >= minus(source_end, F.lit(90_000))) & (end <= source_end)


def search_window(duration: Column) -> Column:
    """Tail in which credits are looked for: 35 hundredths, at most 15 minutes."""
    return F.least(((duration * 35 - (duration * 35) % 100) / 100).cast("bigint"), F.lit(900_000))


def evidence_windows(durations: DataFrame) -> DataFrame:
    """(source, window, start_ms, end_ms): the head, a quarter and at most 600 s, and the last 300 s behind it."""
    quarter = F.least(F.lit(600_000), ((F.col("duration_ms") - F.col("duration_ms") % 4) / 4).cast("bigint"))
    d = durations.withColumn("head", quarter).withColumn("tail", F.greatest(minus(F.col("duration_ms"), F.lit(300_000)), F.col("head")))
    each = F.array(F.struct(F.lit(0).alias("window"), F.lit(0).cast("bigint").alias("start_ms"), F.col("head").alias("end_ms")), F.struct(F.lit(1).alias("window"), F.col("tail").alias("start_ms"), F.col("duration_ms").alias("end_ms")))
    return d.select("source", F.explode(each).alias("w")).select("source", "w.*").where("start_ms < end_ms")


def in_windows(packets: DataFrame, windows: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Packets of each window that they overlap."""
    p = packets.withColumnRenamed("track", "source").withColumn("until", F.col("pts") + F.col("duration"))
    return overlapping(p, windows, ["source"], ("pts", "until"), ("start_ms", "end_ms"), bucket_ms).drop("until")


def islands(samples: DataFrame, gap: int = ROLL_GAP, least: int = MIN_ROLL, count: int = MIN_ROLL_SAMPLES) -> DataFrame:
    """(source, first_ix, last_ix, start_ms, end_ms, samples): runs of text-like samples (source, ix, time_ms, text_like).

    A negative sample or a gap ends a run; a run has at least `count` samples and lasts `least`.
    """
    by = W.partitionBy("source").orderBy("ix")
    parted = ~F.coalesce(F.lag("text_like").over(by), F.lit(False)) | (F.col("time_ms") - F.lag("time_ms").over(by) > gap)
    rows = samples.withColumn("new", parted.cast("int")).withColumn("run", F.sum("new").over(by)).where("text_like")
    runs = rows.groupBy("source", "run").agg(F.min("ix").alias("first_ix"), F.max("ix").alias("last_ix"), F.min_by("time_ms", "ix").alias("start_ms"), F.max_by("time_ms", "ix").alias("end_ms"), F.count("*").alias("samples"))
    return runs.where((F.col("samples") >= count) & (F.col("end_ms") - F.col("start_ms") >= least)).drop("run")


def first_candidates(runs: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    return runs.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("first_ix"))).where(F.col("k") <= most).drop("k")


def refined(runs: DataFrame, samples: DataFrame, probes: DataFrame, durations: DataFrame, reach: int = 10_000) -> DataFrame:
    """Credits with boundaries moved by probes (source, time_ms, text_like) each second around a run's ends.

    The start is the first text-like probe from the neighbour before, at most `reach` away; the end is
    the last probe before the first that is not text-like, up to the neighbour after. Results shorter
    than a roll are dropped. Samples and probes may be many more than the tables they come of let Spark expect, so no side of
    a join is told to all.
    """
    by = W.partitionBy("source").orderBy("ix")
    around = samples.withColumns({"before": F.lag("time_ms").over(by), "after": F.lead("time_ms").over(by)})
    first, last = (around.select("source", F.col("ix").alias(ix), at).hint("merge") for ix, at in (("first_ix", "before"), ("last_ix", "after")))
    r = runs.join(first, ["source", "first_ix"]).join(last, ["source", "last_ix"]).join(durations.hint("merge"), "source")
    r = r.withColumns({"from_ms": F.greatest(F.coalesce("before", "start_ms"), minus(F.col("start_ms"), F.lit(reach))), "to_ms": F.least(F.coalesce("after", F.col("duration_ms") - 1), F.col("end_ms") + reach)})
    p = probes.select("source", F.col("time_ms").alias("t"), F.col("text_like").alias("yes")).hint("merge")
    grid = lambda base: (F.col("t") - F.col(base)) % 1000 == 0
    rows = r.join(p, (r["source"] == p["source"]) & (p["t"] >= r["from_ms"]) & (p["t"] <= r["to_ms"]), "left").drop(p["source"])
    keys = ["source", "first_ix", "last_ix"]
    head = (F.col("t") <= F.col("start_ms")) & grid("from_ms")
    tail = (F.col("t") >= F.col("end_ms")) & grid("end_ms")
    stop = F.min(F.when(tail & ~F.col("yes"), F.col("t"))).over(W.partitionBy(*keys))
    rows = rows.withColumn("stop", stop)
    out = rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(head & F.col("yes"), F.col("t"))), F.max("start_ms")).alias("start_ms"), F.coalesce(F.max(F.when(tail & F.col("yes") & (F.col("stop").isNull() | (F.col("t") < F.col("stop"))), F.col("t"))), F.max("end_ms")).alias("end_ms"))
    return out.where(minus(F.col("end_ms"), F.col("start_ms")) >= MIN_ROLL).withColumn("confidence", F.lit(REFINED_CONFIDENCE))


def valid_markers(markers: DataFrame, durations: DataFrame) -> DataFrame:
    """Markers with a finite confidence of 0.9 to 1 that end within their source."""
    rows = markers.join(durations, "source")
    return rows.where(F.col("confidence").between(MIN_CONFIDENCE, 1.0) & ~F.isnan("confidence") & (F.col("start_ms") < F.col("end_ms")) & (F.col("end_ms") <= F.col("duration_ms"))).drop("duration_ms")


def without_overlaps(markers: DataFrame, most: int = MOST_MARKERS) -> DataFrame:
    """Greedy choice by confidence, then references, then place `ix`: each marker that overlaps none chosen before it.

    At most `most` are chosen for a source, so the state is bounded. Columns: source, start_ms, end_ms, confidence.
    """

    def step(kept, row):
        if len(kept) >= most or any(row["start_ms"] < e and row["end_ms"] > s for s, e in kept):
            return kept, []
        return [*kept, (row["start_ms"], row["end_ms"])], [(row["source"], row["start_ms"], row["end_ms"], row["confidence"])]

    rows = markers.select("source", (-F.col("confidence")).alias("o1"), (-F.col("reference_count")).alias("o2"), "ix", "start_ms", "end_ms", "confidence")
    return ordered_fold(rows, ["source"], ["o1", "o2", "ix"], list, step, "source long, start_ms long, end_ms long, confidence double", ["source", "start_ms", "end_ms", "confidence"])


def increasing(samples: DataFrame, bound: DataFrame) -> DataFrame:
    """(source, valid): whether times rise strictly and stay within the source's duration."""
    by = W.partitionBy("source").orderBy("ix")
    rows = samples.withColumn("ok", F.coalesce(F.col("time_ms") > F.lag("time_ms").over(by), F.lit(True))).join(bound, "source")
    return rows.groupBy("source").agg(F.bool_and(F.col("ok") & (F.col("time_ms") < F.col("duration_ms"))).alias("valid"))


def pruned(entries: DataFrame, most_entries: int = 20_000, most_bytes: int = 512 << 20) -> DataFrame:
    """(cache, entry, modified, bytes) -> the entries to delete: the oldest, until both limits hold.

    Entries of a cache are summed from the newest back; ties in time go by entry.
    """
    newest = W.partitionBy("cache").orderBy(F.desc("modified"), F.desc("entry")).rowsBetween(W.unboundedPreceding, 0)
    return entries.withColumns({"k": F.count("*").over(newest), "b": F.sum("bytes").over(newest)}).where((F.col("k") > most_entries) | (F.col("b") > most_bytes)).drop("k", "b")


def sampled(frames: DataFrame, spacing: int = 100) -> DataFrame:
    """(source, ix): frames at least `spacing` ms after the last one kept."""

    def step(last, row):
        if last is None or row["time_ms"] - last >= spacing:
            return row["time_ms"], [(row["source"], row["ix"])]
        return last, []

    return ordered_fold(frames.select("source", "ix", "time_ms"), ["source"], ["ix"], lambda: None, step, "source long, ix long", ["source", "ix"])


def clocked(frames: DataFrame, rate: int, most_drift_ms: int = 100) -> DataFrame:
    """(track, ix, sample, jumped): a sample clock that counts on, and jumps to the source where they part by more than a threshold."""

    def step(clock, row):
        at = row["pts"] * rate // 1000 if row["pts"] is not None else None
        jump = at is not None and clock is not None and abs(at - clock) * 1000 > most_drift_ms * rate
        now = at if clock is None and at is not None or jump else (clock or 0)
        return now + row["samples"], [(row["track"], row["ix"], now, jump)]

    return ordered_fold(frames.select("track", "ix", "pts", "samples"), ["track"], ["ix"], lambda: None, step, "track long, ix long, sample long, jumped boolean", ["track", "ix", "sample", "jumped"])


def nearest_frame(frames: DataFrame, requests: DataFrame, reach: int = 200) -> DataFrame:
    """(source, time_ms, ix, frame_ms): the nearest frame within `reach` ms of each request, the first of equals.

    An as-of join in both directions as an equi-join: frames stand in buckets of `reach`, and a
    request looks into its own and both neighbours.
    """
    f = frames.select("source", "ix", F.col("time_ms").alias("frame_ms"), F.floor(F.col("time_ms") / reach).alias("bucket"))
    r = requests.select("source", "time_ms").withColumn("b", F.floor(F.col("time_ms") / reach)).withColumn("bucket", F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1))).drop("b")
    near = r.join(f, ["source", "bucket"]).withColumn("d", F.abs(F.col("frame_ms") - F.col("time_ms"))).where(F.col("d") <= reach)
    return near.groupBy("source", "time_ms").agg(F.min_by(F.struct("ix", "frame_ms"), F.struct("d", "ix")).alias("f")).select("source", "time_ms", "f.ix", "f.frame_ms")


def decoded_frame(frames: DataFrame, requests: DataFrame, reach: int = 200) -> DataFrame:
    """As nearest_frame, over frames that a reader has who starts at the last keyframe at or before the request.

    Frames carry `keyframe`; a request before every keyframe starts at the first frame.
    """
    begun = latest(frames.where("keyframe"), requests.select("source", "time_ms"), ["source"], "time_ms", "ix", F.col("ix")).select("source", "time_ms", F.coalesce("found", F.lit(0)).alias("first_ix")).distinct()
    f = frames.select("source", "ix", F.col("time_ms").alias("frame_ms"), F.floor(F.col("time_ms") / reach).alias("bucket"))
    r = begun.withColumn("b", F.floor(F.col("time_ms") / reach)).withColumn("bucket", F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)))
    near = r.join(f, ["source", "bucket"]).withColumn("d", F.abs(F.col("frame_ms") - F.col("time_ms"))).where((F.col("d") <= reach) & (F.col("ix") >= F.col("first_ix")))
    return near.groupBy("source", "time_ms").agg(F.min_by(F.struct("ix", "frame_ms"), F.struct("d", "ix")).alias("f")).select("source", "time_ms", "f.ix", "f.frame_ms")


def peer_windows(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(source, window, start_ms, end_ms, quality): for each window of a source, the best stretch that both peers repeat.

    `found` are matches (source, window, side, peer, peer_window, start_ms, end_ms, quality, ix) of a source's window with
    each window of its two peers, sides 0 and 1. Outside a peer's first window or the source's own a match
    counts only if it lies where credits do; `windows` (source, window, end_ms) say where each ends.
    """
    ends = windows.select(F.col("source").alias("peer"), F.col("window").alias("peer_window"), F.col("end_ms").alias("peer_end"))
    own = windows.select("source", "window", F.col("end_ms").alias("own_end"))
    late = lambda end: terminal(F.col("start_ms"), F.col("end_ms"), F.col(end))
    good = found.join(ends, ["peer", "peer_window"]).join(own, ["source", "window"]).where(((F.col("peer_window") == 0) | late("peer_end")) & ((F.col("window") == 0) | late("own_end")))
    key = good.withColumn("whose", F.struct("source", "window")).select(F.col("whose").alias("source"), "side", "start_ms", "end_ms", "quality", F.struct("peer_window", "ix").alias("ix"))
    both = consensus(key.where("side = 0").drop("side"), key.where("side = 1").drop("side"))
    return best_match(both).select("source.source", "source.window", "start_ms", "end_ms", "quality")


def print_gaps(prints: DataFrame, most: int = 150) -> DataFrame:
    """(source, packets, broken): whether each packet of samples (source, ix, pts, samples, rate) begins where those before it end, within `most` ms.

    `broken` is the first that does not. What is expected counts from the first packet on, so that packets may be cut anywhere.
    """
    by = W.partitionBy("source").orderBy("ix")
    before = F.coalesce(F.sum("samples").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    expected = F.first("pts").over(by) + (before * 1000 - before * 1000 % F.col("rate")) / F.col("rate")
    rows = prints.withColumn("bad", F.abs(expected - F.col("pts")) > most)
    return rows.groupBy("source").agg(F.count("*").alias("packets"), F.min(F.when(F.col("bad"), F.col("ix"))).alias("broken"))


def all_markers(heard: DataFrame, seen: DataFrame) -> DataFrame:
    """Markers of both detectors, those of sound first, numbered by `ix` within their source."""
    cols = ("source", "start_ms", "end_ms", "confidence", "reference_count")
    both = heard.select(*cols, "ix").withColumn("part", F.lit(0)).unionByName(seen.select(*cols, "ix").withColumn("part", F.lit(1)))
    return both.withColumn("ix", (F.row_number().over(W.partitionBy("source").orderBy("part", "ix")) - 1).cast("bigint")).drop("part")


def usable_references(references: DataFrame, most: int = 2) -> DataFrame:
    """(source, reference) -> (source, usable): at most two references, all different, and none the source itself."""
    g = references.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("reference").alias("d"), F.coalesce(F.bool_or(F.col("reference") == F.col("source")), F.lit(False)).alias("own"))
    return g.select("source", ((F.col("n") <= most) & (F.col("n") == F.col("d")) & ~F.col("own")).alias("usable"))
