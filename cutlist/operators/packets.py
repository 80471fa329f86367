"""Packet timing: repair, normalisation, sample tables and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timing import minus, rescale


def _order(*more: str) -> W:
    return W.partitionBy("track").orderBy("ix", *more)


def lookahead_durations(packets: DataFrame) -> DataFrame:
    """Durations up to the next packet; the last packet repeats the one before, a lone one has 0."""
    by = _order()
    ahead = minus(F.lead("pts").over(by), F.col("pts"))
    return packets.withColumn("ahead", ahead).withColumn("duration", F.coalesce("ahead", F.lag("ahead").over(by), F.lit(0))).drop("ahead")


def last_duration(packets: DataFrame) -> DataFrame:
    """(track, last_duration): time from the packet before the last to the last; none for one packet."""
    by = _order()
    rows = packets.withColumn("d", F.col("pts") - F.lag("pts").over(by))
    return rows.groupBy("track").agg(F.max_by("d", "ix").alias("last_duration")).where("last_duration >= 0")


def nominal_duration(packets: DataFrame, most_ms: int = 250) -> DataFrame:
    """(track, nominal): upper median of the positive steps of at most `most_ms` between packets in decode order."""
    steps = packets.withColumn("d", F.col("pts") - F.lag("pts").over(_order())).where((F.col("d") > 0) & (F.col("d") <= most_ms))
    ranked = steps.withColumn("k", F.row_number().over(W.partitionBy("track").orderBy("d"))).withColumn("n", F.count("*").over(W.partitionBy("track")))
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("track", F.col("d").alias("nominal"))


def repaired(packets: DataFrame, nominal: DataFrame) -> DataFrame:
    """Video timing where a nominal duration is known: dts counts it up from the first pts and every packet lasts it.

    Other tracks keep their timing, but for the last packet, which lasts as long as the step before it.
    """
    by = _order()
    whole = W.partitionBy("track")
    rows = packets.join(nominal, "track", "left").withColumn("first", F.min_by("pts", "ix").over(whole)).withColumn("step", F.col("pts") - F.lag("pts").over(by)).withColumn("last", F.lead("ix").over(by).isNull())
    duration = F.coalesce(F.col("nominal"), F.when(F.col("last") & (F.col("step") >= 0), F.col("step")), F.col("duration"))
    dts = F.when(F.col("nominal").isNotNull(), F.col("first") + F.col("ix") * F.col("nominal")).otherwise(F.col("pts"))
    return rows.select("track", "ix", "pts", dts.alias("dts"), duration.alias("duration"), "size", "keyframe")


def laced(blocks: DataFrame) -> DataFrame:
    """(track, block, pts, frame_duration, sizes) -> packets: frames of a block follow each other by the frame duration.

    A packet lasts until the next one of its track; the last keeps the frame duration.
    """
    frames = blocks.select("track", "block", "pts", "frame_duration", F.posexplode("sizes").alias("k", "size"))
    rows = frames.withColumn("pts", F.col("pts") + F.col("k") * F.coalesce("frame_duration", F.lit(0)))
    by = W.partitionBy("track").orderBy("block", "k")
    return rows.select("track", (F.row_number().over(by) - 1).cast("bigint").alias("ix"), "pts", F.coalesce(minus(F.lead("pts").over(by), F.col("pts")), "frame_duration", F.lit(0)).alias("duration"), "size")


def normalised(samples: DataFrame, *keep: str) -> DataFrame:
    """(track, ix, duration, offset) -> dts, pts: running durations, shifted so that no time of the track is negative; other columns where they are named."""
    before = _order().rowsBetween(W.unboundedPreceding, -1)
    rows = samples.withColumn("dts", F.coalesce(F.sum("duration").over(before), F.lit(0))).withColumn("pts", F.col("dts") + F.col("offset"))
    shift = F.least(F.min(F.least("pts", "dts")).over(W.partitionBy("track")), F.lit(0))
    return rows.withColumn("shift", shift).select("track", "ix", (F.col("dts") - F.col("shift")).alias("dts"), (F.col("pts") - F.col("shift")).alias("pts"), "duration", *keep)


def sample_offsets(samples: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Where each sample lies: samples (track, ix, size), chunks (track, chunk, offset), runs (track, first_chunk, per_chunk).

    Chunks hold as many samples as the latest run that begins at or before them says; a sample lies
    behind the others of its chunk. Samples beyond the chunks and chunks beyond the samples are left out.
    """
    by = W.partitionBy("track").orderBy("chunk")
    filled = chunks.join(runs.withColumnRenamed("first_chunk", "chunk"), ["track", "chunk"], "left").withColumn("per_chunk", F.last("per_chunk", ignorenulls=True).over(by))
    slots = filled.where("per_chunk > 0").select("track", "chunk", "offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("per_chunk") - 1)).alias("k"))
    slots = slots.withColumn("ix", (F.row_number().over(W.partitionBy("track").orderBy("chunk", "k")) - 1).cast("bigint"))
    before = W.partitionBy("track", "chunk").orderBy("ix").rowsBetween(W.unboundedPreceding, -1)
    return samples.join(slots, ["track", "ix"]).select("track", "ix", "chunk", (F.col("offset") + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("source_offset"), "size")


def sanitised(packets: DataFrame, dts: Column, pts: Column) -> DataFrame:
    """Strictly rising dts in a segment of a kind, and pts no earlier: rows (segment, kind, ix, ...) with out_dts, out_pts.

    The running rule `max(dts, last + 1)` is the running maximum of dts - place, plus the place.
    """
    by = W.partitionBy("segment", "kind").orderBy("ix")
    rows = packets.withColumn("place", F.row_number().over(by).cast("bigint")).withColumn("d", dts).withColumn("p", pts)
    out = F.col("place") + F.max(F.col("d") - F.col("place")).over(by.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("out_dts", out).withColumn("out_pts", F.greatest("p", "out_dts")).drop("place", "d", "p")


def fragment_samples(packets: DataFrame, scale: int, timescale: int) -> DataFrame:
    """Samples of fragments: duration of at least 1, and composition offsets shifted so that none is negative."""
    at = lambda c: rescale(F.col(c), F.lit(scale), F.lit(timescale))
    cto = F.greatest(F.least(at("pts") - at("dts"), F.lit(2**31 - 1)), F.lit(-(2**31)))
    rows = packets.withColumn("cto", cto)
    shift = F.least(F.min("cto").over(W.partitionBy("track")), F.lit(0))
    return rows.withColumn("cto", F.col("cto") - shift).select("track", "ix", F.greatest(at("duration"), F.lit(1)).alias("duration"), "size", "cto", F.when(F.col("keyframe"), 0x02000000).otherwise(0x01010000).alias("flags"))


def contiguous(frames: DataFrame) -> DataFrame:
    """(track, frames, broken): whether each frame starts where those before it end; `broken` is the first that does not."""
    by = _order()
    expected = F.first("start_sample").over(by) + F.coalesce(F.sum("samples").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = frames.withColumn("bad", F.col("start_sample") != expected)
    return rows.groupBy("track").agg(F.count("*").alias("frames"), F.min(F.when(F.col("bad"), F.col("ix"))).alias("broken"))


def interleaved(packets: DataFrame) -> DataFrame:
    """place: the order of writing, by dts in milliseconds, video before audio, then as read."""
    return packets.withColumn("place", (F.row_number().over(W.partitionBy("segment").orderBy("dts", F.col("kind") != "video", "track", "ix")) - 1).cast("bigint"))


def rates(stts: DataFrame) -> DataFrame:
    """(track, scale, counts, deltas, bytes) -> totals and rates of a run-length table.

    max_rate: the scale over the smallest step with samples, null if a step with samples is 0;
    bitrate: whole bits a second, null where the duration is 0.
    """
    runs = stts.select("track", "scale", "bytes", F.explode(F.arrays_zip("counts", "deltas")).alias("r")).select("track", "scale", "bytes", F.col("r.counts").alias("n"), F.col("r.deltas").alias("d"))
    total, least = F.sum(F.col("n") * F.col("d")), F.min(F.when(F.col("n") > 0, F.col("d")))
    wide = lambda c: c.cast("decimal(38,0)")
    bits = wide(F.max("bytes").cast("decimal(20,0)") * 8) * F.max("scale").cast("decimal(10,0)")
    out = runs.groupBy("track").agg(F.sum("n").alias("samples"), total.alias("duration"), F.when(least > 0, F.max("scale") / least).alias("max_rate"), bits.cast("decimal(38,0)").alias("bits"))
    whole = ((F.col("bits") - F.col("bits") % F.col("duration")) / F.col("duration")).cast("bigint")
    return out.select("track", "samples", "duration", F.round("max_rate", 6).alias("max_rate"), F.when(F.col("duration") > 0, whole).alias("bitrate"))
