"""Lifecycle, budgets, publishing and the remaining lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .asof import latest, overlapping
from .chunks import whole
from .fold import ordered_fold


def published(df: DataFrame, path: str) -> str:
    """Writes rows to a path once: 'written', or 'same' where equal rows stand there; other rows are an error.

    What is there is never replaced. Rows compare as a multiset. They are written under a name that no other
    writer uses, and take the path by a rename that fails where it exists, so that of two writers one wins.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        own = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(own)
        try:
            at = store.makeQualified(hadoop.Path(own))
            names = hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
            names.rename(at, store.makeQualified(place), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
            return "written"
        except Exception as error:  # noqa: BLE001
            store.delete(hadoop.Path(own), True)
            if "AlreadyExists" not in str(error):
                raise
    there = spark.read.parquet(path)
    new = df.select(*there.columns) if sorted(df.columns) == sorted(there.columns) else None
    if new is None or not new.exceptAll(there).isEmpty() or not there.exceptAll(new).isEmpty():
        raise FileExistsError(path)
    return "same"


def source_stamp(path: Column, length: Column, modified: Column, kind: str) -> Column:
    """Key of cached evidence: a digest of what identifies a source, and of the kind of evidence."""
    return F.sha2(F.concat_ws("\n", path, length.cast("string"), modified.cast("string"), F.lit(kind)), 256)


def tracks_present(packets: DataFrame, tracks: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """(track, found): whether each asked track has a packet in a window."""
    inside = packets.where((F.col("pts") >= start_ms) & (F.col("pts") < end_ms)).select("track").distinct().withColumn("found", F.lit(True))
    return tracks.join(inside, "track", "left").select("track", F.coalesce("found", F.lit(False)).alias("found"))


def bounded_bitrate(plan: DataFrame, requested: int, output_bytes: int) -> DataFrame:
    """(track, bitrate): the requested one, or what half the output budget allows for the longest chunk and a second, less a quarter."""
    bits = output_bytes // 2 * 8 * 3 // 4
    seconds = whole(F.col("duration_ms") + 999, F.lit(1000)) + 1
    return plan.groupBy("track").agg(F.least(F.lit(requested), F.min(whole(F.lit(bits).cast("bigint"), seconds))).alias("bitrate"))


def mux_budgets(packets: DataFrame, windows: DataFrame, factor: int, private: int, bucket_ms: int, compressed: int, output: int) -> DataFrame:
    """(track, n, compressed, stream, fragment, rejected): bytes of a window and estimates of what muxing makes of them.

    A transport stream packs 176 bytes into 188; a fragment adds 16 bytes a packet; both start from 1,024.
    """
    size = F.col("size")
    ts = whole(size * factor + private + 64 + 175, F.lit(176)) * 188
    rows = packets.withColumns({"ts": ts, "fr": size + 16, "bucket": F.floor(F.col("pts") / bucket_ms)})
    touched = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))))
    inside = rows.join(touched, ["track", "bucket"]).where("pts >= start_ms AND pts < end_ms").groupBy("track", "n").agg(F.sum("size").alias("c"), F.sum("ts").alias("t"), F.sum("fr").alias("f"))
    out = windows.join(inside, ["track", "n"], "left").select("track", "n", F.coalesce("c", F.lit(0)).alias("compressed"), (F.coalesce("t", F.lit(0)) + 1024).alias("stream"), (F.coalesce("f", F.lit(0)) + 1024).alias("fragment"))
    return out.withColumn("rejected", F.when(F.col("compressed") > compressed, "compressed").when(F.col("stream") > output, "output"))


def reassociated(packets: DataFrame) -> DataFrame:
    """(track, frame, pts, duration): decoded frames come in order of presentation and take timings in that order, equal ones as decoded."""
    return packets.select("track", (F.row_number().over(W.partitionBy("track").orderBy("pts", "ix")) - 1).cast("bigint").alias("frame"), "pts", "duration")


def cue_chunks(cues: DataFrame, target_ms: int) -> DataFrame:
    """(track, time_ms) of seek points -> (track, chunk, start_ms, duration_ms, first, end): distinct times, cut greedily.

    All chunks are key-aligned; the last lasts to the last seek point.
    """
    by = W.partitionBy("track").orderBy("time_ms")
    rows = cues.select("track", "time_ms").distinct().withColumn("ix", (F.row_number().over(by) - 1).cast("bigint"))

    def step(start, row):
        if start is None or row["time_ms"] - start >= target_ms:
            return row["time_ms"], [(row["track"], row["ix"])]
        return start, []

    heads = ordered_fold(rows, ["track"], ["ix"], lambda: None, step, "track long, ix long", ["track", "ix"]).join(rows, ["track", "ix"])
    by = W.partitionBy("track").orderBy("ix")
    ends = rows.groupBy("track").agg(F.max("time_ms").alias("last"), F.count("*").alias("n"))
    h = heads.withColumns({"next": F.lead("time_ms").over(by), "stop": F.lead("ix").over(by), "chunk": F.row_number().over(by) - 1}).join(ends, "track")
    return h.select("track", F.col("chunk").cast("bigint").alias("chunk"), F.col("time_ms").alias("start_ms"), (F.coalesce("next", "last") - F.col("time_ms")).alias("duration_ms"), F.col("ix").alias("first"), F.coalesce("stop", "n").alias("end"))


def latest_cue(cues: DataFrame, requests: DataFrame) -> DataFrame:
    """(track, request, position): the latest seek point at or before a time, the last of equals; null without one."""
    rows = cues.withColumnRenamed("time_ms", "target_ms")
    return latest(rows, requests, ["track"], "target_ms", "ix", F.col("position")).select("track", "request", F.col("found").alias("position"))


def codec_sessions(requests: DataFrame) -> DataFrame:
    """(session, created, reuses, resets) over requests (session, ix, segment, failed).

    A codec is used again for the segment that follows the one it completed; any other one, or one
    after a failure, takes a new codec. A failed request completes nothing. What a request meets is
    known from the one before it, so that no state is needed beyond a neighbour.
    """
    by = W.partitionBy("session").orderBy("ix")
    last, bad = F.lag("segment").over(by), F.lag("failed").over(by)
    follows = ~bad & (last + 1 == F.col("segment"))
    state = F.when(last.isNull(), "created").when(follows, "reused").otherwise("reset")
    rows = requests.withColumn("state", state)
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    return rows.groupBy("session").agg((n("created") + n("reset")).alias("created"), n("reused").alias("reuses"), n("reset").alias("resets"))


def bounds(windows: DataFrame) -> DataFrame:
    """(track, start_ms, end_ms): the span of all windows asked of a track."""
    return windows.groupBy("track").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def clipped(frames: DataFrame, windows: DataFrame, bucket: int = 480_000) -> DataFrame:
    """Samples of frames (track, start, samples) that lie in a window (track, n, from_sample, to_sample), and the silence before the first.

    Silence fills at most two seconds at 48 kHz; more is an error, marked by `broken`.
    """
    f = frames.withColumn("stop", F.col("start") + F.col("samples"))
    rows = overlapping(f, windows, ["track"], ("start", "stop"), ("from_sample", "to_sample"), bucket)
    got = rows.groupBy("track", "n", "from_sample").agg(F.sum(F.least("stop", "to_sample") - F.greatest("start", "from_sample")).alias("kept"), F.min(F.greatest("start", "from_sample")).alias("first"))
    out = got.withColumn("silence", F.col("first") - F.col("from_sample"))
    return out.select("track", "n", "kept", "silence", (F.col("silence") > 96_000).alias("broken"))


def manifest(tracks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, manifest): a JSON document a source, tracks in order with their chunks in order."""
    c = chunks.groupBy("source", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "start_ms", "duration_ms"))), lambda x: F.struct(x["chunk"].alias("index"), x["start_ms"].alias("startMs"), x["duration_ms"].alias("durationMs"))).alias("chunks"))
    empty = F.array().cast("array<struct<index:bigint,startMs:bigint,durationMs:bigint>>")
    t = tracks.join(c, ["source", "id"], "left").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ix", F.struct("id", "kind", F.col("family").alias("codec"), F.coalesce("chunks", empty).alias("chunks")).alias("t")))).alias("ts"))
    return t.select("source", F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.transform("ts", lambda x: x["t"]).alias("tracks"))).alias("manifest"))
