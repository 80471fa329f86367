"""Incremental forms of the packet operators, as Structured Streaming with keyed state.

Packets arrive in decode order within a track; the state of a track is a few numbers. A packet
with `last` set ends its track, and what is pending is given out. Rows of one batch and track are
ordered by ix; an ix at or below the last one seen is a repeat and is ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNKS = "track long, chunk long, start_ms long, duration_ms long, packet_start long, packet_end long, key_aligned boolean"
TIMED = "track long, ix long, pts long, duration long"


def stream_chunks(packets: DataFrame, target_ms: int) -> DataFrame:
    """Chunks as soon as they are cut; equal to operators.chunks.plan_chunks over the whole track."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        seen, chunk, first, start, end, aligned = state.get if state.exists else (-1, 0, 0, None, 0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("ix")
        for ix, pts, duration, keyframe, last in rows[["ix", "pts", "duration", "keyframe", "last"]].itertuples(index=False, name=None):
            if ix <= seen:
                continue
            if start is None:
                first, start, aligned = ix, pts, keyframe
            elif keyframe and max(pts - start, 0) >= target_ms:
                out.append((key[0], chunk, start, max(end - start, 0), first, ix, aligned))
                chunk, first, start, aligned = chunk + 1, ix, pts, keyframe
            seen, end = ix, pts + duration
            if last:
                out.append((key[0], chunk, start, max(end - start, 0), first, ix + 1, aligned))
        state.update((int(seen), int(chunk), int(first), None if start is None else int(start), int(end), bool(aligned)))
        yield pd.DataFrame(out, columns=["track", "chunk", "start_ms", "duration_ms", "packet_start", "packet_end", "key_aligned"])

    rows = packets.select("track", "ix", "pts", "duration", "keyframe", "last")
    return rows.groupBy("track").applyInPandasWithState(step, CHUNKS, "seen long, chunk long, first long, start long, end long, aligned boolean", "append", GroupStateTimeout.NoTimeout)


def stream_durations(packets: DataFrame) -> DataFrame:
    """Packets with durations up to the next: one is pending per track; the last repeats the duration before it."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        seen, pts, before = state.get if state.exists else (-1, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("ix")
        for ix, now, last in rows[["ix", "pts", "last"]].itertuples(index=False, name=None):
            if ix <= seen:
                continue
            if pts is not None:
                before = max(now - pts, 0)
                out.append((key[0], seen, pts, before))
            seen, pts = ix, now
            if last:
                out.append((key[0], seen, pts, before))
        state.update((int(seen), None if pts is None else int(pts), int(before)))
        yield pd.DataFrame(out, columns=["track", "ix", "pts", "duration"])

    rows = packets.select("track", "ix", "pts", "last")
    return rows.groupBy("track").applyInPandasWithState(step, TIMED, "seen long, pts long, before long", "append", GroupStateTimeout.NoTimeout)


def stream_new(samples: DataFrame) -> DataFrame:
    """Samples later than the latest seen of their source: a scan that resumes, by its checkpoint, where it stopped."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        (latest,) = state.get if state.exists else (-(2**62),)
        rows = pd.concat(list(batches)).sort_values("time_ms").drop_duplicates("time_ms")
        rows = rows[rows["time_ms"] > latest]
        if len(rows):
            state.update((int(rows["time_ms"].max()),))
        yield rows[["source", "time_ms", "text_like"]]

    return samples.select("source", "time_ms", "text_like").groupBy("source").applyInPandasWithState(step, "source long, time_ms long, text_like boolean", "latest long", "append", GroupStateTimeout.NoTimeout)


def replayed(rows: DataFrame, lot: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming form gives out for a table that arrives lot by lot, each lot a file and a batch of its own.

    Input, checkpoint and results lie below spark.checkpoint.dir, which all machines share; a session on
    one machine may do without.
    """
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="cutlist-")
    top = f"{base.rstrip('/')}/replayed-{uuid.uuid4().hex}"
    kept = rows.persist()
    for k in sorted(r[0] for r in kept.select(lot).distinct().collect()):  # a few numbers: the lots
        kept.where(kept[lot] == k).drop(lot).coalesce(1).write.mode("append").parquet(f"{top}/in")
    kept.unpersist()
    source = spark.readStream.schema(rows.drop(lot).schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    out = make(source)
    run = out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")
