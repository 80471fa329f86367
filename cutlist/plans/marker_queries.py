"""Queries of operators.markers."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import chunks as C
from ..operators import markers as M
from ..sources import adapters as A
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
DAY = A.DAY

_DURATION = "durations AS (SELECT source, max(time_ms) + 1 AS duration_ms FROM observations GROUP BY source)"
_NUMBERED = "samples AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY time_ms, event_id) - 1 AS ix, time_ms, text_like FROM observations)"
_ISLANDS = f"""{_NUMBERED}, marked AS (SELECT *, CASE WHEN NOT coalesce(lag(text_like) OVER w, false) OR time_ms - lag(time_ms) OVER w > {DAY} THEN 1 ELSE 0 END AS new FROM samples WINDOW w AS (PARTITION BY source ORDER BY ix)),
    runs AS (SELECT source, min(ix) AS first_ix, max(ix) AS last_ix, arg_min(time_ms, ix) AS start_ms, arg_max(time_ms, ix) AS end_ms, count(*) AS samples FROM (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY ix) AS run FROM marked) WHERE text_like GROUP BY source, run HAVING count(*) >= 4 AND end_ms - start_ms >= 20000)"""


def _samples(spark, d):
    ix = F.row_number().over(W.partitionBy("source").orderBy("time_ms", "event_id")) - 1
    return A.observations(spark, d).withColumn("ix", ix.cast("bigint")).select("source", "ix", "time_ms", "text_like")


def _durations(spark, d):
    return A.observations(spark, d).groupBy("source").agg((F.max("time_ms") + 1).alias("duration_ms"))


@query(f"WITH {_ISLANDS} SELECT * FROM runs", "observations")
def evidence_islands(spark, d):
    """F17, with a gap of a day as events are hours apart."""
    return M.islands(_samples(spark, d), gap=DAY)


@query(f"WITH {_ISLANDS} SELECT source, first_ix, last_ix, start_ms, end_ms, samples FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_ix) AS k FROM runs) WHERE k <= 2", "observations")
def first_candidates(spark, d):
    """G11, with two for eight."""
    return M.first_candidates(M.islands(_samples(spark, d), gap=DAY), 2)


_MATCHES = """m AS (SELECT user_id AS source, event_id % 2 AS peer, event_id AS ix, (event_id * 7919) % 100000 AS start_ms, (event_id * 7919) % 100000 + 20000 + (event_id * 31) % 60000 AS end_ms, 0.85::DOUBLE + (event_id % 15) / 100.0::DOUBLE AS quality FROM events)"""
_CONSENSUS = f"""{_MATCHES}, pairs AS (SELECT a.source, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms, greatest(a.end_ms - a.start_ms, b.end_ms - b.start_ms) AS long, least(a.quality, b.quality) AS quality, a.ix AS i, b.ix AS j FROM m a JOIN m b USING (source) WHERE a.peer = 0 AND b.peer = 1),
    agreed AS (SELECT source, start_ms, end_ms, round(arg_max(quality, [i, j]), 9) AS quality FROM pairs WHERE end_ms - start_ms >= 15000 AND (end_ms - start_ms) / long::DOUBLE >= 0.8 AND quality >= 0.9 GROUP BY ALL)"""


@query(f"WITH {_CONSENSUS} SELECT * FROM agreed")
def peer_consensus(spark, d):
    """D09."""
    return _agreed(spark, d)


def _agreed(spark, d):
    e = F.col("event_id")
    start = (e * 7919) % 100_000
    ev = A.table(spark, d, "events")
    rows = ev.select(F.col("user_id").alias("source"), (e % 2).alias("peer"), e.alias("ix"), start.alias("start_ms"), (start + 20_000 + (e * 31) % 60_000).alias("end_ms"), (F.lit(0.85) + (e % 15) / F.lit(100.0)).alias("quality"))
    return M.consensus(rows.where("peer = 0"), rows.where("peer = 1")).withColumn("quality", F.round("quality", 9))


@query(f"""WITH {_CONSENSUS} SELECT source, start_ms, end_ms, quality FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY end_ms - start_ms DESC, quality DESC, start_ms, end_ms) AS k FROM agreed) WHERE k = 1""")
def best_match(spark, d):
    """G05."""
    return M.best_match(_agreed(spark, d))


REGISTRY.also("peer_consensus", "whole_peer_consensus")
REGISTRY.also("best_match", "whole_best_match")


@query("""WITH o AS (SELECT o_orderkey AS source, o_custkey * 1000 AS s, o_custkey * 1000 + 60000 AS e, o_custkey * 1000 + (o_orderkey % 300) * 1000 AS z FROM orders)
    SELECT source, s >= greatest(z - 240000, 0) AND e >= greatest(z - 90000, 0) AND e <= z AS terminal, least(z * 35 // 100, 900000) AS search_ms FROM o""")
def credits_gates(spark, d):
    """C18, C19."""
    s = F.col("o_custkey") * 1000
    z = s + (F.col("o_orderkey") % 300) * 1000
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), M.terminal(s, s + 60_000, z).alias("terminal"), M.search_window(z).alias("search_ms"))


@query(f"""WITH dur AS (SELECT track AS source, max(pts) - min(pts) AS duration_ms FROM packets GROUP BY track), h AS (SELECT *, least(600000, duration_ms // 4) AS head FROM dur),
    w AS (SELECT source, 0 AS "window", 0::BIGINT AS start_ms, head AS end_ms FROM h UNION ALL SELECT source, 1, greatest(duration_ms - 300000, head, 0), duration_ms FROM h), live AS (SELECT * FROM w WHERE start_ms < end_ms),
    p AS (SELECT track AS source, ix, pts - min(pts) OVER (PARTITION BY track) AS pts, duration FROM packets)
    SELECT p.source, ix, pts, "window", start_ms, end_ms FROM p JOIN live USING (source) WHERE pts < end_ms AND pts + duration > start_ms""", "packets")
def evidence_windows(spark, d):
    """Packets that overlap the head or the tail of their track."""
    p = A.packets(spark, d).withColumn("pts", F.col("pts") - F.min("pts").over(W.partitionBy("track")))
    dur = p.groupBy(F.col("track").alias("source")).agg(F.max("pts").alias("duration_ms"))
    return M.in_windows(p.select("track", "ix", "pts", "duration"), M.evidence_windows(dur), DAY).select("source", "ix", "pts", "window", "start_ms", "end_ms")


_MARKERS = "mk AS (SELECT user_id AS source, event_id AS ix, (event_id * 7919) % 1000000 AS start_ms, (event_id * 7919) % 1000000 + (event_id % 13 - 1) * 9000 AS end_ms, 0.85::DOUBLE + (event_id % 17) / 100.0::DOUBLE AS confidence, event_id % 3 AS reference_count FROM events)"


def _markers(spark, d):
    e = F.col("event_id")
    start = (e * 7919) % 1_000_000
    ev = A.table(spark, d, "events")
    return ev.select(F.col("user_id").alias("source"), e.alias("ix"), start.alias("start_ms"), (start + (e % 13 - 1) * 9000).alias("end_ms"), (F.lit(0.85) + (e % 17) / F.lit(100.0)).alias("confidence"), (e % 3).alias("reference_count"))


def _valid(spark, d):
    m = _markers(spark, d)
    return M.valid_markers(m, m.select("source").distinct().withColumn("duration_ms", F.lit(1_000_000)))


@query(f"WITH {_MARKERS} SELECT source, ix, start_ms, end_ms, round(confidence, 9) AS confidence, reference_count FROM mk WHERE confidence BETWEEN 0.9 AND 1.0 AND start_ms < end_ms AND end_ms <= 1000000")
def valid_markers(spark, d):
    """C17."""
    return _valid(spark, d).withColumn("confidence", F.round("confidence", 9))


_WITHOUT_OVERLAPS = f"""WITH {_MARKERS}, v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, reference_count DESC, ix) AS k FROM mk WHERE confidence BETWEEN 0.9 AND 1.0 AND start_ms < end_ms AND end_ms <= 1000000),
    f AS (SELECT source, k, start_ms, end_ms, confidence, true AS taken, [{{'s': start_ms, 'e': end_ms}}] AS kept FROM v WHERE k = 1
      UNION ALL SELECT v.source, v.k, v.start_ms, v.end_ms, v.confidence, len(list_filter(kept, lambda x: v.start_ms < x.e AND v.end_ms > x.s)) = 0,
        CASE WHEN len(list_filter(kept, lambda x: v.start_ms < x.e AND v.end_ms > x.s)) = 0 THEN list_append(kept, {{'s': v.start_ms, 'e': v.end_ms}}) ELSE kept END FROM f JOIN v ON v.source = f.source AND v.k = f.k + 1)
    SELECT source, start_ms, end_ms, round(confidence, 9) AS confidence FROM f WHERE taken"""


@query(_WITHOUT_OVERLAPS)
def markers_without_overlaps(spark, d):
    """G07."""
    return M.without_overlaps(_valid(spark, d)).withColumn("confidence", F.round("confidence", 9))


REGISTRY.also("valid_markers", "whole_valid_markers")
REGISTRY.also("markers_without_overlaps", "whole_markers_without_overlaps")


@query(f"WITH {_NUMBERED}, {_DURATION}, o AS (SELECT source, coalesce(time_ms > lag(time_ms) OVER (PARTITION BY source ORDER BY ix), true) AS ok, time_ms, duration_ms FROM samples JOIN durations USING (source)) SELECT source, bool_and(ok AND time_ms < duration_ms) AS valid FROM o GROUP BY source", "observations")
def evidence_is_valid(spark, d):
    """C20."""
    return M.increasing(_samples(spark, d), _durations(spark, d))


@query("""WITH e AS (SELECT user_id % 10 AS cache, event_id AS entry, epoch_us(ts) // 1000 AS modified, (coalesce(value, 0) * 100)::BIGINT AS bytes FROM (SELECT user_id, event_id, ts, round(value * 100) / 100 AS value FROM events)),
    s AS (SELECT *, count(*) OVER w AS k, sum(bytes) OVER w AS b FROM e WINDOW w AS (PARTITION BY cache ORDER BY modified DESC, entry DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT cache, entry, modified, bytes FROM s WHERE k > 60 OR b > 400000""")
def cache_to_prune(spark, d):
    """E12, with limits of 60 entries and 400,000 bytes."""
    cents = F.round(F.round(F.col("value") * 100) / 100 * 100).cast("bigint")
    e = A.table(spark, d, "events").select((F.col("user_id") % 10).alias("cache"), F.col("event_id").alias("entry"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000").alias("modified"), F.coalesce(cents, F.lit(0)).alias("bytes"))
    return M.pruned(e, 60, 400_000)


@query(f"""WITH {_NUMBERED}, f AS (SELECT source, 0 AS n, ix, time_ms FROM samples WHERE ix = 0 UNION ALL SELECT f.source, f.n + 1, min(s.ix), arg_min(s.time_ms, s.ix) FROM f JOIN samples s ON s.source = f.source AND s.ix > f.ix AND s.time_ms - f.time_ms >= {DAY} GROUP BY f.source, f.n)
    SELECT source, ix FROM f""", "observations")
def thinned_frames(spark, d):
    """F24, with a day for 100 ms."""
    return M.sampled(_samples(spark, d), DAY)


@query("""WITH p AS (SELECT track, ix, pts - min(pts) OVER (PARTITION BY track) AS pts, duration // 1000000 AS samples FROM packets),
    f AS (SELECT track, ix, 0::BIGINT AS sample, false AS jumped, samples AS next FROM p WHERE ix = 0
      UNION ALL SELECT p.track, p.ix, CASE WHEN j THEN src ELSE next END, j, CASE WHEN j THEN src ELSE next END + p.samples FROM (SELECT f.track, f.ix + 1 AS ix, next, p2.pts * 8 // 1000 AS src, abs(p2.pts * 8 // 1000 - next) * 1000 > 40000000 * 8 AS j FROM f JOIN p p2 ON p2.track = f.track AND p2.ix = f.ix + 1) x JOIN p USING (track, ix))
    SELECT track, ix, sample, jumped FROM f""", "packets")
def sample_clock(spark, d):
    """eight samples a second and a drift of 40,000 seconds."""
    p = A.packets(spark, d).withColumn("pts", F.col("pts") - F.min("pts").over(W.partitionBy("track"))).withColumn("samples", C.whole(F.col("duration"), F.lit(1_000_000)))
    return M.clocked(p, 8, 40_000_000)


@query(f"""WITH {_NUMBERED}, r AS (SELECT DISTINCT source, time_ms // {DAY} * {DAY} AS time_ms FROM samples),
    n AS (SELECT r.source, r.time_ms, ix, s.time_ms AS frame_ms, row_number() OVER (PARTITION BY r.source, r.time_ms ORDER BY abs(s.time_ms - r.time_ms), ix) AS k FROM r JOIN samples s ON s.source = r.source AND abs(s.time_ms - r.time_ms) <= 20000000)
    SELECT source, time_ms, ix, frame_ms FROM n WHERE k = 1""", "observations")
def nearest_frames(spark, d):
    """A17, D05, with a reach of 20,000 seconds."""
    s = _samples(spark, d)
    r = s.select("source", (C.whole(F.col("time_ms"), F.lit(DAY)) * DAY).alias("time_ms")).distinct()
    return M.nearest_frame(s, r, 20_000_000)


@query("""WITH g AS (SELECT source, count(*) AS n, count(DISTINCT bits) FILTER (voiced) AS d FROM fingerprints GROUP BY source) SELECT source FROM g WHERE n <= 8000 AND d >= 32""", "fingerprints")
def eligible_fingerprints(spark, d):
    """H02 and the filter of D10."""
    return M.eligible(A.fingerprints(spark, d))


@query("""WITH ev AS (SELECT * FROM fingerprints UNION ALL SELECT source + 1000, ix + 100, (ix + 100) * 400, bits, voiced FROM fingerprints WHERE ix < 48),
    el AS (SELECT source FROM ev GROUP BY source HAVING count(*) <= 8000 AND count(DISTINCT bits) FILTER (voiced) >= 32),
    g AS (SELECT * FROM ev JOIN el USING (source)),
    votes AS (SELECT a.source, b.source AS peer, b.ix - a.ix AS shift FROM g a JOIN g b ON a.bits >> 20 = b.bits >> 20 AND a.source <> b.source GROUP BY ALL HAVING count(*) > 1),
    diag AS (SELECT v.source, v.peer, v.shift, a.ix, a.t_ms, bit_count(xor(a.bits, b.bits)) AS d FROM votes v JOIN g a ON a.source = v.source JOIN g b ON b.source = v.peer AND b.ix = a.ix + v.shift),
    near AS (SELECT *, avg(d) OVER (PARTITION BY source, peer, shift ORDER BY ix ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mean FROM diag),
    runs AS (SELECT *, ix - row_number() OVER (PARTITION BY source, peer, shift ORDER BY ix) AS run FROM near WHERE mean <= 6.4),
    found AS (SELECT source, peer, min(t_ms) AS start_ms, max(t_ms) AS end_ms, avg(d) AS score FROM runs GROUP BY source, peer, shift, run)
    SELECT source, peer, start_ms, end_ms, round(1 - score / 32, 6) AS quality FROM found WHERE end_ms - start_ms BETWEEN 15000 AND 300000 AND score <= 3.2""", "fingerprints")
def repeated_intro(spark, d):
    """All series with each other, and with copies of each one's first 48 frames planted a hundred frames later in another source."""
    p = A.fingerprints(spark, d)
    planted = p.where("ix < 48").select((F.col("source") + 1000).alias("source"), (F.col("ix") + 100).alias("ix"), ((F.col("ix") + 100) * 400).alias("t_ms"), "bits", "voiced")
    every = p.select(*planted.columns).unionByName(planted)
    return M.align(every, every).withColumn("quality", F.round("quality", 6))
