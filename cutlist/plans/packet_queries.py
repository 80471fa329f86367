"""Queries of operators.packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import packets as P
from ..sources import adapters as A
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query



@query("""WITH l AS (SELECT *, lead(pts) OVER (PARTITION BY track ORDER BY ix) - pts AS d FROM packets), a AS (SELECT *, CASE WHEN d >= 0 THEN d WHEN d < 0 THEN 0 END AS ahead FROM l)
    SELECT track, ix, pts, coalesce(ahead, lag(ahead) OVER (PARTITION BY track ORDER BY ix), 0) AS duration, size, keyframe FROM a""", "reordered")
def lookahead_durations(spark, d):
    """F06, F09, L02 in batch form."""
    return P.lookahead_durations(A.packets(spark, d, reordered=True))


@query("""WITH s AS (SELECT track, ix, pts - lag(pts) OVER (PARTITION BY track ORDER BY ix) AS step FROM packets)
    SELECT track, arg_max(step, ix) AS last_duration FROM s GROUP BY track HAVING arg_max(step, ix) >= 0""", "packets")
def last_duration(spark, d):
    """F08."""
    return P.last_duration(A.packets(spark, d))


@query(f"""WITH s AS (SELECT track, pts - lag(pts) OVER (PARTITION BY track ORDER BY ix) AS step FROM packets),
    r AS (SELECT track, step, row_number() OVER (PARTITION BY track ORDER BY step) AS k, count(*) OVER (PARTITION BY track) AS n FROM s WHERE step > 0 AND step <= {A.DAY // 2})
    SELECT track, step AS nominal FROM r WHERE k = n // 2 + 1""", "reordered")
def nominal_duration(spark, d):
    """The upper median."""
    return P.nominal_duration(A.packets(spark, d, reordered=True), A.DAY // 2)


@query(f"""WITH s AS (SELECT *, pts - lag(pts) OVER (PARTITION BY track ORDER BY ix) AS step, lead(ix) OVER (PARTITION BY track ORDER BY ix) IS NULL AS last, first_value(pts) OVER (PARTITION BY track ORDER BY ix) AS first FROM packets),
    r AS (SELECT track, step, row_number() OVER (PARTITION BY track ORDER BY step) AS k, count(*) OVER (PARTITION BY track) AS n FROM s WHERE step > 0 AND step <= {A.DAY // 2} AND track % 2 = 0),
    nom AS (SELECT track, step AS nominal FROM r WHERE k = n // 2 + 1)
    SELECT track, ix, pts, CASE WHEN nominal IS NULL THEN pts ELSE first + ix * nominal END AS dts, coalesce(nominal, CASE WHEN last AND step >= 0 THEN step END, duration) AS duration, size, keyframe FROM s LEFT JOIN nom USING (track)""", "reordered")
def repaired_timing(spark, d):
    """tracks with even numbers stand for video."""
    p = A.packets(spark, d, reordered=True)
    return P.repaired(p, P.nominal_duration(p, A.DAY // 2).where("track % 2 = 0"))


@query("""WITH b AS (SELECT user_id AS track, event_id AS block, epoch_us(ts) // 1000 AS pts, 20 AS fd, event_id % 4 + 1 AS n, event_id AS e FROM events),
    f AS (SELECT track, block, k, pts + k * fd AS pts, fd, e % 97 + k AS size FROM (SELECT *, unnest(range(0, n)) AS k FROM b))
    SELECT track, row_number() OVER w - 1 AS ix, pts, CASE WHEN lead(pts) OVER w IS NULL THEN fd ELSE greatest(lead(pts) OVER w - pts, 0) END AS duration, size FROM f WINDOW w AS (PARTITION BY track ORDER BY block, k)""")
def laced_frames(spark, d):
    """each event as a block of one to four frames of 20 ms."""
    ev = A.table(spark, d, "events")
    sizes = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("event_id") % 4), lambda k: F.col("event_id") % 97 + k)
    return P.laced(ev.select(F.col("user_id").alias("track"), F.col("event_id").alias("block"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000").alias("pts"), F.lit(20).cast("bigint").alias("frame_duration"), sizes.alias("sizes")))


@query("""WITH s AS (SELECT track, ix, duration, (size % 7 - 3) * 1000000 AS o FROM packets),
    t AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY track ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS d FROM s),
    m AS (SELECT *, least(min(least(d, d + o)) OVER (PARTITION BY track), 0) AS shift FROM t)
    SELECT track, ix, d - shift AS dts, d + o - shift AS pts, duration FROM m""", "packets")
def normalised_timing(spark, d):
    """composition offsets of up to three thousand seconds either way."""
    p = A.packets(spark, d)
    return P.normalised(p.withColumn("offset", (F.col("size") % 7 - 3) * 1_000_000))


@query("""WITH c AS (SELECT DISTINCT track, chunk, chunk * 1000000 AS o, CASE WHEN chunk < 3 THEN 4 WHEN chunk < 8 THEN 2 ELSE 5 END AS per FROM (SELECT track, unnest(range(0, 12)) AS chunk FROM packets)),
    slots AS (SELECT track, chunk, o, row_number() OVER (PARTITION BY track ORDER BY chunk, k) - 1 AS ix FROM (SELECT *, unnest(range(0, per)) AS k FROM c))
    SELECT track, ix, chunk, (o + coalesce(sum(size) OVER (PARTITION BY track, chunk ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS source_offset, size FROM slots JOIN packets USING (track, ix)""", "packets")
def sample_offsets(spark, d):
    """chunks of four, then two, then five samples."""
    p = A.packets(spark, d)
    tracks = p.select("track").distinct()
    chunks = tracks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint")))).withColumn("offset", F.col("chunk") * 1_000_000)
    runs = tracks.withColumn("r", F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias("first_chunk"), F.lit(n).cast("bigint").alias("per_chunk")) for c, n in ((0, 4), (3, 2), (8, 5))]))).select("track", "r.*")
    return P.sample_offsets(p.select("track", "ix", "size"), chunks, runs)


@query("""WITH s AS (SELECT track AS segment, CASE WHEN keyframe THEN 'video' ELSE 'audio' END AS kind, ix, pts // 3600000 AS dts, pts // 7200000 AS pts FROM packets),
    k AS (SELECT *, row_number() OVER (PARTITION BY segment, kind ORDER BY ix) AS n FROM s),
    fold AS (SELECT segment, kind, ix, n, dts, pts, dts AS out_dts FROM k WHERE n = 1 UNION ALL SELECT k.segment, k.kind, k.ix, k.n, k.dts, k.pts, greatest(k.dts, f.out_dts + 1) FROM fold f JOIN k ON k.segment = f.segment AND k.kind = f.kind AND k.n = f.n + 1)
    SELECT segment, kind, ix, dts, pts, out_dts, greatest(pts, out_dts) AS out_pts FROM fold""", "reordered")
def sanitised_times(spark, d):
    """the closed form against the loop."""
    p = A.packets(spark, d, reordered=True)
    whole = lambda n: C.whole(F.col("pts"), F.lit(n))
    rows = p.select(F.col("track").alias("segment"), F.when(F.col("keyframe"), "video").otherwise("audio").alias("kind"), "ix", whole(3_600_000).alias("dts"), whole(7_200_000).alias("pts"))
    return P.sanitised(rows, F.col("dts"), F.col("pts"))


@query("""WITH r AS (SELECT track, ix, size, keyframe, duration * 90000 // 1000 AS d, (pts + (size % 5 - 2) * 1000) * 90000 // 1000 - pts * 90000 // 1000 AS o FROM packets),
    m AS (SELECT *, greatest(least(o, 2147483647), -2147483648) AS c FROM r)
    SELECT track, ix, greatest(d, 1) AS duration, size, c - least(min(c) OVER (PARTITION BY track), 0) AS cto, CASE WHEN keyframe THEN 33554432 ELSE 16842752 END AS flags FROM m""", "packets")
def fragment_samples(spark, d):
    """At 90,000 units a second, with presentation up to two seconds around decoding."""
    p = A.packets(spark, d).withColumn("dts", F.col("pts")).withColumn("pts", F.col("pts") + (F.col("size") % 5 - 2) * 1000)
    return P.fragment_samples(p, 1000, 90_000)


@query("""WITH f AS (SELECT track, ix, size % 1024 AS samples, coalesce(sum(size % 1024) OVER (PARTITION BY track ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + CASE WHEN track % 3 = 0 AND ix = 7 THEN 1 ELSE 0 END AS start_sample FROM packets)
    SELECT track, count(*) AS frames, min(ix) FILTER (track % 3 = 0 AND ix = 7) AS broken FROM f GROUP BY track""", "packets")
def contiguous_frames(spark, d):
    """every third track has a gap at its eighth frame."""
    from pyspark.sql import Window as W

    before = W.partitionBy("track").orderBy("ix").rowsBetween(W.unboundedPreceding, -1)
    p = A.packets(spark, d).withColumn("samples", F.col("size") % 1024)
    start = F.coalesce(F.sum("samples").over(before), F.lit(0)) + F.when((F.col("track") % 3 == 0) & (F.col("ix") == 7), 1).otherwise(0)
    return P.contiguous(p.withColumn("start_sample", start))


@query("""SELECT segment, track, ix, kind, dts, row_number() OVER (PARTITION BY segment ORDER BY dts, kind <> 'video', track, ix) - 1 AS place
    FROM (SELECT track % 5 AS segment, track, ix, CASE WHEN track % 2 = 0 THEN 'video' ELSE 'audio' END AS kind, pts // 86400000 AS dts FROM packets)""", "packets")
def interleaved(spark, d):
    """Days stand for milliseconds."""
    p = A.packets(spark, d)
    return P.interleaved(p.select((F.col("track") % 5).alias("segment"), "track", "ix", F.when(F.col("track") % 2 == 0, "video").otherwise("audio").alias("kind"), C.whole(F.col("pts"), F.lit(A.DAY)).alias("dts")))


@query("""WITH r AS (SELECT l_orderkey AS track, l_linenumber AS n, (l_partkey % 50) AS delta, (l_extendedprice * 100)::BIGINT AS b FROM lineitem),
    t AS (SELECT track, sum(n)::BIGINT AS samples, sum(n * delta)::BIGINT AS duration, min(delta) AS least, sum(b)::HUGEINT AS bytes FROM r GROUP BY track)
    SELECT track, samples, duration, CASE WHEN least > 0 THEN round(1000.0::DOUBLE / least, 6) END AS max_rate, CASE WHEN duration > 0 THEN (bytes * 8 * 1000 // duration)::BIGINT END AS bitrate FROM t""")
def track_rates(spark, d):
    """Lines stand for runs of samples."""
    li = A.table(spark, d, "lineitem")
    t = li.groupBy(F.col("l_orderkey").alias("track")).agg(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("n"), (F.col("l_partkey") % 50).alias("d"))).alias("r"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("bytes"))
    return P.rates(t.select("track", F.lit(1000).alias("scale"), "bytes", F.col("r.n").alias("counts"), F.col("r.d").alias("deltas")))


_SPAN_ROWS = "SELECT track, ix, ix * 5000 + CASE WHEN ix % 7 = 3 THEN -9000 ELSE size % 300 END AS o, 4800 + size % 150 AS s FROM packets WHERE size >= 0"


@query(f"""WITH p AS ({_SPAN_ROWS}),
    f AS (SELECT track, ix, 0 AS n, o AS a, o + s AS z, 1 AS c, s AS pay, true AS new FROM p WHERE ix = 0
      UNION ALL SELECT p.track, p.ix, CASE WHEN j THEN n ELSE n + 1 END, CASE WHEN j THEN a ELSE x.o END, x.o + x.s, CASE WHEN j THEN c + 1 ELSE 1 END, CASE WHEN j THEN pay + x.s ELSE x.s END, NOT j
      FROM (SELECT f.*, p.o, p.s, p.ix AS ix2, (f.z = p.o AND f.z - f.a = f.pay) OR (p.o - f.z BETWEEN 0 AND 256 AND greatest(f.z, p.o + p.s) - f.a <= 65536 AND greatest(f.z, p.o + p.s) - f.a <= 2 * (f.pay + p.s)) AS j FROM f JOIN p ON p.track = f.track AND p.ix = f.ix + 1) x JOIN p USING (track) WHERE p.ix = x.ix2)
    SELECT track, n AS span_ix, arg_max(a, ix) AS "offset", arg_max(z - a, ix) AS length, arg_max(c, ix) AS packets, arg_max(pay, ix) AS payload FROM f GROUP BY track, n""", "packets")
def read_spans(spark, d):
    """Packets of about 5,000 bytes laid out with small gaps, some out of order."""
    p = A.packets(spark, d).where("size >= 0")
    o = F.col("ix") * 5000 + F.when(F.col("ix") % 7 == 3, -9000).otherwise(F.col("size") % 300)
    return C.read_spans(p.select("track", "ix", o.alias("source_offset"), (4800 + F.col("size") % 150).alias("size")))
