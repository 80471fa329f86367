"""Queries of functions.timing, functions.names and functions.codecs over numbers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, timing as T
from ..sources import adapters as A
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_Q = "(n * t)::HUGEINT"
_RESCALE = f"""SELECT l_orderkey, l_linenumber, n, s, t, {{}} FROM (SELECT l_orderkey, l_linenumber, (l_extendedprice * 100)::BIGINT - 3000000 AS n, l_partkey % 7 * 1001 AS s, l_suppkey % 5 * 90000 AS t FROM lineitem)"""


def _numbers(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.round(F.col("l_extendedprice") * 100).cast("bigint") - 3_000_000).alias("n"), (F.col("l_partkey") % 7 * 1001).alias("s"), (F.col("l_suppkey") % 5 * 90_000).alias("t"))


_BAD = "s = 0 OR t = 0"


@query(_RESCALE.format(f"""CASE WHEN {_BAD} THEN NULL ELSE trunc_q END AS truncate, CASE WHEN {_BAD} THEN NULL WHEN r < 0 THEN trunc_q - 1 ELSE trunc_q END AS floor, CASE WHEN {_BAD} THEN NULL WHEN r > 0 THEN trunc_q + 1 ELSE trunc_q END AS ceil,
    CASE WHEN {_BAD} THEN NULL WHEN 2 * abs(r) >= s THEN trunc_q + sign(r)::BIGINT ELSE trunc_q END AS nearest""").replace("FROM (SELECT", "FROM (SELECT *, CASE WHEN s = 0 THEN 0 ELSE (n * t) // s END AS trunc_q, CASE WHEN s = 0 THEN 0 ELSE (n * t) % s END AS r FROM (SELECT").replace("FROM lineitem)", "FROM lineitem))"))
def rescaled(spark, d):
    """All roundings, with scales of 0."""
    rows = _numbers(spark, d)
    return rows.withColumns({r: T.rescale(F.col("n"), F.col("s"), F.col("t"), r) for r in T.ROUNDINGS})


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s = 0 THEN 0 ELSE n * 1000 // s END AS millis, CASE WHEN s = 0 THEN 0 ELSE (n * t + s // 2) // s END AS half_up, n * s * 1000 // 1000000 AS ticks
    FROM (SELECT l_orderkey, l_linenumber, (l_extendedprice * 100)::BIGINT AS n, l_partkey % 7 * 1001 AS s, l_suppkey % 5 * 90000 AS t FROM lineitem)""")
def millis(spark, d):
    """I02, I04, I05, I06, I07."""
    rows = _numbers(spark, d).withColumn("n", F.col("n") + 3_000_000)
    return rows.select("l_orderkey", "l_linenumber", T.to_millis(F.col("n"), F.col("s")).alias("millis"), T.rescale_half_up(F.col("n"), F.col("s"), F.col("t")).alias("half_up"), T.matroska_millis(F.col("n"), F.col("s") * 1000).alias("ticks"))


@query("""WITH o AS (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS ms FROM orders) SELECT o_orderkey, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, printf('%d:%02d:%02d.%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000 // 10) AS ass FROM o""")
def clocks(spark, d):
    """I12."""
    ms = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return A.table(spark, d, "orders").select("o_orderkey", T.clock(ms).alias("clock"), T.ass_clock(ms).alias("ass"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS h, o_custkey % 62 AS m, (o_orderkey // 7) % 61 AS s, (o_orderkey // 11) % 31 AS f, o_orderkey % 2 = 0 AS drop_ FROM orders),
    n AS (SELECT *, ((h * 60 + m) * 60 + s) * 30 + f - CASE WHEN drop_ THEN 2 * (h * 60 + m - (h * 60 + m) // 10) ELSE 0 END AS frame, m > 59 OR s > 59 OR f > 29 OR (drop_ AND s = 0 AND f < 2 AND m % 10 <> 0) AS bad FROM o)
    SELECT o_orderkey, CASE WHEN NOT bad THEN frame END AS frame, CASE WHEN NOT bad THEN (frame * 1001 + 15) // 30 END AS ms FROM n""")
def scc_times(spark, d):
    """I08."""
    k = F.col("o_orderkey")
    whole = lambda n: ((k - k % n) / n).cast("bigint")
    stamp = F.concat(F.format_string("%02d:%02d:%02d", k % 3, F.col("o_custkey") % 62, whole(7) % 61), F.when(k % 2 == 0, ";").otherwise(":"), F.format_string("%02d", whole(11) % 31))
    frame = T.scc_frame(stamp)
    return A.table(spark, d, "orders").select("o_orderkey", frame.alias("frame"), T.frames_to_millis(frame).alias("ms"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), ''), 'subtitle') AS safe, replace(replace(url || '"\', '\', '\\'), '"', '\"') AS escaped, nullif(lower(regexp_extract(url, '[^/.][^/]*\.([^./]+)$', 1)), '') AS extension FROM pages""")
def safe_names(spark, d):
    """J15, J16, C05."""
    return A.table(spark, d, "pages").select("page_id", names.safe_component(F.col("url"), "subtitle").alias("safe"), names.escape_attribute(F.concat("url", F.lit('"\\'))).alias("escaped"), names.extension(F.col("url")).alias("extension"))


@query("""WITH p AS (SELECT o_orderkey, o_custkey * 37 % 32768 AS x FROM orders), l AS (SELECT *, x // 1024 % 32 AS a, x // 32 % 32 AS b, x % 32 AS c FROM p)
    SELECT o_orderkey, CASE WHEN x <> 0 AND x <> 21956 AND a BETWEEN 1 AND 26 AND b BETWEEN 1 AND 26 AND c BETWEEN 1 AND 26 THEN chr((a + 96)::INT) || chr((b + 96)::INT) || chr((c + 96)::INT) END AS language FROM l""")
def packed_languages(spark, d):
    """J19."""
    return A.table(spark, d, "orders").select("o_orderkey", names.language_of((F.col("o_custkey") * 37 % 32_768).cast("int")).alias("language"))


@query("""WITH u AS (SELECT page_id, lower(regexp_extract(url, '([^/?]*)(\\?|$)', 1)) AS stem, CASE page_id % 3 WHEN 0 THEN 'sub' WHEN 1 THEN 'idx' ELSE 'srt' END AS ext FROM pages)
    SELECT page_id, stem, ext FROM u a WHERE NOT (ext = 'sub' AND EXISTS (SELECT 1 FROM u b WHERE b.stem = a.stem AND b.ext = 'idx'))""")
def sidecars(spark, d):
    """The last part of each url as a file of one of three kinds; a .sub with an .idx beside it is left to that one."""
    u = A.table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"([^/?]*)(\?|$)", 1)).alias("stem"), F.element_at(F.array(F.lit("sub"), F.lit("idx"), F.lit("srt")), (F.col("page_id") % 3 + 1).cast("int")).alias("ext"))
    paired = u.where("ext = 'idx'").select("stem", F.lit("sub").alias("ext")).distinct()
    return u.join(paired, ["stem", "ext"], "left_anti").select("page_id", "stem", "ext")
