"""Stand-ins that give the driver's tables the shapes of media tables; they are not media.

Each adapter has an equal in SQL, under the same name, in `SQL`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

DAY = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str, reordered: bool = False) -> DataFrame:
    """events as packets: track, ix in decode order, pts and duration in milliseconds, size, keyframe.

    `reordered` shuffles decode order a little, as pictures that refer forward do. A packet lasts
    until the next one; the last repeats the one before it; the only packet of a track lasts 0.
    """
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), "event_id",
        F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000").alias("pts"),
        F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint").alias("size"),
        F.col("event_type").isin("signup", "purchase").alias("keyframe"),
    )
    order = [F.col("event_id") + 7 * (F.col("event_id") % 3), F.col("event_id")] if reordered else [F.col("pts"), F.col("event_id")]
    by = W.partitionBy("track").orderBy(*order)
    later = F.lead("pts").over(by) - F.col("pts")
    before = F.col("pts") - F.lag("pts").over(by)
    return ev.select("track", (F.row_number().over(by) - 1).cast("bigint").alias("ix"), "pts", F.greatest(F.coalesce(later, before, F.lit(0)), F.lit(0)).alias("duration"), "size", "keyframe")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tracks: source, ix, kind, codec, is_default, language."""
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    li = table(spark, sf_dir, "lineitem").withColumn("ix", (F.row_number().over(by) - 1).cast("bigint"))
    kind = F.when(F.col("ix") == 0, "video").when(F.col("l_returnflag") == "R", "subtitle").otherwise("audio")
    pick = {k: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("l_partkey") % len(v) + 1).cast("int")) for k, v in KINDS.items()}
    codec = F.when(kind == "video", pick["video"]).when(kind == "audio", pick["audio"]).otherwise(pick["subtitle"])
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "ja", "fr", None)]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("source"), "ix", kind.alias("kind"), codec.alias("codec"), (F.col("l_linestatus") == "F").alias("is_default"), lang.alias("language"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as subtitle cues: track, ix, start_ms, end_ms, text; a turn lasts 50 ms a character."""
    long = F.length(F.coalesce("text", F.lit(""))).cast("bigint") * 50
    by = W.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(by) - 1).cast("bigint").alias("ix"), (F.sum(long).over(by.rowsBetween(W.unboundedPreceding, 0))).alias("end_ms"), long.alias("d"), "text")
    return c.select(F.col("conv_id").alias("track"), "ix", (F.col("end_ms") - F.col("d")).alias("start_ms"), "end_ms", "text")


def observations(spark: SparkSession, sf_dir: str, at_least: float = 50.0) -> DataFrame:
    """events as visual observations: source, time_ms, text_like."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("source"), "event_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000").alias("time_ms"), F.coalesce(F.col("value") >= at_least, F.lit(False)).alias("text_like"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as acoustic fingerprints: source, ix, t_ms, bits (signs of the first 32 components), voiced."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL")
    signs = F.transform(F.slice("embedding", 1, 32), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    ix = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("bigint").alias("source"), ix.cast("bigint").alias("ix"), (ix * 400).cast("bigint").alias("t_ms"), F.aggregate(signs, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bits"), (F.col("embedding")[32] > -0.3).alias("voiced"))


#: Fixed values of the stand-ins: codec labels by kind.
KINDS = {
    "video": ("h264", "hevc", "av1", "vp9", "mpeg2"),
    "audio": ("aac", "ac3", "eac3", "dca", "truehd", "flac", "opus", "mp3", "vorbis"),
    "subtitle": ("subrip", "hdmv_pgs_subtitle", "mov_text", "ttml"),
}


def _packets_sql(order: str) -> str:
    return f"""SELECT track, ix, pts, greatest(coalesce(lead(pts) OVER w - pts, pts - lag(pts) OVER w, 0), 0) AS duration, size, keyframe FROM (
        SELECT user_id AS track, event_id, epoch_us(ts) // 1000 AS pts, round(coalesce(value, 0.0) * 100)::BIGINT AS size, event_type IN ('signup', 'purchase') AS keyframe,
               row_number() OVER (PARTITION BY user_id ORDER BY {order}) - 1 AS ix FROM events) WINDOW w AS (PARTITION BY track ORDER BY ix)"""


def _case(kind: str) -> str:
    v = KINDS[kind]
    return "CASE l_partkey % " + str(len(v)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v)) + " END"


SQL = {
    "packets": _packets_sql("epoch_us(ts) // 1000, event_id"),
    "reordered": _packets_sql("event_id + 7 * (event_id % 3), event_id"),
    "tracks": f"""SELECT source, ix, kind, CASE kind WHEN 'video' THEN v WHEN 'audio' THEN a ELSE s END AS codec, is_default, language FROM (
        SELECT l_orderkey AS source, ix, CASE WHEN ix = 0 THEN 'video' WHEN l_returnflag = 'R' THEN 'subtitle' ELSE 'audio' END AS kind,
               {_case("video")} AS v, {_case("audio")} AS a, {_case("subtitle")} AS s, l_linestatus = 'F' AS is_default,
               CASE l_suppkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'fr' END AS language FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) - 1 AS ix FROM lineitem))""",
    "cues": """SELECT conv_id AS track, ix, end_ms - d AS start_ms, end_ms, text FROM (
        SELECT conv_id, row_number() OVER w - 1 AS ix, (sum(d) OVER w)::BIGINT AS end_ms, d, text FROM (SELECT *, length(coalesce(text, '')) * 50 AS d FROM conversations)
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "observations": "SELECT user_id AS source, event_id, epoch_us(ts) // 1000 AS time_ms, coalesce(value >= 50.0, false) AS text_like FROM events",
    "fingerprints": "SELECT label::BIGINT AS source, ix, ix * 400 AS t_ms, (" + " + ".join(f"CASE WHEN embedding[{k + 1}] > 0 THEN {1 << k} ELSE 0 END" for k in range(32)) + ")::BIGINT AS bits, embedding[33] > -0.3 AS voiced FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ix FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)",
}
