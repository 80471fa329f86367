"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target in words (weights shared over its sources, capped at a
multiple of the source, the excess shared again). Of target / size, the whole part
is that many certain copies of every document. What remains of the target is drawn
with unequal probabilities: a document's inclusion is in proportion to its words, so
that the expected words are the remaining target; the longest ones, whose inclusion
would pass 1, are certain and taken first. A document with uniform number u and
inclusion f has the Pareto rank (u / (1 - u)) / (f / (1 - f)), and documents are taken
by rank until their words come as near to what is left as whole documents allow.

Ranks are summed in two levels, so a source that holds a third of all rows is never
in one task: words are added up by (source, rank bucket) with partial aggregation,
prefix sums run over buckets, then over the rows of each bucket by itself. Inclusion is
found from the number of documents of each size, one row for each size of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._text import materialised

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str) -> Column:
    """In (0, 1), the same on every run and machine: 52 bits of md5(id|seed)."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit("|" + seed))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(2**52)


def bucket(q: Column, part: Column, buckets: int) -> Column:
    """Bucket of a rank, in order of q; q times the source's mean odds spreads over all buckets whatever the odds."""
    scaled = q * part / (1 - part)
    return F.least(F.floor(scaled / (1 + scaled) * buckets), F.lit(buckets - 1)).cast("int")


def inclusion(sizes: DataFrame) -> DataFrame:
    """(skey, size, n, need) -> (skey, pull, left): a document of size s is included with min(1, pull * s).

    From the longest size on, documents are certain as long as the need that they leave, spread over the rest in
    proportion to size, would include the next with 1 or more; `left` is what the others have to give.
    """
    down = W.partitionBy("skey").orderBy(F.desc("size"))
    squares = F.col("size").cast("decimal(12,0)") * F.col("size").cast("decimal(12,0)") * F.col("n").cast("decimal(12,0)")
    left = F.col("need") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = sizes.withColumn("left", left).withColumn("pull", left / F.sum(squares).over(down.rowsBetween(0, W.unboundedFollowing)).cast("double"))
    open_ = F.col("pull") * F.col("size") < 1
    return found.where(open_).groupBy("skey").agg(F.max_by("pull", "size").alias("pull"), F.max_by("left", "size").alias("left"))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(skey, source, source_size) -> the same with target: one row a source.

    Sources in code point order, null last, weigh `weights`, repeating. The level of the
    capped shares is found in closed form: in order of cap / weight, the first source
    whose cap lies above its share of what the capped ones before it leave. The windows
    run over one row a source, not over documents.
    """
    n = len(weights)
    all_rows = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    fill = W.orderBy("ratio", "place")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", place)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows) * F.lit(share))
        .withColumn("left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.col("left"))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("ratio", "place"))).over(all_rows))
    )
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))).select("skey", "source", "source_size", "target")


#: At most so many sources are broadcast (some 100 bytes each); beyond it the plan is joined by key.
BROADCAST_SOURCES = 50_000


def pareto_mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
    weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", buckets: int = 4096,
) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies, and the columns of `keep`.

    Null or empty text has size 0 and takes 0 words. A null source is a source of its own.
    Rows that repeat an id have one u and ranks by their sizes; rows equal in id, source and
    size are taken alike. A null id is drawn by the text. Texts of any length are counted whole.
    No rows give no rows. Columns other than the named ones are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("did"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    base = base.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).withColumn("u", uniform(F.col("did"), seed))
    narrow = materialised(base.select("doc_id", "source", "size", "skey", "u", "did"), "mix-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = source_targets(narrow.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = plan.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    plan = materialised(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).drop("source", "rate"), "mix-plan")
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    sizes = narrow.where("size > 0").groupBy("skey", "size").agg(F.count("*").alias("n")).join(small(plan.where("part > 0").select("skey", "need")), "skey")
    plan = materialised(plan.join(inclusion(sizes), "skey", "left"), "mix-inclusion")
    # null where a document is certain or has no words
    f = F.col("pull") * F.col("size")
    rank = F.when((f > 0) & (f < 1), F.col("u") / (1 - F.col("u")) * (1 - f) / f)
    rows = narrow.join(small(plan.where("pull > 0").select("skey", "part", "pull")), "skey").withColumn("q", rank).where("q IS NOT NULL").withColumn("bucket", bucket(F.col("q"), F.col("part"), buckets))
    upto = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    inside = W.partitionBy("skey", "bucket").orderBy("q", "did", "size").rowsBetween(W.unboundedPreceding, -1)
    # only the bucket in which the words run out has to be looked into
    last = sums.join(small(plan.select("skey", "left")), "skey").where(F.col("before") < F.col("left")).groupBy("skey", "left").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("b")).select("skey", "left", "b.bucket", "b.before")
    taken = rows.join(small(last), ["skey", "bucket"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).where(F.col("ahead") + F.col("size") / 2.0 < F.col("left"))
    cut = taken.groupBy("skey").agg(F.max(F.struct("q", "did", "size")).alias("cut"))
    plan = materialised(plan.join(last.select("skey", "bucket"), "skey", "left").join(cut, "skey", "left"), "mix-cut")

    source = base if keep else narrow
    by_rank = F.coalesce(bucket(F.col("q"), F.col("part"), buckets) < F.col("bucket"), F.lit(False)) | F.coalesce(F.struct("q", "did", "size") <= F.col("cut"), F.lit(False))
    extra = F.when(F.col("q").isNotNull(), by_rank).otherwise(F.coalesce(f >= 1, F.lit(False)))
    out = source.join(small(plan), "skey").withColumn("q", rank).withColumn("copies", F.col("whole") + extra.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
