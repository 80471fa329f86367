"""From raw documents to a training mix, in five stages; each takes (spark, docs, sf_dir) and returns documents.

Stages end in tables of the shared folder, so that none is computed twice and a lost
executor costs no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutlist.llm import gbt, minhash, mixing, suffix, wumanber
from cutlist.llm._text import materialised
from cutlist.llm.queries import residue, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from two thirds of the labelled ids.

    Null and empty texts are scored as empty; repeated rows stay or go together; documents without id are scored like any other.
    """
    trees = gbt.learn(docs.where(residue(3) != 1), table(spark, sf_dir, "labels").where(residue(3) != 1))
    return gbt.score(docs, trees, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, a null id before all others.

    Null and empty texts are near nothing and stay; of equal rows one stays, and rows that share an id but not a text are documents of their own.
    """
    return minhash.without_near_duplicates(docs).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 100-byte strings that stand earlier in the corpus; lengths follow the text.

    Null text becomes empty; a character of which only a part is left goes whole. Of rows equal in id and text one keeps its text.
    """
    others = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    found = suffix.dedup(docs, keep=tuple(c for c in others if c != "doc_id"), with_text=True)
    return found.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item, nor a whole shorter item.

    Null and empty texts hold nothing and stay; items without id count, items without words do not; repeated rows stay or go together.
    """
    return wumanber.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).where("NOT contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; `copy` counts from 0.

    A null source is a source of its own; documents without words come as often as their source's whole copies; rows equal in id, source and size are taken alike.
    """
    found = mixing.pareto_mix(docs, keep=("text", "lang", "source", "n_chars"))
    return found.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).select(*COLUMNS, "copy")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontaminate", decontaminate), ("mix", mix)]

#: Trees and trained scores have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each on what the one before it kept; no documents give no rows."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
