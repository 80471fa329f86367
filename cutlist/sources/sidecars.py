"""Subtitle files beside media files: which belong to which, and their text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.names import extension

#: Extensions of sidecars; those whose text may be of the old Western encoding; those that must be UTF-8.
EXTENSIONS = ("srt", "vtt", "webvtt", "ass", "ssa", "ttml", "dfxp", "xml", "smi", "sami", "sub", "idx", "sup", "scc", "txt", "sbv")
WESTERN = ("srt", "smi", "sami", "ass", "ssa", "sub", "txt", "sbv")
UTF8_ONLY = ("vtt", "webvtt", "scc")
MOST_FILES, HEADER = 32, 8192
_DECLARED = {"xml": re.compile(r"""<\?xml[^>]*\bencoding\s*=\s*["']([\w.:-]+)"""), "html": re.compile(r"""<meta[^>]*\bcharset\s*=\s*["']?([\w.:-]+)""", re.I)}
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def found(media: DataFrame, files: DataFrame) -> DataFrame:
    """(media, path, ix, extension, language): files of a media file's folder with its name, or its name and a dot and more.

    Case does not matter. A .sub file is left to an .idx of the same name. The first 32 by path count.
    The join is on folder and on every beginning of a file's name that ends before a dot.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*/)?[^/]*$", 1)
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", ""))
    m = media.select(F.col("path").alias("media"), folder("path").alias("folder"), stem("path").alias("begin"))
    f = files.select("path", folder("path").alias("folder"), stem("path").alias("stem"), extension(F.col("path")).alias("extension")).where(F.col("extension").isin(*EXTENSIONS))
    pairs = f.where("extension = 'idx'").select("folder", "stem", F.lit("sub").alias("extension")).distinct()
    f = f.join(pairs, ["folder", "stem", "extension"], "left_anti")
    words = F.split("stem", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), "."))
    joined = f.withColumn("begin", F.explode(begins)).join(m, ["folder", "begin"])
    # a name that fits a longer media name belongs to that one too, as the rule asks for each media file by itself
    rest = F.substring("stem", F.length("begin") + 2, F.length("stem"))
    language = F.when(F.regexp_like(rest, F.lit(r"^[a-z]{2,3}(-[a-z0-9]+)*(\.|$)")), F.regexp_extract(rest, r"^([a-z]{2,3}(?:-[a-z0-9]+)*)", 1))
    ix = F.row_number().over(W.partitionBy("media").orderBy("path")) - 1
    return joined.select("media", "path", ix.cast("bigint").alias("ix"), "extension", language.alias("language")).where(F.col("ix") < MOST_FILES)


def text_of(kind: str, raw: bytes) -> tuple[str | None, str | None]:
    """Text of a file and None, or None and why not: by mark, by declaration, as UTF-8, or for some kinds as Western text."""
    mark, name = next(((m, n) for m, n in _MARKS if raw.startswith(m)), (b"", None))
    if name and name != "utf-8" and kind in UTF8_ONLY:
        return None, "needs UTF-8"
    body = raw[len(mark) :]
    head = body[:HEADER].decode(name, "replace") if name else "".join(chr(b) if b < 128 else "?" for b in body[:HEADER])
    pattern = _DECLARED["xml"] if kind in ("ttml", "dfxp", "xml") else _DECLARED["html"] if kind in ("smi", "sami") else None
    said = {x.lower() for x in pattern.findall(head)} if pattern else set()
    if len(said) > 1:
        return None, "conflicting declarations"
    declared = next(iter(said), None)
    if name and declared and not declared.replace("_", "-").startswith(name[:6]):
        return None, "mark and declaration differ"
    if not name and declared and declared.startswith("utf-16"):
        return None, "UTF-16 needs a mark"
    try:
        text = body.decode(name or declared or "utf-8")
    except (LookupError, UnicodeDecodeError):
        if name or declared or kind not in WESTERN:
            return None, "cannot be decoded"
        text = body.decode("cp1252", "replace")
    return (None, "null characters") if "\0" in text else (None, "needs ASCII") if kind == "scc" and not text.isascii() else (text, None)


def decoded(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, text, error): one row a file; errors are rows, not failures."""

    def run(batches):
        for b in batches:
            kinds = [(p or "").rsplit(".", 1)[-1].lower() for p in b.column(0).to_pylist()]
            both = [text_of(k, raw or b"") for k, raw in zip(kinds, b.column(1).to_pylist())]
            if both:
                texts, errors = zip(*both)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")
