"""Sidecar files, their text, and budgets."""

from dataclasses import astuple, fields

from cutlist.operators import budgets
from cutlist.sources import sidecars


def test_which_files_belong(spark):
    media = spark.createDataFrame([("/m/Movie.mkv",), ("/m/Movie.Extra.mkv",), ("/n/Movie.mkv",)], "path string")
    paths = ["/m/movie.srt", "/m/MOVIE.en.forced.ass", "/m/Movie.sub", "/m/Movie.idx", "/m/Movies.srt", "/m/Movie.extra.pt-br.vtt", "/m/Movie.txt.bak", "/n/movie.sub", "/o/movie.srt"]
    got = [(r.media, r.path, r.extension, r.language) for r in sidecars.found(media, spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("media", "ix").collect()]
    assert got == [
        ("/m/Movie.Extra.mkv", "/m/Movie.extra.pt-br.vtt", "vtt", "pt-br"),
        ("/m/Movie.mkv", "/m/MOVIE.en.forced.ass", "ass", "en"), ("/m/Movie.mkv", "/m/Movie.extra.pt-br.vtt", "vtt", None), ("/m/Movie.mkv", "/m/Movie.idx", "idx", None), ("/m/Movie.mkv", "/m/movie.srt", "srt", None),
        ("/n/Movie.mkv", "/n/movie.sub", "sub", None)]


def test_decoding(spark):
    xml = '<?xml version="1.0" encoding="iso-8859-1"?><tt>é</tt>'
    files = {"a.srt": "é".encode(), "b.srt": "é".encode("cp1252"), "c.vtt": "é".encode("cp1252"), "d.srt": b"\xff\xfe" + "é".encode("utf-16-le"), "e.vtt": b"\xff\xfe" + "é".encode("utf-16-le"), "f.ttml": xml.encode("latin-1"), "g.ttml": b"\xef\xbb\xbf" + xml.encode(), "h.srt": b"a\0b", "i.scc": "é".encode(), "j.srt": b"\xef\xbb\xbfx", "k.srt": None}
    got = {r.path: r.text if r.error is None else r.error for r in sidecars.decoded(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    assert got == {"a.srt": "é", "b.srt": "é", "c.vtt": "cannot be decoded", "d.srt": "é", "e.vtt": "needs UTF-8", "f.ttml": xml, "g.ttml": "mark and declaration differ", "h.srt": "null characters", "i.scc": "needs ASCII", "j.srt": "x", "k.srt": ""}


def test_policies_and_first_errors(spark):
    from pyspark.sql import functions as F

    made = [budgets.Policy(100, 200, 10, 20, 20, 20, 30), budgets.Policy(99, 200, 10, 20, 20, 20, 30), budgets.Policy(100, 90, 10, 20, 20, 20, 30), budgets.Policy(100, 200, 0, 20, 20, 20, 30), budgets.Policy(100, 200, 10, 20, 20, 20, 30, threads=65)]
    want = [None, "sum", "sum", "ceiling", "capacity"]
    assert [p.problem() for p in made] == want
    df = spark.createDataFrame([(i, *astuple(p)) for i, p in enumerate(made)], ["i", *[f.name for f in fields(budgets.Policy)]])
    assert [r[0] for r in df.orderBy("i").select(budgets.policy_problem(F.struct("*"))).collect()] == want
    df = spark.createDataFrame([(1, 5, 5), (2, 50, 500), (3, 5, 500)], "k int, a long, b long")
    got = budgets.checked(df, "plan", [("first", F.col("a"), 10), ("second", F.col("b"), 100)]).orderBy("k").collect()
    assert [r.error and (r.error.resource, r.error.requested, r.error.allowed) for r in got] == [None, ("first", 50, 10), ("second", 500, 100)]
