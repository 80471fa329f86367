"""Archives, embeddings, components and the pipeline."""

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest

from cutlist.llm import ego, graph, warc
from cutlist.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("wide", [False, True])
def test_archives_round_trip(spark, wide):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/ b\n", big), (2, None, big), (9, "x", big), (4, "y", "small"), (5, "z", "small"), (6, None, None), (7, "q", ""), (None, "n", big + "!"), (9, "x", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS size")
    got = warc.archive_and_read(pages, wide=wide, roll_bytes=600).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = i in (1, 2)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(r.digest_ok for r in got)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_members_are_those_that_zipfile_sees(wide):
    out = io.BytesIO()
    z = warc.ZipWriter(out, wide)
    for name, body in (("archive/data.warc.gz", b"abc" * 50), ("indexes/ü.cdx", b"")):
        z.begin(name)
        z.write(body)
        z.end()
    z.close()
    raw = out.getvalue()
    seen = zipfile.ZipFile(io.BytesIO(raw))
    assert seen.testzip() is None
    for name, (at, size, _) in warc.members(io.BytesIO(raw), len(raw)).items():
        assert raw[at : at + size] == seen.read(name)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as f:
        f.writestr("stored", b"x" * 100)
        f.writestr(zipfile.ZipInfo("packed"), b"y" * 100, zipfile.ZIP_DEFLATED)
        f.comment = b"PK\x05\x06 a note"
    raw = other.getvalue()
    assert list(warc.members(io.BytesIO(raw), len(raw))) == ["stored"]
    for broken in (b"", raw[:-40], raw[60:]):
        with pytest.raises(ValueError):
            warc.members(io.BytesIO(broken), len(broken))


@pytest.mark.parametrize("block", [16, 4096])
def test_epsilon_join(spark, monkeypatch, block):
    monkeypatch.setattr(ego, "LEAF", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + rng.normal(size=(150, 16)) * 0.25, rng.normal(size=(60, 16))]).astype(np.float32)
    vectors = [v.tolist() for v in x] + [x[0].tolist()] * 3 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1e30] * 16, [1e-30] * 16, [1.0, 2.0]]
    ids = list(range(len(vectors)))
    ids[5] = ids[4]
    df = spark.createDataFrame(list(zip(ids, vectors, [1] * len(ids))), "vec_id long, embedding array<float>, cid int")
    ok = [i for i, v in enumerate(vectors) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {i: np.array(vectors[i], np.float32).astype(float) for i in ok}
    unit = {i: v / np.abs(v).max() for i, v in unit.items()}
    root = {i: i for i in range(len(vectors))}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.9:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    low = {}
    for i in root:
        low[find(i)] = min(low.get(find(i), 10**9), ids[i])
    want = sorted((ids[i], links[i], low[find(i)], ids[i] == low[find(i)]) for i in root)
    assert sorted(tuple(r) for r in ego.epsilon_join(df, block=block).collect()) == want
    assert ego.epsilon_join(df.limit(0)).count() == 0



def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    """Blocks meet in a product that reads their table; screening in single precision loses no link."""
    plans, own = {}, ego.materialised
    monkeypatch.setattr(ego, "materialised", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and own(df, name))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 32)).astype(np.float32)
    x[200:] = x[:100] + rng.normal(size=(100, 32)).astype(np.float32) * 0.45
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert 20 < want.sum() < 190
    got = ego.epsilon_join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), block=32)
    assert {r.vec_id: r.n_links for r in got.collect()} == dict(enumerate(want.tolist()))
    assert "CartesianProduct" in plans["ego-links"] and "Exchange" not in plans["ego-links"]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 200), 100 + rng.randint(0, 200)) for _ in range(120)] + [(5, 5), (3, 2)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in linked)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def compared(spark, name, sql):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    own = con.sql(sql)
    names = list(own.columns)
    assert sorted(names) == sorted(df.columns)
    fixed = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    return sorted(map(repr, (fixed(r) for r in df.select(*names).collect()))), sorted(map(repr, (fixed(r) for r in own.fetchall())))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    got, want = compared(spark, name, ORACLE_SQL[name])
    assert got == want


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, None, None)], docs.schema))
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES:
        before = docs
        docs = p.materialised(stage(spark, before, SF), f"test-{name}")
        assert {r.doc_id for r in docs.collect()} <= ids and list(docs.columns)[:5] == list(p.COLUMNS)
        if name != "mix":
            assert docs.schema.simpleString() == before.schema.simpleString()
        if name == "near_duplicates":
            from cutlist.llm import minhash

            assert minhash.public(minhash.near_duplicates(docs)).where("NOT kept").count() == 0
        if name == "repeated_strings":
            assert docs.count() == before.count()
    assert docs.count() > 0
    empty = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", ["op1_language_id", "op9_quality"])
def test_held_out_accuracy(spark, name):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).where("held_out")
    if name == "op1_language_id":
        truth = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
        pairs = [(r.lang, r.lang_pred) for r in got.join(truth, "doc_id").collect()]
    else:
        truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
        pairs = [(r.quality, r.predicted) for r in got.join(truth, "doc_id").collect()]
    assert len(pairs) > 50 and sum(a == b for a, b in pairs) / len(pairs) > 0.95
