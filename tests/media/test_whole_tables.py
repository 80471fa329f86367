"""Queries over all rows of their tables, against loops over those rows."""

from collections import defaultdict

import pytest

from cutlist.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("events", "orders")}


def rows_of(spark, name, *cols, sf=SF):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in catalog.QUERIES[name](spark, sf).select(*cols).collect())


def test_consensus_over_all_matches(spark, tables):
    of = defaultdict(lambda: ([], []))
    for r in tables["events"]:
        e = r.event_id
        s = e * 7919 % 100_000
        of[r.user_id][e % 2].append((e, s, s + 20_000 + e * 31 % 60_000, 0.85 + e % 15 / 100))
    want = {}
    for u, (a, b) in of.items():
        for i, s1, e1, q1 in sorted(a):
            for _, s2, e2, q2 in sorted(b):
                s, e, q = max(s1, s2), min(e1, e2), min(q1, q2)
                if e - s >= 15_000 and (e - s) / max(e1 - s1, e2 - s2) >= 0.8 and q >= 0.9:
                    want[u, s, e] = round(q, 6)
    assert want and rows_of(spark, "whole_peer_consensus", "source", "start_ms", "end_ms", "quality") == sorted((*k, q) for k, q in want.items())
    best = {}
    for (u, s, e), q in want.items():
        best[u] = min(best.get(u, (0, 0, 0, 0)), (s - e, -q, s, e))
    assert rows_of(spark, "whole_best_match", "source", "start_ms", "end_ms", "quality") == sorted((u, s, e, -q) for u, (_, q, s, e) in best.items())


def test_markers_and_references_over_all_rows(spark, tables):
    of = defaultdict(list)
    for r in tables["events"]:
        e = r.event_id
        s = e * 7919 % 1_000_000
        end, sure = s + (e % 13 - 1) * 9000, 0.85 + e % 17 / 100
        if 0.9 <= sure <= 1.0 and s < end <= 1_000_000:
            of[r.user_id].append((-sure, -(e % 3), e, s, end))
    assert rows_of(spark, "whole_valid_markers", "source", "ix") == sorted((u, m[2]) for u, ms in of.items() for m in ms)
    want = []
    for u, ms in of.items():
        kept = []
        for sure, _, _, s, e in sorted(ms):
            if len(kept) < 128 and all(s >= e2 or e <= s2 for s2, e2 in kept):
                kept.append((s, e))
                want.append((u, s, e, round(-sure, 6)))
    assert rows_of(spark, "whole_markers_without_overlaps", "source", "start_ms", "end_ms", "confidence") == sorted(want)
    seen = defaultdict(list)
    for r in tables["events"]:
        seen[r.user_id].append((r.event_id % 2, r.event_id))
    assert rows_of(spark, "whole_all_markers", "source", "ix", "start_ms") == sorted((u, k, e * 10) for u, es in seen.items() for k, (_, e) in enumerate(sorted(es)))
    refs = defaultdict(list)
    for r in tables["orders"]:
        refs[r.o_custkey].append(r.o_orderkey % 50)
    assert rows_of(spark, "whole_usable_references", "source", "usable") == sorted((c, len(x) <= 2 and len(x) == len(set(x)) and c not in x) for c, x in refs.items())


#: Texts with several lines, blank lines, tags, groups, one character, spaces at the ends or nothing.
TEXTS = ["one line", "two\nlines", "a\n\n b \n\n\nc\n", "x", "\n", "", None, "  both ends \t", "old\rmac\r\nwin", "<i>a</i> {\\an8}b\n<b>c", "-->\n7\n{a{b{c}}}d", " \n \t\nlast", "{open\nend", "a > b {x\ny} c"]


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    like = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = spark.createDataFrame([(k % 3, k // 3, t) for k, t in enumerate(TEXTS)], "conv_id long, turn long, text string")
    rows.selectExpr(*[f"CAST({c if c in rows.columns else 'NULL'} AS {like.schema[c].dataType.simpleString()}) AS {c}" for c in like.columns]).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def by_duck(name, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con.sql(catalog.ORACLE_SQL[name])


def test_subrip_round_trip_of_all_texts(spark, odd_texts):
    want = []
    for track in range(3):
        at, ix = 0, 0
        for t in TEXTS[track::3]:
            start, at = at, at + 50 * len(t or "")
            lines = [x.rstrip() for x in (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
            if text := "\n".join(x for x in lines if x):
                want.append((track, ix, start, at, text))
                ix += 1
    cols = ("track", "ix", "start_ms", "end_ms", "text")
    assert rows_of(spark, "whole_subrip_round_trip", *cols, sf=odd_texts) == sorted(want) == sorted(by_duck("whole_subrip_round_trip", odd_texts).select(*cols).fetchall())


def plain(text):
    out, deep, tag = "", 0, False
    for c in text:
        if tag:
            tag = c != ">"
        elif c == "{":
            deep += 1
        elif c == "}" and deep:
            deep -= 1
        elif c == "<" and not deep:
            tag = True
        elif not deep:
            out += c
    return "\n".join(x.strip() for x in out.replace("\r\n", "\n").split("\n") if x.strip())


def test_plain_texts_of_all_texts(spark, odd_texts):
    want = [(k % 3, k // 3, None if t is None else plain("<i>" + t + "</i>{\\pos{1}(2,3)}\n  " + t + " <b")) for k, t in enumerate(TEXTS)]
    got = [tuple(r) for r in catalog.QUERIES["whole_plain_texts"](spark, odd_texts).select("conv_id", "turn", "plain").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) == sorted(by_duck("whole_plain_texts", odd_texts).select("conv_id", "turn", "plain").fetchall(), key=repr)


def test_all_series_are_aligned_with_each_other(spark):
    from cutlist.sources import adapters

    series = defaultdict(dict)
    for r in adapters.fingerprints(spark, SF).collect():
        series[r.source][r.ix] = (r.t_ms, r.bits, r.voiced)
        if r.ix < 48:
            series[r.source + 1000][r.ix + 100] = ((r.ix + 100) * 400, r.bits, r.voiced)
    series = {s: f for s, f in series.items() if len(f) <= 8000 and len({b for _, b, v in f.values() if v}) >= 32}
    want = []
    for s, a in series.items():
        for p, b in series.items():
            votes = defaultdict(int)
            for i, (_, x, _) in a.items():
                for j, (_, y, _) in b.items():
                    if s != p and x >> 20 == y >> 20:
                        votes[j - i] += 1
            for shift in (k for k in votes if votes[k] > 1):
                ixs = [i for i in sorted(a) if i + shift in b]
                d = [(a[i][1] ^ b[i + shift][1]).bit_count() for i in ixs]
                near = [k for k in range(len(ixs)) if (w := d[max(0, k - 4) : k + 5]) and sum(w) / len(w) <= 6.4]
                runs = defaultdict(list)
                for n, k in enumerate(near):
                    runs[ixs[k] - n].append(k)
                for ks in runs.values():
                    start, end, score = a[ixs[ks[0]]][0], a[ixs[ks[-1]]][0], sum(d[k] for k in ks) / len(ks)
                    if 15_000 <= end - start <= 300_000 and score <= 3.2:
                        want.append((s, p, start, end, round(1 - score / 32, 6)))
    assert {s < 1000 for s, *_ in want} == {True, False}
    assert rows_of(spark, "repeated_intro", "source", "peer", "start_ms", "end_ms", "quality") == sorted(want)


def test_stamps_of_keys_beyond_thirty_days(spark, tmp_path):
    keys = [1, 5_184_000, 5_184_001, 9_000_003, 54_000_001]
    spark.createDataFrame([(k, k % 90) for k in keys], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.k: r.seconds for r in catalog.QUERIES["stamps"](spark, str(tmp_path)).collect()}
    assert got == {k: k * 500 for k in keys}


def test_folds_deal_rows_behind_a_join_by_the_same_keys(spark):
    """Such a join may turn into a broadcast as it runs, and then leaves rows as mappers do; a fold behind it must deal them itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["markers_without_overlaps"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" in plan[plan.index("MapInArrow") : plan.index("SortMergeJoin")]


def test_no_probes_are_told_to_all(spark):
    plan = catalog.QUERIES["refined_credits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
