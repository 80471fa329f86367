"""Collisions, missing ids, work that must come through the named method, memory, and whole stages against brute force."""

import hashlib
import json
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cutlist.llm import _text, anchors, gbt, langid, licenses, minhash, mixing, phrases, suffix, wumanber

from .test_text_operators import DOCS, bench_words, brute_components, docs, rows_of, split  # noqa: F401

SF = "/root/testdata/sf0.001"


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


def test_words_that_cancel_out_in_linear_hashes_differ(docs):  # noqa: F811
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    tail = " ".join(f"w{k}" for k in range(34))
    data = [(1, x, None, None, None), (2, y, None, None, None), (3, f"{x} {tail}", None, None, None), (4, f"{y} {tail}", None, None, None)]
    buf = np.frombuffer((x + y).encode(), np.uint8)
    h = _text.word_hashes(buf, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1] and len(set(_text.windows(_text.word_hashes(buf, np.arange(2048), np.arange(2048) + 1), 1024)[[0, 1024]].tolist())) == 2
    assert {r.doc_id: r.component_id for r in minhash.public(minhash.near_duplicates(docs(data))).collect()}[2] == 2
    assert {r.n_removed for r in phrases.dedup(docs(data)).collect()} == {0}


def test_documents_without_id_lose_nothing(docs):  # noqa: F811
    rng = random.Random(1)
    unique = [(None, " ".join(str(rng.random()) for _ in range(14)), None, None, None) for _ in range(5000)]
    copies = [(None, " ".join(f"c{k}x{j}" for j in range(40)), None, None, None) for k in range(100)] * 2
    data = docs(unique + copies).repartition(8)
    own = {t for _, t, *_ in unique}
    sizes = {hashlib.sha256(t.encode()).hexdigest() for t in own}
    found = suffix.dedup(data).collect()
    assert len(found) == 5200 and sizes <= {r.kept_sha256 for r in found} and sum(r.n_removed > 0 for r in found) == 100
    found = phrases.dedup(data).collect()
    assert sum(r.n_removed > 0 for r in found) == 200 and all(r.n_removed in (0, 40) for r in found)
    left = [r.text for r in minhash.without_near_duplicates(data).collect()]
    assert len(left) == 5100 and own <= set(left)


def test_rows_of_one_id_are_documents_of_their_own(docs):  # noqa: F811
    data = docs([(7, f"{k} " + " ".join(str(k * j) for j in range(60)), None, None, None) for k in range(1, 300)])
    assert suffix.dedup(data).where("n_removed > 0").count() == 0 and minhash.without_near_duplicates(data).count() == 299


def table_of(texts, times, window, units):
    n = [len(units(np.frombuffer(t, np.uint8), np.array([0, len(t)])).symbols) - window + 1 for t in texts]
    k = len(texts)
    return pa.table({"nn": np.ones(k, np.int64), "did": np.arange(k), "chk": np.zeros(k, np.int64), "start": np.zeros(k, np.int64), "n": np.array(n), "times": np.array(times), "data": pa.array(texts, pa.binary())})


def test_automata_decide_which_words_go(monkeypatch):
    words = [f"w{k}".encode() for k in range(60)]
    texts = [b" ".join(words[:50]), b" ".join([b"other", *words[10:60]]), b" ".join(f"z{k}".encode() for k in range(40))]
    row, s, e, again = phrases.recurring(table_of(texts, [1, 1, 2], 35, phrases.units), 35)
    got = [set() for _ in texts]
    for r, a, z in zip(row.tolist(), s.tolist(), e.tolist()):
        got[r].update(range(a, z))
    assert got == [set(range(10, 50)), set(range(1, 41)), set(range(40))] and again.tolist() == [False, False, True]
    monkeypatch.setattr(phrases, "locate", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    row, _, _, again = phrases.recurring(table_of(texts, [1, 1, 2], 35, phrases.units), 35)
    assert not len(row) and not again.any()


@pytest.mark.parametrize("seed", range(4))
def test_chains_of_windows_cover_what_windows_cover(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdef", k=rng.randint(8, 30))).encode() for _ in range(6)]
    texts = [b" ".join(rng.choices(pool, k=rng.randint(1, 3))) for _ in range(12)]
    times = [rng.choice([1, 1, 2]) for _ in texts]
    seen = Counter()
    for t, k in zip(texts, times):
        w = t.split()
        seen.update({x: c * k for x, c in Counter(tuple(w[i : i + 6]) for i in range(len(w) - 5)).items()})
    row, s, e, again = phrases.recurring(table_of(texts, times, 6, phrases.units), 6)
    got = [set() for _ in texts]
    for r, a, z in zip(row.tolist(), s.tolist(), e.tolist()):
        got[r].update(range(a, z))
    for t, mine, k, whole in zip(texts, got, times, again.tolist()):
        w = t.split()
        hits = [i for i in range(len(w) - 5) if seen[tuple(w[i : i + 6])] > 1]
        assert mine == {k for i in hits for k in range(i, i + 6)} and whole == (k > 1 and len(hits) == len(w) - 5)


def test_the_order_of_suffixes_decides_which_bytes_go(monkeypatch):
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(260))
    texts = [base[:150], base[20:200], bytes(rng.choice(b"xyz") for _ in range(120))]
    units = suffix._method(100).units
    row, s, e, again = suffix.repeats(table_of(texts, [1, 1, 2], 100, units), 100)
    assert [(int(r), int(a), int(z)) for r, a, z in zip(row, s, e)] == [(1, 0, 130)] and again.tolist() == [False, False, True]
    monkeypatch.setattr(suffix, "two_stage", lambda text, wanted, depth, words: np.flatnonzero(wanted))
    row, *_, again = suffix.repeats(table_of(texts, [1, 1, 2], 100, units), 100)
    assert not len(row) and not again.any()


@pytest.mark.parametrize("module,window", [(suffix, 100), (phrases, 35)])
def test_blocks_and_shares_lose_nothing(docs, monkeypatch, module, window):  # noqa: F811
    """A passage in very many documents, between texts of their own: its anchors are frequent, and its segments fill many blocks."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    data = [(i, f"{' '.join(str(rng.random()) for _ in range(6))} {passage} {' '.join(str(rng.random()) for _ in range(6))}" if i % 3 else passage, None, None, None) for i in range(400)]
    cut = split if module is phrases else lambda t: t.encode()
    seen, want = Counter(), []
    for _, t, *_ in data:
        w = cut(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    before = set()
    for d, t, *_ in data:
        w = cut(t)
        own = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        gone = set()
        for i, x in enumerate(own):
            if seen[x] > 1 if module is phrases else x in before:
                gone.update(range(i, i + window))
            before.add(x)
        want.append((d, len(gone)))
    monkeypatch.setattr(anchors, "SAMPLE", 2)
    make = module._method
    monkeypatch.setattr(module, "_method", lambda w: anchors.Method(**{**make(w).__dict__, "most": 4000}))
    assert rows_of(module.dedup(docs(data)), "doc_id", "n_removed") == sorted(want)


def peak_mb(code):
    """Memory beyond that of the imports, of a process that runs some lines."""
    head = "import resource, sys, random\nimport numpy as np, pyarrow as pa\nfrom cutlist.llm import _text, anchors, gbt, minhash, phrases, suffix, wumanber, licenses\nrss = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\n"
    made = "rng = np.random.default_rng(1)\ntext = rng.integers(97, 123, SIZE).astype(np.uint8)\ntext[rng.integers(0, SIZE, SIZE // 6)] = 32\noff = np.array([0, SIZE])\nbase = rss()\n"
    run = subprocess.run([sys.executable, "-c", head + made.replace("SIZE", str(16 << 20)) + code + "\nprint(rss() - base)"], capture_output=True, text=True, env={"PYTHONPATH": __file__.rsplit("/tests/", 1)[0], "PATH": "/usr/bin"}, check=True)
    return float(run.stdout)


#: A text of 16 MB in one piece, by operator; what it takes besides the text, in bytes a byte of text, is bounded.
LONG = {
    "shingles": ("minhash.shingle_sets(text, off, 5)", 28),
    "bytes": ("m = suffix._method(100); anchors.segments(m.units(text, off), m)", 16),
    "words": ("m = phrases._method(35); anchors.segments(m.units(text, off), m)", 24),
    "statistics": ("gbt.statistics(text, off)", 36),
    "patterns": ("p = wumanber.compile_patterns([('1', 'a b c')], 10); wumanber.search(pa.array([text.tobytes().decode()], pa.large_string()), p)", 36),
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_a_long_text_takes_a_bounded_multiple_of_its_size(name):
    code, most = LONG[name]
    assert peak_mb(code) < 16 * most


def test_many_blocks_of_a_benchmark(docs, spark):  # noqa: F811
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(f"i{k % 90}", " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 40])))) for k in range(100)] + [(None, "v1 v2 v3 v4")]
    data = [(d, " ".join([*rng.choices(vocabulary, k=20), rng.choice(items)[1], *rng.choices(vocabulary, k=20)]), None, None, None) for d in range(60)]
    patterns = {}
    for i, t in items:
        w = t.split()
        m = min(10, len(w))
        for k in range(len(w) - m + 1):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(i)
    want = []
    for d, t, *_ in data:
        w, hit, found = t.split(), set(), set()
        for k in range(len(w)):
            for m in range(1, 11):
                if k + m <= len(w) and (own := patterns.get(tuple(w[k : k + m]))):
                    hit.update(range(k, k + m))
                    found |= own
        ids = sorted(found - {None})
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    most = sum(len(t) for _, t in items) // 20
    n, parts = wumanber.blocks(bench, most)
    assert n >= 20 and sum(len(p) for p in parts) == len(items)
    got = wumanber.decontaminate(docs(data), bench, most_bytes=most)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)


def test_tables_of_patterns_grow_with_their_text():
    rng = random.Random(2)
    text = " ".join(str(rng.random())[2:9] for _ in range(100_000))
    p = wumanber.compile_patterns([("1", text)], 10)
    size = len(p.text) + sum(x.nbytes for x in (p.hashes, p.begin, p.end)) + sum(x.nbytes for t in p.lengths for x in (t.shift, t.suffix, t.start, t.owner))
    assert size < 6 * len(text) + (2 << 20)


def test_trees_score_as_walks_do_and_statistics_as_counts():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = gbt.fit(x, y, rounds=12)
    for row, score in zip(x[:80], trees.score(x[:80])):
        total = trees.start
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = int(trees.left[node] if row[trees.feature[node]] <= trees.bound[node] else trees.right[node])
            total += trees.value[node]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12
    texts = ["", "One two two\nTWO! été 12|3\n\nOne two", "a", " \n\t", "x " * 500 + "!!!\nBUY NOW\nBUY NOW\n" + "é" * 300]
    got = gbt.statistics(*_text.flat(pa.array(texts)))
    classes = {**dict.fromkeys(range(0x21, 0x7F), 8), **dict.fromkeys(b"abcdefghijklmnopqrstuvwxyz", 1), **dict.fromkeys(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), **dict.fromkeys(b"0123456789", 3), 0x20: 4, 10: 5, 13: 5, **dict.fromkeys(b".,;:'\"", 6), **dict.fromkeys(b"!?", 7), **dict.fromkeys(b"|\t", 9), **dict.fromkeys(range(128, 256), 10)}
    for t, row in zip(texts, got.tolist()):
        raw, words = t.encode(), re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        lines = re.findall(rb"[^\n\r]+", raw)
        n, many = max(len(raw), 1), max(len(words), 1)
        share = [sum(classes.get(b, 0) == k for b in raw) / n for k in range(11)]
        runs = [len(list(g)) for _, g in __import__("itertools").groupby(words)]
        want = [math.log1p(len(raw)), math.log1p(len(words)), *share, sum(map(len, words)) / many, math.log1p(max(map(len, words), default=0)), len(set(words)) / many, sum(a == b for a, b in zip(words, words[1:])) / many, math.log1p(max(runs, default=0)), len(set(zip(words, words[1:], words[2:]))) / many]
        want += [sum(classes[w[0]] == 2 for w in words) / many, sum(classes.get(w[-1], 0) >= 7 for w in words) / many, len(lines) / many if words else len(lines), len(set(lines)) / max(len(lines), 1), -sum(s * math.log(s) for s in share if s)]
        assert np.allclose(row, want), t[:30]


def test_languages_of_whole_texts_by_brute_force(docs):  # noqa: F811
    rng = random.Random(6)
    spelled = {"▁": 0, "a": 1, "b": 2, "ab": 3, "ba": 4, "▁a": 5, "abab": 6, "bb": 7}
    voc = langid.Vocabulary(spelled)
    probs = np.array([[0.2, 0.1], [0.1, 0.3], [0.2, 0.05], [0.1, 0.1], [0.05, 0.15], [0.15, 0.1], [0.05, 0.1], [0.1, 0.05], [0.05, 0.05]])
    model = langid.Model(voc, ["x", "y"], probs, np.log([0.6, 0.4]))

    def log_sum(word, k):
        w, alpha = "▁" + word, [1.0]
        for e in range(1, len(w) + 1):
            own = sum(alpha[e - s] * probs[spelled[w[e - s : e]], k] for s in range(1, min(e, 4) + 1) if w[e - s : e] in spelled)
            alpha.append(own if w[e - 1] in spelled else alpha[e - 1] * probs[voc.other, k])
        return math.log(alpha[-1])

    texts = [" ".join("".join(rng.choices("abz", k=rng.randint(1, 90))) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    got = {r.doc_id: r for r in langid.identify(docs([(i, t, None, None, None) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        logs = [model.prior[k] + sum(log_sum(w, k) for w in t.split()) for k in range(2)]
        best = max(range(2), key=lambda k: logs[k])
        assert got[i].lang_pred == "xy"[best] and abs(got[i].score - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-6
    assert langid.identify(docs([]), model).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_licenses_are_those_of_every_place(docs, seed):  # noqa: F811
    """Dense stretches lose nothing: aligning at every place of a document gives the same best match of each template."""
    rng = random.Random(seed)
    ts = licenses.Templates({k: v for k, v in licenses.TEMPLATES.items() if len(v) < 400})
    pool = sorted({w for own in ts.words for w in own}) + [b"zz", b"qq"]
    for _ in range(25):
        w = []
        for _ in range(rng.randint(1, 3)):
            own = list(rng.choice(ts.words))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = rng.choices(pool, k=rng.randint(0, 2))
            w += rng.choices(pool, k=rng.randint(0, 12)) + own
        text = b" ".join(w)
        buf = np.frombuffer(text, np.uint8)
        starts, ends, _ = _text.words(buf, np.array([0, len(buf)]), _text.ALNUM)
        h = _text.word_hashes(buf, starts, ends)
        got = {x[0]: x[1:3] for x in licenses.matches(h, lambda s, e: w[s:e], ts, 0.9)}
        want = {}
        for t, own in enumerate(ts.words):
            need, most = max(1, math.ceil(0.9 * len(own) - 1e-9)), int(len(own) / 0.9 + 1e-9)
            for i in range(len(w)):
                pairs = licenses.aligned(own, w[i : i + most], need, 0.9, lambda j: False) if w[i] in own[: len(own) - need + 1] else []
                if pairs and len(pairs) > want.get(t, (0, 0))[1]:
                    want[t] = (len(pairs) / len(own), len(pairs))
        assert got == want
    assert licenses.scan(docs([])).count() == 0 and licenses.scan(docs([(1, None, None, None, None)])).collect()[0].license is None


def test_every_stage_of_the_pipeline_by_brute_force(spark):
    import corpus_pipeline as p

    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in source.select(*p.COLUMNS).collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frame = lambda data: spark.createDataFrame(data, source.select(*p.COLUMNS).schema)
    of = lambda name, data: sorted((tuple(r) for r in dict(p.STAGES)[name](spark, frame(data), SF).collect()), key=repr)

    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[0] in labels]
    stats = lambda data: gbt.statistics(*_text.flat(pa.array([t for _, t, *_ in data], pa.string())))
    order = {r.doc_id: k for k, r in enumerate(spark.createDataFrame([(r[0],) for r in learned], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect())}
    learned.sort(key=lambda r: order[r[0]])
    trees = gbt.fit(stats(learned), np.array([float(labels[r[0]]) for r in learned]))
    good = [r for r, s in zip(rows, trees.score(stats(rows))) if s >= 0.5]
    assert of("quality", rows) == sorted(good, key=repr) and 0 < len(good) < len(rows)

    first = [r for r, (_, n, low, kept) in zip(good, brute_components(good)) if kept or not n]
    assert of("near_duplicates", good) == sorted(first, key=repr) and len(first) < len(good)

    seen, left = set(), []
    for r in sorted(first):
        raw, gone = (r[1] or "").encode(), set()
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(raw[k : k + 100])
        text = bytes(b for k, b in enumerate(raw) if k not in gone).decode("utf-8", "ignore")
        left.append((r[0], text, r[2], r[3], len(text)))
    assert of("repeated_strings", first) == sorted(left, key=repr)

    patterns = {}
    for i, t in bench:
        w = bench_words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(m, set()).add(tuple(w[k : k + m]))
    clean = [r for r in left if not any(tuple(w[k : k + m]) in own for w in [bench_words(r[1])] for m, own in patterns.items() for k in range(len(w) - m + 1))]
    assert of("decontaminate", left) == sorted(clean, key=repr) and len(clean) < len(left)

    taken = {r.doc_id: r.copies for r in mixing.pareto_mix(frame(clean)).collect()}
    want = [(*r, k) for r in clean for k in range(taken[r[0]])]
    assert of("mix", clean) == sorted(want, key=repr) and set(taken.values()) <= {0, 1, 2}
    whole = sorted((tuple(r) for r in p.run(spark, SF).collect()), key=repr)
    assert whole == sorted(want, key=repr) and json.dumps(len(whole))
