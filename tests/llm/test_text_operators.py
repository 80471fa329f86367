"""Operators on text against brute-force versions, with nulls, empty and odd texts, repeated rows and clashing columns."""

import hashlib
import random
import re

import pytest

from cutlist.llm import gbt, langid, licenses, minhash, mixing, phrases, suffix, wumanber

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACES.split(text or "") if w]


def corpus(seed, n=40, words=300):
    """Texts that share passages, with copies, runs of one word, odd spaces and none at all."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 80))) for _ in range(4)]
    texts = [None, "", " \t\n ", "one", "a " * 90, "a " * 90 + "b"]
    while len(texts) < n:
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, words))) for _ in range(2)]
        t = rng.choice([" ", "\n", "\x0b\x0c "]).join([parts[0], rng.choice(passages), parts[1]]) if rng.random() < 0.6 else parts[0]
        texts += [t] * rng.choice([1, 1, 1, 3])
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", i) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[12], (11, "a text of its own under an id that stands twice", None, None, None), (None, texts[9], None, None, None)]


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS did", "2 AS chk", "'x' AS score", "3 AS key", "4 AS size")

    return make


def rows_of(df, *cols):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def sort_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases(docs, seed):
    data = corpus(seed)
    seen = {}
    for _, t, *_ in data:
        w = split(t)
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = []
    for d, t, *_ in data:
        w = split(t)
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows_of(phrases.dedup(docs(data)), "doc_id", "n_words", "n_removed", "kept_sha256") == sort_rows(want)
    assert phrases.dedup(docs([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(docs, seed):
    data = corpus(seed)
    data += [(1000, "ab" * 200, None, None, None), (1001, "ab" * 170 + "c" * 130, None, None, None)]
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is not None, data[i][0] or 0, data[i][1] or ""))
    # a null id comes first; equal rows in any order; the one id with two texts has its order by checksum
    seen, want = set(), []
    for i in order:
        raw = (data[i][1] or "").encode()
        gone = set()
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(raw[k : k + 100])
        spans = sum(1 for k in gone if k - 1 not in gone)
        want.append((data[i][0], len(raw), len(gone), spans, hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in gone)).hexdigest()))
    assert rows_of(suffix.dedup(docs(data)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sort_rows(want)
    assert suffix.dedup(docs([])).count() == 0


def test_two_stage_order():
    import numpy as np

    rng = random.Random(3)
    for alphabet in (b"ab", b"abc\x00\xff", bytes(range(256))):
        raw = bytes(rng.choice(alphabet) for _ in range(700)) + b"aaaa" * 40
        text = np.frombuffer(raw, np.uint8)
        got = suffix.two_stage(text, np.ones(len(raw), bool), 200, suffix.words_of(text)).tolist()
        pad = raw + bytes(0)
        assert [pad[i : i + 200] for i in got] == sorted(pad[i : i + 200] for i in range(len(raw)))


def shingles(text):
    w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(data):
    sets = [shingles(t) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i in range(len(data)):
        low.setdefault(find(i), []).append(data[i][0])
    least = {k: min(v, key=lambda x: (x is not None, x)) for k, v in low.items()}
    return [(data[i][0], len(sets[i]), least[find(i)], data[i][0] == least[find(i)]) for i in range(len(data))]


def near_copies(seed, groups=6, copies=30):
    rng = random.Random(seed)
    rows = corpus(seed, 20, 80)
    n = 100
    for _ in range(groups):
        base = [rng.choice("xyzuvw") * rng.randint(1, 3) + str(rng.randint(0, 500)) for _ in range(rng.randint(4, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = str(rng.random())
            rows.append((n, " ".join(w).upper() if n % 5 == 0 else " ".join(w), None, None, None))
            n += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(docs, seed):
    data = near_copies(seed)
    got = minhash.public(minhash.near_duplicates(docs(data)))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sort_rows(brute_components(data))


def test_near_duplicate_removal_keeps_one_row_of_each_group(docs):
    data = near_copies(4, groups=2)
    left = minhash.without_near_duplicates(docs(data))
    texts = [r for r in data if r[1] and split(r[1])]
    groups = {c for d, n, c, _ in brute_components(data) if n}
    got = [tuple(r)[:2] for r in left.collect()]
    assert len([r for r in got if r[1] and split(r[1])]) <= len(texts) and {r[0] for r in got if r[1] and split(r[1])} >= groups
    assert len(got) == len(set(got)) and left.columns == docs([]).columns


def test_blocks_of_a_region_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    data = near_copies(5, groups=2, copies=40)
    got = minhash.public(minhash.near_duplicates(docs(data)))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sort_rows(brute_components(data))


def bench_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(docs, spark):
    data = corpus(7)
    rng = random.Random(7)
    items = [(1, "The Quick, brown fox"), (2, None), (3, "..."), (4, "word"), (20, " ".join(bench_words(data[15][1])[:25]).upper()), (3, "a " * 12), (20, "ünï"), (None, "a b c"), (31, " ".join(str(rng.random()) for _ in range(30)))]
    data += [(2000, "see: the-quick BROWN fox! and a word more", None, None, None), (2001, "the quick brown dog", None, None, None), (2002, "Ünï ünï", None, None, None)]
    patterns = {}
    for i, t in items:
        w = bench_words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m and i is not None else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(i)
    want = []
    for d, t, *_ in data:
        w, hit, found = bench_words(t), set(), set()
        for k in range(len(w)):
            for m in range(1, 11):
                own = patterns.get(tuple(w[k : k + m])) if k + m <= len(w) else None
                if own:
                    hit.update(range(k, k + m))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(wumanber.decontaminate(docs(data), bench), *cols) == sort_rows(want)
    # several blocks give the same
    assert rows_of(wumanber.decontaminate(docs(data), bench, most_bytes=150), *cols) == sort_rows(want)
    assert wumanber.decontaminate(docs(data), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_by_items_without_id(docs, spark):
    bench = spark.createDataFrame([(None, "red green blue"), (None, "solo"), (5, "green blue"), (None, None)], "item_id long, text string")
    data = [(1, "a Red green, blue b", None, None, None), (2, "solo", None, None, None), (3, "green blue", None, None, None), (4, "red green", None, None, None)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(1, 3, 1, sha("5"), True), (2, 1, 0, sha(""), True), (3, 2, 1, sha("5"), True), (4, 0, 0, sha(""), False)]
    for most_bytes in (4 << 20, 8):
        assert rows_of(wumanber.decontaminate(docs(data), bench, most_bytes=most_bytes), "doc_id", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_mixing(docs):
    rng = random.Random(9)
    data = [(i, " ".join(["w"] * rng.randint(1, 60)) if i % 11 else None, None, None if i % 10 == 9 else f"s{i % 10 // 3}", None) for i in range(900)]
    out = mixing.pareto_mix(docs(data))
    rows = out.collect()
    size = {None: 0} | {f"s{k}": 0 for k in range(3)}
    for _, t, _, s, _ in data:
        size[s] += len(split(t))
    weight, total = {"s0": 5, "s1": 2, "s2": 1, None: 5}, 1.5 * sum(size.values())
    want, open_ = {}, set(size)
    while open_:  # share, cap, share what is left
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ = open_ - over if over else set()
    by_id, source = {r.doc_id: r for r in rows}, {d: s for d, _, _, s, _ in data}
    for s, t in want.items():
        own = [by_id[d] for d in by_id if source[d] == s]
        assert all(abs(r.target - t) < 1e-6 and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 31
    assert rows_of(out, "doc_id", "taken") == rows_of(mixing.pareto_mix(docs(data[::-1])), "doc_id", "taken")
    assert mixing.pareto_mix(docs([])).count() == 0


def test_mixing_spreads_ranks_whatever_the_share(docs):
    F = mixing.F
    ids = docs([(i, "", None, None, None) for i in range(4000)]).withColumn("u", mixing.uniform(F.col("doc_id"), "mix"))
    for part in (0.0005, 0.3, 0.9995):
        q = F.col("u") / (1 - F.col("u")) * (1 - part) / part
        counts = [r["count"] for r in ids.groupBy(mixing.bucket(q, F.lit(part), 64).alias("b")).count().collect()]
        assert len(counts) == 64 and max(counts) < 4 * 4000 / 64


def test_inclusion_follows_the_share(docs):
    data = [(i, "a b c d", None, f"s{i % 4}", None) for i in range(4000)]
    taken = [r.taken for r in mixing.pareto_mix(docs(data)).where("target < 2 * source_size").collect()]
    assert taken and set(taken) <= {0, 4, 8}


def test_inclusion_follows_the_size_and_ranks_decide(docs):
    """Long documents are taken in proportion to their words, the longest surely; by u alone others would be taken."""
    size = {i: 5000 if i < 3 else 40 if i % 2 else 10 for i in range(3000)}
    data = [(i, "w " * n, None, "a", None) for i, n in size.items()]
    got = {r.doc_id: r for r in mixing.pareto_mix(docs(data), weights=(1,), share=0.4).collect()}
    total, need = sum(size.values()), 0.4 * sum(size.values())
    assert all(abs(r.target - need) < 1e-6 for r in got.values()) and abs(sum(r.taken for r in got.values()) - need) <= 20
    assert all(got[i].taken == 5000 for i in range(3)) and total - need > 0
    rate = {n: sum(got[i].taken > 0 for i in size if size[i] == n) / sum(v == n for v in size.values()) for n in (10, 40)}
    left = need - 15000
    pull = left / sum(n * n for n in size.values() if n < 5000)
    assert abs(rate[40] - 40 * pull) < 0.03 and abs(rate[10] - 10 * pull) < 0.03
    u = {r.doc_id: r.u for r in docs(data).select("doc_id", mixing.uniform(mixing.F.col("doc_id"), "mix").alias("u")).collect()}
    rank = {i: u[i] / (1 - u[i]) * (1 - pull * size[i]) / (pull * size[i]) for i in size if size[i] < 5000}
    out, words = set(), 0
    for i in sorted(rank, key=rank.get):
        if words + size[i] / 2 < left:
            out.add(i)
        words += size[i]
    assert {i for i in rank if got[i].taken} == out
    plain = sorted(rank, key=u.get)[: len(out)]
    assert set(plain) != out


def test_language_id_sums_all_segmentations(spark):
    voc = langid.Vocabulary({"▁a": 0, "▁": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5})
    import numpy as np

    probs = np.array([[0.3], [0.1], [0.2], [0.2], [0.05], [0.1], [0.05]])
    model = langid.Model(voc, ["x"], probs, np.zeros(1))
    p = {k: probs[v, 0] for k, v in {"▁a": 0, "▁": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5}.items()}
    want = p["▁ab"] + p["▁a"] * p["b"] + p["▁"] * p["ab"] + p["▁"] * p["a"] * p["b"]
    assert abs(np.exp(langid.word_logs(["ab"], model))[0, 0] - want) < 1e-12
    assert np.isfinite(langid.word_logs(["z" * 5000, ""], model)).all()
    counts = langid.expected_counts(["▁ab"], np.array([2.0]), voc, probs[:, 0])
    assert abs(counts[5] - 2 * p["▁ab"] / want) < 1e-12 and abs(counts[3] - 2 * (p["▁a"] * p["b"] + p["▁"] * p["a"] * p["b"]) / want) < 1e-12


def test_language_id_learns_and_marks_what_has_no_letters(docs):
    rng = random.Random(11)
    words = {"en": "the of and to in is that was for".split(), "fr": "le la et des les une dans que pour".split()}
    data = [(i, " ".join(rng.choices(words[x], k=12)), x, None, None) for i, x in enumerate(["en", "fr"] * 40)]
    model = langid.train(docs(data))
    ask = [(1, "the was for in", None, None, None), (2, "les une dans", None, None, None), (3, None, None, None, None), (4, " 12 ... ", None, None, None), (5, "", None, None, None)]
    got = rows_of(langid.identify(docs(ask), model), "doc_id", "lang_pred")
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")]
    assert langid.identify(docs(ask), langid.train(docs([]))).where("lang_pred = 'und'").count() == 5


def test_language_id_sums_words_of_any_length(docs, monkeypatch):
    import numpy as np

    rng = random.Random(5)
    spelled = {"▁": 0, "a": 1, "b": 2, "ab": 3, "ba": 4, "▁a": 5, "abab": 6, "c": 7}
    voc = langid.Vocabulary(spelled)
    probs = np.array([[1e-6, 0.1]] * 6 + [[1e-9, 0.1]] * 2 + [[1e-25, 1e-18]])
    model = langid.Model(voc, ["x", "y"], probs, np.zeros(2))

    def summed(word, k):
        alpha, w = [0.0], "▁" + word
        for e in range(1, len(w) + 1):
            own = [alpha[e - s] + np.log(probs[spelled[w[e - s : e]], k]) for s in range(1, min(e, 4) + 1) if w[e - s : e] in spelled]
            alpha.append(np.logaddexp.reduce(own if w[e - 1] in spelled else [alpha[e - 1] + np.log(probs[voc.other, k])]))
        return alpha[-1]

    new = ["".join(rng.choices(letters, k=n)) for n in (3, 20, 24, 60, 127, 128, 300, 301, 5000) for letters in ("ab", "abc", "abz", "z")] + ["", "ab" * 12 + "a"]
    got = langid.word_logs(new, model)
    assert all(abs(got[i, k] / summed(w, k) - 1) < 1e-9 for i, w in enumerate(new) for k in range(2))
    for w in new:
        times = np.array([3e9])
        counts = langid.expected_counts(["▁" + w], times, voc, probs[:, 0])
        size = np.array([len(p) for p in spelled] + [1])
        assert np.isfinite(counts).all() and abs(counts @ size / times[0] - len(w) - 1) < 1e-6 * (len(w) + 1)
    short = ["▁" + w for w in new if 0 < len(w) < 25 and "z" not in w]
    want = langid.expected_counts(short, np.arange(1.0, len(short) + 1), voc, probs[:, 1])
    monkeypatch.setattr(langid, "TINY", 1.0)
    assert np.allclose(langid.expected_counts(short, np.arange(1.0, len(short) + 1), voc, probs[:, 1]), want, rtol=1e-9)
    monkeypatch.undo()

    from pyspark.sql import functions as F

    count = langid.count_words
    monkeypatch.setattr(langid, "count_words", lambda d: count(d).withColumn("n", F.when(F.length("part") < 20, F.col("n") * 10**8).otherwise(F.col("n"))))
    odd = "\U0001f9ff" * 5000
    data = [(i, " ".join(rng.choices(x, k=20)), lang, None, None) for i in range(40) for lang, x in (("en", ["the", "of", "was", "http://" + "zq" * 300]), ("fr", ["le", "la", "des", "été"]))]
    for extra in ([], [(900, odd, "en", None, None)]):
        model = langid.train(docs(data + extra))
        assert np.isfinite(model.probs).all() and (model.probs > 0).all() and np.allclose(model.probs.sum(0), 1)
        assert np.isfinite(langid.word_logs([odd, "ꙮ" * 5000 + "the"], model)).all()
    ours, other = model.probs[model.vocabulary.other]
    assert ours > 10 * other
    got = {r.doc_id: r for r in langid.identify(docs([(1, odd, None, None, None), (2, "été " + "ꙮ" * 5000, None, None, None), (3, "the was " + "q" * 5000, None, None, None)]), model).collect()}
    assert got[1].lang_pred == "und" and (got[2].lang_pred, got[3].lang_pred) != ("und", "und") and all(0 <= r.score <= 1 for r in got.values())


def test_quality_trees_separate_and_are_flat(docs, spark):
    rng = random.Random(13)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(80))
    data = [(i, good() if i % 2 else " ".join(["BUY!!"] * 60) + str(i), None, None, None) for i in range(300)] + [(900, None, None, None, None), (901, "", None, None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(900, None), (5, 7)], "doc_id long, quality int")
    trees = gbt.learn(docs(data), labels, rounds=10)
    got = {r.doc_id: r.score for r in gbt.score(docs(data), trees).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(300)) and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901]
    none = gbt.learn(docs(data), labels.limit(0))
    assert {r.score for r in gbt.score(docs(data), none).collect()} == {0.5}


def test_licenses(docs):
    notice = licenses.TEMPLATES["GPL-3.0"]
    apache = licenses.TEMPLATES["Apache-2.0-header"].replace("compliance", "accordance")
    filler = "words of the work and others in it " * 40
    data = [(1, filler + notice + filler, None, None, None), (2, filler, None, None, None), (3, None, None, None, None), (4, "", None, None, None), (5, apache + "\n" + filler + apache, None, None, None), (6, (notice + " ") * 3, None, None, None), (7, filler.join(notice.split()), None, None, None)]
    got = {r.doc_id: r for r in licenses.scan(docs(data)).collect()}
    assert {k: r.license for k, r in got.items()} == {1: "GPL-3.0", 2: None, 3: None, 4: None, 5: "Apache-2.0", 6: "GPL-3.0", 7: None}
    assert "Apache-2.0-header" in got[5].all_licenses and got[1].coverage == 1.0 and got[1].last_word - got[1].first_word + 1 == got[1].n_aligned == 12


def test_near_miss_licenses(docs):
    t = licenses.TEMPLATES
    filler = "words of the work and others in it " * 20
    cases = {
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY 2.0.": None,
        "This work is licensed under the GNU Lesser General Public License, version 2.": None,
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Library General Public License, version 2.": None,
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 2. 1 file": "GPL-2.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This code is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0-text",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": None,
        "Licensed under the Apache License, Version 1.1.": None,
        t["BSD-3-Clause"]: "BSD-3-Clause",
        t["BSD-2-Clause"]: "BSD-2-Clause",
        t["BSD-2-Clause"].replace("1.", "*").replace("2.", "*").replace("COPYRIGHT HOLDER OR", "REGENTS OR"): "BSD-2-Clause",
        t["BSD-2-Clause"][:300]: None,
        t["MIT-text"] + "\n" + t["MIT-text"]: "MIT-text",
        t["MIT-text"][:300]: None,
        t["LGPL-2.1-text"]: "LGPL-2.1-text",
        "the of this work is licensed " * 30 + t["GPL-3.0-text"]: "GPL-3.0-text",
        "software the of to and in " * 500: None,
    }
    data = [(i, front + x + back, None, None, None) for i, (x, front, back) in enumerate((x, f, b) for x in cases for f, b in (("", ""), (filler, filler), (x.split()[0] + " ", " " + x.split()[-1])))]
    got = {r.doc_id: r.license for r in licenses.scan(docs(data)).collect()}
    assert [got[i] for i in range(len(data))] == [v for v in cases.values() for _ in range(3)]


def test_alignment_is_common_and_rising():
    rng = random.Random(17)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= len(licenses.common(a, b))
        assert licenses.align(a, a) == [(i, i) for i in range(len(a))]


@pytest.mark.parametrize("window", [8, 300])
def test_windows_of_other_sizes(docs, window):
    rng = random.Random(window)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    data = [(1, base, None, None, None), (2, "x" + base[50:650] + "y", None, None, None), (3, base[:5], None, None, None)]
    seen, want = set(), []
    for d, t, *_ in data:
        gone = set()
        for k in range(len(t) - window + 1):
            if t[k : k + window] in seen:
                gone.update(range(k, k + window))
            seen.add(t[k : k + window])
        want.append((d, len(gone)))
    assert rows_of(suffix.dedup(docs(data), window=window), "doc_id", "n_removed") == want
    words = [" ".join(t[k] for k in range(len(t)) if t[k] != " ") for _, t, *_ in data]
    data = [(i, w, None, None, None) for i, w in enumerate(words)]
    seen = {}
    for w in words:
        s = w.split()
        for k in range(len(s) - window + 1):
            seen[tuple(s[k : k + window])] = seen.get(tuple(s[k : k + window]), 0) + 1
    want = []
    for i, w in enumerate(words):
        s = w.split()
        want.append((i, len({x for k in range(len(s) - window + 1) if seen[tuple(s[k : k + window])] > 1 for x in range(k, k + window)})))
    assert rows_of(phrases.dedup(docs(data), window=window), "doc_id", "n_removed") == want
