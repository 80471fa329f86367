"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
likelihood is the sum over all its segmentations into pieces of the product of their
probabilities, computed by a forward recursion; pieces never cross white space, so a
text's log-likelihood is the sum over its words, and equal words are computed once.
The probabilities start from the public tokenizer's own segmentation counts and are
refined by expectation maximisation, whose expected counts come from the same forward
recursion and its backward twin. Words are counted over every training row, with
partial counts before the shuffle; the recursions then run over different words only.

Words of any length are summed whole. A long word is a product over stretches that no
piece crosses, as every segmentation ends there; stretches whose sums come near the
smallest double, and those too long for doubles anyway, are taken in logarithms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from ._text import materialised, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words and characters whose results a task keeps; the longest piece used.
MOST_WORDS, MOST_CHARS, LONGEST_PIECE = 200_000, 32 << 20, 16
#: Words over WHOLE characters are cut where no piece crosses; stretches over LONGEST characters, or
#: with a sum below TINY (what doubles lose on the way to more is below one part in 1e50), go in logarithms.
WHOLE, LONGEST, TINY = 24, 128, 1e-250
_LETTER = regex.compile(r"\p{L}")
_MARK = "▁"
_STEP, _SPREAD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces by the hash of their characters; a character that no piece spells is the piece `other`."""

    def __init__(self, pieces: dict[str, int]):
        self.other = max(pieces.values(), default=-1) + 1
        self.size = self.other + 1
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        o = np.argsort(keys)
        self.keys, self.ids = keys[o], np.array(list(pieces.values()), np.int64)[o]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys * _SPREAD >> np.uint64(44)).astype(np.int64)] = True
        self.longest = min(LONGEST_PIECE, max(map(len, pieces), default=1))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_STEP) + ord(c) + 1) % 2**64
        return h

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls({p: i for i in range(sp.get_piece_size()) if len(p := sp.id_to_piece(i)) <= LONGEST_PIECE and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        out = np.full(h.shape, -1, np.int64)
        at = np.flatnonzero(self.seen[(h * _SPREAD >> np.uint64(44)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.keys, h.ravel()[at]), len(self.keys) - 1)
            out.ravel()[at] = np.where(self.keys[k] == h.ravel()[at], self.ids[k], -1)
        return out

    def arcs(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length, by end: (begin, rows, pieces) of every piece that spells a stretch."""
        n = codes.shape[1]
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        h = np.zeros((len(codes), n + 1), np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            h = h[:, : n - size + 1] * _STEP + codes[:, size - 1 :] + np.uint64(1)
            ids = self.find(np.ascontiguousarray(h.T))
            if size == 1:
                ids[ids < 0] = self.other
            for i in range(n - size + 1):
                rows = np.flatnonzero(ids[i] >= 0)
                if len(rows):
                    out[i + size].append((i, rows, ids[i][rows]))
        return out

    def beginning(self, codes: np.ndarray, start: int, end: int) -> np.ndarray:
        """(sizes, rows, end - start): the piece of each size that begins at each place, or -1."""
        c = codes[:, start : end + self.longest - 1]
        out = np.full((self.longest, len(c), end - start), -1, np.int64)
        h = np.zeros((len(c), c.shape[1] + 1), np.uint64)
        for size in range(1, min(c.shape[1], self.longest) + 1):
            h = h[:, : c.shape[1] - size + 1] * _STEP + c[:, size - 1 :] + np.uint64(1)
            ids = self.find(np.ascontiguousarray(h[:, : end - start]))
            if size == 1:
                ids[ids < 0] = self.other
            out[size - 1, :, : ids.shape[1]] = ids
        return out

    def targets(self, sp) -> np.ndarray:
        """The piece that counts for each id of the tokenizer: `other` once for a character spelled in bytes."""
        to = np.minimum(np.arange(sp.get_piece_size()), self.other)
        for i in range(len(to)):
            if sp.is_unknown(i):
                to[i] = self.other
            elif sp.is_byte(i):
                to[i] = -1 if 0x80 <= int(sp.id_to_piece(i)[3:5], 16) < 0xC0 else self.other
        return to


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    languages: list[str]
    probs: np.ndarray  # (pieces, languages)
    prior: np.ndarray  # log share of each language


def parts(marked: list[str], voc: Vocabulary, block: int = 1 << 18) -> tuple[list[str], np.ndarray]:
    """Stretches of words behind their marks, and how many each word has.

    Long words are cut wherever no piece crosses, which every segmentation does as well: the sum over
    a word's segmentations is the product of its stretches' sums.
    """
    many = np.ones(len(marked), np.int64)
    long = [i for i, w in enumerate(marked) if len(w) > WHOLE]
    if not long:
        return marked, many
    text = "".join([marked[i] for i in long])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, last = len(codes), np.cumsum([len(marked[i]) for i in long])
    crossed = np.zeros(n + 1, np.int32)
    for k in range(0, n, block):
        c = codes[k : k + block + voc.longest - 1].astype(np.uint64)
        h = np.zeros(len(c) + 1, np.uint64)
        for size in range(1, min(len(c), voc.longest) + 1):
            h = h[: len(c) - size + 1] * _STEP + c[size - 1 :] + np.uint64(1)
            if size > 1:
                at = np.flatnonzero(voc.find(h[:block]) >= 0) + k
                at = at[at + size <= last[np.searchsorted(last, at, "right")]]
                crossed[at + 1] += 1
                crossed[at + size] -= 1
    cut = np.flatnonzero(np.cumsum(crossed[:n]) == 0)
    many[long] = np.diff(np.searchsorted(cut, last), prepend=0)
    bounds = [*cut.tolist(), n]
    own = iter([text[x:y] for x, y in zip(bounds, bounds[1:])])
    return [x for w, m in zip(marked, many.tolist()) for x in ([w] if len(w) <= WHOLE else [next(own) for _ in range(m)])], many


def by_length(stretches: list[str], most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, characters) of stretches of equal length up to LONGEST, in groups of bounded size."""
    size = np.fromiter(map(len, stretches), np.int64, len(stretches))
    for n in np.unique(size[size <= LONGEST]).tolist():
        at = np.flatnonzero(size == n)
        for k in range(0, len(at), most):
            own = at[k : k + most]
            raw = "".join([stretches[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass")
            yield own, np.frombuffer(raw, np.uint32).reshape(len(own), n).astype(np.uint64)


def forward(arcs, n_rows: int, probs: np.ndarray) -> list[np.ndarray]:
    """By position: the sum over all segmentations of a stretch's first characters, a column a language."""
    alpha = [np.ones((n_rows, probs.shape[1]))]
    for ending in arcs[1:]:
        v = np.zeros((n_rows, probs.shape[1]))
        for begin, rows, pieces in ending:
            v[rows] += alpha[begin][rows] * probs[pieces]
        alpha.append(v)
    return alpha


def padded(stretches: list[str], at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, characters, lengths) of the stretches at some places, those of about one length together."""
    size = np.fromiter((len(stretches[i]) for i in at.tolist()), np.int64, len(at))
    o = np.argsort(size, kind="stable")
    at, size, k = at[o], size[o], 0
    while k < len(at):
        end = min(int(np.searchsorted(size, size[k] * 5 // 4 + 8, "right")), k + 256, k + max(1, (1 << 20) // int(size[k])))
        codes = np.zeros((end - k, int(size[end - 1])), np.uint64)
        for r, i in enumerate(at[k:end].tolist()):
            codes[r, : size[k + r]] = np.frombuffer(stretches[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        yield at[k:end], codes, size[k:end]
        k = end


def _blocks(codes: np.ndarray) -> list[tuple[int, int]]:
    step = max(1, (1 << 16) // len(codes))
    return [(k, min(k + step, codes.shape[1])) for k in range(0, codes.shape[1], step)]


def log_forward(voc: Vocabulary, codes: np.ndarray, size: np.ndarray, logs: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Logarithm of `forward` at each row's own length; `kept` takes it at every place.

    `logs` are the pieces' log probabilities with a last row of -inf, which is that of no piece.
    """
    out = np.zeros((len(codes), logs.shape[1]))
    a = np.zeros((1, *out.shape))
    for start, end in _blocks(codes):
        ids = voc.beginning(codes, start, end)
        a = np.concatenate([a, np.full((end - start + voc.longest - len(a) + 1, *out.shape), -np.inf)])
        for j in range(end - start):
            reach = a[j + 1 : j + 1 + voc.longest]
            np.logaddexp(reach, a[j] + logs[ids[:, :, j]], out=reach)
        if kept is not None:
            kept[start : end + 1] = a[: end - start + 1, :, 0]
        done = np.flatnonzero((size > start) & (size <= end))
        out[done] = a[size[done] - start, done]
        a = a[end - start :]
    return out


def log_counts(voc: Vocabulary, codes: np.ndarray, size: np.ndarray, times: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Expected piece counts by logarithms, for stretches of any length and any probabilities."""
    n, rows = codes.shape[1], np.arange(len(codes))
    alpha = np.zeros((n + 1, len(codes)))
    total = log_forward(voc, codes, size, logs, alpha)[:, 0]
    beta = np.full((n + 1 + voc.longest, len(codes)), -np.inf)
    beta[size, rows] = np.log(times) - total
    out = np.zeros(voc.size)
    for start, end in reversed(_blocks(codes)):
        ids = voc.beginning(codes, start, end)
        share = np.empty(ids.shape)
        for j in range(end - start - 1, -1, -1):
            i = start + j
            v = logs[ids[:, :, j], 0] + beta[i + 1 : i + 1 + voc.longest]
            beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(v, axis=0))
            share[:, :, j] = np.exp(alpha[i] + v)
        some = ids >= 0
        out += np.bincount(ids[some], share[some], len(out))
    return out


def _logs(probs: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log(probs), np.full((1, probs.shape[1]), -np.inf)])


def stretch_logs(stretches: list[str], model: Model) -> np.ndarray:
    """Log-likelihood of each stretch in each language."""
    out = np.zeros((len(stretches), len(model.languages)))
    rest = [np.flatnonzero(np.fromiter(map(len, stretches), np.int64, len(stretches)) > LONGEST)]
    for at, codes in by_length(stretches):
        v = forward(model.vocabulary.arcs(codes), len(codes), model.probs)[-1]
        small = (v < TINY).any(1)
        out[at] = np.log(np.maximum(v, TINY))
        rest.append(at[small])
    if len(at := np.concatenate(rest)):
        logs = _logs(model.probs)
        for at, codes, size in padded(stretches, at):
            out[at] = log_forward(model.vocabulary, codes, size, logs)
    return out


def word_logs(new: list[str], model: Model) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    cut, many = parts([_MARK + w for w in new], model.vocabulary)
    if len(cut) == len(new):
        return stretch_logs(cut, model)
    place = {x: k for k, x in enumerate(dict.fromkeys(cut))}
    logs, at = stretch_logs(list(place), model), np.fromiter(map(place.__getitem__, cut), np.int64, len(cut))
    return np.stack([np.add.reduceat(logs[at, k], np.cumsum(many) - many) for k in range(len(model.languages))], axis=1)


def expected_counts(stretches: list[str], times: np.ndarray, voc: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts of stretches with multiplicities, under one language's probabilities."""
    out = np.zeros(voc.size)
    rest = [np.flatnonzero(np.fromiter(map(len, stretches), np.int64, len(stretches)) > LONGEST)]
    for at, codes in by_length(stretches):
        arcs = voc.arcs(codes)
        n = len(codes)
        alpha = forward(arcs, n, probs[:, None])
        beta = [np.zeros(n) for _ in arcs]
        small = alpha[-1][:, 0] < TINY
        beta[-1] = np.where(small, 0, times[at] / np.maximum(alpha[-1][:, 0], TINY))
        rest.append(at[small])
        for end in range(len(arcs) - 1, 0, -1):
            for begin, rows, pieces in arcs[end]:
                v = probs[pieces] * beta[end][rows]
                beta[begin][rows] += v
                out += np.bincount(pieces, alpha[begin][rows, 0] * v, len(out))
    if len(at := np.concatenate(rest)):
        logs = _logs(probs[:, None])
        for at, codes, size in padded(stretches, at):
            out += log_counts(voc, codes, size, times[at], logs)
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, part, n) over all rows with text and lang: words behind their marks and how often each occurs.

    Tasks count before the shuffle and hand on what they have whenever it grows over a bound.
    """
    schema = "lang string, part string, n long"

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            names, n = [_MARK + w for w in c], list(c.values())
            size, k = np.cumsum([0, *map(len, names)]), 0
            while k < len(names):
                end = min(k + 50_000, max(k + 1, int(np.searchsorted(size, size[k] + (4 << 20), "right")) - 1))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names[k:end])), pa.array(names[k:end]), pa.array(n[k:end], pa.int64())], ["lang", "part", "n"])
                k = end

    def run(batches):
        counts: dict[str, Counter] = {}
        read = 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                for text, lang in zip(b.column("text").slice(k, 256).to_pylist(), b.column("lang").slice(k, 256).to_pylist()):
                    counts.setdefault(lang, Counter()).update(text.split())
                    read += len(text)
                if sum(map(len, counts.values())) > MOST_WORDS or read > MOST_CHARS:
                    yield from rows(counts)
                    counts, read = {}, 0
        yield from rows(counts)

    return docs.mapInArrow(run, schema).groupBy("lang", "part").agg(F.sum("n").alias("n"))


def _counts(counted: DataFrame, make, languages: list[str], size: int) -> np.ndarray:
    """Sum over all rows of task-wise piece counts: a task gives at most one row a language and piece."""

    def run(batches):
        total = np.zeros((len(languages), size))
        for b in slices(batches, "part", 4 << 20):
            lang, n = b.column("lang"), b.column("n").to_numpy(zero_copy_only=False).astype(float)
            for k, name in enumerate(languages):
                own = np.flatnonzero(pc.equal(lang, name).to_numpy(zero_copy_only=False))
                for j in range(0, len(own), 50_000):
                    at = own[j : j + 50_000]
                    total[k] += make(k, b.column("part").take(pa.array(at)).to_pylist(), n[at])
        for k in range(len(languages)):
            at = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int64()), pa.array(at, pa.int64()), pa.array(total[k][at], pa.float64())], ["lang", "piece", "n"])

    got = counted.mapInArrow(run, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((len(languages), size))
    out[got["lang"].to_numpy(int), got["piece"].to_numpy(int)] = got["n"]
    return out


def _model(voc: Vocabulary, languages: list[str], counts: np.ndarray, rows: np.ndarray, smooth: float) -> Model:
    """Probabilities with additive smoothing towards the pieces' shares over all languages."""
    base = counts.sum(0) + 0.1
    base /= base.sum()
    p = counts + smooth * base * counts.shape[1]
    return Model(voc, languages, (p / p.sum(1, keepdims=True)).T.copy(), np.log((rows + 1) / (rows.sum() + len(rows))))


def train(docs: DataFrame, *, vocabulary: str = VOCABULARY, rounds: int = 1, smooth: float = 0.05) -> Model:
    """Piece probabilities from all rows with text and lang; `rounds` steps of expectation maximisation.

    The driver receives one number for each language and piece; the set of languages is the
    set of labels, which is fixed and does not grow with the corpus. Without any training
    row there are no languages.
    """
    rows = docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    langs = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    languages, sizes = [x for x, _ in langs], np.array([float(n) for _, n in langs])
    voc = Vocabulary.load(vocabulary)
    size = voc.size
    if not languages:
        return Model(voc, [], np.zeros((size, 0)), np.zeros(0))
    counted = materialised(count_words(rows), "langid-words")

    def first(k, words, n):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        ids = sp.encode([x.removeprefix(_MARK) for x in words], num_threads=1)
        flat = voc.targets(sp)[np.fromiter((i for x in ids for i in x), np.int64)]
        return np.bincount(flat[flat >= 0], np.repeat(n, [len(x) for x in ids])[flat >= 0], size)

    model = _model(voc, languages, _counts(counted, first, languages, size), sizes, smooth)
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def again(k, words, n, shared=shared):
            own = shared.value.vocabulary
            cut, many = parts(words, own)
            if len(cut) > len(words):
                place = {x: j for j, x in enumerate(dict.fromkeys(cut))}
                n = np.bincount(np.fromiter(map(place.__getitem__, cut), np.int64, len(cut)), np.repeat(n, many))
                cut = list(place)
            return expected_counts(cut, n, own, np.ascontiguousarray(shared.value.probs[:, k]))

        model = _model(voc, languages, _counts(counted, again, languages, size), sizes, smooth)
    return model


def identify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `keep` with lang_pred and score, the posterior of that language; one row for each row.

    `und` with score 0 where the text is null or has no letter, or nothing was learned; ties go to
    the first language in order. Equal texts are predicted alike, texts of any length whole. Other columns are not read.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        known: dict[str, int] = {}
        held = 0
        table = np.zeros((0, len(m.languages)))
        for b in slices(batches, "text", 4 << 20):
            pred, prob = [], []
            split = [t.split() if t and m.languages and _LETTER.search(t) else None for t in b.column("text").to_pylist()]
            if len(known) > 2 * MOST_WORDS or held > MOST_CHARS:
                known, table, held = {}, table[:0], 0
            new = list({w for s in split if s for w in s}.difference(known))
            held += sum(map(len, new))
            known.update(zip(new, range(len(table), len(table) + len(new))))
            table = np.concatenate([table, word_logs(new, m)])
            for s in split:
                if s is None:
                    pred.append("und"), prob.append(0.0)
                    continue
                logs = m.prior + table[np.fromiter(map(known.__getitem__, s), np.int64, len(s))].sum(0)
                best = int(logs.argmax())
                pred.append(m.languages[best]), prob.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(prob, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, lang_pred string, score double")


