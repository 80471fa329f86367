"""Repeated windows of a corpus, found without shuffling every window.

A window is `window` consecutive symbols (bytes or words) of one document. Its anchor is
the gram with the smallest hash inside it, the leftmost of equals, so that equal windows
have equal anchors wherever they stand. Consecutive windows with the same anchor form a
segment; only segments (a few hundredths of the symbols) are shuffled, by the anchor's
hash. A segment whose anchor occurs once in the corpus holds no repeated window.

Of equal segments one stands for all: its text is fetched and compared with the other
segments of its anchor in `compare`, which the operators supply, and what is decided there
about a content that occurs again is carried to its other places. Segments are equal if
their anchors' hashes and 64 bits of BLAKE2 of their text are.

Grams that a small sample of documents shows to be frequent come last in the order of
hashes, so that a very common passage anchors only windows wholly inside it, which are
equal and collapse. The sample changes which anchors are chosen, never the result. Segments
of grams that are frequent even then are dealt out by documents as well, and each share has its own
representatives, so that no task sees all of them. Where the different segments of one anchor
are more than a table holds, they are cut into blocks, and each pair of blocks is compared
on its own.

Documents are shuffled once, by their keys, and that exchange is read twice: to fetch the
segments that must be compared, and to apply what was found. All steps are rows keyed by
document or anchor; there is no collect, and a lost executor's part is computed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ._text import flat, mix, ragged, slices, sliding_min, union

_POS = np.uint64((1 << 24) - 1)
#: Windows handled at a time; bounds memory for texts of any length.
BLOCK = 1 << 18
#: Grams are frequent if they anchor so many segments of the sample, one document in so many; at most so many are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 64, 12, 1 << 16
#: Shares that the segments of a frequent gram are dealt out to.
SHARES = 32
#: Windows of a segment are counted in eight bits, so a gram is never more than so many symbols shorter than a window.
MOST_WINDOWS = 255
#: In place of an equal segment: what was decided on a content, that its other places go or not.
AGAIN, NOTHING = -1, -2
KEY = ["did", "chk"]


@dataclass(frozen=True)
class Units:
    """The symbols of a batch and where they stand in its text; `begin` and `end` are None where symbols are bytes."""

    symbols: np.ndarray
    first: np.ndarray
    text: bytes
    begin: np.ndarray | None = None
    end: np.ndarray | None = None

    def cut(self, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """The text of symbols start to stop, for each of a number of stretches."""
        if self.begin is not None:
            start, stop = self.begin[start], self.end[stop - 1]
        text = self.text
        return [text[s:e] for s, e in zip(start.tolist(), stop.tolist())]


@dataclass(frozen=True)
class Grams:
    """A set of grams, each with its place in order."""

    grams: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray) -> Grams:
        low = np.zeros(1 << 20, bool)
        low[(grams & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return cls(np.sort(grams), low)

    def place(self, grams: np.ndarray) -> np.ndarray:
        """Place of each gram in the set, or -1."""
        out = np.full(len(grams), -1, np.int64)
        if len(self.grams):
            maybe = np.flatnonzero(self.low[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
            out[maybe] = np.where(self.grams[k] == grams[maybe], k, -1)
        return out


@dataclass(frozen=True)
class Frequent:
    """Grams that come last in order, those that anchor very many segments even so, and in how many blocks the segments of each are compared."""

    last: Grams
    hot: Grams
    blocks: np.ndarray


@dataclass(frozen=True)
class Method:
    """What an operator adds: how texts become symbols and grams, and how segments with a common anchor are compared."""

    window: int
    gram: int
    #: units(buf, off) -> Units of a batch of texts.
    units: Callable
    #: grams(symbols, gram) -> hashes of each `gram` neighbours.
    grams: Callable
    #: compare(table of nn, did, chk, start, n, times, data) -> (row, starts, ends, again): intervals to remove, counted
    #: from the segment's start, and for each row whether the other places of its content go as well.
    compare: Callable
    #: Bytes of segments that are compared at a time.
    most: int = 4 << 20


def segments(units: Units, method: Method, frequent: Frequent | None = None):
    """(document, first window, windows, anchor hash, content hash, repeats) of all segments of a batch.

    First windows count from the document's start. Where a text repeats itself with a short
    period, its segments are equal and follow each other; they are one row with their number.
    """
    window, gram, first, symbols = method.window, method.gram, units.first, units.symbols
    found = []
    for at in range(0, max(len(symbols) - window + 1, 0), BLOCK):
        part = symbols[at : at + BLOCK + window - 1]
        grams = method.grams(part, gram)
        n_windows, n_grams = len(part) - window + 1, len(grams)
        order = grams >> np.uint64(1)
        if frequent is not None:
            order[frequent.last.place(grams) >= 0] |= np.uint64(1 << 63)
        place = (sliding_min((order & ~_POS) | np.arange(n_grams, dtype=np.uint64), window - gram + 1) & _POS).astype(np.int64)
        d0, d1 = max(int(np.searchsorted(first, at, "right")) - 1, 0), int(np.searchsorted(first, at + n_windows, "left"))
        lo = np.clip(first[d0:d1] - at, 0, n_windows)
        hi = np.clip(first[d0 + 1 : d1 + 1] - window + 1 - at, 0, n_windows)
        count = np.maximum(hi - lo, 0)
        own = ragged(lo, count)
        if not len(own):
            continue
        doc = np.repeat(np.arange(d0, d0 + len(lo)), count)
        anchor = place[own]
        new = np.ones(len(own), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1] + 1)
        head = np.flatnonzero(new)
        start, n = own[head], np.diff(np.append(head, len(own)))
        digest = hashlib.blake2b
        texts = units.cut(start + at, start + at + n - 1 + window)
        h = np.frombuffer(b"".join([digest(x, digest_size=8).digest() for x in texts]), np.int64)
        d = doc[head]
        fresh = np.ones(len(head), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (n[1:] != n[:-1]) | (h[1:] != h[:-1])
        lead = np.flatnonzero(fresh)  # at most BLOCK windows are one row
        found.append((d[lead], start[lead] + at - first[d[lead]], n[lead], grams[anchor[head]][lead], h[lead], np.diff(np.append(lead, len(head)))))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """nn, did, chk, text and the columns of `keep` under their places' names.

    A document's key is its id, with 64 bits of its text's hash if any id stands twice, or 128 bits of that
    hash where the id is null; so rows that repeat an id are documents of their own, and so are
    those without one. nn is 0 without an id and 1 with one: null ids stand before all others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.col(id_col).cast("long")
    did = F.coalesce(own, F.xxhash64(F.lit("a document without id"), text))
    unique = docs.select(own.alias("did")).where("did IS NOT NULL").groupBy("did").count().where("count > 1").isEmpty()
    chk = F.when(own.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long")) if unique else F.xxhash64(text)
    return docs.select(own.isNotNull().cast("int").alias("nn"), did.alias("did"), chk.alias("chk"), text.alias("text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])


def public_id(nn: str = "nn", did: str = "did"):
    return F.when(F.col(nn) == 1, F.col(did))


def _occurrences(rows: DataFrame, method: Method, frequent) -> DataFrame:
    """(g, share, h, did, chk, at, reps): `at` holds nn, the first window in 36 bits and the windows in 8; share is 0 but for hot grams."""

    def run(batches):
        known = frequent.value if frequent else None
        for b in slices(batches, "text"):
            doc, start, n, g, h, reps = segments(method.units(*flat(b.column("text"))), method, known)
            nn, did, chk = (b.column(c).to_numpy(zero_copy_only=False) for c in ("nn", "did", "chk"))
            at = (nn[doc].astype(np.int64) << 44) | (start << 8) | n
            share = np.zeros(len(g), np.int64)
            if known is not None:
                k = np.flatnonzero(known.hot.place(g) >= 0)
                share[k] = 1 + (mix((did[doc[k]] ^ chk[doc[k]]).astype(np.uint64)) % np.uint64(SHARES)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(share.astype(np.int32)), pa.array(h), pa.array(did[doc]), pa.array(chk[doc]), pa.array(at), pa.array(reps.astype(np.int32))], ["g", "share", "h", "did", "chk", "at", "reps"])

    return rows.select("nn", "did", "chk", "text").mapInArrow(run, "g long, share int, h long, did long, chk long, at long, reps int")


def frequent_grams(rows: DataFrame, method: Method) -> Frequent:
    """What a sample of documents shows about anchors, in two passes over it: at most MOST_FREQUENT numbers each.

    Anchors that are frequent at first come last from then on; those that are frequent in that order are hot.
    """
    spark = rows.sparkSession
    sample = rows.where(F.pmod(F.xxhash64("did", "chk"), F.lit(SAMPLE)) == 0)
    size = F.col("at").bitwiseAND(255) + method.window - 1

    def often(known) -> tuple[np.ndarray, np.ndarray]:
        contents = _occurrences(sample, method, known).groupBy("g", "h").agg(F.count("*").alias("n"), F.max(size).alias("size"))
        # a content that is frequent itself has a representative a share, others stand for as many as the sample leaves out
        bytes_ = F.when(F.col("n") < FREQUENT, F.col("size") * F.col("n") * SAMPLE).otherwise(F.col("size") * SHARES)
        got = contents.groupBy("g").agg(F.sum("n").alias("n"), F.sum(bytes_).alias("size")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "g").limit(MOST_FREQUENT).toPandas().sort_values("g")
        grams = got["g"].to_numpy(np.int64).view(np.uint64)
        o = np.argsort(grams)
        return grams[o], np.ceil(got["size"].to_numpy(float)[o] / method.most).astype(np.int64).clip(1)

    none = np.zeros(0, np.uint64)
    first = often(None)[0]
    if not len(first):
        return Frequent(Grams.of(none), Grams.of(none), none.astype(np.int64))
    hot, blocks = often(spark.sparkContext.broadcast(Frequent(Grams.of(first), Grams.of(none), none.astype(np.int64))))
    return Frequent(Grams.of(first), Grams.of(hot), blocks)


def _row_bytes(t: pa.Table) -> np.ndarray:
    out = np.full(t.num_rows, 8 * t.num_columns, np.int64)
    for c in t.columns:
        if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_string(c.type):
            out += pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64)
    return out


def _pieces(t: pa.Table, key: str, most: int) -> Iterator[pa.Table]:
    """Slices at group boundaries, of about `most` bytes or one group."""
    k, upto = t.column(key).to_numpy(), np.cumsum(_row_bytes(t))
    ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
    at = 0
    while at < len(k):
        fit = int(np.searchsorted(upto[ends - 1], (upto[at - 1] if at else 0) + most, "right")) - 1
        end = int(max(ends[fit] if fit >= 0 else 0, ends[np.searchsorted(ends, at, "right")]))
        yield t.slice(at, end - at)
        at = end


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Rows that arrive sorted by key, in tables of whole groups: about `most` bytes, or one group of more.

    A group here is at most two blocks of what is compared; see `find`.
    """
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        k = t.column(key).to_numpy()
        last = int(np.searchsorted(k, k[-1], "left"))  # the last group may go on
        if last:
            yield from _pieces(t.slice(0, last), key, most)
        held = t.slice(last).combine_chunks()
    if held is not None:
        yield from _pieces(held, key, most)


def find(rows: DataFrame, method: Method) -> DataFrame:
    """(did, chk, spans, carried): for documents with something to remove, its intervals of symbols.

    `spans` are lists of packed int64 pairs from comparisons, `carried` starts and lengths of equal segments. `rows`
    are keyed(); they are shuffled by key here, and a caller that joins them with the result by
    key reads the same exchange.
    """
    window = method.window
    known = frequent_grams(rows, method)
    frequent = rows.sparkSession.sparkContext.broadcast(known) if len(known.last.grams) else None
    here, same = W.partitionBy("g", "share"), W.partitionBy("g", "share", "h")
    by = same.orderBy(F.shiftright("at", 44), "did", "chk", "at")
    seen = _occurrences(rows, method, frequent).repartition("g", "share").withColumn("c", F.sum("reps").over(here)).where("c > 1 OR share > 0")
    seen = seen.withColumns({"place": F.row_number().over(by), "times": F.sum("reps").over(same)})
    start, n = F.shiftright("at", 8).bitwiseAND((1 << 36) - 1), F.col("at").bitwiseAND(255)
    content = F.xxhash64("g", "h", "share")
    # the first of each content is compared; the others, and repeats in a row, follow what is decided on it
    size = F.sum(F.when(F.col("place") == 1, n + (window - 1 + 64))).over(here)
    lead = seen.withColumn("blocks", F.when(F.col("share") == 0, F.ceil(size / F.lit(method.most))).otherwise(F.lit(0)).cast("int")).where("place = 1")
    lists = lead.groupBy("did", "chk").agg(F.collect_list(F.struct("g", content.alias("content"), start.alias("start"), n.alias("n"), F.least("times", F.lit(2)).cast("int").alias("times"), "share", "blocks")).alias("own"))
    wanted = rows.select("nn", "did", "chk", "text", *[c for c in rows.columns if c.startswith("_keep_")]).join(lists, KEY)
    names = ["key", "content", "nn", "did", "chk", "start", "n", "times", "data"]
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", data binary"

    def fetch(batches):
        for b in slices(batches, "text"):
            units = method.units(*flat(b.column("text")))
            own = b.column("own")
            item, count = own.flatten(), np.diff(own.offsets.to_numpy())
            g, content, start, n, times, share, cuts = (item.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7))
            row = np.repeat(np.arange(b.num_rows), count)
            nn, did, chk = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[row] for c in ("nn", "did", "chk"))
            place = units.first[row] + start
            if frequent is not None:
                k = np.flatnonzero(share)
                cuts[k] = frequent.value.blocks[frequent.value.hot.place(g[k].view(np.uint64))]
            data = pa.array(units.cut(place, place + n + window - 1), pa.binary())
            # a segment of an anchor in several blocks goes to every pair of blocks that holds its own
            own_block = (mix((did ^ chk ^ start).astype(np.uint64)) % np.maximum(cuts, 1).astype(np.uint64)).astype(np.int64)
            each = np.repeat(np.arange(len(g)), cuts)
            other = ragged(np.zeros(len(g), np.int64), cuts)
            low, high = np.minimum(own_block[each], other), np.maximum(own_block[each], other)
            key = np.where(cuts[each] == 1, g[each], mix(g[each].view(np.uint64) ^ mix((low << 32 | high).astype(np.uint64))).view(np.int64))
            for k in range(0, len(each), 4096):
                at = each[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 4096]), *[pa.array(c[at]) for c in (content, nn, did, chk, start, n, times)], data.take(pa.array(at))], names)

    fetched = wanted.mapInArrow(fetch, schema)

    def compare(batches):
        out = ["content", "did", "chk", "span", "data"]
        for t in whole_groups(batches, "key", method.most):
            t = t.combine_chunks()
            row, s, e, again = method.compare(t)
            start = t.column("start").to_numpy()
            pairs = np.stack([start[row] + s, start[row] + e], 1).astype("<i8")
            told = np.flatnonzero(np.bincount(row, minlength=t.num_rows).astype(bool) | again)
            cuts = np.searchsorted(row, told), np.searchsorted(row, told, "right")
            data = [pairs[a:z].tobytes() if z > a else None for a, z in zip(*(c.tolist() for c in cuts))]
            if len(told):
                yield pa.RecordBatch.from_arrays([*[pa.array(t.column(c).to_numpy()[told]) for c in out[:3]], pa.array(np.where(again[told], AGAIN, NOTHING)), pa.array(data, pa.binary())], out)

    compared = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "content long, did long, chk long, span long, data binary")
    # where an equal segment lies: its start above the lower 28 bits, which hold its length
    begin = F.when(F.col("place") > 1, start).otherwise(start + n)
    others = seen.where("place > 1 OR reps > 1").select(content.alias("content"), "did", "chk", (F.shiftleft(begin, 28) + (start + n * F.col("reps") + (window - 1)) - begin).alias("span"), F.lit(None).cast("binary").alias("data"))
    both = compared.unionByName(others).withColumn("gone", F.max(F.col("span") == AGAIN).over(W.partitionBy("content")))
    decided = both.where("data IS NOT NULL OR (span >= 0 AND gone)").withColumn("span", F.when(F.col("span") >= 0, F.col("span")))
    return decided.groupBy("did", "chk").agg(F.collect_list("data").alias("spans"), F.collect_list("span").alias("carried"))


def intervals(spans: list[bytes] | None, carried: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Union of a document's lists of intervals."""
    raw = np.frombuffer(b"".join(spans or ()), "<i8").reshape(-1, 2)
    more = np.array(carried or (), np.int64)
    start = more >> 28
    return union(np.append(raw[:, 0], start), np.append(raw[:, 1], start + (more & ((1 << 28) - 1))))
