"""Web archives packaged as ZIP: a writer, and a reader that works by position.

An archive is a ZIP file of stored members: `archive/data.warc.gz`, whose records are
gzip members of their own, and `indexes/index.cdx`, one line a record. The reader finds
the end of the central directory (ZIP64 where its fields overflow), walks the directory,
locates the stored members in the file, reads the index, and then fetches each record by
its range; nothing is extracted.

Archives are built by Spark tasks under names that no other attempt uses, in the shared
folder; only files named by a finished task's manifest row are read, so lost executors
and repeated attempts leave at most unused files.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from ._text import materialised, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


# --- reading ------------------------------------------------------------------------------


def members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Name -> (place of its data, stored size, CRC) of a ZIP file's stored members.

    Compressed members are left out, as ranges of them mean nothing. A file without a
    directory, or one that points outside the file, is a ValueError.
    """

    def at(place: int, n: int) -> bytes:
        if place < 0 or place + n > size:
            raise ValueError("ZIP directory points outside the file")
        f.seek(place)
        return f.read(n)

    tail_at = max(0, size - 22 - _FULL16)
    tail = at(tail_at, size - tail_at)
    k = tail.rfind(struct.pack("<I", _EOCD))
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(struct.pack("<I", _EOCD), 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if count == _FULL16 or length == _FULL32 or start == _FULL32:
        sign, _, place, _ = struct.unpack("<IIQI", at(tail_at + k - 20, 20))
        if sign != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        head = at(place, 56)
        if struct.unpack_from("<I", head)[0] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", head, 32)
    directory, out, p = at(start, length), {}, 0
    for _ in range(count):
        if p + 46 > length or struct.unpack_from("<I", directory, p)[0] != _CENTRAL:
            raise ValueError("broken central directory")
        method, crc, packed, plain, n_name, n_extra, n_note = struct.unpack_from("<10xH4xIIIHHH", directory, p)
        place = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # ZIP64: those of the three that overflowed, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain = next(wide) if plain == _FULL32 else plain
                packed = next(wide) if packed == _FULL32 else packed
                place = next(wide) if place == _FULL32 else place
            q += 4 + n
        if method == 0:
            sign, n1, n2 = struct.unpack("<I22xHH", at(place, 30))
            if sign != _LOCAL:
                raise ValueError("no local header where the directory says")
            out[name] = (place + 30 + n1 + n2, packed, crc)
        p += 46 + n_name + n_extra + n_note
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip-compressed WARC record."""
    plain = gzip.decompress(raw)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, each fetched by the range that the index gives."""
    store, name = open_path(path)
    with store.open_input_file(name) as f:
        found = members(f, f.size())
        (data, data_size, _), (index, index_size, _) = found[DATA], found[INDEX]
        f.seek(index)
        for line in f.read(index_size).decode("utf-8").splitlines():
            where = json.loads(line.split(" ", 2)[2])
            start, n = int(where["offset"]), int(where["length"])
            if start + n > data_size:
                raise ValueError("index points outside its member")
            f.seek(data + start)
            yield parse_record(f.read(n))


def read_archives(manifest: DataFrame, path_col: str = "path") -> DataFrame:
    """One row a record of all archives named by the manifest: ids, type, digests and lengths.

    A response's payload digest is computed from what was read and compared with the header;
    a revisit's digest and length are those its headers state, see archive_and_read. A null path gives no rows.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, digest_ok boolean"
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok"]

    def number(urn: str | None) -> int | None:
        x = (urn or "").strip("<>").rsplit(":", 1)[-1]
        return int(x) if x.lstrip("-").isdigit() else None

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for fields, block in records(path) if path else ():
                    head, _, payload = block.partition(b"\r\n\r\n")
                    stated = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)}
                    want = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    got = want if revisit else hashlib.sha1(payload).hexdigest()
                    size = int(stated["content-length"]) if revisit else len(payload)
                    rows.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), size, got, got == want))
                    if len(rows) >= 5000:
                        yield _rows(rows, names)
                        rows = []
                if rows:
                    yield _rows(rows, names)

    def _rows(rows, names):
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select(path_col).mapInArrow(run, schema)


# --- writing ------------------------------------------------------------------------------


class ZipWriter:
    """Appends stored members to a stream; sizes follow the data, so nothing is kept in memory.

    Members are written with ZIP64 fields where `wide` is set or a size needs them.
    """

    def __init__(self, out, wide: bool = False):
        self.out, self.at, self.entries, self.wide = out, 0, [], wide

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # bit 3: sizes stand behind the data; bit 11: UTF-8 name
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(self.name), 0) + self.name)

    def write(self, raw: bytes) -> None:
        self.crc = zlib.crc32(raw, self.crc)
        self.size += len(raw)
        self._put(raw)

    def end(self) -> None:
        wide = self.wide or self.size >= _FULL32
        self._put(struct.pack("<II" + ("QQ" if wide else "II"), 0x08074B50, self.crc, self.size, self.size))
        self.entries.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        start = self.at
        for name, crc, size, place in self.entries:
            big, far = self.wide or size >= _FULL32, self.wide or place >= _FULL32
            extra = (struct.pack("<QQ", size, size) if big else b"") + (struct.pack("<Q", place) if far else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            s, p = (_FULL32 if big else size), (_FULL32 if far else place)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, s, s, len(name), len(extra), 0, 0, 0, 0, p) + name + extra)
        n, length = len(self.entries), self.at - start
        if self.wide or start >= _FULL32 or length >= _FULL32 or n >= _FULL16:
            head = self.at
            self._put(struct.pack("<IQHHIIQQQQ", _EOCD64, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<IIQI", _LOCATOR, 0, head, 1))
            n, length, start = _FULL16, _FULL32, _FULL32
        self._put(struct.pack("<IHHHHIIH", _EOCD, 0, 0, n, n, length, start, 0))


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _record(page: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers: int | None, level: int) -> bytes:
    """A response, or where payload is None a revisit, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL)}")
    if payload is None:
        head += [f"WARC-Refers-To: {_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, level, mtime=0)


#: At most so many revisits (some 70 bytes each) are broadcast to the pages; beyond it pages are shuffled by id.
BROADCAST_REVISITS = 300_000
_URL = ":/?#[]@!$&'()*+,;=%~"


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, roll_bytes: int = 64 << 20, level: int = 1, wide: bool = False) -> DataFrame:
    """Writes a record for each row and returns the manifest (path, records, bytes), a table in the shared folder.

    What revisits what is decided on ids and digests alone, so that payloads meet nothing and only
    responses are written with one. Of equal payloads of at least `least` bytes the one with the
    largest id is a response and the others revisit it; rows that share that largest id are all
    responses. Null html is an empty payload, texts of any length are written whole; a null url leaves its
    field out; a null id is written as such and is never the one referred to, unless all are null.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    narrow = base.where(F.octet_length("html") >= least).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = materialised(narrow.join(groups, "digest").where("NOT page_id <=> first").select(F.col("page_id").alias("own"), F.col("digest").alias("same"), "first").distinct(), "warc-revisits")
    few = later.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    joined = base.join(F.broadcast(later) if few else later, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")), "left")
    plain = F.when(F.col("same").isNull(), F.col("html"))
    rows = joined.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("size"), "first", plain.alias("html"))

    def write(batches):
        store, top = open_path(folder)
        store.create_dir(top, recursive=True)
        out = None

        def begin():
            nonlocal out, path, index, n
            path, index, n = f"{folder}/{uuid.uuid4().hex}.wacz", [], 0
            out = store.open_output_stream(open_path(path)[1])
            z = ZipWriter(out, wide)
            z.begin(DATA)
            return z

        def finish(z):
            z.end()
            z.begin(INDEX)
            for line in index:
                z.write(line)
            z.end()
            z.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([z.at], pa.int64())], ["path", "records", "bytes"])

        path, index, n, z = "", [], 0, None
        for b in batches:
            for page, url, dig, size, first, html in (r for k in range(0, b.num_rows, 200) for r in zip(*[c.to_pylist() for c in b.slice(k, 200).columns])):
                z = z or begin()
                raw = _record(page, url, dig, size, None if html is None else html.encode(), first, level)
                index.append(f"{quote(url or '-', safe=_URL)} 19700101000000 {json.dumps({'offset': z.size, 'length': len(raw), 'id': page})}\n".encode())
                z.write(raw)
                n += 1
                if z.size >= roll_bytes:
                    yield finish(z)
                    z = None
        if z:
            yield finish(z)

    return materialised(rows.mapInArrow(write, "path string, records bigint, bytes bigint"), "warc-manifest")


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages and reads them back; archives are dealt out one by one.

    `digest_ok` of a revisit says whether the response that it refers to was read, with that digest and length.
    """
    manifest = write_archives(pages, shared_dir(pages.sparkSession, "warc"), **options)
    n = max(1, min(manifest.count(), 10_000))
    read = materialised(read_archives(manifest.repartition(n)), "warc-records")
    found = read.where("record_type = 'response' AND digest_ok").select(F.col("page_id").alias("to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).distinct()
    same = F.col("refers_to").eqNullSafe(F.col("to")) & (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("n"))
    revisits = read.where("record_type = 'revisit'").drop("digest_ok").join(found, same, "left").withColumn("digest_ok", F.col("d").isNotNull())
    return read.where("record_type <> 'revisit'").unionByName(revisits.select(*read.columns))
